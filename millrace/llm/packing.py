"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, needs_integer_id, remembered

LENGTH, END_ID = 4096, 1
#: Documents packed together, in expectation; groups are independent of one another and of partitions.
GROUP_DOCS = 50_000


def _letters(text: str) -> bool:
    """Whether the text is of letters only, also as the tokenizer normalises it: some letters become one with a mark, which parts words."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


class _WordIds:
    """White-space-delimited words (UTF-8) and their ids as little-endian 32-bit numbers.

    Exact for a tokenizer that lower-cases, drops white space and never joins what it separates,
    and that parts letters from the punctuation behind them. The words that are not known yet are
    encoded in one string: words of letters are parted by their last ids, others by a mark. Where
    these ends are not as many as the words, the words are encoded one by one.
    What was not met since the last but one time that `bound` words had come together is forgotten.
    """

    TAIL, MARK, SPECIAL = b".,;:!?|#$%&*()", "\0", b"<|"

    def __init__(self, file: str, bound: int = 150_000):
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.tokenizer, self.bound = Tokenizer.from_file(file), bound
        self.mark = self._encode(self.MARK)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _marked(text: bytes) -> bool:
        """Whether there are characters from U+0300 to U+037F, by their first byte: all marks that A-Z compose with are among them."""
        return b"\xcc" in text or b"\xcd" in text

    def _core(self, word: bytes) -> bytes:
        """The word without punctuation behind its last letter; itself if it doesn't end so."""
        core = word.rstrip(self.TAIL)
        if not core or core == word:
            return word
        last = core[-1]
        return core if 97 <= last <= 122 or last >= 128 and _letters(core.decode("utf-8")[-1]) else word

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        if self.before:
            met = words & self.before.keys()
            known.update(zip(met, map(self.before.__getitem__, met), strict=True))
            words -= met
        cores = {w: c for w in words if (c := self._core(w)) != w}
        need = [w for w in {*(words - cores.keys()), *cores.values(), *(w[len(c) :] for w, c in cores.items())} if w not in known]
        text = {w: w.decode("utf-8") for w in need}
        letters = [w for w in need if _letters(text[w])]  # one unit each, so that their last ids part them
        plain = set(letters)
        others = [w for w in need if w not in plain and b"\0" not in w and self.SPECIAL not in w] if len(self.mark) == 1 else []
        for own, mark, kind in ((letters, " ", self.last), (others, f" {self.MARK} ", None)):
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                ids = np.array(self._encode(mark.join(map(text.__getitem__, part))), "<u4")
                ends = (np.flatnonzero(kind[ids]) + 1).tolist() if kind is not None else [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
                if len(ends) != len(part):
                    continue  # left to the loop below
                data, start = ids.tobytes(), 0
                for w, end in zip(part, ends, strict=True):
                    known[w] = data[4 * start : 4 * end]
                    start = end + (kind is None)
        for w in need:
            if w not in known:
                known[w] = np.array(self._encode(text[w]), "<u4").tobytes()
        for w, core in cores.items():
            known[w] = known[core] + known[w[len(core) :]]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        split = []
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            if self.SPECIAL in data:
                split.append(data.split())
            elif not self._marked(data):
                split.append(data.lower().split())
            else:  # a letter and its mark are composed before they are lower-cased, which is left to the tokenizer
                split.append([w if self._marked(w) else w.lower() for w in data.split()])
        self._learn(set().union(*split) - self.known.keys())
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        if len(self.known) > self.bound:
            self.known, self.before = {}, self.known
        return out


@lru_cache(2)
def _word_ids(file: str) -> _WordIds:
    return _WordIds(file)


remembered("ids", _word_ids.cache_clear)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, file: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32): ids and an end id, cut only where longer than `length`.

    A null or empty text has the end id alone. Each executor finds the tokenizer file itself
    when `file` is None. doc_id must be an integer, and comes as a long.
    """
    needs_integer_id(docs)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("ids")
        words = _word_ids(file or tokenizer_file())
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            doc, piece, start, size, crc = [], [], [], [], []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), words.ids(b.column("text").to_pylist()), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    doc.append(doc_id)
                    piece.append(n)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.

    Each item goes where the sum over gaps of (open bins with that gap) squared becomes
    least: a new bin, or an open bin with some gap. Ties: the smallest gap, an open bin before
    a new one. Items come in order of decreasing size, so that the small ones, placed
    last, close the gaps that are left.
    """
    order = np.argsort(-sizes, kind="stable")
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap; a full or an empty bin has none
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    which, offset, bins = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    far = np.int64(1) << 60
    for item in order.tolist():
        size = int(sizes[item])
        if size >= capacity:
            which[item], bins = bins, bins + 1
            continue
        own = counts[size:capacity]
        change = 2 * (counts[: capacity - size] - own)
        change += 2
        change[0] -= 1
        change[own == 0] = far
        best = int(change.argmin())
        if change[best] <= 2 * counts[capacity - size] + 1:
            gap = size + best
            bin_ = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, bin_ = capacity, bins
            bins += 1
        which[item], offset[item] = bin_, capacity - gap
        if gap > size:
            stacks[gap - size].append(bin_)
            counts[gap - size] += 1
    return which, offset, bins


def pack(docs: DataFrame, file: str | None = None, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place.

    Pieces are dealt by a hash of what they are and where they come from into groups of about `group_docs` documents,
    each packed on its own; only lengths and ids move, never text. Sequence ids are unique
    but not dense. Null texts, empty texts and repeated rows are documents of their own, a null
    doc_id stays null; an empty table gives an empty one.
    """
    groups = max(1, round(docs.count() / group_docs))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        which, offset, _ = sum_of_squares(t.column("length").to_numpy(), length)
        return pa.table([*(t.column(c) for c in schema.names[:5]), pa.array(which + (key[0].as_py() << 32)), pa.array(offset)], schema=schema)

    return (
        pieces(docs, file, length, end_id)
        .withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )

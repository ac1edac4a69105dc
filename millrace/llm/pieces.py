"""SentencePiece encoding and decoding by a unigram Viterbi search over an Aho-Corasick automaton of the pieces.

The automaton reports, at each position, all pieces that end there (the longest first, along
its output links); each relaxes the best score of its end from that of its start. A
character that is no piece itself can stand alone as unknown, at a penalty, and is written as
byte pieces where the vocabulary has them. Scores and pieces come from the model file; a
file trained for another search (merges) lends its vocabulary, not that search. Unused pieces are
not searched; user-defined ones score as many times the best score (0 at least, as the library has it) as they
have bytes, less 0.1.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE, UNKNOWN_PENALTY = "▁", 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces of a model file and the automaton over them."""

    def __init__(self, file: str, memory: int = 300_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix = self.squeeze = True
        for field, value in _fields(open(file, "rb").read()):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("character maps of a normaliser are not supported")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        usable = [i for i, kind in enumerate(self.kinds) if kind in (NORMAL, USER)]
        best = max([0.0, *(self.scores[i] for i in usable if self.kinds[i] == NORMAL)])
        self.unknown = self.kinds.index(UNKNOWN)
        self.penalty = min((self.scores[i] for i in usable if self.kinds[i] == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.single = {self.pieces[i] for i in usable if len(self.pieces[i]) == 1}
        self.byte = {int(self.pieces[i][3:5], 16): i for i, kind in enumerate(self.kinds) if kind == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            gain = self.scores[i] if self.kinds[i] == NORMAL else len(self.pieces[i].encode()) * best - 0.1
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), gain))
        self.automaton.make_automaton()
        #: If no piece goes on behind a space mark that follows something else, a best path of the text is one of each word.
        self.by_word = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        self.memory, self.known = memory, {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.dummy_prefix:
            text = f" {text}"
        return text.replace(" ", SPACE)

    def viterbi(self, chunk: str) -> tuple[list[int], float]:
        """Ids of the best path through a string, and its score. Ties: the earlier start, that is the longer piece."""
        n, cur = len(chunk), 0
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        single, penalty = self.single, self.penalty

        def alone(p: int) -> None:
            if chunk[p] not in single:
                score = best[p] + penalty
                if best[p + 1] is None or score > best[p + 1]:
                    best[p + 1], back[p + 1] = score, (p, -1)

        for end, (id_, size, gain) in self.automaton.iter(chunk):
            while cur < end:
                alone(cur)
                cur += 1
            start = end + 1 - size
            score = best[start] + gain
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (start, id_)
        while cur < n:
            alone(cur)
            cur += 1
        ids: list[int] = []
        while n:
            start, id_ = back[n]
            if id_ >= 0:
                ids.append(id_)
            elif self.byte:
                ids += [self.byte[x] for x in reversed(chunk[start:n].encode("utf-8", "replace"))]
            elif not (ids and ids[-1] == self.unknown):
                ids.append(self.unknown)
            n = start
        return ids[::-1], best[-1]

    def encode(self, text: str | None) -> tuple[bytes, float]:
        """Ids of a whole text as little-endian 32-bit numbers, and the score of its best path; nothing and 0 for null or empty."""
        text = self.normalise(text or "")
        if not self.by_word:
            ids, score = self.viterbi(text) if text else ([], 0.0)
            return np.array(ids, "<u4").tobytes(), score
        known, out, total = self.known, [], 0.0
        if len(known) > self.memory:
            known.clear()
        for chunk in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text):
            found = known.get(chunk)
            if found is None:
                ids, score = self.viterbi(chunk)
                found = np.array(ids, "<u4").tobytes(), score
                if len(chunk) <= 64:
                    known[chunk] = found
            out.append(found[0])
            total += found[1]
        return b"".join(out), total

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding puts before it is taken off. Bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def vocabulary(file: str | None = None) -> Vocabulary:
    return Vocabulary(file or model_file())


def encode(docs: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, ids array<int>, score), a row per row; no ids and score 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file)
        for b in batches:
            got = [v.encode(t) for t in b.column("text").to_pylist()]
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array([s for _, s in got], pa.float64())], names=["doc_id", "ids", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, score double")


def decode(encoded: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, ids, ...) -> (doc_id, text), a row per row; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file)
        for b in batches:
            text = [v.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_ids, ids_crc32, score, same), a row per row: whole texts encoded, and decoded again.

    ids_crc32 is of the ids as little-endian 32-bit numbers; same tells whether the decoded
    text is the text (it can't be where the text has the space mark itself). Null counts as
    empty, with no ids, score 0 and same true.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                ids, score = v.encode(text)
                out.append((len(ids) // 4, zlib.crc32(ids), score, v.decode(ids) == (text or "")))
            cols = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols, kinds)], names=["doc_id", "n_ids", "ids_crc32", "score", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, score double, same boolean")

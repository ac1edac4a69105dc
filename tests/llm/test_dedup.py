"""SimHash, components, MinHash fingerprints and line dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from millrace.llm import linededup, minhash, packing, simhash
from millrace.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOC)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, links):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_fingerprint_is_the_majority_of_shingle_hashes():
    rng = random.Random(1)
    for text in ("", None, " \n", "one", "Two Words", "ÀB c D E f", " ".join(words(rng, 300)), "a\x1cb c d"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


GAPS = ["a b c d e f g" + " " * 700, " " * 300 + "one", "x" * 900 + " b " + "y" * 900, "a b c" + "\n" * 400 + "d e f" + " \t" * 300 + "g", "q" * 3000, " " * 999, ("long" * 90 + " ") * 7, "a " * 300 + "\x0b" * 500 + "b"]


@pytest.mark.parametrize("size", [1, 7, 64, 100, 513])
def test_long_texts_are_read_in_chunks(monkeypatch, size):
    texts = [" ".join(words(random.Random(2), 3000)), *GAPS]
    read = lambda t: (simhash.fingerprint(t), minhash.pack(minhash.sketch(t)), minhash.pack(minhash.sketch(t, 2, 64, 8), 8))
    whole = [read(t) for t in texts]
    assert [x[0] for x in whole] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr("millrace.llm.common.CHUNK_BYTES", size)
    assert [read(t) for t in texts] == whole


def plain_mix(x):
    m = 2**64 - 1
    x = x + 0x9E3779B97F4A7C15 & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain_sketch(text, k, bins, bits):
    """One hash a shingle, the least of each bin; an empty bin walks its own order of bins up to a full one."""
    w = (text or "").encode().lower().split()
    if not w:
        return ""
    m, size = 2**64 - 1, min(k, len(w))
    least = {}
    for i in range(len(w) - size + 1):
        total = size
        for j in range(size):
            total += plain_mix(xxhash.xxh64_intdigest(w[i + j]) * int(minhash.FACTORS[j]) + j & m)
        h = plain_mix(total & m)
        least.setdefault(h * bins >> 64, []).append(h)
    least = {b: min(hs) for b, hs in least.items()}
    out = ""
    for b in range(bins):
        order = sorted(range(bins), key=lambda c: plain_mix(b * bins + c + 2**40))
        value = least[b] if b in least else least[next(c for c in order if c in least)]
        out += f"{(plain_mix(value ^ plain_mix(b + 2**50)) & 2**bits - 1):0{bits}b}"
    return f"{int(out, 2):0{len(out) // 4}x}"


def test_minhash_equals_a_plain_one():
    rng = random.Random(9)
    for n in (0, 1, 2, 4, 5, 9, 30, 200, 900):
        text = " ".join(words(rng, n, 5000))
        for k, bins, bits in ((5, 64, 4), (2, 16, 8), (5, 512, 4)):
            assert minhash.pack(minhash.sketch(text, k, bins, bits), bits) == plain_sketch(text, k, bins, bits)


def test_ids_that_are_no_integers_are_refused(spark):
    docs = spark.createDataFrame([("x", "some text")], "doc_id string, text string")
    for f in (minhash.edited_likeness, linededup.dedup_lines, packing.pack):
        with pytest.raises(TypeError):
            f(docs)
    assert simhash.near_duplicates(docs).first()["component_id"] == "x"


def test_golay_table_covers_the_space():
    patterns, sizes = simhash.golay()
    assert sorted(set(sizes.tolist())) == [1, 6]
    assert (sizes == 6).sum() == 1771
    for s, e in enumerate(patterns[:, 0].tolist()):
        assert simhash.syndrome(np.array([e]))[0] == s and bin(e).count("1") <= 3


@pytest.mark.parametrize("bits", range(1, 5))
def test_keys_find_every_pair_within_four_bits(bits):
    rng = random.Random(bits)
    a = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    b = np.array([int(x) ^ sum(1 << i for i in rng.sample(range(64), bits)) for x in a], np.uint64)
    fps = np.concatenate([a, b])
    key, row = simhash.keys(fps)
    x, y = simhash.match(key, fps[row])
    links = {frozenset(p) for p in zip(x.tolist(), y.tolist())}
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} <= links


def test_large_groups_of_one_key_are_connected():
    base = random.Random(3).getrandbits(64)
    fps = np.array(sorted({base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)}), np.uint64)
    key, row = simhash.keys(fps)
    x, y = simhash.match(key, fps[row])
    assert len(x) == len(fps) - 1


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components(sorted(set(itertools.chain(*links))), links)
    assert got == {i: r for i, r in want.items() if i != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, "  \n", "Same Text", "same text", "short"]
    for _ in range(25):
        base = words(rng, rng.choice([5, 30, 200]))
        texts.append(" ".join(base))
        for _ in range(3):
            edited = list(base)
            edited[rng.randrange(len(base))] = "edit"
            texts.append(" ".join(edited))
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(list(fps), [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4])
    assert {i: (f % 2**64, c) for i, (f, c) in got.items()} == {i: (fps[i], want[i]) for i in fps}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, texts)).collect()}
    assert kept == set(want.values())


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    got = simhash.near_duplicates(frame(spark, ["a b", "a b", "c d e f g"], [None, None, 3])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, -1), (3, 3)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    clash = frame(spark, ["x y z w", "x y z w"]).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS root", "4 AS node")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(clash).collect()} == {(0, 0), (1, 0)}
    assert simhash.drop_near_duplicates(clash).columns == clash.columns
    shared = simhash.drop_near_duplicates(frame(spark, ["x y z w", "x y z  w", "other words stay here"], [1, 5, 5]))
    assert sorted((r["doc_id"], r["text"]) for r in shared.collect()) == [(1, "x y z w"), (5, "other words stay here")]


def jaccard(a, b):
    def parts(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = parts(a), parts(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_edited_likeness_estimates_jaccard(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.choice([0, 1, 3, 6, 40, 300]), 5000)) for _ in range(60)] + [None, "x" * 50]
    ids = rng.sample(range(-1000, 1000), len(texts))
    got = {r["doc_id"]: r for r in minhash.edited_likeness(frame(spark, texts, ids)).collect()}
    order = sorted(zip(ids, texts))
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == minhash.pack(minhash.sketch(text)) and r["edited_fingerprint"] == minhash.pack(minhash.sketch(edited))
        assert abs(r["near_edited"] - jaccard(text, edited)) < 0.12 and abs(r["near_next"] - jaccard(text, after)) < 0.12


def test_ranges_join_up_whatever_their_number(spark, monkeypatch):
    texts = [f"text number {i} of many" for i in range(300)]
    want = {tuple(r) for r in minhash.edited_likeness(frame(spark, texts)).collect()}
    monkeypatch.setattr(minhash, "RANGE_ROWS", 2)
    assert {tuple(r) for r in minhash.edited_likeness(frame(spark, texts).repartition(5)).collect()} == want


def test_edited_likeness_of_nulls_repeats_and_nothing(spark):
    assert minhash.edited_likeness(frame(spark, [])).count() == 0
    (r,) = minhash.edited_likeness(frame(spark, ["a b c d e f"])).collect()
    assert r["near_next"] == 1.0
    got = minhash.edited_likeness(frame(spark, ["b", "a", None, "a"], [None, 5, 5, None])).collect()
    assert len(got) == 4 and sum(r["doc_id"] is None for r in got) == 2


def test_likeness_is_unbiased_by_shared_bits():
    rng = random.Random(6)
    errors = []
    for share in (0.0, 0.5, 0.9):
        for _ in range(20):
            common, a, b = ([f"{rng.random()}" for _ in range(n)] for n in (int(600 * share), int(600 * (1 - share)), int(600 * (1 - share))))
            x, y = " ".join(common + a), " ".join(common + b)
            errors.append(minhash.likeness(minhash.sketch(x), minhash.sketch(y)) - jaccard(x, y))
    assert abs(np.mean(errors)) < 0.02


def plain_line_dedup(rows, least):
    """Deletes each line that lies in any run of at least `least` words which occurs at an earlier place; of a run that overlaps its first place what lies beyond that."""
    docs = [(i, t, [x.strip() for x in (t or "").split("\n") if x.strip()]) for i, t in rows]
    order = sorted(range(len(docs)), key=lambda n: docs[n][0])
    first, gone = {}, {}
    places = [(n, p) for n in order for p in range(len(docs[n][2]))]
    for n, p in places:
        lines = docs[n][2]
        for q in range(p + 1, len(lines) + 1):
            run = tuple(lines[p:q])
            if sum(len(x.split()) for x in run) >= least and run in first:
                there, at = first[run]
                gone.setdefault(docs[n][0], set()).update(range(max(p, at + len(run)) if there == n else p, q))
        for q in range(p + 1, len(lines) + 1):
            first.setdefault(tuple(lines[p:q]), (n, p))
    return {i: sorted(gone.get(i, ())) for i, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(linededup, "HOT", (2000, 20, 1)[seed])  # all, some or no keys are hot
    rng = random.Random(seed)
    pool = [" ".join(words(rng, rng.choice([1, 2, 3, 5, 9]))) for _ in range(12)]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.8 else f"unique {rng.random()}" for _ in range(rng.randrange(1, 25))) for _ in range(30)]
    texts += [texts[0], texts[3] + "\n\n" + texts[4], "", None, "\n \n"]
    got = {r["doc_id"]: r["removed"] for r in linededup.dedup_lines(frame(spark, texts), 10).collect()}
    assert got == plain_line_dedup(list(enumerate(texts)), 10)


def test_line_dedup_edits_texts_and_counts(spark):
    long = " ".join(f"word{i}" for i in range(60))
    tail = "short tail"
    texts = [f"first\n{long}\n{tail}\nend one", f"{long}\n{tail}", f"second\n\n {long} \n{tail}\nend two", "clean text stays"]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts).selectExpr("*", "1 AS o", "2 AS lines", "3 AS m"), drop_emptied=True).collect()}
    assert set(got) == {0, 2, 3}
    assert got[0]["text"] == texts[0] and got[2]["text"] == "second\n\nend two" and got[2]["n_chars"] == len("second\n\nend two")
    assert (got[3]["text"], got[3]["removed"], got[3]["o"]) == (texts[3], [], 1)


def test_line_dedup_keeps_columns_with_its_own_names(spark):
    line = " ".join(["x"] * 55)
    docs = frame(spark, [line, line]).selectExpr("*", "'mine' AS removed", "7 AS i", "8 AS id", "9 AS w", "1 AS r", "2 AS s", "3 AS first")
    got = linededup.dedup_lines(docs, report=None)
    assert got.columns == docs.columns and [(r["text"], r["removed"]) for r in got.orderBy("doc_id").collect()] == [(line, "mine"), ("", "mine")]


def test_line_dedup_of_nulls_repeats_and_nothing(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    line = " ".join(["x"] * 55)
    got = linededup.dedup_lines(frame(spark, [line, line, line, None], [7, 7, None, 8])).collect()
    assert sorted((r["doc_id"] or -1, "-" if r["text"] is None else r["text"]) for r in got) == [(-1, line), (7, ""), (7, ""), (8, "-")]


def test_a_run_keeps_its_first_place_where_copies_overlap_it(spark):
    line = " ".join(f"w{i}" for i in range(25))
    got = linededup.dedup_lines(frame(spark, ["\n".join([line] * 4), "\n".join([line] * 3), line])).orderBy("doc_id").collect()
    assert [r["removed"] for r in got] == [[2, 3], [0, 1, 2], []]


def test_no_column_is_lost_or_changed(spark):
    from millrace.llm import jaccard, simhash

    words_ = " ".join(f"w{i}" for i in range(80))
    extra = {c: 70 + n for n, c in enumerate(("__hash", "__id", "__text", "__order", "__gone", "___gone", "row", "f", "tf", "o", "th", "sid", "items", "lines", "first", "start"))}
    docs = frame(spark, [f"{words_}\nend", f"{words_}\nlast", "other text", None, words_])
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    for step in (linededup.dedup_lines, jaccard.drop_near_duplicates, simhash.drop_near_duplicates):
        got = step(docs)
        rows = got.collect()
        assert set(docs.columns) <= set(got.columns) and rows and all(r[c] == v for r in rows for c, v in extra.items())


@pytest.mark.parametrize("patience", [3, None])
def test_sets_of_one_template_are_linked_as_by_brute_force(spark, monkeypatch, patience):
    """All sets share their keys, and few pairs are alike: each large group has to be searched, not met at one set."""
    from millrace.llm import jaccard

    monkeypatch.setattr(jaccard, "HUBS", 30)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(90):
        own = list(base)
        for p in rng.sample(range(300), 4):
            own[p] = f"x{rng.random()}"
        texts.append(" ".join(own))
    sets = [set(jaccard.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, texts), patience=patience).collect()}
    assert [got[i] for i in range(len(texts))] == root and 1 < len(set(root)) < len(texts)


def test_small_tables_are_joined_like_large_ones(spark):
    """A side that is broadcast while it is small would hide the shuffle of texts, or of lines, that a larger input needs."""
    from millrace.llm.common import with_counted

    line = " ".join(f"v{i}" for i in range(60))
    texts = linededup.dedup_lines(frame(spark, [line, line, "other"]))
    assert [r["removed"] for r in texts.orderBy("doc_id").collect()] == [[], [0], []]
    rows, counted = spark.range(9).withColumnRenamed("id", "k"), spark.range(3).selectExpr("id AS k", "1L AS n")
    for df in (texts, with_counted(rows, counted, ["k"], 9)):
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_a_large_group_is_searched_whole_after_rounds_without_a_link(spark, monkeypatch):
    """Sets that share a key but are not alike must not end the search for two that are, nor take a round for every few of them."""
    from millrace.llm import jaccard
    from millrace.llm.common import keep

    monkeypatch.setattr(jaccard, "HUBS", 2)
    monkeypatch.setattr(jaccard, "UNIT", 40, raising=False)  # several blocks and chunks
    rng = np.random.default_rng(4)
    items = [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(299)]
    items.append(np.unique(np.r_[items[298][:-2], rng.integers(0, 2**63, 2).astype(np.uint64)]))
    large = keep(spark.createDataFrame([(7, 300, i, 50) for i in range(300)], "key long, n long, sid long, size long"), "large")
    sets = keep(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(items)], "sid long, items binary"), "items")
    roots = keep(spark.createDataFrame([], "node long, root long"), "roots")
    got = jaccard._more_roots(large, roots, sets, jaccard.LEAST, jaccard.PATIENCE)
    assert [tuple(r) for r in got.collect()] == [(299, 298)]


def test_common_items_are_counted_in_parts(monkeypatch):
    from millrace.llm import jaccard

    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(5)
    x, y = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in sizes] for sizes in ((9, 40, 0, 3), (50, 1, 30)))
    assert jaccard.common_counts(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert jaccard.common_counts([], y).shape == (0, 3) and jaccard.common_counts(x[2:3], y).tolist() == [[0, 0, 0]]

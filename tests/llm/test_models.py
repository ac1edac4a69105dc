"""Pieces, language-model scores and toxicity against brute force and held-out rows."""

import collections
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

from millrace.llm import lm, pieces, toxicity

VOCABULARY_TEXTS = ["", "a", " ", "  two  spaces ", "Hello world, it's fine.", "naïve Éa ñandú straße", "日本語 text", "\U0001f600 \u0301", "tab\tnew\nline\r\n", "x" * 500, "the the the", "▁"]


def slow_viterbi(v, text):
    """Best score over all segmentations of a normalised string."""
    score = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k in (1, 4, 5)}
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            part = text[start:end]
            if part in score:
                best[end] = max(best[end], best[start] + score[part])
            elif end - start == 1:
                best[end] = max(best[end], best[start] + v.penalty)
    return best[-1]


def test_encoding_is_the_best_path_and_round_trips():
    v = pieces.vocabulary()
    for text in VOCABULARY_TEXTS:
        ids, score = v.encode(text)
        assert score == slow_viterbi(v, v.normalise(text)) or len(text) > 400
        if "▁" not in text:
            assert v.decode(ids) == text
    whole = v.viterbi(v.normalise("one two  three"))
    assert np.frombuffer(v.encode("one two  three")[0], "<u4").tolist() == whole[0]


def test_best_paths_score_as_those_of_the_library(tmp_path):
    """The model file with its type set to unigram, read by the library, which does not always find the best path; ours is never worse."""
    import sentencepiece

    data = bytearray(open(pieces.model_file(), "rb").read())
    at = data.rindex(bytes([3 << 3, 2, 4 << 3]))  # the trainer's settings: type 2, then the vocabulary's size
    data[at + 1] = 1
    file = tmp_path / "unigram.model"
    file.write_bytes(bytes(data))
    library = sentencepiece.SentencePieceProcessor(model_file=str(file))
    v = pieces.vocabulary()
    rng = random.Random(1)
    texts = ["Hello world, it's fine.", "two  spaces here", "x" * 30] + [" ".join("".join(rng.choice("thetionaxz'.") for _ in range(rng.randrange(1, 9))) for _ in range(6)) for _ in range(200)]
    same = 0
    for text in texts:
        theirs = sum(map(library.get_score, library.nbest_encode(text, nbest_size=1)[0]))
        assert v.encode(text)[1] >= theirs, text
        same += v.encode(text)[1] == theirs
        assert sum(v.scores[i] for i in np.frombuffer(v.encode(text)[0], "<u4").tolist()) == v.encode(text)[1]
    assert same > 0.9 * len(texts)


def test_encoded_tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(VOCABULARY_TEXTS)] + [(None, None), (1, "a")], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS score")
    got = {(r["doc_id"], r["n_ids"], r["ids_crc32"], r["same"]) for r in pieces.round_trip(docs).collect()}
    v = pieces.vocabulary()
    assert got == {(i, len(v.encode(t)[0]) // 4, zlib.crc32(v.encode(t)[0]), t != "▁") for i, t in enumerate(VOCABULARY_TEXTS)} | {(None, 0, 0, True)}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs.where("doc_id IS NOT NULL"))).collect()}
    assert back == {i: t if t != "▁" else " " for i, t in enumerate(VOCABULARY_TEXTS)}
    assert pieces.round_trip(docs.where("false")).count() == 0


def made_up_model(rows):
    """A model file for a unigram search: (piece, score, kind) each; identity normaliser."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    field = lambda n, data: bytes([n << 3 | 2]) + varint(len(data)) + data
    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", x) + b"\x18" + varint(kind)) for p, x, kind in rows)
    return out + field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x01\x28\x01")


def test_unused_and_user_defined_pieces_as_the_library_takes_them(tmp_path):
    import sentencepiece

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.0, 1), ("c", -2.25, 1), ("ab", -3.0, 1), ("abc", -1.0, 5), ("bca", -90.0, 4), ("▁a", -4.0, 1)]
    file = tmp_path / "made.model"
    file.write_bytes(made_up_model(rows))
    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=str(file)), pieces.Vocabulary(str(file))
    rng = random.Random(1)
    for text in ["abc", "bca", "abca abc", *("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(200))]:
        assert np.frombuffer(ours.encode(text)[0], "<u4").tolist() == theirs.encode(text), text


def plain_model(rows):
    """Exact counts and learned weights -> probabilities of words after two others, with counts at their levels."""
    toks = [[w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t, h in zip(toks, held):
        if not h:
            one.update(t)
            two.update(zip(["\n", *t], t))
            three.update(zip(["\n", *t], t, t[1:]))
    n, v = sum(one.values()), len(one)
    bounds = sorted({1 << i for i in range(40)} | {3 << i for i in range(40)})
    level = lambda c: sum(b <= c for b in bounds)
    least = lambda c: bounds[level(c) - 1] if c else 0
    most = lambda c: bounds[level(c)] - 1

    def learned(grams, histories):
        want = 1 - sum(c == 1 for c in grams.values()) / sum(grams.values())
        by_level = collections.defaultdict(list)
        for c in histories.values():
            by_level[level(c)].append(c)
        mean = lambda k: sum(sum(cs) * (m := sum(cs) / len(cs) - 1) / (m + k) for cs in by_level.values()) / sum(histories.values())
        low, high = -20.0, 60.0
        for _ in range(80):
            low, high = ((low + high) / 2, high) if mean(2 ** ((low + high) / 2)) > want else (low, (low + high) / 2)
        return 2**low

    k2, k3 = learned(two, one), learned(three, two)

    def p1(w):
        return (one[w] + 0.1) / (n + 0.1 * (v + 1))

    def p2(w, b):
        m = max(0, one[b] - 1) / (max(0, one[b] - 1) + k2)
        return (m * least(two[b, w]) / one[b] if one[b] else 0) + (1 - m) * p1(w)

    def p3(w, a, b):
        c = two[a, b]
        m = max(0, least(c) - 1) / (max(0, least(c) - 1) + k3)
        return (m * min(least(three[a, b, w]), least(c)) / most(c) if c else 0) + (1 - m) * p2(w, b)

    return toks, held, one, n, v, p1, p2, p3


def plain_scores(rows):
    toks, held, one, n, _, p1, p2, p3 = plain_model(rows)
    out = []
    for (i, _), t, h in zip(rows, toks, held):
        full = sum(math.log10(p2(w, "\n") if j == 0 else p3(w, ["\n", *t][j - 1], t[j - 1])) for j, w in enumerate(t))
        out.append((i, h, len(t), sum(one[x] > 0 for x in t), n, sum(math.log10(p1(w)) for w in t), full))
    return out


def test_probabilities_add_up_to_one_at_most():
    toks, _, one, _, _, _, p2, p3 = plain_model(corpus(1))
    for t in toks[:40]:
        for a, b in zip(["\n", *t], t):
            assert sum(p3(w, a, b) for w in one) <= 1 + 1e-9 and sum(p2(w, b) for w in one) <= 1 + 1e-9


def corpus(seed, n=150):
    rng = random.Random(seed)
    chain = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}
    rows = []
    for i in range(n):
        w, t = rng.randrange(200), []
        for _ in range(rng.randrange(60)):
            w = rng.choice(chain[w % 200]) if rng.random() < 0.8 else rng.randrange(250)
            t.append(f"W{w}")
        rows.append((i, " ".join(t)))
    return rows + [(None, "w1 w2"), (7, None), (3, rows[3][1]), (10_000, "entirely new words é")]


READ = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def sorted_scores(df):
    return sorted((tuple(r) for r in df.select(*READ).collect()), key=lambda r: (r[0] if r[0] is not None else -1, r[2], round(r[5], 6)))


def test_scores_equal_exact_counts_but_for_the_filter(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS score", "3 AS level", "4 AS rid")
    want = sorted(plain_scores(rows), key=lambda r: (r[0] if r[0] is not None else -1, r[2], round(r[5], 6)))
    for bits in (300, lm.BITS):  # with many bits there are no false positives
        got = sorted_scores(lm.score(docs, filter_bits=bits))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want])
        near = np.array([g[6] for g in got]) - [w[6] for w in want]
        assert np.abs(near).max() < 1e-6 if bits == 300 else abs(near.mean()) < 0.5
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_texts_that_occur_twice_are_scored_apart(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(80))) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]
    got = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), "false").collect()}
    twice, once = [got[i] for i in range(40)], [got[i] for i in range(40, 300)]
    assert np.mean([a > b for a in twice for b in once]) > 0.93


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_chunks_change_no_score(spark, chunk):
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string")
    want, got = (sorted_scores(lm.score(d, filter_bits=300, chunk=c)) for d, c in ((docs, lm.CHUNK), (docs.repartition(3), chunk)))
    assert [w[:5] for w in want] == [g[:5] for g in got] and np.allclose([w[5:] for w in want], [g[5:] for g in got])


def test_scores_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs).count() == 0
    (r,) = lm.score(spark.createDataFrame([("x", "a b")], "doc_id string, text string"), "true").collect()
    assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == ("x", 3, 0, 0)


def toxic_corpus(seed, n=900):
    rng = random.Random(seed)
    clean = [f"{a}{b}" for a in ("tra", "mul", "sen", "kor", "vin") for b in ("ta", "do", "ri", "lem", "pas", "gun")]
    bad, stem, rows, labels = ["vile", "nasty"], "gruk", [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        t = [rng.choice(clean) for _ in range(rng.randrange(10, 80))]
        if toxic:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(bad) if i % 2 else stem + rng.choice(["abo", "ilu", "oma", "enk"]) + rng.choice("abcdefgh")
        rows.append((i, ". ".join(" ".join(t[j : j + 9]) for j in range(0, len(t), 9)).replace(". ", ".\n") + f"\nunique {rng.random()}"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_documents_are_found_by_held_out_labels(spark):
    rows, labels = toxic_corpus(1)
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "vile nasty words")], "doc_id long, text string").selectExpr("*", "1 AS toxic", "'x' AS line", "2 AS score")
    table = spark.createDataFrame([(i, y, None) for i, y in labels] + [(None, 1, 0), (6000, 1, 0), (7, None, 0)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, table).collect()}
    held = [(got[i]["predicted"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == y for p, y in held]) > 0.98 and sum(y for _, y in held) > 20
    assert got[None]["predicted"] == 1 and got[5000]["predicted"] == 0 and got[5000]["score"] == got[5001]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    toxic = dict(labels)
    assert np.mean([toxic[e] for r in got.values() if r["score"] > 0.95 for e in r["evidence"]]) > 0.9
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    (r,) = toxicity.score(docs, labels).collect()
    assert (round(r["score"], 9), r["predicted"], r["evidence"]) == (0.05, 0, [])
    assert toxicity.score(docs.where("false"), labels).count() == 0 and toxicity.drop_toxic(docs, labels).count() == 1


def test_a_table_of_four_documents_teaches(spark):
    """Words that most documents have weigh little, but they weigh."""
    docs = spark.createDataFrame([(i, f"the same words {w}") for i, w in enumerate(["vile", "vile", "kind", "kind"])], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, "true").collect()}
    assert got[1]["evidence"][0] == 0 and got[3]["evidence"][0] == 2 and got[1]["cosines"][0] > 0.99 > got[1]["cosines"][1] > 0


@pytest.mark.parametrize("full", [8, 15, 1000])
def test_block_max_search_is_exact(monkeypatch, full):
    monkeypatch.setattr(toxicity, "FULL", full)  # none, some or all features are scored from full rows
    rng = random.Random(2)
    weight = np.array([rng.uniform(0, 5) if rng.random() < 0.9 else 0.0 for _ in range(60)])
    row = lambda: (np.sort(np.array(rng.sample(range(60), size := rng.randrange(9)), np.int64)), np.array([rng.randrange(1, 4) for _ in range(size)], np.int64))
    examples = [(i, float(rng.randrange(2)), *row()) for i in range(900)]
    examples += [(900 + i, 1.0 - x[1], *x[2:]) for i, x in enumerate(examples[:300])]  # ties
    index = toxicity.Index(examples, weight, 3.0)
    by_id = {e[0]: index.vector(e[2], e[3]) for e in examples}
    for _ in range(80):
        f, tf = row()
        f, w = index.vector(*(np.r_[x, [y] * more].astype(np.int64) for more in [rng.randrange(2)] for x, y in ((f, 60), (tf, 1))))
        dense = np.zeros(60)
        dense[f] = w
        cosine = np.array([float(dense[by_id[i][0]] @ by_id[i][1]) for i in index.ids])
        edge = max(np.sort(cosine)[-15], 1e-12)
        n, s = index.nearest(f, w)
        assert set(n.tolist()) == set(np.flatnonzero((cosine > 0) & (cosine >= edge - 1e-9)).tolist())
        assert np.allclose(s, cosine[n]) and (np.diff(s) <= 0).all()


def test_votes_equal_a_plain_search_over_all_words(spark):
    rows, labels = toxic_corpus(4, 400)
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000, "words that no example has"), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels += [(1000 + i, 1) for i in range(30)]  # copies with other labels
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id % 2 = 0")
    known: dict = {}
    for i, y in labels:
        if i % 2 == 0:
            known.setdefault(dict(rows)[i], []).append(y)
    share = {t: sum(ys) / len(ys) for t, ys in known.items()}
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    parts = lambda t: [f for w in words(t) for f in [w] + [w[:n] + "-" for n in range(4, 9) if len(w) >= n]]
    every = {f for t in share for f in parts(t)}
    n1 = sum(y > 0.5 for y in share.values())
    n0 = len(share) - n1
    lines = {line for t, y in share.items() if y > 0.5 for line in t.split("\n")}
    gain = {}
    for f in every:
        x = min(sum(f in parts(t) for t, y in share.items() if y > 0.5), sum(f in parts(line) for line in lines))
        z = sum(f in parts(t) for t, y in share.items() if y <= 0.5)
        cells = [(x, n1, x + z), (z, n0, x + z), (n1 - x, n1, n1 + n0 - x - z), (n0 - z, n0, n1 + n0 - x - z)]
        ratio = 2 * sum(o * math.log(o * (n1 + n0) / (n * m)) for o, n, m in cells if o)
        lift = x / n1 / ((z + 0.5) / (n0 + 1))
        if x >= 3 and ratio >= 15 and lift > 1:
            gain[f] = math.log(lift)
    assert any(f.endswith("-") for f in gain) and len(gain) > 3
    df = {f: sum(f in parts(t) for _, t in rows) for f in every}

    def vector(t):
        v = {}
        for f in set(parts(t)):
            w = (not f.endswith("-")) + gain.get(f, 0.0)
            if w:
                v[f] = (1 + math.log(parts(t).count(f))) * w * math.sqrt(math.log((1 + len(rows)) / (1 + df.get(f, 0))) + 1e-3)
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()}

    vectors = [(vector(t), y) for t, y in share.items()]
    base = sum(share.values()) / len(share)
    tokens = toxicity._Tokens(model.vocabulary)
    for _, t in rows[::7] + rows[-35:]:
        q = vector(t)
        near = sorted(((sum(x * v.get(f, 0.0) for f, x in q.items()), y) for v, y in vectors), reverse=True)
        near = [(s, y) for s, y in near if s > 0 and s >= near[14][0] - 1e-9]
        want = (sum(s * y for s, y in near) + 0.3 * base) / (sum(s for s, _ in near) + 0.3)
        got, n, _ = model.index.vote(*model.index.vector(*tokens.counts(t)))
        assert abs(got - want) < 1e-6 and len(n) == len(near)


def test_scores_don_t_depend_on_doc_ids(spark):
    rows, labels = toxic_corpus(5, 300)
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    labels += [(1000 + i, 1 - y) for i, y in labels[:40]]
    other = {i: 3 * (7919 * i % 10_007) for i, _ in rows}  # every row is learned from, before and after
    read = lambda r, y: {t: s for t, s in toxicity.score(spark.createDataFrame(r, "doc_id long, text string").repartition(5), spark.createDataFrame(y, "doc_id long, toxic int"), "true").join(spark.createDataFrame(r, "doc_id long, text string"), "doc_id").select("text", "score").collect()}
    a, b = read(rows, labels), read([(other[i], t) for i, t in rows], [(other[i], y) for i, y in labels])
    assert a.keys() == b.keys() and all(abs(a[t] - b[t]) < 1e-9 for t in a)


def test_calibration_pools_adjacent_violators():
    rng = random.Random(6)
    votes = np.array(sorted(rng.random() for _ in range(60)))
    shares = np.array([float(rng.random() < v) for v in votes])
    places, values = toxicity.calibration(votes, shares, 0.2)
    assert (np.diff(places) > 0).all() and (np.diff(values) >= 0).all()
    want = [max(min(shares[i : j + 1].mean() for j in range(at, 60)) for i in range(at + 1)) for at in range(60)]  # the least-squares monotone fit
    levels = sorted(set(np.round(want, 9)))
    sizes = [int(sum(abs(w - x) < 1e-9 for w in want)) for x in levels]
    assert np.allclose(values, np.maximum.accumulate([(x * n + 0.2) / (n + 1) for x, n in zip(levels, sizes)]))
    assert toxicity.Model(None, toxicity.Index([], np.zeros(1), 1.0), places, values).calibrated(0.5) == 0.05

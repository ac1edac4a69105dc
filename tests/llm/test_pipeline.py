"""The corpus pipeline on a small corpus, against what was planted in it."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline

from millrace.llm import minhash, packing, simhash


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, toxic and copied documents, a passage that several share, and odd rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    vocabulary = [word() for _ in range(900)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(n))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, toxic = [], set()
    for i in range(300):
        t = text(rng.randrange(1, 5))
        if i % 6 == 5:
            toxic.add(i)
            parts = t.split(" ")
            for _ in range(4):
                parts[rng.randrange(len(parts))] = rng.choice(["vilest", "nastier", "wretched"])
            t = " ".join(parts)
        elif i % 7 == 3:
            t = f"{t}\n{passage}"
        rows.append((i, t))
    rows += [(1000, rows[0][1]), (1001, rows[1][1]), (1002, ""), (1003, None), (1004, rows[2][1].replace(" ", "  ")), (1004, "one more row of that id")]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, toxic, passage


def test_stages_do_their_work(spark, corpus, tmp_path):
    folder, rows, toxic, passage = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 3:
            assert docs.columns == columns
            kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    want = [(i, t) for i, t in rows if i not in toxic]
    assert sorted(map(repr, kept[0])) == sorted(map(repr, want))
    holders = [i for i, t in kept[1] if passage in (t or "")]
    assert holders == [min(i for i, t in want if passage in (t or ""))]
    ids = {i for i, _ in kept[1]}
    assert not {1000, 1001} & ids and {0, 1, 1002, 1003} <= ids
    by_fp = {}
    for i, t in kept[1]:
        by_fp.setdefault(simhash.fingerprint(t), []).append(i)
    assert {i for i, _ in kept[2]} == {min(v) for v in by_fp.values()}  # nothing here is near without being equal
    v = packing._WordIds(packing.tokenizer_file())
    total = {i: len(x) // 4 + 1 for (i, _), x in zip(kept[2], v.ids([t for _, t in kept[2]]), strict=True)}
    got = {}
    for r in docs.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total


def test_run_is_the_stages_in_turn(spark, corpus):
    folder, *_ = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "best-fit packing"]
    assert corpus_pipeline.run(spark, folder).count() > 200


@pytest.mark.parametrize("small", [16, 2])
def test_planted_near_copies_go_as_brute_force_says(spark, monkeypatch, small):
    from millrace.llm import jaccard

    monkeypatch.setattr(jaccard, "SMALL", small)  # with 2, most groups are large ones
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randrange(40, 300))] for _ in range(60)]
    line = [rng.choice(vocabulary) for _ in range(25)]  # a common line
    for i in range(0, 60, 3):
        texts[i] = [*line, *texts[i]]
    for i in range(40):  # near copies with a word in every 8 to 120 changed
        copy = list(texts[i])
        for at in range(rng.randrange(8), len(copy), rng.choice([8, 20, 35, 45, 60, 120])):
            copy[at] = rng.choice(vocabulary)
        texts.append(copy)
    for _ in range(30):  # one large group of them
        copy = list(texts[7])
        for _ in range(max(1, len(copy) // 60)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(copy)
    rows = [(1000 - i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)] + [(2000, None, "en", "s", 0), (2001, " ", "en", "s", 0), (2002, "two words", "en", "s", 0)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((r[1] or "").split() for r in rows)]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    far = 0
    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > 4
                root[find(i)] = find(j)
    want = {}
    for i, r in enumerate(rows):
        want[find(i)] = min(want.get(find(i), r[0]), r[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert far > 20 and len(want) < len(rows) - 40 and got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want.values())
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), "").count() == 0


def test_candidates_share_golay_keys_of_simhash_fingerprints():
    """A key is the codewords nearest to a sample's fingerprint, whose bits are those of over half of its hashes."""
    from millrace.llm import common, jaccard

    rng = np.random.default_rng(9)
    whole = np.unique(rng.integers(0, 2**64, 900, np.uint64, endpoint=False))
    likes = [np.sort(rng.permutation(whole)[:800]) for _ in range(2)]  # a likeness of about 0.8
    samples = np.array([minhash.least_of(x, jaccard.BANDS * jaccard.WIDTH) for x in likes], np.uint64).reshape(-1, jaccard.WIDTH)
    fps = jaccard.fingerprints(samples)
    for own, fp in zip(common.mix(samples).tolist(), fps.tolist(), strict=True):
        assert fp == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in own) > len(own))
    a, b = jaccard.band_keys(likes)
    assert 3 <= (a == b).sum() < jaccard.BANDS and len(set(a.tolist())) == jaccard.BANDS
    words = np.array([w for w in range(1 << 16) if not simhash.syndrome(np.array([w]))[0]], np.int64)  # codewords that fit a segment of 21 bits
    for _ in range(20):
        fp, near = 0, 0
        for low, width in simhash.SEGMENTS:
            word = int(rng.choice(words))
            flipped = sum(1 << int(i) for i in rng.choice(width, 3, replace=False))
            fp, near = fp | word << low, near | (word ^ flipped) << low
        assert simhash.nearest(np.array([fp], np.uint64)) == simhash.nearest(np.array([near], np.uint64))


def test_stages_delete_what_their_result_does_not_read(spark, corpus):
    """Vectors, lines, and shingles take more room than the texts; they must not lie on disk while later stages run."""
    from millrace.llm import common

    folder, *_ = corpus
    at = common.shared_dir(spark).removeprefix("file:")
    seen = set(os.listdir(at)) if os.path.isdir(at) else set()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert docs.count() > 200
    assert sorted(x.split("-")[0] for x in set(os.listdir(at)) - seen) == ["gone", "later", "near", "toxic"]

"""Models that fail on single rows, and a graph that is kept as documents change."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import edges, inference
from millrace.operators.models import HashingEmbedder


class Poisoned(HashingEmbedder):
    def embed(self, texts, prefix="passage: "):
        if any("poison" in t for t in texts):
            raise RuntimeError("bad text")
        return super().embed(texts, prefix)


def test_one_poisoned_text_costs_one_row(spark):
    rows = [(k, f"text number {k}") for k in range(1000)] + [(2000, "some poison here"), (2001, ""), (2002, None), (2003, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("error", F.lit("own")).repartition(3)
    good, bad = inference.embed(docs, lambda: Poisoned(8), wait=lambda s: None)
    (row,) = bad.collect()
    assert (row["doc_id"], row["attempts"]) == (2000, 2) and "bad text" in row["error"]
    got = {r["doc_id"]: r["embedding"] for r in good.collect()}
    assert len(got) == 1003 and all(got[k] == [0.0] * 8 for k in (2001, 2002, 2003))
    assert np.allclose(got[17], HashingEmbedder(8).embed(["text number 17"])[0])
    assert [x.count() for x in inference.embed(docs.limit(0), Poisoned(8))] == [0, 0]


def test_batches_are_halved_and_single_texts_tried_again():
    calls, waits = [], []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise OSError("no")
        return np.ones((len(texts), 2))

    got = inference._narrowed(model, ["a", "b", "bad", "c"], 3, waits.append)
    assert [v is None for v, _, _ in got] == [False, False, True, False] and calls == [4, 2, 2, 1, 1, 1, 1] and waits == [0.1, 0.2]
    assert inference._narrowed(lambda t: [], ["a"], 1, waits.append)[0][1].startswith("ValueError")


def test_edits_equal_a_full_rebuild(spark, tmp_path):
    rng = random.Random(1)
    state = {k: {rng.choice("abcdefghij") for _ in range(rng.randint(0, 4))} for k in range(60)}
    kept = edges.Edges(spark, str(tmp_path / "g"), 8)
    frame = lambda ids: spark.createDataFrame([(k, e, f"T{e}") for k in ids for e in state.get(k, ())], "doc_id long, entity_id string, entity_text string")
    ids = lambda own: spark.createDataFrame([(k,) for k in own], "doc_id long")
    kept.apply(ids(state), frame(state))
    for edit in range(3):
        changed = rng.sample(range(70), 6)
        before = {k: set(state.get(k, ())) for k in changed}
        for k in changed:
            state[k] = set() if rng.random() < 0.3 else {rng.choice("abcdefghijkl") for _ in range(3)}
        old = kept.edges.manifest()["parts"]
        got = kept.apply(ids(changed), frame(changed))
        assert got == {"added": sum(len(state[k] - before[k]) for k in changed), "retracted": sum(len(before[k] - state[k]) for k in changed)}
        assert sum(v != old.get(p) for p, v in kept.edges.manifest()["parts"].items()) <= 6
    assert kept.apply(ids(changed), frame(changed)) == {"added": 0, "retracted": 0}
    want = sorted((k, e) for k, own in state.items() for e in own)
    assert sorted((r["doc_id"], r["entity_id"]) for r in kept.edges.read().collect()) == want
    degrees = lambda: {r["entity_id"]: r["degree"] for r in kept.degrees.read().collect()}
    now = degrees()
    assert now == {e: sum(x == e for _, x in want) for e in {x for _, x in want}}
    kept.rebuild_degrees()
    assert degrees() == now


def test_vertices_carry_the_properties_of_their_type(spark):
    docs = spark.createDataFrame([("1", "repo", "k1", datetime(2026, 1, 2, 3), "a/b", 5, ["x", "y"], None), ("2", "paper", "k2", None, "no", 7, None, "T")], "doc_id string, type string, doc_key string, event_at timestamp, full_name string, stars long, tags array<string>, title string")
    got = {r["node_id"]: (r["label"], r["properties"]) for r in edges.vertices(docs, edges.PROPERTIES | {"repo": ("full_name", "stars", "tags")}).collect()}
    assert got["1"] == ("repo", {"full_name": "a/b", "stars": "5", "tags": '["x","y"]', "doc_key": "k1", "type": "repo", "event_at": "2026-01-02T03:00:00+00:00"})
    assert got["2"] == ("paper", {"title": "T", "doc_key": "k2", "type": "paper"})


def test_dead_letters_count_as_blank_what_sql_does(spark, tmp_path):
    """Texts without words, or whose words cancel, have the zero vector without being blank; ids may repeat or be null."""
    import duckdb

    from millrace.plans import registry, tables

    from . import oracle

    rows = [(1, "!!!", "en"), (2, " \n\t", "en"), (3, " ", "en"), (4, "", None), (4, None, None), (4, "License", "de"), (None, "some words", "de"), (None, "\x0b", "de")]
    cancelled = next(f"a{i} b{j}" for i in range(100) for j in range(100) if not HashingEmbedder(16).embed([f"a{i} b{j}"]).any())
    docs = spark.createDataFrame([*rows, (5, cancelled, "fr")], "doc_id long, text string, lang string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = tables.embedding_dead_letters(spark, str(tmp_path))
    result = con.execute(registry.ORACLES["embedding_dead_letters"])
    assert oracle.rows(got.columns, got.collect()) == oracle.rows([d[0] for d in result.description], result.fetchall())

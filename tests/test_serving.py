"""Serving structures: BM25 from blocks, vectors as matrices, paged links."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks, bm25, dense, entities


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(900)]
    docs = [(k, rng.choice(["a", "b"]), " ".join(words[min(int(rng.expovariate(0.02)), 899)] for _ in range(rng.randint(1, 60)))) for k in range(1500)]
    docs += [(2000, "a", ""), (2001, "b", None), (2002, "a", "w5"), (2003, "a", "w5"), (2004, "b", "zz zz zz rare")]
    return spark.createDataFrame(docs, "doc_id long, type string, text string")


def test_blocks_give_the_same_rows_and_read_few(spark, corpus, tmp_path, monkeypatch):
    index = bm25.build(corpus, written=True)
    laid = blocks.write(index, str(tmp_path / "i"), 20)
    hits = lambda df: [(r["doc_id"], round(r["score"], 9)) for r in df.collect()]
    allowed = corpus.where("doc_id % 3 = 0").select("doc_id")
    for query in ("w5", "w120 w300", "rare", "w1 w2 w3 w250", "nothing here", "", "w5 w5 w40"):
        for more in ({}, {"kind": "b"}, {"allowed": allowed}):
            assert hits(laid.search(query, 7, **more)) == hits(bm25.search(index, query, 7, **more)), (query, more)
    monkeypatch.setattr(blocks, "ROUNDS", (2, 3))
    assert hits(laid.search("w120 w30", 50)) == hits(bm25.search(index, "w120 w30", 50))


def test_two_words_read_few_postings(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    docs = [(k, " ".join(f"t{rng.randint(0, 4000)}" for _ in range(40))) for k in range(6000)]
    monkeypatch.setattr(blocks, "LAYOUT", {"parquet.block.size": "16384", "parquet.page.row.count.limit": "500", "parquet.page.size.row.check.min": "100", "parquet.page.size.row.check.max": "100", "parquet.block.size.row.check.min": "200", "parquet.block.size.row.check.max": "500"})
    laid = blocks.write(bm25.build(spark.createDataFrame(docs, "doc_id long, text string"), written=True), str(tmp_path / "i"), 64)
    read: list = []
    assert laid.search("t17 t1234", 10, read=read).count() == 10
    met = total = groups = 0
    for f in (tmp_path / "i" / "postings").rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            total, groups = total + group.num_rows, groups + 1
            span = lambda c: group.column(names.index(c)).statistics  # noqa: B023, E731
            if any(span("term").min <= t <= span("term").max and any(span("range").min <= r <= span("range").max for r in ranges) for terms, ranges in read for t in terms):
                met += group.num_rows
    assert groups > 40 and met < 0.05 * total


def test_matrix_search_equals_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "ab"[k % 2], [float(np.float32(x)) for x in rng.normal(size=6)]) for k in range(200)]
    rows += [(300, "a", rows[4][2]), (301, "a", None), (302, "a", [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, "b", [1.0]), (304, "b", [])]
    df = spark.createDataFrame(rows, "doc_id long, type string, embedding array<float>").repartition(5)
    query = rows[4][2]
    score = lambda v: sum(a * b for a, b in zip(v, query))
    able = [(k, t, score(v)) for k, t, v in rows if v and len(v) == 6 and None not in v]
    want = lambda own, n: [k for k, _, s in sorted(own, key=lambda x: (-round(x[2], 9), x[0]))[:n]]
    ids = lambda got: [r["doc_id"] for r in got.collect()]
    assert ids(dense.search(df, query, 9)) == want(able, 9)
    assert ids(dense.search(df, query, 500, F.col("type") == "b")) == want([x for x in able if x[1] == "b"], 500)
    assert ids(dense.similar(df, 4, 5)) == want([x for x in able if x[1] == "a" and x[0] != 4], 5)
    assert ids(dense.similar(df, 999, 5)) == [] and ids(dense.search(df.limit(0), query)) == []
    words = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert ids(dense.search(words, query, 3)) == [f"d{k}" for k in want(able, 3)]
    assert [r["doc_id"] for r in dense.search(df.where("doc_id IN (4, 300)"), query, 2).collect()] == [4, 300]


def test_an_entity_of_any_size_keeps_all_its_links(spark):
    rng = random.Random(4)
    links = [("hot", k, "repo") for k in range(25_000)] + [(f"e{k % 40}", k, "paper") for k in range(900)] + [("e1", 1, "paper")]
    rng.shuffle(links)
    edges = spark.createDataFrame(links, "entity_id string, doc_id long, type string").repartition(8)
    pages = entities.paged_links(edges, 1000).cache()
    hot = pages.where("entity_id = 'hot'").orderBy("page").collect()
    assert [r["page"] for r in hot] == list(range(25)) and [(r["first_doc"], r["last_doc"]) for r in hot] == [(1000 * p, 1000 * p + 999) for p in range(25)]
    assert sum(len(r["links"]) for r in pages.collect()) == len(set(links))
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id")
    assert [r["doc_id"] for r in entities.documents_of(pages, docs, "hot", 7).collect()] == list(range(7000, 8000))
    assert entities.page_of(pages, "e1", 1).count() == 0 and entities.page_of(pages, "e1", 0).count() == 23
    assert entities.paged_links(edges.limit(0)).collect() == []

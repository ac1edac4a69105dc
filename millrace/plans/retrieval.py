"""Retrieval queries: lexical, dense, graph and fused ranking, filters, and the quality of rankings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, tokenize
from ..operators import blocks, bm25, dense, entities, evaluate, fusion, graph, rag, search
from .registry import query, table
from .tables import scratch

QUERY = "Licensed under the Apache License, version 2.0"

#: Tokens of documents, and BM25 scores of QUERY, in SQL.
TOKENS = f"""
raw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#.\\-]*')) AS t FROM documents WHERE trim(text) <> ''),
tok AS (SELECT doc_id, regexp_replace(t, '^[.\\-]+|[.\\-]+$', '', 'g') AS term FROM raw WHERE t NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE length(term) > 1 GROUP BY ALL)"""
BM25 = f"""{TOKENS},
lens AS (SELECT d.doc_id, coalesce(sum(p.tf), 0) AS len FROM documents d LEFT JOIN post p USING (doc_id) WHERE trim(d.text) <> '' GROUP BY d.doc_id),
corp AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
raw_idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, corp GROUP BY term, n),
idfs AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw_idf) ELSE idf END AS idf FROM raw_idf),
asked AS (SELECT unnest(['licensed', 'under', 'apache', 'license', 'version', '2.0']) AS term),
scored AS (SELECT p.doc_id, sum(i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.len / c.avgdl))) AS score
           FROM post p JOIN asked USING (term) JOIN idfs i USING (term) JOIN lens l USING (doc_id), corp c GROUP BY p.doc_id)"""
DENSE = """
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id AS doc_id, label, list_dot_product(embedding::DOUBLE[], q) AS score FROM embeddings, qv)"""
GRAPH = """
deg AS (SELECT term, count(*) AS degree FROM post WHERE term IN (SELECT term FROM post WHERE doc_id IN (SELECT doc_id FROM seeds)) GROUP BY term HAVING count(*) BETWEEN 2 AND 25),
expanded AS (SELECT p.doc_id, sum(ln(1 + (SELECT count(*) FROM documents) / d.degree)) AS score, list_sort(list(DISTINCT term))[1:8] AS shared
             FROM post p JOIN deg d USING (term) WHERE p.doc_id NOT IN (SELECT doc_id FROM seeds) GROUP BY p.doc_id)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def _token_edges(docs: DataFrame) -> DataFrame:
    """Documents and their tokens as a graph."""
    one = docs.where(F.trim("text") != "").select("doc_id", F.explode(F.array_distinct(tokenize("text"))).alias("entity_id"))
    return one.withColumn("entity_text", F.col("entity_id"))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY round(scored.score, 9) DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _scored(bm25.search(bm25.build(_documents(spark, d), written=True), QUERY))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY round(scored.score, 9) DESC, doc_id LIMIT 20")
def bm25_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    allowed = docs.where("lang = 'en'").select("doc_id")
    return _scored(bm25.search(bm25.build(docs, written=True), QUERY, allowed=allowed))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY round(scored.score, 9) DESC, doc_id LIMIT 20")
def bm25_blocks_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best documents from postings in blocks, of which ranges are read in the order of their bounds."""
    return _scored(blocks.write(bm25.build(_documents(spark, d), written=True), scratch(spark, "blocks")).search(QUERY))


@query(f"WITH {TOKENS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build(_documents(spark, d)).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {DENSE} SELECT doc_id, round(score, 4) AS score FROM near ORDER BY round(near.score, 9) DESC, doc_id LIMIT 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    own = vectors.where("doc_id = 0").first()["embedding"]
    return dense.search(vectors, own).select("doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {DENSE} SELECT doc_id, round(score, 4) AS score FROM near WHERE label = 3 ORDER BY round(near.score, 9) DESC, doc_id LIMIT 20")
def dense_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    own = vectors.where("doc_id = 0").first()["embedding"]
    return dense.search(vectors, own, where=F.col("label") == 3).select("doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {DENSE} SELECT doc_id, round(score, 4) AS score FROM near WHERE doc_id <> 0 AND label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY round(near.score, 9) DESC, doc_id LIMIT 10")
def similar_docs(spark: SparkSession, d: str) -> DataFrame:
    return dense.similar(_vectors(spark, d), 0, same="label").select("doc_id", F.round("score", 4).alias("score"))


_CHANNELS = f"""{BM25}, {DENSE},
kw AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20),
se AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM near QUALIFY rank <= 20)"""
_FUSED = """
fused AS (SELECT doc_id, sum(w / (60 + rank)) AS s, min((o, rank)) AS tie FROM ch GROUP BY doc_id)"""


@query(
    f"""WITH {_CHANNELS},
ch AS (SELECT doc_id, 0.5 AS w, rank, 0 AS o FROM kw UNION ALL SELECT doc_id, 1.0, rank, 1 FROM se), {_FUSED}
SELECT doc_id, round(s, 8) AS rrf_score FROM fused"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    own = vectors.where("doc_id = 0").first()["embedding"]
    channels = {"keyword": bm25.search(bm25.build(_documents(spark, d), written=True), QUERY), "semantic": dense.search(vectors, own)}
    return fusion.fuse(channels).select("doc_id", F.round("rrf_score", 8).alias("rrf_score"))


@query(
    f"""WITH {_CHANNELS},
seeds AS (SELECT doc_id FROM kw WHERE rank <= 5 UNION SELECT doc_id FROM se WHERE rank <= 5), {GRAPH},
cut AS (SELECT doc_id, score FROM expanded ORDER BY round(score, 9) DESC, doc_id LIMIT 20),
gr AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cut WHERE doc_id NOT IN (SELECT doc_id FROM kw) AND doc_id NOT IN (SELECT doc_id FROM se)),
ch AS (SELECT doc_id, 0.5 AS w, rank, 0 AS o FROM kw UNION ALL SELECT doc_id, 1.0, rank, 1 FROM se UNION ALL SELECT doc_id, 0.5, rank, 2 FROM gr), {_FUSED},
best AS (SELECT doc_id, s FROM fused ORDER BY round(s, 12) DESC, tie LIMIT 10)
SELECT doc_id, lang, round(s, 8) AS rrf_score FROM best JOIN documents USING (doc_id)"""
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs, vectors = _documents(spark, d), _vectors(spark, d)
    own = vectors.where("doc_id = 0").first()["embedding"]
    engine = search.Engine(docs, bm25.build(docs, written=True), vectors, lambda _: own, _token_edges(docs))
    return engine.search(QUERY).select("doc_id", "lang", F.round("rrf_score", 8).alias("rrf_score"))


@query(
    f"""WITH {TOKENS}, seeds AS (SELECT unnest([0, 1, 2, 3, 4]) AS doc_id), {GRAPH}
SELECT doc_id, round(score, 6) AS score, array_to_string(shared, ' ') AS shared FROM expanded ORDER BY round(expanded.score, 9) DESC, doc_id LIMIT 20"""
)
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    seeds = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    found = graph.expand(_token_edges(docs), seeds, docs.agg(F.count(F.lit(1)).alias("n")))
    return found.select("doc_id", F.round("score", 6).alias("score"), F.array_join("shared", " ").alias("shared"))


NAMES = "[A-Z][a-z]{3,}"
_ENTITIES = f"""
found AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{NAMES}')) AS name FROM documents),
per_doc AS (SELECT doc_id, lang, name, count(*) AS n FROM found GROUP BY ALL),
useful AS (SELECT * FROM per_doc WHERE lower(name) NOT IN ({", ".join(f"'{g}'" for g in entities.GENERIC)}) AND length(name) <= 60),
forms AS (SELECT lower(name) AS k, name, count(*) AS entries, sum(n) AS mentions FROM useful GROUP BY ALL),
named AS (SELECT k, arg_min(name, (-entries, name)) AS entity_text, sum(mentions)::BIGINT AS mention_count FROM forms GROUP BY k),
linked AS (SELECT lower(name) AS k, count(DISTINCT doc_id) AS document_count FROM useful GROUP BY 1)"""


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised words of documents as entities, found without leaving the engine."""
    names = F.regexp_extract_all("text", F.lit(f"({NAMES})"), F.lit(1))
    one = table(spark, d, "documents").select("doc_id", F.col("lang").alias("type"), F.explode(names).alias("entity_text"))
    counted = one.groupBy("doc_id", "type", "entity_text").agg(F.count(F.lit(1)).alias("count")).withColumn("entity_type", F.lit("ORG"))
    kept = counted.where(entities.is_useful("entity_text", "entity_type"))
    return kept.withColumn("entity_id", F.lower("entity_text"))


@query(f"WITH {_ENTITIES} SELECT entity_text, 'ORG' AS entity_type, mention_count, document_count FROM named JOIN linked USING (k)")
def canonical_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.canonical(_mentions(spark, d)).select("entity_text", "entity_type", "mention_count", "document_count")


@query(f"WITH {_ENTITIES} SELECT entity_text, mention_count FROM named ORDER BY mention_count DESC, entity_text LIMIT 10")
def top_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.top_entities(entities.canonical(_mentions(spark, d))).select("entity_text", "mention_count")


@query(
    f"""WITH {_ENTITIES} SELECT 'node' AS kind, lang AS label, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'node', 'entity', count(*) FROM named UNION ALL SELECT 'edge', 'mentions', count(*) FROM useful"""
)
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    edges = _mentions(spark, d)
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("type"), F.col("source").alias("title"))
    return graph.summary(graph.vertices(docs, entities.canonical(edges)), edges)


@query(
    """WITH hits AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
gains AS (SELECT source AS query_id, doc_id, 1 + quality AS gain FROM labels JOIN documents USING (doc_id)),
j AS (SELECT g.query_id, gain, CASE WHEN rank <= 10 THEN rank END AS place, rank FROM gains g LEFT JOIN hits h USING (query_id, doc_id)),
ideal AS (SELECT query_id, sum(gain / log2(pos + 1)) AS idcg FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS pos FROM gains) WHERE pos <= 10 GROUP BY 1)
SELECT query_id, round(count(place) / 10, 6) AS p, round(count(place) / count(*), 6) AS r, round(coalesce(1 / min(rank), 0), 6) AS mrr,
       round(coalesce(sum(gain / log2(place + 1)), 0) / any_value(idcg), 6) AS ndcg FROM j JOIN ideal USING (query_id) GROUP BY query_id"""
)
def eval_ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    hits = docs.select(F.col("source").alias("query_id"), "doc_id", place.alias("rank")).where("rank <= 50")
    gains = table(spark, d, "labels").join(docs, "doc_id").select(F.col("source").alias("query_id"), "doc_id", (F.col("quality") + 1).alias("gain"))
    return evaluate.ranking(hits, gains).select("query_id", *(F.round(c, 6).alias(c) for c in ("p", "r", "mrr", "ndcg")))


@query(
    """WITH x AS (SELECT quality = 1 AS t, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM x)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c"""
)
def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "labels").join(_documents(spark, d), "doc_id").select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1000).alias("predicted"))
    return evaluate.confusion(pairs).withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall")})


@query("SELECT event_id, event_type AS type FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10")
def relaxed_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """No event lies in Lisbon or on the last days: the place is dropped, then the window widened."""
    events = table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.lit("Austin, Texas").alias("location"), F.col("ts").cast("timestamp").alias("event_at"))
    plan = search.Plan("", kind="error", place="Lisbon", days=10)

    def attempt(f: search.Filters) -> DataFrame:
        return events.where(f.column()).orderBy(F.desc("event_at"), "event_id").limit(10)

    return search.retrieve(plan, attempt, datetime(2024, 2, 12)).select("event_id", "type")


@query(
    """WITH last AS (SELECT conv_id, turn, upper(role[1]) || lower(role[2:]) || ': ' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE text <> '' QUALIFY n <= 6)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM last GROUP BY conv_id"""
)
def chat_history_window(spark: SparkSession, d: str) -> DataFrame:
    return rag.recent_turns(table(spark, d, "conversations"))


_SWEEP = ", ".join(f"({w}::DOUBLE)" for w in (0.0, 0.25, 0.5, 0.75, 1.0))


@query(
    f"""WITH {_CHANNELS},
grid AS (SELECT col0 AS weight FROM (VALUES {_SWEEP})),
gains AS (SELECT doc_id, 1 + quality AS gain FROM labels),
ch AS (SELECT weight, doc_id, weight AS w, rank, 0 AS o FROM kw, grid UNION ALL SELECT weight, doc_id, 1.0, rank, 1 FROM se, grid),
fused AS (SELECT weight, doc_id, sum(w / (60 + rank)) AS s, min((o, rank)) AS tie FROM ch GROUP BY weight, doc_id),
hits AS (SELECT weight, doc_id, row_number() OVER (PARTITION BY weight ORDER BY round(s, 12) DESC, tie, doc_id) AS place FROM fused QUALIFY place <= 10),
ideal AS (SELECT sum(gain / log2(pos + 1)) AS idcg FROM (SELECT gain, row_number() OVER (ORDER BY gain DESC) AS pos FROM gains) WHERE pos <= 10)
SELECT weight, round(coalesce(sum(gain / log2(place + 1)), 0) / (SELECT idcg FROM ideal), 6) AS ndcg FROM hits LEFT JOIN gains USING (doc_id) GROUP BY weight"""
)
def fusion_weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """nDCG at ten of the fused ranking by the weight of the keyword channel, with labelled quality as gain; weights are few, channels have their best only."""
    vectors = _vectors(spark, d)
    own = vectors.where("doc_id = 0").first()["embedding"]
    found = {"keyword": bm25.search(bm25.build(_documents(spark, d), written=True), QUERY), "semantic": dense.search(vectors, own)}
    found = {name: spark.createDataFrame(hits.collect(), hits.schema) for name, hits in found.items()}  # 20 rows each
    gains = table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).alias("gain"))
    ideal = gains.orderBy(F.desc("gain")).limit(10).select("gain", F.row_number().over(Window.orderBy(F.desc("gain"))).alias("pos")).agg(F.sum(F.col("gain") / F.log2(F.col("pos") + 1)).alias("idcg"))
    rows = None
    for weight in (0.0, 0.25, 0.5, 0.75, 1.0):
        fused = fusion.fuse(found, 10, weights={"keyword": weight}, tie=True)
        place = F.row_number().over(Window.orderBy(F.desc(F.round("rrf_score", 12)), "_tie", "doc_id"))
        one = fused.select(F.lit(weight).alias("weight"), "doc_id", place.alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    gained = gains.join(F.broadcast(rows), "doc_id", "right").groupBy("weight").agg(F.coalesce(F.sum(F.col("gain") / F.log2(F.col("place") + 1)), F.lit(0.0)).alias("dcg"))
    return gained.crossJoin(F.broadcast(ideal)).select("weight", F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg"))

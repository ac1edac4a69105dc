"""The graph kept as it changes: edges by document, degrees with them, and vertices with properties.

When documents change, only their own edges are replaced: what a text no longer mentions is retracted, and degrees move by the difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, MapType, NumericType, StringType, StructType, TimestampType

from .parts import PART, PartTable
from .shared import keep

#: The properties of a vertex by document type.
PROPERTIES = {
    "startup": ("name", "description", "location", "funding", "source", "link", "yc_batch"),
    "article": ("title", "description", "author", "published_date", "source", "article_url"),
    "repo": ("full_name", "description", "stars", "forks", "primary_language", "source", "html_url"),
    "launch": ("title", "description", "company_name", "yc_batch", "platform", "kind", "points", "url"),
    "model": ("hf_id", "organization", "pipeline_tag", "library_name", "likes", "downloads", "url"),
    "paper": ("title", "organization", "upvotes", "github_repo", "arxiv_id", "url"),
}


def scalar(df: DataFrame, name: str) -> Column:
    """A column as a property value, as text: lists of texts joined as JSON, maps and structs as JSON, times in ISO form."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, ArrayType):
        return F.to_json(F.transform(c, lambda x: x.cast("string")) if not isinstance(kind.elementType, (StructType, MapType, ArrayType)) else F.transform(c, lambda x: F.to_json(x)))
    if isinstance(kind, (StructType, MapType)):
        return F.to_json(c)
    if isinstance(kind, TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    if isinstance(kind, (StringType, NumericType, BooleanType, DateType)):
        return c.cast("string")
    return c.cast("string")


def vertices(docs: DataFrame, kinds: dict[str, tuple[str, ...]] = PROPERTIES) -> DataFrame:
    """(node_id, label, properties): a vertex a document, with those of its type's properties that are not null, and its key, type and date."""
    every = sorted({n for names in kinds.values() for n in names} & set(docs.columns))
    entries = [F.when(F.col("type").isin(*(k for k, names in kinds.items() if n in names)), F.struct(F.lit(n).alias("k"), scalar(docs, n).alias("v"))) for n in every]
    entries += [F.struct(F.lit(n).alias("k"), scalar(docs, n).alias("v")) for n in ("doc_key", "type", "event_at") if n in docs.columns]
    have = F.filter(F.array(*entries), lambda e: e.isNotNull() & e["v"].isNotNull())
    return docs.select(F.col("doc_id").cast("string").alias("node_id"), F.col("type").alias("label"), F.map_from_entries(have).alias("properties"))


class Edges:
    """Edges (doc_id, entity_id, ...) in buckets of documents, and (entity_id, degree) in buckets of entities, under one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.edges, self.degrees = PartTable(spark, f"{path}/edges"), PartTable(spark, f"{path}/degrees")

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(self.buckets)).cast("string")

    def apply(self, documents: DataFrame, edges: DataFrame) -> dict[str, int]:
        """Replace the edges of some documents (doc_id) by `edges`, all that these have now; documents without edges lose theirs.

        Returns how many links of a document and an entity were added and retracted. Doing it again changes nothing. Degrees follow from
        the difference; should a run end between the two tables, the next call with the same documents finds no difference in edges, so `rebuild_degrees` is for that.
        """
        ids = keep(documents.select("doc_id").distinct(), "changed")
        fresh = keep(edges.join(ids, "doc_id", "left_semi").distinct(), "fresh")
        touched = [r[0] for r in ids.select(self._bucket("doc_id")).distinct().collect()]  # no more than there are buckets
        if not touched:
            return {"added": 0, "retracted": 0}
        base = self.edges.manifest()
        old = self.edges._rows(base, touched) if base["schema"] else fresh.limit(0)
        gone = old.join(ids, "doc_id", "left_semi").select("doc_id", "entity_id").distinct()
        came = fresh.select("doc_id", "entity_id").distinct()
        change = gone.withColumn("d", F.lit(-1)).unionByName(came.withColumn("d", F.lit(1))).groupBy("doc_id", "entity_id").agg(F.sum("d").alias("d")).where("d <> 0")
        change = keep(change, "links")
        rest = old.join(ids, "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
        self.edges._write(rest.withColumn(PART, self._bucket("doc_id")), rest.schema, lambda _: touched, (), ("doc_id", "entity_id"), base)
        self._move(change.groupBy("entity_id").agg(F.sum("d").alias("d")).where("d <> 0"))
        counts = change.agg(F.count_if(F.col("d") > 0), F.count_if(F.col("d") < 0)).first()
        return {"added": counts[0], "retracted": counts[1]}

    def _move(self, delta: DataFrame) -> None:
        delta = keep(delta, "delta")
        touched = [r[0] for r in delta.select(self._bucket("entity_id")).distinct().collect()]
        if not touched:
            return
        base = self.degrees.manifest()
        old = self.degrees._rows(base, touched) if base["schema"] else self.spark.createDataFrame([], delta.select("entity_id", F.col("d").alias("degree")).schema)
        now = old.unionByName(delta.select("entity_id", F.col("d").alias("degree"))).groupBy("entity_id").agg(F.sum("degree").alias("degree")).where("degree > 0")
        self.degrees._write(now.withColumn(PART, self._bucket("entity_id")), now.schema, lambda _: touched, ("entity_id",), ("entity_id",), base)

    def rebuild_degrees(self) -> None:
        """Count all degrees again."""
        now = self.edges.read().select("doc_id", "entity_id").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))
        self.degrees._write(now.withColumn(PART, self._bucket("entity_id")), now.schema, lambda _: None, ("entity_id",), ("entity_id",))

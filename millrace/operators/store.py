"""Tables in files: keyed upserts, versions with an atomic pointer, replaced partitions, snapshots, migration, copies."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import event_at
from ..functions.doctext import FIELDS, content_hash, with_fields
from ..functions.identity import doc_key
from .entities import stale
from .shared import keep, work_dir  # noqa: F401  others take them from here

#: Fields that change without the text, and fields that a new fetch never overwrites.
VOLATILE = ("stars", "forks", "watchers", "open_issues", "updated_at", "pushed_at", "team_size", "status", "is_hiring", "likes", "downloads", "trending_score", "points", "num_comments", "upvotes", "github_stars")
PROTECTED = ("doc_id", "first_seen_at", "entities", "entities_extracted_at", "embedding", "embedding_generated_at")
#: Metrics of a type that are kept by day.
METRICS = {"repo": ("stars", "forks", "watchers", "open_issues"), "model": ("likes", "downloads", "trending_score"), "launch": ("points", "num_comments"), "paper": ("upvotes", "github_stars")}


def prepare(fields: DataFrame, kind: str, source: str) -> DataFrame:
    """Normalised documents of one source with type, source, key, date and hash; a null doc_key means no identity."""
    full = with_fields(fields.withColumns({"type": F.lit(kind), "source": F.lit(source)}), FIELDS)
    return full.withColumns({"doc_key": doc_key("type"), "event_at": event_at("type", set(full.columns))}).withColumn("content_hash", content_hash("type"))


def upsert(existing: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """The next version of a keyed table, with `outcome`: new, changed, unchanged, or kept for rows not met.

    Of several incoming rows with one key the last by content hash counts. Changed rows take
    all incoming fields but the protected; unchanged ones the volatile only. Files have no
    updates of rows: one full outer join makes the new version.
    """
    extra = ("first_seen_at", "last_seen_at")
    columns = list(dict.fromkeys([*existing.columns, *(c for c in incoming.columns if c not in existing.columns)]))
    types = {f.name: f.dataType for f in [*incoming.schema, *existing.schema]}
    missing = lambda df: df.withColumns({c: F.lit(None).cast(types[c]) for c in columns if c not in df.columns}) if set(columns) - set(df.columns) else df
    one = incoming.where("doc_key IS NOT NULL").groupBy("doc_key").agg(F.max_by(F.struct(*incoming.columns), "content_hash").alias("r")).select("r.*")
    old, new = missing(existing).alias("old"), missing(one).alias("new")
    joined = old.join(new, F.col("old.doc_key") == F.col("new.doc_key"), "full")
    outcome = F.when(F.col("old.doc_key").isNull(), "new").when(F.col("new.doc_key").isNull(), "kept").when(F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")), "unchanged").otherwise("changed")
    stamp = F.lit(now).cast("timestamp")
    have = set(incoming.columns)
    cols: list[Column] = []
    for c in columns:
        before, after = F.col(f"old.`{c}`"), F.col(f"new.`{c}`")
        if c in extra:
            continue
        if c in PROTECTED:
            cols.append(F.when(F.col("outcome") == "new", after).otherwise(before).alias(c))
        elif c in have:
            takes = ["new", "changed"] + (["unchanged"] if c in VOLATILE else [])
            cols.append(F.when(F.col("outcome").isin(*takes), after).otherwise(before).alias(c))
        else:
            cols.append(before.alias(c))
    seen = {c: F.col(f"old.{c}") if c in columns else F.lit(None).cast("timestamp") for c in extra}
    joined = joined.withColumn("outcome", outcome)
    return joined.select(
        *cols,
        F.when(F.col("outcome") == "new", stamp).otherwise(seen["first_seen_at"]).alias("first_seen_at"),
        F.when(F.col("outcome") == "kept", seen["last_seen_at"]).otherwise(stamp).alias("last_seen_at"),
        "outcome",
    )


class VersionedTable:
    """A table as numbered Parquet folders and a pointer to the current one; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda p: hadoop.Path(p)
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The version that the newest pointer names."""
        if not self._fs.exists(self._at(self.path)):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return max((int(n[8:]) for n in names if n.startswith("current=")), default=None)

    def read(self) -> DataFrame:
        v = self.version()
        if v is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={v}")

    def replace(self, df: DataFrame, *partition_by: str, options: dict[str, str] | None = None) -> int:
        """Write df beside the current version, then move the pointer; a failed write leaves the old one in place. Options go to the writer."""
        old = self.version()
        v = 0 if old is None else old + 1
        while self._fs.exists(self._at(f"{self.path}/v={v}")):
            v += 1  # what a failed write left
        writer = df.write.options(**(options or {}))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v={v}")
        self._fs.mkdirs(self._at(f"{self.path}/current={v}"))
        if old is not None:
            self._fs.delete(self._at(f"{self.path}/current={old}"), True)
        return v


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite just the partitions that df has rows for: doing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def snapshots(docs: DataFrame, day: date) -> DataFrame:
    """(doc_id, type, metrics ..., date): the day's metrics of each document that has any of its type's."""
    every = sorted({m for own in METRICS.values() for m in own})
    docs = with_fields(docs, dict.fromkeys(every, "bigint"))
    has = None
    for kind, own in METRICS.items():
        cond = (F.col("type") == kind) & F.coalesce(*(F.col(m).cast("double") for m in own)).isNotNull()
        has = cond if has is None else has | cond
    shown = {m: F.when(F.col("type").isin(*(k for k, own in METRICS.items() if m in own)), F.col(m).cast("long")) for m in every}
    return docs.where(has).select(F.col("doc_id").cast("string").alias("doc_id"), "type", *(c.alias(m) for m, c in shown.items()), F.lit(day).alias("date"))


def refresh_hashes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with present content hashes, and one row about how many changed, and how many derived parts are stale."""
    full = with_fields(docs, FIELDS | {"content_hash": "string", "entities_hash": "string", "embedding_hash": "string"})
    fresh = full.withColumn("_hash", content_hash("type"))
    report = fresh.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(~F.col("content_hash").eqNullSafe(F.col("_hash"))).alias("rehashed"),
        F.count_if(stale("entities_hash", "_hash")).alias("stale_entities"),
        F.count_if(stale("embedding_hash", "_hash")).alias("stale_embeddings"),
    )
    return fresh.drop("content_hash").withColumnRenamed("_hash", "content_hash"), report


def migrate(collections: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Former collections by type -> one table, its report by type, and keys that more than one row has."""
    out = None
    for kind, df in collections.items():
        own = prepare(df, kind, "migration") if "source" not in df.columns else _keyed(df, kind)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    report = out.groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_at").isNotNull()).alias("dated"))
    doubled = out.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_key IS NULL")
    return out, report, doubled


def _keyed(df: DataFrame, kind: str) -> DataFrame:
    full = with_fields(df.withColumn("type", F.lit(kind)), FIELDS)
    return full.withColumns({"doc_key": doc_key("type"), "event_at": event_at("type", set(full.columns))}).withColumn("content_hash", content_hash("type"))


def dangling(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges whose document does not exist."""
    return edges.join(docs.select("doc_id"), "doc_id", "left_anti")


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> dict[str, int]:
    """Copy tables between folders; rows by name."""
    out = {}
    for name in names:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
        out[name] = spark.read.parquet(f"{target}/{name}").count()
    return out


def save_index(index, path: str, spark: SparkSession) -> dict[str, int]:
    """A lexical index as versioned tables."""
    return {name: VersionedTable(spark, f"{path}/{name}").replace(getattr(index, name)) for name in index.TABLES}


def load_index(cls, path: str, spark: SparkSession):
    return cls(*(VersionedTable(spark, f"{path}/{name}").read() for name in cls.TABLES))


def export_jsonl(collections: dict[str, DataFrame], path: str) -> None:
    """Rows as JSON lines with the collection's name, without vectors."""
    out = None
    for name, df in collections.items():
        own = df.drop("embedding").select(F.lit(name).alias("collection"), F.to_json(F.struct(*df.drop("embedding").columns)).alias("doc"))
        out = own if out is None else out.unionByName(own)
    out.write.mode("overwrite").json(path)


def import_jsonl(spark: SparkSession, path: str, collection: str, schema: str) -> DataFrame:
    rows = spark.read.schema("collection string, doc string").json(path)
    return rows.where(F.col("collection") == collection).select(F.from_json("doc", schema).alias("d")).select("d.*")

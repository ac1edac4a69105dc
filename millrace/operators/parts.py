"""Tables in parts: folders of hash buckets or of column values, listed by a manifest that one rename makes current.

A write makes new folders for the parts it touches and then a new manifest; all other parts stay where they are. Readers hold
on to one manifest, and so see one version. A manifest is put in place only if none has its number yet: of two writers
one wins, and the other goes on from the winner's version if they touched different parts. `vacuum` deletes what no kept manifest lists.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import keep, upsert

PART = "_part"
#: Batches that a manifest remembers as done, newest last.
REMEMBERED = 1000


class Conflict(RuntimeError):
    """Another writer has replaced a part that this write was based on."""


class Breach(ValueError):
    """What was written breaks a constraint; it has not become current."""


class PartTable:
    """A table whose parts are the values of a column (`by`) or numbers that a subclass gives."""

    def __init__(self, spark: SparkSession, path: str, by: str | None = None):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    # ---- manifests

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifests") if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """A version (the newest); an empty one for a table that does not exist."""
        versions = self.versions()
        if version is None and not versions:
            return {"version": -1, "schema": None, "parts": {}, "batches": [], "settings": {}}
        found = versions[-1] if version is None else version
        if found not in versions:
            raise FileNotFoundError(f"no version {found} of {self.path}")
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/manifests/{found:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> bool:
        """Make a manifest current unless one with its number exists; a rename is all or nothing."""
        final = f"{self.path}/manifests/{manifest['version']:010d}.json"
        temporary = self._hadoop.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(self._hadoop.Path(final)), options)
            return True
        except Exception as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def _names(self, path: str) -> list[str]:
        at = self._hadoop.Path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    # ---- reading

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """One version as a DataFrame, whole or some parts of it only: the others' files are not listed."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._rows(manifest, parts)

    def _rows(self, manifest: dict, parts: Iterable[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        wanted = manifest["parts"].keys() if parts is None else [p for p in dict.fromkeys(parts) if p in manifest["parts"]]
        folders = [f"{self.path}/{manifest['parts'][p]}" for p in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # ---- writing

    def replace(self, rows: DataFrame, scope: Iterable | None = None, key: tuple[str, ...] = (), required: tuple[str, ...] = (), batch: str | None = None) -> dict:
        """Make rows the content of the parts in scope (all parts: None); parts in scope without rows vanish.

        Rows outside the scope, nulls in `required` columns and repeated keys are breaches: they are counted while rows are written, and
        the version before stays current. Doing it again changes nothing but the version.
        """
        if self.by is None:
            raise ValueError("this table has no column that makes parts")
        named = rows.withColumn(PART, F.col(self.by).cast("string"))
        wanted = None if scope is None else [str(s) for s in scope]
        return self._write(named, rows.schema, lambda _: wanted, key, (*required, self.by), batch=batch)

    def _write(self, rows: DataFrame, schema: StructType, scope_of: Callable, key: tuple[str, ...], required: tuple[str, ...], base: dict | None = None, batch: str | None = None, settings: dict | None = None, observed: dict[str, Column] | None = None) -> dict:
        base = base or self.manifest()
        scope = scope_of(base)
        seen = Observation(f"write-{uuid.uuid4().hex}")
        part = F.col(PART)
        counts = {"rows": F.count(F.lit(1)), "outside": F.count_if(~F.coalesce(part.isin(*scope), F.lit(False))) if scope is not None else F.sum(F.lit(0)), "nulls": F.count_if(F.array_contains(F.array(*(F.col(f"`{c}`").isNull() for c in required)), True)) if required else F.sum(F.lit(0))}
        if self.by is None:
            rows = rows.repartition(PART)  # buckets are of like size; rows of a key share one, so that the window needs no other exchange
        if key:
            rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(PART, *key).orderBy(F.lit(1))))
            counts["repeated"] = F.count_if(F.col("_nth") > 1)
        if self.by is not None:
            rows = rows.hint("rebalance", PART)  # values may be of any size: large ones are split over tasks
        rows = rows.observe(seen, *(c.alias(n) for n, c in (counts | (observed or {})).items()))
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(PART, *(F.col(f"`{c}`") for c in schema.fieldNames())).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        got = seen.get
        broken = {n: got[n] for n in ("outside", "nulls", "repeated") if got.get(n)}
        if broken:
            self._fs.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
            raise Breach(f"not made current: {broken}")
        fresh = {unquote(n.split("=", 1)[1]): f"{folder}/{n}" for n in self._names(f"{self.path}/{folder}") if n.startswith(f"{PART}=")}
        now = base
        while True:
            touched = set(base["parts"]) | set(now["parts"]) | set(fresh) if scope is None else set(scope)
            if any(base["parts"].get(p) != now["parts"].get(p) for p in touched) or now["settings"] != base["settings"]:
                self._fs.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
                raise Conflict(f"version {now['version']} replaced parts that this write had read")
            parts = {p: f for p, f in now["parts"].items() if p not in touched} | fresh
            manifest = {
                "version": now["version"] + 1,
                "at": datetime.now(timezone.utc).isoformat(),
                "schema": schema.jsonValue(),
                "parts": parts,
                "batches": [*now["batches"], *([batch] if batch else [])][-REMEMBERED:],
                "settings": settings or now["settings"],
                "written": sorted(fresh),
                "removed": sorted(touched & set(now["parts"]) - set(fresh)),
                "metrics": {k: v for k, v in got.items() if isinstance(v, int)},
            }
            if self._put(manifest):
                return manifest
            now = self.manifest()

    # ---- old versions

    def vacuum(self, last: int = 2, older_than_s: float = 3600) -> int:
        """Forget all but the last versions and delete folders that none of them lists; younger ones may belong to a write that goes on."""
        versions = self.versions()
        for v in versions[: -max(1, last)]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/manifests/{v:010d}.json"), False)
        used = {f for v in self.versions() for f in self.manifest(v)["parts"].values()}
        deleted, before = 0, (time.time() - older_than_s) * 1000
        for folder in self._names(f"{self.path}/data"):
            top = self._hadoop.Path(f"{self.path}/data/{folder}")
            own = [n for n in self._names(f"{self.path}/data/{folder}") if n.startswith(f"{PART}=")]
            if self._fs.getFileStatus(top).getModificationTime() > before:
                continue
            for n in own:
                if f"data/{folder}/{n}" not in used:
                    self._fs.delete(self._hadoop.Path(f"{self.path}/data/{folder}/{n}"), True)
                    deleted += 1
            if not any(f"data/{folder}/{n}" in used for n in own):
                self._fs.delete(top, True)
        return deleted


class BucketTable(PartTable):
    """A keyed table in hash buckets; a merge reads and rewrites only the buckets that the incoming keys fall into."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_key", buckets: int = 64):
        super().__init__(spark, path)
        self.key, self.buckets = key, buckets

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("string")

    def merge(self, incoming: DataFrame, now: datetime, batch: str | None = None, tries: int = 5) -> dict[str, int]:
        """Upsert incoming rows by key (see store.upsert) into the next version; returns outcomes of incoming rows.

        Rows without a key are left out. A batch whose name is remembered is not merged again, so that a stream may hand it over twice.
        A lost race is run again on the winner's version.
        """
        staged = keep(incoming.where(F.col(self.key).isNotNull()), "incoming")
        for attempt in range(tries):
            base = self.manifest()
            if batch is not None and batch in base["batches"]:
                return {"new": 0, "changed": 0, "unchanged": 0}
            buckets = base["settings"].get("buckets", self.buckets)
            touched = [r[0] for r in staged.select(self._bucket(buckets)).distinct().collect()]  # no more than there are buckets
            if not touched:
                return {"new": 0, "changed": 0, "unchanged": 0}
            existing = self._rows(base, touched) if base["schema"] else staged.limit(0)
            merged = upsert(existing, staged, now)
            schema = merged.drop("outcome").schema
            names = ("new", "changed", "unchanged")
            try:
                got = self._write(
                    merged.withColumn(PART, self._bucket(buckets)), schema, lambda _, t=touched: t, (self.key,), (self.key,), base, batch, {"buckets": buckets},
                    {n: F.count_if(F.col("outcome") == n) for n in names},
                )
                return {n: got["metrics"][n] for n in names}
            except Conflict:
                if attempt + 1 == tries:
                    raise
            except PySparkException:
                # a bucket that a vacuum or another writer took away while it was read
                if attempt + 1 == tries or self.manifest()["version"] == base["version"]:
                    raise
        raise Conflict("unreachable")

    def rebucket(self, buckets: int) -> dict:
        """Deal all rows out again: for tables that outgrew their number of buckets."""
        base = self.manifest()
        rows = self._rows(base)
        return self._write(rows.withColumn(PART, self._bucket(buckets)), rows.schema, lambda _: None, (self.key,), (self.key,), base, None, {"buckets": buckets})

    def lookup(self, keys: list[str]) -> DataFrame:
        """The rows of some keys, read from their buckets only."""
        base = self.manifest()
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` string")
        own = [r[0] for r in wanted.select(self._bucket(base["settings"]["buckets"])).distinct().collect()]
        return self._rows(base, own).join(F.broadcast(wanted), self.key, "left_semi")

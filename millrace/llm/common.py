"""What the operators share: tables cut from their lineage, words, shingles and hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters 9 to 13; bytes.split() cuts at the same six bytes.
CHUNK_BYTES = 4 << 20
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or one of our own where that is unset.

    The fallback is meant for tests and single-machine runs; on a cluster without the
    setting it is a folder of the (shared) warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = "file:///tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read back: later reads survive lost executors and don't recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that keep() gave and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it once results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps whose results are written, and gives the driver's free memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


#: A key with more than this part of all rows is hot; so there are fewer hot keys than HOT, which are broadcast.
HOT = 2000


def with_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, hot: int = HOT) -> DataFrame:
    """rows joined with a counted table (keys, n, ...) of theirs; the rows of hot keys stay where they are, so that no task gets them all.

    All others are sorted and merged at every size: a table that is broadcast while it is small would hide what the join of a larger one shuffles.
    """
    least = max(1, total // hot)
    many, few = counted.where(F.col("n") > least), counted.where(F.col("n") <= least)
    return rows.join(F.broadcast(many), keys).unionByName(rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(few.hint("merge"), keys))


_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembered(name: str, clear: Callable[[], None]) -> None:
    """Registers how something that a Python worker remembers from task to task is forgotten."""
    _REMEMBERED[name] = clear


def forget(but: str = "") -> None:
    """A worker that turns to an operator frees what it remembered for others; results don't depend on it."""
    for name, clear in _REMEMBERED.items():
        if name != but:
            clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, changed until df has none like them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def needs_integer_id(docs: DataFrame) -> None:
    """Operators that order documents by doc_id, or pack it, take integers of any width; the others keep whatever kind it is."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be an integer column here, not {kind}")


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 of text with A-Z lower-cased; other letters stay. Null is empty."""
    return (text or "").encode("utf-8", "replace").lower()


def word_chunks(text: str | None, overlap: int = 0) -> Iterator[list[bytes]]:
    """Lower-cased words in order, as lists of bounded size; each list after the first repeats the last `overlap` words.

    Every list has more than `overlap` words, and so brings new ones; but a text that has no more in all
    comes as one list, empty or not at all if it has none. A text of any length needs memory for one
    chunk of words besides itself.
    """
    data = ascii_lower(text)
    if len(data) <= CHUNK_BYTES:
        yield data.split()
        return
    start, carry, begun = 0, [], False
    while start < len(data):
        stop = start + CHUNK_BYTES
        if stop < len(data):
            while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
                stop += 1
        words = carry + data[start:stop].split()
        if len(words) > overlap:
            yield words
            begun, words = True, words[len(words) - overlap :]
        carry, start = words, stop
    if carry and not begun:
        yield carry


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """k-word shingles with repeats, space-joined; fewer words give the whole sequence, none give none."""
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it grows beyond its bound."""

    def __init__(self, bound: int = 100_000, seed: int = 0):
        super().__init__()
        self.bound, self.seed = bound, seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.bound:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))

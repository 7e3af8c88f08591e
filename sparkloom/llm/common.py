"""What the corpus operators share: written intermediate tables, hashed words, connected components."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashing constants. Odd multipliers, so that they can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all tasks run on this
    machine, as in tests, a new local one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    _written[made] = spark
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


#: Spark's setting by which a statement's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors. The shuffle files
    behind the written table are deleted, so that a long job holds those of one step at a time."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that save() gave and that is read no more."""
    spark, folders = df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def drop_written() -> None:
    """Deletes the intermediate tables of this process."""
    for path, spark in list(_written.items()):
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended already
            pass
    _written.clear()


def all_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(2 * n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


INVERSE = pow(BASE, -1, 1 << 64)
#: A random value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For bytes.translate: A-Z become a-z, and whitespace a space.
PLAIN = np.where(SPACE, np.uint8(32), LOWER).tobytes()


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, A-Z taken as a-z."""
    return plain_words(data.tobytes().translate(PLAIN))[:2]


def plain_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after it) of each word of a text that went through PLAIN."""
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    gap = np.ones(len(data) + 2, bool)
    np.equal(data, 32, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    first, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data)), out=sums[1:])
    return mix((sums[end] - sums[first]) * powers(len(data) + 1, INVERSE)[first] + (end - first).astype(np.uint64)), first, end


def utf8(column) -> list[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def hashed_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; of all words, if there are fewer; of none, if there are none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = (out + words[i : len(words) - k + 1 + i]) * np.uint64(BASE)
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(k))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in edges; component is the smallest node that it reaches.

    Alternates large-star and small-star steps: each round links nodes to the smallest neighbour, so chains halve.
    Every round is a distributed aggregation and a join, and is written before the next begins."""
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = save(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        near = both(edges)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = near.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = save(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

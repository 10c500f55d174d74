"""Tables in the shared folder, blobs of packed integers and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and driver and executors are one process, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a cluster it must be set: a local one would be another on each machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or LOCAL_SHARED


_WRITTEN: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/barloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this application and returns their number. Call it when results are written:
    DataFrames that operators have returned read those tables."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession, per_shuffle_partition: int = 4) -> int:
    return per_shuffle_partition * max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_CLAIMED: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called where an operator starts in a worker: frees what others have left there, as workers are reused.

    What they remember is cleared, and memory that Arrow's pool and the allocator still hold goes back to the system."""
    if name in _CLAIMED:
        return
    while _CLAIMED:
        _CLAIMED.popitem()[1]()
    _CLAIMED[name] = clear
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class Remembered(dict):
    """A dict of bounded cost in bytes. When half of that has been put in, it begins anew; what it held until then is
    found in ``older``, until the next time."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = self.left = limit // 2
        self.older: dict = {}

    def put(self, key, value, cost: int) -> None:
        self.put_all(((key, value),), cost)

    def put_all(self, items, cost: int) -> None:
        """Puts in pairs (key, value), of that cost together."""
        if cost > self.left:
            self.older = dict(self)
            self.clear()
            self.left = self.limit
        self.left -= cost
        self.update(items)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, each with as many underscores appended as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def quoted(df: DataFrame) -> list[str]:
    """The columns of ``df``, as select() takes them whatever is in their names."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def slices(batches, rows: int):
    """Arrow batches of at most so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array, transposed by significance so that equal high bytes compress away."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 8
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).reshape(n) if n else np.zeros(0, np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """As pack(), of the differences of an ascending array."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    return pack(np.diff(v, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def bitmap_of(df: DataFrame, column: str, log2_words: int = 20) -> np.ndarray:
    """A one-hash Bloom bitmap of a column of hashes: at most 2**log2_words words of 64 bits whatever the input's size."""
    h = F.col(column)
    word = h.bitwiseAND(F.lit((1 << log2_words) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    rows = df.where(F.col(column).isNotNull()).select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << log2_words, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    h = hashed.astype(np.int64).view(np.uint64)
    return (bitmap[(h & np.uint64(len(bitmap) - 1)).astype(np.int64)] >> (h >> np.uint64(58))) & np.uint64(1) == 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id with an edge to another one; component is the smallest id that it reaches.

    Alternating large-star and small-star steps. A hub is pre-aggregated to its smallest neighbour before the shuffle
    and its rows are only ever joined to that one row, so adaptive skew joins can split it. Null ends are ignored.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    cur = saved(edges.where(F.col(a) != F.col(b)).select(hi.alias("hi"), lo.alias("lo")).distinct(), "edges")
    mark = None
    while True:
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select("lo", "hi"))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")), "large")
        least = saved(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        cur = saved(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    # a star forest: each id has its centre as its only lower neighbour
    return cur.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(cur.select(F.col("lo"), F.col("lo")).distinct())


def smallest_ids(owners: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) for owners' (node, first): the smallest ``first`` among all nodes that the links (a, b) connect.

    Nodes whose ``first`` is null connect others all the same."""
    found = connected_components(links, a, b)
    rooted = saved(owners.join(found, F.col("node") == F.col("id"), "left").select("node", "first", F.coalesce("component", "node").alias("root")), "rooted")
    least = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    return saved(rooted.join(least, "root").select("node", "component_id"), "components")

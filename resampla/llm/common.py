"""Shared pieces of the corpus operators: scratch tables, Arrow text buffers, token hashing, components.

Texts are handled as Arrow buffers: the UTF-8 bytes of a whole batch lie in one array, with
document offsets beside it, so tokenising and hashing are vectorised over the batch.  Batches are
worked through in slices of a few MB, which bounds the memory of a Python worker whatever the
length of a document's neighbours.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import platform
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_LIBC = ctypes.CDLL("libc.so.6") if platform.libc_ver()[0] == "glibc" else None
SLICE_BYTES = 2 << 20

# ---------------------------------------------------------------- scratch tables


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that a Python worker's memory doesn't follow the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a local one only in local mode where unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="resampla-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; its owner clears the shared folder then
        pass


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write a table into the shared folder (a folder for each value of ``by``) and read it again.

    Unlike an executor-local copy it survives lost executors.  Removed by ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/resampla-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Remove scratch tables that ``materialize`` wrote (or one folder of them), once their last reader is done."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.endswith(part):
                _remove(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more; it does so as the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system; a Python worker otherwise keeps the most that it ever took."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(run):
    """``run`` over batches, after which the worker gives back what it has freed."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text buffers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first document, last document, bytes, offsets) of runs of whole documents of about ``limit`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words between bytes of ``between``; by default ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~between[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


# ---------------------------------------------------------------- hashing

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n``."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """p with p[e] - p[s] = base**s * (hash of data[s:e]), for all s <= e."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes have equal hashes wherever they lie."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, documents and 64-bit hashes of the words of A-Z-lowered bytes."""
    starts, ends, docs = words(data, offsets)
    return starts, ends, docs, span_hash(prefix_hash(data), starts, ends)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each distinct mixed hash, and the number of its kind for each element; without a sort."""
    n = len(h)
    bits = max(4, int(2 * n).bit_length())
    slot = (h >> U64(64 - bits)).astype(np.int64)
    holder = np.empty(1 << bits, np.int64)
    holder[slot] = np.arange(n)
    found = holder[slot]
    first = np.flatnonzero(found == np.arange(n))
    number = np.empty(n, np.int64)
    number[first] = np.arange(len(first))
    kind = number[found]
    rest = np.flatnonzero(h[found] != h)  # kinds that lost their slot to another
    if len(rest):
        _, at, inverse = np.unique(h[rest], return_index=True, return_inverse=True)
        kind[rest] = len(first) + inverse
        first = np.r_[first, rest[at]]
    return first, kind


def shingles(h: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and first words of all k-word shingles; they don't cross documents.

    A document of one to k-1 words has its whole sequence as its one shingle.
    """
    n = len(h)
    if not n:
        return h, docs, docs
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    size = np.diff(np.r_[first, n])
    short, at = size < k, np.arange(max(0, n - k + 1))
    at = at[docs[at] == docs[at + k - 1]] if len(at) else at
    g = np.zeros(len(at), np.uint64)
    for j in range(k):
        g = mix(g * _BASE + h[at + j] + U64(j + 1))
    extra = first[short]
    e = np.zeros(len(extra), np.uint64)
    for j in range(k - 1):
        live = size[short] > j
        e[live] = mix(e[live] * _BASE + h[extra[live] + j] + U64(j + 1))
    e = mix(e + size[short].astype(np.uint64))
    at = np.r_[at, extra]
    return np.r_[g, e], docs[at], at


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, name: str, most: int = 50) -> DataFrame:
    """(node, component) of the nodes that ``edges`` (a, b: long) name; component: the smallest node reached.

    Alternating large-star and small-star steps: each only takes minima (combined before the
    shuffle) and equi-joins, whose hot keys the adaptive planner splits, and ends when nothing
    changes, in about the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = held = materialize(e, name)
    seen = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        e = big.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct()
        before, e = held, materialize(e, name)
        held = e
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    tree = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = tree.select(F.col("component").alias("node"), "component").distinct()
    return tree.unionByName(roots)

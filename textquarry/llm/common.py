"""Shared helpers: the shared work folder, whole-row ids, vectorised word hashing and connected components."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one numpy pass looks at; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


# --------------------------------------------------------------------------- work folder


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/_work"


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder among those of this application."""
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Drop all stored tables of this application, once no result needs them any more."""
    drop_path(spark, f"{work_dir(spark)}/{spark.sparkContext.applicationId}")


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back: lineage ends there and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], names: list[str]) -> list[str]:
    """``names``, each with ``_`` appended until no column of ``taken`` is called so (in any case)."""
    out, have = [], {c.lower() for c in taken}
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def mapped(df: DataFrame, kernel, appended: tuple[StructField, ...] = ()) -> DataFrame:
    """``kernel`` over Arrow batches of ``df``, all of whose columns it returns by position, and ``appended`` ones after them."""
    plain = [f"c{k}" for k in range(len(df.columns) + len(appended))]

    def named(batches):
        for batch in kernel(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain)

    fields = [StructField(name, f.dataType) for name, f in zip(plain, [*df.schema.fields, *appended])]
    return df.toDF(*plain[: len(df.columns)]).mapInArrow(named, StructType(fields)).toDF(*df.columns, *(f.name for f in appended))


#: Rows of an Arrow batch of texts: small, as one text may be very long.
BATCH_ROWS = 1_000


def in_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches kept small for what Python reads from it."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- words in numpy

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(mult: int, n: int) -> np.ndarray:
    have = _powers.get(mult)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, mult, np.uint64)
        out[0] = 1
        _powers[mult] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _trim() -> None:
    """Give freed memory back to the system: workers outlive the task whose arrays they held."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library: nothing to trim
    _libc = None


def passes(column: pa.Array, limit: int = PASS_BYTES):
    """Slices of a string column as (first row, bytes, offsets); nulls count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    _trim()


def word_spans(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE):
    """Starts and ends (bytes) of maximal runs without ``gap`` bytes, and the first word of each row (rows + 1)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~gap[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    left = np.empty(n, bool)
    left[0] = True
    left[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (left | cut[:-1]))
    right = np.empty(n, bool)
    right[-1] = True
    right[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (right | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, letters A-Z as a-z."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(_MULT, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INV, n)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5):
    """For each row the sorted distinct hashes of its ``width``-word shingles; of fewer words, the whole sequence as one."""
    starts, ends, first = word_spans(data, offs)
    h = word_hashes(data, starts, ends)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled += h[k : len(h) - width + 1 + k] * _power(0xC2B2AE3D27D4EB4F | 1, width + 1)[k + 1]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = (h[a:b] * _power(0xA24BAED4963EE407 | 1, width + 1)[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


# --------------------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b: long): component is the smallest node reachable.

    Alternates the two star contractions: each node's larger neighbours move to its smallest neighbour, then its
    smaller ones do. Both are a grouped minimum and one equi-join, so a node with very many links is combined before the
    shuffle and its join rows can be split. Every round's edges are written to the shared folder.
    """
    spark = edges.sparkSession
    edges, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("e"))
        small = small.select("e.a", F.col("e.low").alias("b")).where("a <> b").distinct()
        after, new = stored(small, name)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        edges, path = after, new
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# --------------------------------------------------------------------------- picking rows by id

#: Ids that a broadcast may hold, at most; beyond it the same join shuffles both sides.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (one column of fixed width) hinted for broadcast if it is proven small."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``ids`` (doc_id); rows without a doc_id stay."""
    return docs.join(sized(ids.where("doc_id is not null").distinct()), "doc_id", "left_anti").select(columns(docs))

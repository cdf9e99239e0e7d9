"""Ranking: named signals of a path and a size, their sum, and orders made from it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import columns as C
from textquarry.functions import fixed as V


def _ends(text: Column, endings: tuple[str, ...]) -> Column:
    return text.rlike(f"(?:{'|'.join(endings)})$")


def signals(path: Column, size: Column) -> Column:
    """An array of (key, weight, detail), in the order in which they are added up."""
    stem, ext, depth, parts = C.stem(path), C.extension(path), C.depth(path), C.segments(path)
    top = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    said = F.concat(F.lit("depth "), depth.cast("string"))

    def signal(key: str, weight, detail: Column) -> Column:
        weight = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
        return F.struct(F.lit(key).alias("key"), weight.alias("weight"), detail.alias("detail"))

    blank, kilo = F.lit(""), F.concat(F.floor(size / 1024).cast("string"), F.lit("kB"))
    found = [
        F.when(stem.startswith("readme"), signal("readme", 7.0, stem)).when(stem.isin(*V.ANCHOR_STEMS), signal("anchor", 2.4, stem)).when(_ends(stem, V.ANCHOR_ENDINGS), signal("anchor-suffix", 1.3, stem)),
        F.when(top.isin(*V.ROOT_MARKERS), signal("source-root", 1.9, top)),
        F.when(ext.isin(*V.SOURCE_EXTS), signal("source", 1.5, ext)).when(ext.isin(*V.DOC_EXTS), signal("docs", 1.0, ext)).when(ext.isin(*V.CONFIG_EXTS), signal("config", 0.7, ext)),
        F.when(depth == 0, signal("top-level", 1.2, path)).when(depth <= 2, signal("shallow", 0.6, said)),
        F.when(_ends(stem, V.STRUCTURAL_ENDINGS) & ext.isin(*V.SOURCE_EXTS, *V.CONFIG_EXTS), signal("structural", 1.4, stem)),
        F.when(stem.isin(*V.NOISE_STEMS), signal("boilerplate-doc", -4.0, stem)),
        F.when(F.exists(F.array(*map(F.lit, V.GENERATED_MARKERS)), lambda m: F.contains(path, m)), signal("generated", -3.5, blank)),
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, V.VENDOR_DIRS))), signal("vendored", -3.0, blank)),
        F.when(top.isin(*V.LOW_VALUE_DIRS), signal("low-value-dir", -1.5, top)),
        F.when(size > 300_000, signal("huge", -2.5, kilo)).when(size > 80_000, signal("large", -1.2, kilo)).when(size < 2_000, signal("small", 0.4, F.concat(size.cast("string"), F.lit("B")))),
        F.when(depth > 2, signal("depth", F.least(depth - 2, F.lit(6)) * -0.45, said)),
    ]
    return F.array_compact(F.array(*found))


def scored(files: DataFrame) -> DataFrame:
    """``files`` (path, size, ...) with signals and score."""
    files = C.bound(files, signals=signals(F.col("path"), F.col("size")))
    total = F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + s["weight"])
    return files.withColumn("score", F.round(total, 4))


def ranked(files: DataFrame) -> DataFrame:
    return (files if "score" in files.columns else scored(files)).orderBy(F.desc("score"), "path")


def top(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by rank, 0 for all: on metadata, so no text is read for the others."""
    order = ranked(files)
    return order.limit(n) if n else order


def scan_cut(files: DataFrame, n: int) -> DataFrame:
    """``files`` with ``considered``: whether they are among the first ``n`` (0: all).

    The cut is the n-th row's (score, path), found by a bounded top-n, and one comparison then marks every row.
    """
    if not n:
        return files.withColumn("considered", F.lit(True))
    last = files.select("score", "path").orderBy(F.desc("score"), "path").limit(n).orderBy("score", F.desc("path")).first()
    if last is None:
        return files.withColumn("considered", F.lit(True))
    return files.withColumn("considered", (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (F.col("path") <= last["path"])))


def round_robin(files: DataFrame) -> DataFrame:
    """Rank 0 of every directory, then rank 1, and so on; ``turn`` is the rank in the directory."""
    order = Window.partitionBy("dirname").orderBy(F.desc("score"), "path")
    return files.withColumn("turn", F.row_number().over(order) - 1).orderBy("turn", "dirname")


def boosted(files: DataFrame, distances: DataFrame, weight: float, resort: bool = False) -> DataFrame:
    """Scores plus ``weight`` times the decay to the power of the hops; files nobody reaches keep theirs.

    The order of the input is kept unless ``resort``.
    """
    if not math.isfinite(weight):
        raise ValueError("the reach weight must be a finite number")
    gain = F.round(F.lit(weight) * F.pow(F.lit(V.HOP_DECAY), F.col("hops").cast("double")), 4)
    out = files.join(distances.select("path", "hops"), "path", "left")
    out = out.withColumn("score", F.when(F.col("hops").isNull(), F.col("score")).otherwise(F.round(F.col("score") + gain, 4)))
    if "signals" in files.columns:
        reach = F.struct(F.lit("reachable").alias("key"), gain.alias("weight"), F.concat(F.col("hops").cast("string"), F.lit(" hops")).alias("detail"))
        out = out.withColumn("signals", F.when(F.col("hops").isNull(), F.col("signals")).otherwise(F.concat("signals", F.array(reach))))
    out = out.select(*files.columns, "hops")
    return ranked(out) if resort else out


def explained(files: DataFrame) -> DataFrame:
    """path, score and one line of text that names every signal."""
    parts = F.transform("signals", lambda s: F.concat(s["key"], F.format_string(" %+.1f", s["weight"])))
    return files.select("path", "score", F.concat(F.format_string("%6.2f", "score"), F.lit("  "), F.col("path"), F.lit("  "), F.array_join(parts, ", ")).alias("line"))

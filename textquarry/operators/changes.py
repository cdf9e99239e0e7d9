"""Changes between snapshots, and bursts of changes joined into one rebuild."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind) of what was added, modified or deleted between two snapshots (path, mtime_ns, size)."""
    a = before.select("path", F.struct("mtime_ns", "size").alias("a"))
    b = after.select("path", F.struct("mtime_ns", "size").alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind")).where("kind is not null")


def ordered(changes: DataFrame) -> DataFrame:
    return changes.orderBy(F.col("kind") == "deleted", "path")


def bursts(events: DataFrame, settle: float, key: str = "key") -> DataFrame:
    """(key, burst, begin, end, n): events of a key closer than ``settle`` seconds belong together; ``t`` is in seconds."""
    order = Window.partitionBy(key).orderBy("t", "id")
    gap = F.col("t") - F.lag("t").over(order)
    marked = events.withColumn("fresh", F.when(gap.isNull() | (gap > settle), 1).otherwise(0))
    numbered = marked.withColumn("burst", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "burst").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.count("*").alias("n"))


def rebuilds(events: DataFrame, settle: float, most: float, key: str = "key") -> DataFrame:
    """(key, at, n): a rebuild ``settle`` after the last of a burst's events, but ``most`` after the first at the latest.

    Bursts are cut by a built-in window: a gap longer than ``settle`` outlasts any rebuild that is due. A burst that ends
    within ``most`` is one rebuild; only in longer ones the latest-time rule depends on its own last decision and is a fold
    over one burst's events in time order.
    """
    late = F.col("t") > F.lag("t").over(Window.partitionBy(key).orderBy("t")) + settle
    order = Window.partitionBy(key).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    rows = events.select(key, "t", late.cast("int").alias("_late")).select(key, "t", F.coalesce(F.sum("_late").over(order), F.lit(0)).alias("_burst"))
    whole = Window.partitionBy(key, "_burst")
    rows = rows.withColumns({"_begin": F.min("t").over(whole), "_end": F.max("t").over(whole)})
    short = F.col("_end") <= F.col("_begin") + most
    once = rows.where(short).groupBy(key, "_burst").agg(F.least(F.max("_end") + settle, F.min("_begin") + most).alias("at"), F.count("*").alias("n")).select(key, "at", "n")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, first, due, n = [], None, None, 0
        for t in sorted(pdf["t"]):
            if first is not None and t > due:
                rows.append((pdf[key].iloc[0], due, n))
                first = None
            if first is None:
                first, n = t, 0
            n += 1
            due = min(t + settle, first + most)
        if first is not None:
            rows.append((pdf[key].iloc[0], due, n))
        return pd.DataFrame(rows, columns=[key, "at", "n"])

    kind = events.schema[key].dataType.simpleString()
    return once.unionByName(rows.where(~short).select(key, "t", "_burst").groupBy(key, "_burst").applyInPandas(fold, f"{key} {kind}, at double, n long"))


def snapshots(events: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of an event log: before ``cut`` and at its end; the last event of a path gives its stamp."""

    def at(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("path").agg(F.max(F.struct("mtime_ns", "size")).alias("x"))
        return last.select("path", "x.mtime_ns", "x.size")

    return at(events.where(F.col("mtime_ns") < cut)), at(events)



"""Orders over a whole corpus: running totals and row numbers by two levels of sums, and exact order statistics of many groups.

Neither puts a group, or the corpus, in one partition.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry import work

#: Parts that a group's range of values is cut into in each pass of the search for its order statistics.
DIGIT = 1_024


def running(rows: DataFrame, order: list[Column], ranges: list[Column] | None = None, **totals: Column) -> DataFrame:
    """``rows`` with a running total, in ``order``, for each of ``totals``; ``F.lit(1)`` numbers the rows from 1.

    ``ranges``, a coarser order, cuts the ranges where the values of ``order`` are too long to be sampled on the driver.

    Rows are dealt into ranges of the order and stored. The sums of the ranges, one row for each, are added up on the driver;
    within a range a window adds its own. ``order`` should be total: rows that compare equal are added together in any order.
    """
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"_{name}": value.cast("long") for name, value in totals.items()})
    dealt = work.stored(valued.repartitionByRange(n, *(ranges or order)).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted(dealt.groupBy("_range").agg(*(F.sum(f"_{name}").alias(name) for name in totals)).collect())  # a row for each partition
    before = [list(accumulate([r[name] or 0 for r in sums[:-1]], initial=0)) for name in totals]
    schema = ", ".join(["_range int", *(f"_{name}_before long" for name in totals)])
    start = spark.createDataFrame(list(zip((r["_range"] for r in sums), *before)), schema)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(start), "_range")
    out = out.withColumns({name: F.sum(f"_{name}").over(within) + F.col(f"_{name}_before") for name in totals})
    return out.select(*rows.columns, *totals)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def order_statistics(values: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """``ranks`` (keys, want, rank from 0) with the ``value`` of that rank among the ``values`` (keys, value: double) of its group.

    Each pass cuts the range that a wanted value lies in into ``DIGIT`` parts and counts them; the part that holds the rank is
    the range of the next pass, down to its own least and greatest value. A range ends when these are equal. Values are read
    once for each pass and counted before they are shuffled; nulls and NaN have no rank, a rank beyond the group no row.
    """
    values = work.stored(values.select(*keys, F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)"), "ranked-values")
    ends = values.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    state = ranks.join(ends, _same(ranks, ends, keys)).where("rank between 0 and n - 1").select(*(ranks[k] for k in keys), "want", F.col("rank").cast("long").alias("rank"), "lo", "hi")
    state = work.stored(state, "ranked-state")
    place = F.expr(f"least({DIGIT - 1}, cast(floor((value / 2 - lo / 2) / (hi / 2 - lo / 2) * {DIGIT}) as int))")
    first = Window.partitionBy(*keys, "want").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    done = []
    while True:
        done.append(state.where("lo = hi").select(*keys, "want", F.col("lo").alias("value")))
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        met = values.join(open_, _same(values, open_, keys)).where("value between lo and hi").select(*(open_[k] for k in keys), "want", "rank", "value", place.alias("part"))
        parts = met.groupBy(*keys, "want", "rank", "part").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        parts = parts.withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0)))  # at most DIGIT rows of each
        state = work.stored(parts.where("before <= rank and rank < before + n").select(*keys, "want", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi"), "ranked-state")

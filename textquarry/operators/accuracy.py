"""Accuracy of an estimate against true counts: calibration factor, errors, and tables by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry import work
from textquarry.functions import columns as C
from textquarry.functions import fixed
from textquarry.operators import ordered


def factor(pairs: DataFrame) -> DataFrame:
    """The least-squares factor of (estimate, truth); 1 if there is nothing to fit."""
    square = F.sum(F.col("estimate").cast("double") * F.col("estimate"))
    product = F.sum(F.col("estimate").cast("double") * F.col("truth"))
    return pairs.agg(F.when(F.coalesce(square, F.lit(0.0)) > 0, product / square).otherwise(1.0).alias("factor"), F.count("*").alias("n"))


def error(pairs: DataFrame) -> DataFrame:
    """Mean relative error; a true count of 0 adds nothing but is counted."""
    each = F.when(F.col("truth") != 0, F.abs(F.col("estimate") - F.col("truth")) / F.col("truth")).otherwise(0.0)
    return pairs.agg(F.coalesce(F.sum(each) / F.count("*"), F.lit(0.0)).alias("mape"))


def by_group(pairs: DataFrame, key: str = "ext", least: int = 5) -> DataFrame:
    """Error statistics by ``key`` and over all groups; groups of fewer than ``least`` rows count nowhere.

    The ninth decile and the median are order statistics, found by narrowing histograms; no group's errors come together.
    """
    pairs = pairs.where("truth > 0")
    kept = pairs.join(pairs.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")
    kept = kept.select(key, "estimate", "truth", (F.abs(F.col("estimate") - F.col("truth")) / F.col("truth")).alias("err"))
    rows = kept.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("whole"), key, "estimate", "truth", "err").withColumn(key, F.expr(f"if(whole, null, `{key}`)"))
    rows = work.stored(rows, "accuracy-rows")
    keys = ["whole", key]
    made = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("err"), 5).alias("mape"), F.round(F.sum(F.abs(F.col("estimate") - F.col("truth"))) / F.sum("truth"), 5).alias("weighted"),
        F.round(F.max("err"), 5).alias("worst"), F.round(F.avg((F.col("estimate") > F.col("truth")).cast("double")), 4).alias("over"),
    )
    made = work.stored(made, "accuracy-groups")
    decile = made.select(*keys, F.lit("p90").alias("want"), F.expr("least(floor(0.9D * n), n - 1)").alias("rank"))
    middle = made.select(*keys, F.explode(F.expr("map('low', (n - 1) div 2, 'high', n div 2)")).alias("want", "rank"))
    found = ordered.order_statistics(rows.withColumn("value", F.col("err")), decile, keys).unionByName(ordered.order_statistics(rows.withColumn("value", F.col("truth")), middle, keys))
    found = found.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max(F.when(F.col("want") == "p90", F.col("value"))).alias("p90"), F.avg(F.when(F.col("want") != "p90", F.col("value"))).alias("median"))
    met = made.join(found, made["whole"].eqNullSafe(found["_whole"]) & made[key].eqNullSafe(found[f"_{key}"]))
    return met.select(key, "n", "mape", "weighted", F.round("p90", 5).alias("p90"), "worst", "over", F.bround("median", 0).cast("long").alias("median_truth"))


def sampled(files: DataFrame, most: int, key: str = "ext", seed: int = 0) -> DataFrame:
    """At most ``most`` rows of every group, the same ones every time: those with the smallest hash of seed and path."""
    return _dealt(files, key, seed).where(F.col("_n") <= most).drop("_n")


def _dealt(files: DataFrame, key: str, seed: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(str(seed)), "path")), "path")
    return files.withColumn("_n", F.row_number().over(order))


def round_robin(files: DataFrame, most: int, key: str = "ext", seed: int = 0) -> DataFrame:
    """``most`` rows in all, one of every group in turn, in each group those with the smallest hash first."""
    return _dealt(files, key, seed).orderBy("_n", key).limit(most).drop("_n")


def piece_counts(files: DataFrame) -> DataFrame:
    """(path, cls, len, n): the pieces of every file, counted; the cost model is fitted on these, not on texts."""
    rows = files.select("path", F.explode(C.pieces(F.col("text"))).alias("p"))
    return rows.groupBy("path", C.piece_class(F.col("p")).alias("cls"), F.length("p").alias("len")).agg(F.count("*").alias("n"))


def _packed(pieces: DataFrame) -> DataFrame:
    """A row for each file of ``pieces`` (path, truth, cls, len, n): truth, and the classes, lengths and counts of its pieces."""
    cls = F.array_position(F.array(*map(F.lit, fixed.TOKEN_COSTS)), F.col("cls")) - 1
    one = pieces.groupBy("path").agg(F.first("truth").cast("double").alias("truth"), F.collect_list(F.struct(cls.cast("int").alias("c"), F.col("len").cast("int").alias("len"), F.col("n").cast("long").alias("n"))).alias("p"))
    return work.stored(one.select("truth", F.col("p.c").alias("c"), F.col("p.len").alias("len"), F.col("p.n").alias("n")), "fitted-files")


def _errors(packed: DataFrame, trials: list[dict]) -> list[float]:
    """Mean relative error of every model of ``trials`` over the files of ``_packed``: one pass prices all of them."""
    ratios, free = (np.array([[m[c][k] for c in fixed.TOKEN_COSTS] for m in trials], float) for k in (0, 1))

    def add(batches):
        total = np.zeros(len(trials) + 1)
        for batch in batches:
            if batch.num_rows:
                c, size, n = (batch.column(k).flatten().to_numpy() for k in (1, 2, 3))
                each = np.where(size <= free[:, c], 1.0, (size - free[:, c]) / ratios[:, c]) * n
                starts = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())[:-1]])
                truth = batch.column(0).to_numpy()
                total += [*(np.abs(np.add.reduceat(each, starts, axis=1) - truth) / truth).sum(axis=1), len(truth)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "s"])

    *sums, n = [r["s"] for r in packed.mapInArrow(add, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()] or [0.0]
    return [x / max(n, 1) for x in sums] or [0.0] * len(trials)


def descended(pieces: DataFrame, rounds: int = 6, costs: dict[str, tuple[float, float]] = fixed.TOKEN_COSTS) -> tuple[dict, float]:
    """The model to which coordinate descent leads over the files of ``pieces`` (path, truth, cls, len, n), and its mean error.

    A parameter moves up or down by a step while the error falls; then the step is halved. The moves that follow a model are
    priced together in one pass, and the first that helps is made; no histogram leaves the executors.
    """
    moves = [(name, part, sign) for name in costs for part in (0, 1) for sign in (1, -1)]

    def moved(model: dict, name: str, part: int, sign: int, step: float) -> dict:
        pair = list(model[name])
        pair[part] = max(0.2 if part == 0 else 0.0, pair[part] * (1 + sign * step) + (sign * step if part else 0))
        return model | {name: tuple(pair)}

    best, packed = dict(costs), _packed(pieces)
    (least,) = _errors(packed, [best])
    for step in (0.2 * 0.5**k for k in range(rounds)):
        at, idle = 0, 0  # the next move to try, and how many in a row have not helped
        while idle < len(moves):
            ahead = moves[at:]
            trials = [moved(best, *move, step) for move in ahead]
            hit = next(((k, e) for k, e in enumerate(_errors(packed, trials)) if e < least - 1e-9), None)
            if hit is None:
                idle, at = (idle + len(ahead) if at else len(moves)), 0
                continue
            best, least, idle, at = trials[hit[0]], hit[1], 0, (at + hit[0] + 1) % len(moves)
    return best, least


def fitted(files: DataFrame, vocabulary: str, samples: int | None = 900, hold_out: float = 0.3):
    """A cost model fitted to exact counts of ``samples`` files (None: of all), and its error on the fit and on the rest.

    Samples are the smallest hashes of the path, and so are those that are held out of them.
    """
    rows = files.where("text is not null").select("path", "text")
    chosen = rows if samples is None else rows.join(rows.select("path").orderBy(F.xxhash64("path"), "path").limit(samples), "path", "left_semi")
    truth = C.with_exact_tokens(chosen, vocabulary).where("tokens > 0").select("path", F.col("tokens").alias("truth"))
    pieces = work.stored(piece_counts(chosen).join(truth, "path"), "fitted-pieces")
    held = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(1_000)) < int(1_000 * hold_out)
    model, error = descended(pieces.where(~held))
    rest = pieces.where(held)
    return model, error, error if rest.isEmpty() else _errors(_packed(rest), [model])[0]

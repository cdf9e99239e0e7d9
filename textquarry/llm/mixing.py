"""Mixing sources to target weights: soft memberships, and rates by distributed projected-gradient least squares.

A softmax classifier, fitted on a bounded sample of the labelled table (``SAMPLE_ROWS``, smallest hash of doc_id first),
gives each document a posterior over domains. A document's rate r says how often it is to be drawn; the expected share of
domain d is ``share_d = sum_i r_i * tokens_i * p_id`` over all tokens. Rates minimise the plain sum of squares of ``share -
target`` over ``LEAST <= r <= MOST``, from r = 1: no target is left out, whatever supplies it, ``MOST`` says how often one
document may be drawn, and ``LEAST`` is above 0, so that a target out of reach takes no document away. Targets that such rates can reach are met. One that they cannot is missed by as little as the sum of
squares allows, which leaves the others close to theirs, and the wanted and reached shares stand beside the rates.

A step moves a rate against the gradient, ``p_i . (share - target)`` for each token of the document, and back into its bounds.
Its length is ``PACE``, so great that the gradient has to be taken where the step ends, not where it begins: that makes an
implicit step, which never overshoots. Its end is where ``e = share(clip(r - PACE p . e)) - target`` for a vector e of one
number for each domain, found by Newton steps with several trial lengths at once. A trial is one aggregate over a slim table of
tokens and posteriors, so a fit takes some twenty passes over that table and the driver holds a few numbers for each domain.
The steps are then replayed on every document, so texts and other columns are never written in between.

The fit ends when every share is within ``WITHIN`` of its target or a step moves none by more than that. After ``STEPS`` steps
without that it raises and gives no rates.

Domains of the query: ``good`` (quality 1), ``poor`` (quality 0) and ``toxic`` (toxic 1).

Defined results: null and empty texts have 0 tokens and the posterior of an empty vector, and a rate like any other;
repeated rows have equal rates; without labels the posterior is uniform; rows without any tokens at all leave every rate at 1
and reach no share; other columns are carried through, and a column of theirs that is called like a new one (n_tokens, p, rate,
wanted, reached) stays, the new one having ``_`` appended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField

from . import common
from .quality import _KIND

SAMPLE_ROWS = 6_000
DOMAINS = ("good", "poor", "toxic")
#: Share of the expected tokens that each domain is to have.
TARGETS = {"good": 0.88, "poor": 0.04, "toxic": 0.08}
#: How often a document is drawn, at least and at most.
LEAST, MOST = 0.05, 100.0
#: The length of a step, the shares within which the fit ends, and the steps after which it gives up.
PACE, WITHIN, STEPS = 1e8, 1e-6, 100
#: Lengths of a Newton step that are tried at once, and how many such steps a search takes at most.
_TRIALS, _NEWTON = np.concatenate([0.5 ** np.arange(8), 0.1 ** np.arange(3, 10)]), 100
_WORDS = 1 << 14
_SHAPES = 1 << 9
WIDTH = _WORDS + _SHAPES


def features(data: np.ndarray, offs: np.ndarray):
    """Sparse rows: (row, column, value), and the number of words of each text."""
    starts, ends, first = common.word_spans(data, offs)
    n, rows = np.diff(first), len(offs) - 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float), n
    row = np.repeat(np.arange(rows), n)
    word = (common.word_hashes(data, starts, ends) >> np.uint64(20)).astype(np.int64) % _WORDS
    kind = _KIND[data].astype(np.int64)
    shape = _WORDS + kind[starts] + 8 * kind[ends - 1] + 64 * np.minimum((ends - starts) // 3, 7)
    out = []
    for col, weight in ((word, 1.0), (shape, 2.0)):
        keys, count = np.unique(row * WIDTH + np.minimum(col, WIDTH - 1), return_counts=True)
        r = keys // WIDTH
        v = np.log1p(count)
        norm = np.sqrt(np.bincount(r, v**2, rows))
        out.append((r, keys % WIDTH, weight * v / norm[r]))
    return (*(np.concatenate(x) for x in zip(*out)), n)


@dataclass(frozen=True)
class Softmax:
    weights: np.ndarray  # classes x WIDTH
    bias: np.ndarray

    def posterior(self, row, col, val, rows: int) -> np.ndarray:
        z = np.column_stack([np.bincount(row, w[col] * val, rows) for w in self.weights]) + self.bias if rows else np.zeros((0, len(self.bias)))
        z = np.exp(z - z.max(axis=1, keepdims=True)) if rows else z
        return z / z.sum(axis=1, keepdims=True) if rows else z


def fit(row, col, val, y: np.ndarray, classes: int, steps: int = 200, rate: float = 0.5, ridge: float = 1e-4) -> Softmax:
    """Full-batch Adagrad on the ridge-penalised log loss."""
    model = Softmax(np.zeros((classes, WIDTH)), np.zeros(classes))
    if not len(y):
        return model
    model.bias[:] = np.log((np.bincount(y, minlength=classes) + 1) / (len(y) + classes))
    one = np.eye(classes)[y]
    sq, sqb = np.full((classes, WIDTH), 1e-8), np.full(classes, 1e-8)
    for _ in range(steps):
        err = (model.posterior(row, col, val, len(y)) - one) / len(y)
        for c in range(classes):
            g = np.bincount(col, err[row, c] * val, WIDTH) + ridge * model.weights[c]
            sq[c] += g**2
            model.weights[c] -= rate * g / np.sqrt(sq[c])
        g = err.sum(axis=0)
        sqb += g**2
        model.bias[:] -= rate * g / np.sqrt(sqb) * 0.1
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Softmax:
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("y")).where("y is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def sparse(batches):
        for batch in batches:
            for at, data, offs in common.passes(batch.column(0)):
                row, col, val, n = features(data, offs)
                order = np.argsort(row, kind="stable")
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, len(n)), batch.column(2).slice(at, len(n)), pa.ListArray.from_arrays(cuts, pa.array(col[order].astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(val[order].astype(np.float32)))],
                    names=["doc_id", "y", "col", "val"],
                )

    got = common.in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "doc_id", "y").mapInArrow(sparse, "doc_id long, y int, col array<int>, val array<float>").toArrow()
    if not got.num_rows:
        return Softmax(np.zeros((len(DOMAINS), WIDTH)), np.zeros(len(DOMAINS)))
    got = got.sort_by("doc_id")
    col, val = (got[c].combine_chunks() for c in ("col", "val"))
    row = np.repeat(np.arange(len(got)), np.diff(col.offsets.to_numpy()))
    return fit(row, col.flatten().to_numpy().astype(np.int64), val.flatten().to_numpy().astype(float), got["y"].to_numpy().astype(np.int64), len(DOMAINS))


def posteriors(docs: DataFrame, model: Softmax, moves: np.ndarray | None = None) -> DataFrame:
    """``docs`` with n_tokens (words), p (posterior by DOMAINS) and, given the ``moves`` of a fit, rate."""
    shared, again = docs.sparkSession.sparkContext.broadcast(model), replayed
    where = docs.columns.index("text")
    new = common.fresh(docs.columns, ["n_tokens", "p"] + (["rate"] if moves is not None else []))

    def apply(batches):
        for batch in batches:
            for at, data, offs in common.passes(batch.column(where)):
                row, col, val, n = features(data, offs)
                p = np.round(shared.value.posterior(row, col, val, len(n)), 9)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                rate = [] if moves is None else [pa.array(again(p, moves))]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(n)).columns, pa.array(n.astype(np.int64)), lists, *rate], names=[*batch.schema.names, *new])

    kinds = (LongType(), ArrayType(DoubleType()), DoubleType())
    return common.mapped(common.in_batches(docs), apply, tuple(StructField(name, kind) for name, kind in zip(new, kinds)))


def replayed(p: np.ndarray, moves: np.ndarray, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Rates of documents with posteriors ``p`` (rows x domains) after ``moves`` (a vector by domain for each step)."""
    r = np.ones(len(p))
    for e in moves:
        r = np.clip(r - PACE * (p @ np.asarray(e)), least, most)
    return r


@dataclass(frozen=True)
class Fit:
    moves: np.ndarray  # steps x domains
    wanted: np.ndarray  # shares of all tokens
    reached: np.ndarray


def _trials(members: DataFrame, tokens: float, least: float, most: float) -> Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """A function of (moves so far, trial steps): for each trial the shares of its rates, and the Gram matrix of the documents
    that are within their bounds; one aggregate over ``members`` (n_tokens, p)."""
    again = replayed

    def tried(moves: np.ndarray, trials: np.ndarray):
        domains = trials.shape[1]

        def add(batches):
            total = np.zeros((len(trials), domains + domains * domains))
            for batch in batches:
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                w, before = batch.column(0).to_numpy() / tokens, again(p, moves, least, most)
                for k, e in enumerate(trials):
                    y = before - PACE * (p @ e)
                    free = (y > least) & (y < most)
                    total[k, :domains] += (w * np.clip(y, least, most)) @ p
                    total[k, domains:] += (p[free].T @ (p[free] * w[free, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "s"])

        got = members.select("n_tokens", "p").mapInArrow(add, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
        table = np.array([r["s"] for r in got]).reshape(len(trials), -1)
        return [(x[:domains], x[domains:].reshape(domains, domains)) for x in table]

    return tried


def _step(tried, moves: np.ndarray, goal: np.ndarray, e: np.ndarray, within: float):
    """The vector at which an implicit step ends, and the shares there.

    ``e + target - share`` is the gradient of a convex function of e: Newton steps, each as long as that function falls on it.
    """
    share, gram = tried(moves, e[None])[0]
    for _ in range(_NEWTON):
        slope = e + goal - share
        if np.abs(slope).max() <= within / 10:
            return e, share
        way = -np.linalg.solve(np.eye(len(e)) + PACE * gram, slope)
        trials = e + _TRIALS[:, None] * way
        seen = tried(moves, trials)
        falls = [k for k, (x, (y, _)) in enumerate(zip(trials, seen)) if (x + goal - y) @ way <= 0.1 * abs(slope @ way)]
        best = falls[0] if falls else len(trials) - 1
        e, (share, gram) = trials[best], seen[best]
    raise RuntimeError(f"a step does not end: shares by domain are {share.tolist()} for {goal.tolist()}; allow a wider tolerance")


def fitted(members: DataFrame, target: list[float], least: float = LEAST, most: float = MOST, within: float = WITHIN, steps: int = STEPS) -> Fit:
    """The fit of the rates of ``members`` (n_tokens, p) to shares ``target`` (of their sum) of all tokens."""
    if not sum(target) > 0 or min(target) < 0:
        raise ValueError(f"target shares must be nonnegative and some of them positive: {target}")
    goal = np.array(target, float) / sum(target)
    members = members.where("n_tokens > 0")
    tokens = members.agg(F.sum("n_tokens")).first()[0]
    if not tokens:
        return Fit(np.zeros((0, len(goal))), goal, np.zeros(len(goal)))
    tried, moves = _trials(members, float(tokens), least, most), np.zeros((0, len(goal)))
    before, share, e = None, np.zeros(len(goal)), np.zeros(len(goal))
    for _ in range(steps):
        e, share = _step(tried, moves, goal, e, within)
        moves = np.vstack([moves, e])
        if np.abs(share - goal).max() <= within or (before is not None and np.abs(share - before).max() <= within):
            return Fit(moves, goal, share)
        before = share
    raise RuntimeError(f"no fit after {steps} steps: shares by domain are {share.tolist()} for {goal.tolist()}; allow more steps or a wider tolerance")


def rates(members: DataFrame, target: list[float], least: float = LEAST, most: float = MOST, within: float = WITHIN, steps: int = STEPS) -> DataFrame:
    """``members`` (n_tokens, p, ...) with a ``rate`` between ``least`` and ``most``."""
    moves, again = fitted(members, target, least, most, within, steps).moves, replayed
    where, (name,) = members.columns.index("p"), common.fresh(members.columns, ["rate"])

    def apply(batches):
        for batch in batches:
            p = np.array(batch.column(where).to_pylist(), float).reshape(batch.num_rows, len(target))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again(p, moves, least, most))], names=[*batch.schema.names, name])

    return common.mapped(members, apply, (StructField(name, DoubleType()),))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with n_tokens, p, rate, and the wanted and reached shares of all domains (the same in every row)."""
    model = train(docs, labels)
    members, _ = common.stored(posteriors(docs.select("text"), model).select("n_tokens", "p"), "mixing-members")
    fit = fitted(members, [targets[d] for d in DOMAINS])
    out = posteriors(docs, model, fit.moves)
    shares = zip(common.fresh(out.columns, ["wanted", "reached"]), (fit.wanted, fit.reached))
    return out.select(*common.columns(out), *(F.array(*(F.lit(float(x)) for x in values)).alias(name) for name, values in shares))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), common.table(spark, sf_dir, "labels"))
    by_domain = [F.col(c)[k].alias(f"{c}_{d}") for c in ("p", "wanted", "reached") for k, d in enumerate(DOMAINS)]
    return out.select("doc_id", "source", "n_tokens", *by_domain[:3], "rate", *by_domain[3:])

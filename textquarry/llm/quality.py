"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the bytes of whole texts, a pass of documents at a time. The trees are fitted on the driver
from a bounded, documented sample of labelled rows (``sample_rows``, smallest hash of doc_id first), flattened into arrays
and applied by vectorised traversal in the same pass that computes the statistics: scoring reads the texts once and
shuffles nothing.

Defined results: null and empty texts have all-zero statistics and get a score like any other; a null doc_id is never
held out; repeated rows are scored alike; without usable labels the score is 0.5 (of one class only: that class's share);
a doc_id labelled both 0 and 1 counts as 0; other columns are carried through by ``scored`` and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from . import common

#: Labelled rows that a fit may use, at most.
SAMPLE_ROWS = 20_000

_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
_KIND[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 6
_KIND[128:] = 7
_KIND[1:9] = 8
_KIND[[0, 127]] = 8

NAMES = [
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "mark", "symbol", "high", "control", "bang", "bar", "dot", "newline",
    "word_len", "word_len_sd", "long_words", "short_words", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "caps_words",
    "mark_ends", "symbol_ends", "double_marks", "distinct_lines", "line_len", "bar_words", "worst_caps", "worst_symbol", "worst_repeat",
]


def _share(flags: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)


def _worst(flags: np.ndarray, first: np.ndarray, width: int = 24) -> np.ndarray:
    """The largest share of ``flags`` in any ``width`` consecutive words of a row."""
    out = np.zeros(len(first) - 1)
    total = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            w = min(width, b - a)
            out[k] = (total[a + w : b + 1] - total[a : b - w + 1]).max() / w
    return out


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    rows, size = len(offs) - 1, np.diff(offs)
    kind = _KIND[data]
    share = [_share(kind == k, offs, size) for k in (1, 2, 3, 4, 5, 6, 7, 8)]
    bang, bar, dot, line = (_share(data == c, offs, size) for c in (33, 124, 46, 10))
    starts, ends, first = common.word_spans(data, offs)
    n = np.diff(first)
    hashes = common.word_hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    last = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    before = np.where(ends - starts > 1, kind[np.maximum(ends - 2, 0)] if len(ends) else 0, 0)
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    lower = np.concatenate([[0], np.cumsum(kind == 1)])
    caps = ((upper[ends] - upper[starts]) >= 1) & ((lower[ends] - lower[starts]) == 0) & (length > 1)
    symbol = last == 6
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][n > 0]] = False
    mean = _share(length, first, n)
    sd = np.sqrt(np.maximum(_share(length**2, first, n) - mean**2, 0))
    distinct, top, pairs = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            _, counts = np.unique(hashes[a:b], return_counts=True)
            distinct[k], top[k] = len(counts) / (b - a), counts.max() / (b - a)
            pairs[k] = len(np.unique(hashes[a : b - 1] * np.uint64(31) + hashes[a + 1 : b])) / (b - a - 1) if b - a > 1 else 1.0
    breaks = np.zeros(256, bool)
    breaks[[10, 13]] = True
    ls, le, lf = common.word_spans(data, offs, breaks)
    lh, ln = common.word_hashes(data, ls, le), np.diff(lf)
    lines = np.array([len(np.unique(lh[a:b])) / (b - a) if b > a else 0.0 for a, b in zip(lf[:-1].tolist(), lf[1:].tolist())])
    columns = [
        np.log1p(size), np.log1p(n), *share, bang, bar, dot, line, mean, sd, _share(length > 14, first, n), _share(length <= 3, first, n),
        distinct, top, _share(again, first, n), pairs, _share(caps, first, n), _share(last == 5, first, n), _share(symbol, first, n),
        _share((last >= 5) & (last <= 6) & (before >= 5) & (before <= 6), first, n), lines, np.log1p(_share((le - ls).astype(float), lf, ln)),
        _share((length == 1) & (last == 6), first, n), _worst(caps, first), _worst(symbol, first), _worst(again, first),
    ]
    return np.column_stack(columns) if rows else np.zeros((0, len(NAMES)))


@dataclass(frozen=True)
class Trees:
    """All trees in one set of arrays: node k goes to ``left`` if its feature is <= ``cut``; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for a in range(0, len(x), 2048) if len(self.roots) else ():
            part = x[a : a + 2048]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out[a : a + 2048] += self.value[at].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss, splits searched over quantile-bin histograms."""
    none = np.zeros(0, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(none, none.astype(float), none, none, none.astype(float), none, 0, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    width, features = bins + 1, x.shape[1]
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for store, v in ((feature, 0), (cut, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            store.append(v)
        return len(feature) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        level = [(node(), np.arange(len(y)))]
        roots.append(level[0][0])
        for d in range(depth + 1):
            below = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                if d < depth and len(rows) >= 2 * least:
                    keys = (binned[rows] + np.arange(features) * width).ravel()
                    hist = [np.bincount(keys, np.repeat(w, features) if w is not None else None, features * width).reshape(features, width).cumsum(1)[:, :-1] for w in (g[rows], h[rows], None)]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > best[0] and b < len(edges[f]):
                        best = (gain[f, b], (int(f), int(b)))
                if best[1] is None:
                    value[at] = rate * gs / (hs + ridge)
                    raw[rows] += value[at]
                    continue
                f, b = best[1]
                feature[at], cut[at] = f, float(edges[f][b])
                low = binned[rows, f] <= b
                left[at], right[at] = node(), node()
                below += [(left[at], rows[low]), (right[at], rows[~low])]
            level = below
    arrays = [np.array(v) for v in (feature, cut, left, right, value, roots)]
    return Trees(*arrays, depth, base)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.expr(f"crc32(CAST({doc_id} AS STRING)) % 3 = 1"), F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and 0/1 labels of at most ``sample_rows`` labelled documents outside the held-out third."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(column).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def stats(batches):
        for batch in batches:
            for at, data, offs in common.passes(batch.column(0)):
                x = statistics(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(x)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], names=["y", "x"])

    joined = common.in_batches(docs).select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", "doc_id")
    got = joined.select("text", F.struct("doc_id", "y").alias("y")).mapInArrow(stats, "y struct<doc_id: long, y: int>, x array<double>").toArrow()
    if got.num_rows == 0:
        return np.zeros((0, len(NAMES))), np.zeros(0)
    y = got["y"].combine_chunks()
    ids, y = y.field("doc_id").to_numpy(), y.field("y").to_numpy().astype(float)
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, ids))
    return x[order], y[order]


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias(column))
    return fit(*training_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, column, sample_rows))


def scored(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` appended, with ``_`` at its end where ``docs`` has a column of that name."""
    (name,) = common.fresh(docs.columns, [name])
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    where = docs.columns.index("text")

    def apply(batches):
        for batch in batches:
            out = [shared.value.score(statistics(data, offs)) for _, data, offs in common.passes(batch.column(where))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*batch.schema.names, name])

    return common.mapped(common.in_batches(docs), apply, (StructField(name, DoubleType()),))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, trees).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and characters from U+0080 on. Every ten consecutive
words of a benchmark item are a window; an item of fewer words is one window. The windows' 64-bit hashes are a broadcast
table; each document's token windows are hashed and probed in one pass, and a probe that hits is verified word by word in
the join condition, so the result is exact. Only hits and one row for each document leave that pass.

The broadcast is checked: beyond ``BROADCAST_WINDOWS`` windows, or ``BROADCAST_BYTES`` of their words and ids, the hashes are
shuffled instead, and the words of a document are joined again to its hits only.

Defined results: null and empty texts have no words and are not contaminated; items without words or with a null item_id
have no windows; repeated documents each give a row; repeated items count once; an empty benchmark hits nothing; ``clean``
decides by text alone, so every row that holds a contaminated text goes, also one without a doc_id, and no other row does,
whatever doc_id it shares; other columns are carried through by ``clean`` and ignored otherwise.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 256 << 20
#: Characters below U+0080 that end a word.
_BREAKS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(text: Column) -> Column:
    flat = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _BREAKS, string.ascii_lowercase + " " * len(_BREAKS))
    return F.array_remove(F.split(flat, " +"), "")


def _let(value: Column, name: str) -> Column:
    """``value`` as a generated column: the optimiser can't copy its expression into a lambda that runs for each word."""
    return F.explode_outer(F.array(value)).alias(name)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """h, win (its words) and items (ids as strings) of every distinct window."""
    cut = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), _let(words(F.col("text")), "w")).where("size(w) > 0")
    spans = F.expr(f"transform(sequence(1, greatest(1, size(w) - {WINDOW - 1})), i -> slice(w, i, {WINDOW}))")
    one = cut.select("item", F.explode(spans).alias("win"))
    return one.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64("win").alias("h"), "win", "items")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Of every row of ``docs`` (rid, doc_id, text): n_words, n_hit, items (sorted ids of the items with occurring windows)."""
    windows = benchmark_windows(benchmark)
    weight = sum(F.octet_length(F.array_join(x, " ")) + 16 * F.size(x) for x in ("win", "items"))
    stats = windows.groupBy(F.size("win").alias("len")).agg(F.count("*").alias("n"), F.sum(weight.cast("long")).alias("bytes")).collect()  # at most ten rows
    lengths = sorted((r["len"] for r in stats), reverse=True)
    hashed = [f"if(size(w) >= {n}, transform(sequence(1, greatest(1, size(w) - {n - 1})), i -> xxhash64(slice(w, i, {n}))), array())" for n in lengths]
    skip = "0" + "".join(f" + if(size(win) < {n}, greatest(0, size(w) - {n - 1}), 0)" for n in lengths)
    start = f"(pos - ({skip}))"
    real = f"pos > 0 and win is not null and {start} between 1 and size(w) - size(win) + 1 and slice(w, greatest(1, {start}), size(win)) = win"
    span = F.expr(f"if(win is null, null, struct({start} as s, {start} + size(win) as e))").alias("span")
    marker = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("array<string>").alias("items"))

    token = docs.select("rid", "doc_id", _let(words(F.col("text")), "w"))
    token = token.select("rid", "doc_id", "w", F.expr(f"concat({', '.join(['array(0L)', *hashed])})").alias("hs"))
    if sum(r["n"] for r in stats) <= BROADCAST_WINDOWS and sum(r["bytes"] for r in stats) <= BROADCAST_BYTES:
        # The words ride along within the task; a row is made only of what the probe and the comparison leave.
        spread = token.select("rid", "doc_id", "w", F.posexplode_outer("hs").alias("pos", "h"))
        met = spread.join(F.broadcast(marker.unionByName(windows)), "h").where(f"(pos = 0 and win is null) or ({real})")
    else:
        # The shuffle carries hashes alone; the words come back for the rows that hit.
        token, _ = common.stored(token, "benchmark-words")
        spread = token.select("rid", F.posexplode_outer("hs").alias("pos", "h")).where("pos > 0")
        met = spread.join(windows, "h").join(token.select("rid", "doc_id", "w"), "rid").where(real)
        met = met.unionByName(token.select(F.lit(0).cast("long").alias("h"), "rid", F.lit(0).alias("pos"), F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("array<string>").alias("items"), "doc_id", "w"))
    met = met.select("rid", "doc_id", F.expr("if(win is null, size(w), null)").alias("n_words"), "items", span)
    found = met.groupBy("rid", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_list("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = "aggregate(array_sort(spans), struct(0 as e, 0L as n), (a, x) -> struct(greatest(a.e, x.e) as e, a.n + greatest(0, x.e - greatest(a.e, x.s)) as n), a -> a.n)"
    return found.select("rid", "doc_id", "n_words", F.expr(covered).alias("n_hit"), F.array_sort("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    out = hits(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), benchmark)
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of a benchmark window."""
    digest, (key,) = F.unhex(F.sha2("text", 256)), common.fresh(docs.columns, ["text_digest"])
    bad = hits(docs.select(F.monotonically_increasing_id().alias("rid"), digest.alias("doc_id"), "text"), benchmark).where("n_hit > 0")
    found, _ = common.stored(bad.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, digest).join(common.sized(found, BROADCAST_WINDOWS), key, "left_anti").select(common.columns(docs))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws] ELSE [ws[i:i+9] FOR i IN range(1, len(ws) - 8)] END) AS g FROM b),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS s, ws FROM d, lens WHERE len(ws) >= n),
hit AS (SELECT dw.doc_id, s, n, item FROM dw JOIN win ON win.g = dw.ws[s:s+n-1]),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

"""Factoring of a whole corpus as relations: where blocks occur, which of their spots they may claim, and the texts without them.

A run of lines is compared by hashes of its parts of 1, 2, 4, ... lines, which every file holds as arrays: a run of n lines
equals another if both agree in the part of ``2^k <= n`` lines that they begin with and in that which they end with. Claims
are decided file by file, as spots of different files never overlap, and so are replacements; only ranks and names of blocks
are matters of the whole corpus.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry import work
from textquarry.functions import columns as C
from textquarry.operators import blocks, ordered

_SPOTS = "rank long, path string, start int"


def located(files: DataFrame, found: DataFrame) -> DataFrame:
    """(block, path, start) of every occurrence of ``found`` (block, lines: right-trimmed) in ``files`` (path, text).

    Only lines at which as many lines as the shortest blocks have are some block's first ones are looked at further. Heads meet
    by an equi-join of hashes there, and what meets is told apart by SHA-256 digests of whole runs, made where the file's
    lines are; texts are shuffled once, by file. Blocks without lines occur nowhere.
    """
    found = found.select("block", F.col("lines").alias("ls"), F.size("lines").alias("n"), F.sha2(F.array_join("lines", "\n"), 256).alias("digest")).where("n > 0")
    found = work.stored(found, "located-blocks")
    least, most = found.agg(F.min("n"), F.max("n")).first()
    if most is None:
        return found.select("block", F.lit("").alias("path"), F.lit(0).alias("start")).limit(0)
    levels = range(least.bit_length() - 1, most.bit_length())
    level = F.expr("cast(63 - length(regexp_extract(lpad(bin(n), 64, '0'), '^0*', 0)) as int)")
    heads = blocks.hashed(found, most).withColumn("level", level)
    heads = heads.select("block", "n", "level", F.coalesce(*(F.when(F.col("level") == k, F.get(f"h{k}", F.lit(0))) for k in levels)).alias("head"), F.get(f"h{levels[0]}", F.lit(0)).alias("low"), "digest")
    heads = work.stored(heads, "located-heads")
    table = work.stored(blocks.hashed(blocks.lines(files), most).select("path", "ls", *(f"h{k}" for k in levels)), "located-lines")
    starts = table.select("path", F.posexplode(F.arrays_zip(*(f"h{k}" for k in levels))).alias("start", "h"))
    starts = starts.select("path", "start", F.col(f"h.h{levels[0]}").alias("low"), "h").join(heads.select("low").distinct().hint("merge"), "low", "left_semi")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"h.h{k}").alias("head")) for k in levels))).alias("a")
    met = starts.select("path", "start", each).select("path", "start", "a.level", "a.head").join(heads.drop("low").hint("merge"), ["level", "head"])
    met = met.select("block", "path", "start", "n", "digest").join(table.select("path", "ls").hint("merge"), "path").where("start + n <= size(ls)")
    met = met.select("block", "path", "start", "digest", F.sha2(F.array_join(F.expr("slice(ls, start + 1, n)"), "\n"), 256).alias("mine"))
    return met.where("mine = digest").select("block", "path", "start")


def contents(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(block, lines, text, spots) of the groups of ``runs`` (window, path, start, length): the lines of a group's first spot,
    right-trimmed and as they are, and how many spots it has."""
    groups = runs.groupBy("window").agg(F.min(F.struct("path", "start")).alias("at"), F.first("length").alias("length"), F.count("*").alias("spots"))
    raw = C.bound(files.select("path", "text"), raw=C.lines_lf(F.col("text"))).select("path", "raw")
    rows = groups.select(F.col("window").alias("block"), "at.path", "at.start", "length", "spots").join(raw.hint("merge"), "path").withColumn("raw", F.expr("slice(raw, start + 1, length)"))
    return rows.select("block", F.transform("raw", C.rstrip).alias("lines"), F.array_join("raw", "\n").alias("text"), "spots")


def ranked(found: DataFrame) -> DataFrame:
    """``found`` (block, lines, spots) with ``rank`` from 1: most lines times spots first, then by their lines."""
    order = [F.desc(F.size("lines") * F.col("spots")), F.col("lines"), F.col("block")]
    return ordered.running(found, order, [order[0], F.left(F.get("lines", F.lit(0)), F.lit(64))], rank=F.lit(1))


def _claimed(spots: list[tuple], length: dict, standing=None) -> list[tuple]:
    """Those of one file's ``spots`` (rank, start) that are free when their turn comes, in order of rank and then of start.

    A block's own spots must not overlap either; of its free ones, those that ``standing`` refuses are not taken.
    """
    starts: list[int] = []
    ends: list[int] = []
    out, own, behind = [], None, 0
    for rank, start in sorted(spots):
        if rank != own:
            own, behind = rank, -1
        end, at = start + length[rank], bisect_left(starts, start)
        if start < behind or (at < len(starts) and starts[at] < end) or (at and ends[at - 1] > start):  # taken ones are disjoint
            continue
        behind = end
        if standing is None or standing((rank, start)):
            starts.insert(at, start)
            ends.insert(at, end)
            out.append((rank, start))
    return out


def _file_by_file(spots: DataFrame, kernel) -> DataFrame:
    """(rank, path, start) that ``kernel`` takes of the rows (rank, start, n, ...) of each file of ``spots`` (path, rank, start, n, ...).

    Files lie together and in order in their partitions and are met one after the other: a group of its own for each file costs
    more than its claims.
    """

    def take(batches):
        path, rows = None, []
        for batch in batches:
            out = []
            for own, *row in zip(*(batch[c].tolist() for c in batch.columns)):
                if own != path and rows:
                    out += [(r, path, s) for r, s in kernel(rows)]
                    rows = []
                path = own
                rows.append(row)
            yield pd.DataFrame(out, columns=["rank", "path", "start"])
        yield pd.DataFrame([(r, path, s) for r, s in kernel(rows)] if rows else [], columns=["rank", "path", "start"])

    return spots.repartition("path").sortWithinPartitions("path").mapInPandas(take, _SPOTS)


def claims(spots: DataFrame) -> DataFrame:
    """Those of ``spots`` (rank, path, start, n) that a greedy pass by rank takes: none overlaps one taken before it."""
    return _file_by_file(spots.select("path", "rank", "start", "n"), lambda rows: _claimed([(r, s) for r, s, _ in rows], {r: n for r, _, n in rows}))


#: Lines that stand alone whatever surrounds them: blank ones, comments and decorators.
_ALONE = rf"^[{C.WS}]*(?:#|//|/\*|\*|--|;|%|<!--|@|$)"
_DOUBLE, _SINGLE = '"""', "'''"


def _times(text, mark):
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def _quoting(x):
    """What line ``x`` does to an open string, null if nothing: the states (0 none, 1 double, 2 single quotes) that follow each
    state, as the digits of a number to base 3."""
    double, single = F.contains(x, F.lit(_DOUBLE)), F.contains(x, F.lit(_SINGLE))
    opened = F.when(double, F.when(_times(x, _DOUBLE) == 1, 1).otherwise(0)).otherwise(F.when(_times(x, _SINGLE) == 1, 2).otherwise(0))
    code = opened + F.when(double, 0).otherwise(3) + F.when(single, 0).otherwise(18)
    return F.when((double | single) & ~x.rlike(_ALONE), code.cast("long"))


def strings(files: DataFrame) -> DataFrame:
    """(path, k, state) after each line that touches a long string: 0 outside, 1 and 2 within double and single quotes.

    Lines are maps of states; maps of 2, 4, 8, ... neighbouring lines are composed until each holds all lines up to its own.
    """
    codes = C.bound(files, at=F.transform("ls", lambda x, k: F.struct(k.alias("k"), _quoting(x).alias("m"))))
    codes = codes.select("path", F.filter("at", lambda a: a["m"].isNotNull()).alias("at")).where("size(at) > 0")
    out = work.stored(codes.select("path", F.col("at.k").alias("k"), F.col("at.m").alias("m")), "string-maps")
    most = out.agg(F.max(F.size("m"))).first()[0] or 1
    for level in range((most - 1).bit_length()):
        step = 1 << level
        digits = " + ".join(f"{p} * (c div element_at(array(1, 3, 9), cast(get(m, i - {step}) div {p} % 3 as int) + 1) % 3)" for p in (1, 3, 9))
        out = C.bound(out, after=F.expr(f"transform(m, (c, i) -> if(i < {step}, c, {digits}))")).select("path", "k", F.col("after").alias("m"))
    return out.select("path", F.explode(F.arrays_zip("k", "m")).alias("a")).select("path", "a.k", (F.col("a.m") % 3).alias("state"))


def framed(files: DataFrame) -> DataFrame:
    """What encloses every line of ``files`` (path, text), and one line more at the end of each.

    (path, k): ``alone``, ``before`` and ``after`` (line k, and its neighbours, stand alone), ``depth`` and ``below`` (brackets open
    before and after it), ``inside`` (a long string is open before and after it), ``quoted``, ``complete`` (a statement may end
    with it), ``blank``, and ``indented``, the number of indented lines up to it (``tab``: it is one). Depth can't fall below 0: it is the sum of
    brackets so far less the least such sum.
    """
    table = work.stored(blocks.lines(files.where("text is not null")), "framed-lines")
    x, last = F.col("x"), C.strip(F.col("x"))
    change = F.length(F.regexp_replace(x, r"[)\]}]", "")) - F.length(F.regexp_replace(x, r"[(\[{]", ""))
    statement = F.when(F.left(last, F.lit(1)).isin("{", "["), F.right(last, F.lit(1)).isin("}", "]") & (F.length(last) > 1)).otherwise(F.right(last, F.lit(1)).isin(":", "}", "]", ";"))
    rows = table.select("path", F.posexplode(F.concat("ls", F.array(F.lit("")))).alias("k", "x"))
    rows = rows.withColumn("alone", x.rlike(_ALONE)).withColumn("quoted", F.contains(x, F.lit(_DOUBLE)) | F.contains(x, F.lit(_SINGLE)))
    rows = rows.select(
        "path", "k", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("state"), "alone", "quoted", F.when(F.col("alone") | F.col("quoted"), 0).otherwise(change).alias("change"),
        ((x == "") | statement).alias("complete"), (x == "").alias("blank"), F.left(x, F.lit(1)).isin(" ", "\t").alias("tab"),
    )
    marks = strings(table).select("path", "k", "state", F.lit(1).alias("tag"))
    line = Window.partitionBy("path").orderBy("k", "tag")  # facts of lines, not lines, are shuffled and sorted
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(marks, allowMissingColumns=True).withColumn("state", F.coalesce(F.last("state", ignorenulls=True).over(upto), F.lit(0))).where("tag = 0")
    rows = rows.withColumn("sum", F.sum(F.when(F.col("state") > 0, 0).otherwise(F.col("change"))).over(upto))
    rows = rows.withColumn("below", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    return rows.select(
        "path", "k", "alone", F.lag("alone", 1, True).over(line).alias("before"), F.lead("alone", 1, True).over(line).alias("after"),
        F.lag("below", 1, 0).over(line).alias("depth"), "below", ((F.col("state") > 0) & (F.lead("state", 1, 0).over(line) > 0)).alias("inside"),
        "quoted", "complete", "blank", F.sum(F.col("tab").cast("int")).over(upto).alias("indented"), "tab",
    )


def replaceable(files: DataFrame, spots: DataFrame) -> DataFrame:
    """``spots`` (path, start, n, ...; runs of lines of ``files``) with ``replaceable``: whether a run can go without breaking
    what surrounds it. It stands alone at both ends, inside no bracket or long string, and its first and last line touch none."""
    facts = work.stored(framed(files.join(spots.select("path").distinct().hint("merge"), "path", "left_semi")), "framed")
    head = facts.select("path", F.col("k").alias("start"), "before", "depth", F.col("inside").alias("inside1"), F.col("quoted").alias("quoted1"), (F.col("indented") - F.when(F.col("tab"), 1).otherwise(0)).alias("indented1"))
    tail = facts.select("path", F.col("k").alias("_last"), "alone", "after", "below", "inside", "quoted", "complete", "blank", "indented")
    met = spots.withColumn("_last", F.col("start") + F.col("n") - 1).join(head.hint("merge"), ["path", "start"]).join(tail.hint("merge"), ["path", "_last"])
    enclosed = F.expr("depth > 0 or below > 0 or inside1 or inside or quoted1 or quoted")
    ends = F.expr("after or (alone and not blank) or (indented = indented1 and complete)")
    return met.select(*spots.columns, (~enclosed & F.col("before") & ends).alias("replaceable"))


def found_blocks(files: DataFrame, width: int = 4, longest: int = 200, min_files: int = 2) -> DataFrame:
    """(block, lines, text, occurrences, tokens) of the repeated runs of ``files`` that claim at least one spot."""
    runs = work.stored(blocks.runs(files, width, longest, min_files), "factoring-runs")
    made = work.stored(contents(files, runs), "factoring-contents")
    order = work.stored(ranked(made.select("block", "lines", "spots")).select("block", "rank"), "factoring-ranked")
    spots = runs.join(order.select(F.col("block").alias("window"), "rank"), "window").select("rank", "path", "start", F.col("length").alias("n"))
    taken = claims(spots).groupBy("rank").agg(F.count("*").alias("occurrences"))
    kept = order.join(taken, "rank").select("block", "occurrences")
    return C.with_tokens(made.join(kept.hint("merge"), "block").select("block", "lines", "text", "occurrences"))


def factored(files: DataFrame, found: DataFrame, min_occurrences: int = 3) -> tuple[DataFrame, DataFrame]:
    """``files`` (path, text) with the blocks of ``found`` replaced by marker lines, and what was replaced: (id, text, lines,
    occurrences, tokens). Null texts stay null."""
    if min_occurrences < 2:
        raise ValueError("a block must occur at least twice to be shared")
    often = found.where(F.col("occurrences") >= min_occurrences).withColumn("spots", F.col("occurrences"))
    order = ordered.running(often, [F.desc(F.size("lines") * F.col("spots")), F.col("text"), F.col("block")], rank=F.lit(1))
    order = work.stored(order.select("block", "rank", "lines", "text", "tokens", F.size("lines").alias("n")), "factoring-order")
    spots = located(files, order).join(order.select("block", "rank", "n"), "block").select("rank", "path", "start", "n")

    def take(rows: list[list]) -> list[tuple]:
        free = {(r, s) for r, s, _, can in rows if can}
        return _claimed([(r, s) for r, s, *_ in rows], {r: n for r, _, n, _ in rows}, lambda spot: spot in free)

    spots = work.stored(replaceable(files, spots), "factoring-spots")
    taken = work.stored(_file_by_file(spots.select("path", "rank", "start", "n", "replaceable"), take), "factoring-taken")
    used = order.join(taken.groupBy("rank").agg(F.count("*").alias("occurrences")), "rank")
    used = ordered.running(used, [F.desc((F.col("occurrences") - 1) * F.col("tokens")), F.col("text"), F.col("block")], k=F.lit(1))
    used = work.stored(used.select("rank", F.concat(F.lit("B"), F.col("k").cast("string")).alias("id"), "text", F.col("n").alias("lines"), "occurrences", "tokens"), "factoring-used")

    def splice(key, texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        rows, end, closed = blocks.split_lines(texts["text"].iloc[0])
        for start, n, name in sorted(zip(marks["start"], marks["lines"], marks["id"]), reverse=True):
            rows[start : start + n] = [blocks.marker(key[0], name, n)]
        return pd.DataFrame([(key[0], end.join(rows) + (end if closed else ""))], columns=["path", "text"])

    marks = work.stored(taken.join(used.select("rank", "id", "lines"), "rank").select("path", "start", "id", "lines"), "factoring-marks")
    changed = marks.select("path").distinct()
    again = files.select("path", "text").join(changed, "path", "left_semi").groupBy("path").cogroup(marks.groupBy("path")).applyInPandas(splice, "path string, text string")
    rest = files.select("path", "text").join(changed, "path", "left_anti")
    return rest.unionByName(again), used.drop("rank")


def savings(files: DataFrame, texts: DataFrame, used: DataFrame) -> DataFrame:
    """One row of what factoring ``files`` into ``texts`` (both path, text; a path once) and the blocks ``used`` has saved.

    Tokens before, after and saved (a missing or null text has none), the number of files changed, of blocks, and the tokens
    that their repeats had.
    """
    old, new = (C.with_tokens(x.select("path", F.coalesce("text", F.lit("")).alias("text"))) for x in (files, texts))
    old, new = old.select("path", F.md5("text").alias("was"), F.col("tokens").alias("t1")), new.select("path", F.md5("text").alias("is"), F.col("tokens").alias("t2"))
    empty = F.md5(F.lit(""))
    changed = (F.coalesce("was", empty) != F.coalesce("is", empty)).cast("long")
    parts = old.join(new, "path", "full").select(F.col("t1").alias("before"), F.col("t2").alias("after"), changed.alias("changed"), *(F.lit(0).cast("long").alias(c) for c in ("blocks", "projected")))
    gains = used.select(*(F.lit(0).cast("long").alias(c) for c in ("before", "after", "changed")), F.lit(1).cast("long").alias("blocks"), ((F.col("occurrences") - 1) * F.col("tokens")).alias("projected"))
    both = parts.unionByName(gains)
    sums = both.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in both.columns))
    return sums.withColumn("saved", F.col("before") - F.col("after"))

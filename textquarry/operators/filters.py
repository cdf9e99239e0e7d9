"""Which files count: ignore rules, globs, sizes, and sets of changed paths."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry import work
from textquarry.functions import fixed, patterns


def default_rules() -> list[tuple[str, int, patterns.Rule]]:
    return [("", k, rule) for k, line in enumerate(fixed.DEFAULT_IGNORES) if (rule := patterns.ignore_rule(line))]


def verdict(path: Column, rules: Iterable[tuple[str, int, patterns.Rule]]) -> Column:
    """Whether the last rule that matches ``path`` ignores it; ``rules`` are (base directory, order, rule), outermost first.

    The rules are driver-side parameters: the expression tries them from the last to the first, so the first hit decides.
    """
    ordered = sorted(rules, key=lambda r: (r[0].count("/") + bool(r[0]), r[0], r[1]))
    out = F.lit(False)
    for base, _, rule in ordered:
        local = F.substring(path, F.lit(len(base) + 2), F.length(path)) if base else path
        hit = local.rlike(rule.regex)
        hit = path.startswith(base + "/") & hit if base else hit
        out = F.when(hit, F.lit(not rule.negated)).otherwise(out)
    return out


def _above(path: Column) -> Column:
    """The directories above ``path``, outermost first, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _chained(rules: list[tuple[str, int, patterns.Rule]]) -> Callable[[Column], Column]:
    """The verdict of ``rules`` on one path, where neighbouring rules of one base and sign are one alternation."""
    run, chains = [], []
    for rule in sorted(rules, key=lambda r: (r[0].count("/") + bool(r[0]), r[0], r[1])):
        if run and (run[-1][0], run[-1][2].negated) != (rule[0], rule[2].negated):
            chains.append(run)
            run = []
        run.append(rule)
    chains += [run] if run else []

    def one(path: Column) -> Column:
        out = F.lit(False)
        for chain in chains:
            base, sign = chain[0][0], not chain[0][2].negated
            regex = "|".join(f"(?:{r.regex})" for _, _, r in chain)
            local = F.substring(path, F.lit(len(base) + 2), F.length(path)) if base else path
            hit = path.startswith(base + "/") & local.rlike(regex) if base else local.rlike(regex)
            out = F.when(hit, F.lit(sign)).otherwise(out)
        return out

    return one


def ignored(files: DataFrame, rules: list[tuple[str, int, patterns.Rule]]) -> DataFrame:
    """``files`` with ``is_ignored``: by their own path, or because a directory above is."""
    return files.withColumn("is_ignored", F.exists(_above(F.col("path")), _chained(rules)))


def scan_counts(files: DataFrame, rules: list[tuple[str, int, patterns.Rule]], include: Iterable[str] = (), exclude: Iterable[str] = (), max_size: int | None = None) -> DataFrame:
    """One row of what a walk over a listing (path, size, is_binary) finds and leaves out.

    A directory that is ignored counts once, whatever lies below it; a file is left out by the first of rules, globs, size
    and binary content. Directories without files are not in a listing.
    """
    hit = _chained(rules)
    skip = F.array(*map(F.lit, fixed.HARD_SKIP_DIRS))
    above = _above(F.col("path"))
    at = F.filter(above, lambda p: hit(p) | ((p != F.col("path")) & F.array_contains(skip, F.substring_index(p, "/", -1))))
    rows = files.select("path", "size", "is_binary", F.get(at, F.lit(0)).alias("at"), above.alias("above"))
    seen, large = F.col("at").isNull(), F.lit(False) if max_size is None else F.col("size") > max_size
    wanted = globbed(F.col("path"), include, exclude)
    kind = F.when(~seen, "pruned").when(~wanted, "unwanted").when(large, "too_large").when(F.col("is_binary"), "binary").otherwise("file")
    inner = F.expr("filter(above, p -> p <> path and (at is null or (p <> at and not startswith(p, at || '/'))))")
    rows = rows.select(F.col("size").cast("long").alias("size"), kind.alias("kind"), F.when(~seen, F.col("at")).otherwise("").alias("key"), inner.alias("inner"))
    facts = F.concat(F.array(F.struct("kind", "key", "size")), F.transform("inner", lambda d: F.struct(F.lit("inner").alias("kind"), d.alias("key"), F.lit(0).cast("long").alias("size"))))
    each = rows.select(F.explode(facts).alias("x")).groupBy("x.kind", "x.key").agg(F.count("*").alias("n"), F.sum("x.size").alias("size"))

    def total(column: str, kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    return each.agg(
        total("n", "file").alias("files"), total("size", "file").alias("total_bytes"), (F.count_if(F.col("kind") == "pruned") + total("n", "unwanted")).alias("ignored"),
        total("n", "too_large").alias("too_large"), total("n", "binary").alias("binary"), (F.count_if(F.col("kind") == "inner") + 1).alias("directories"),
    )


#: Rules that name no part of a path, at most: every path meets all of them.
MOST_WILD_RULES = 10_000


def candidates(paths: DataFrame, keyed: DataFrame) -> DataFrame:
    """``path`` with every rule of ``keyed`` (rule, keys, ...; ``keys`` as of ``patterns.literal_keys``) that may match it.

    A rule meets only paths that hold one of its literals (a segment, or how one begins or ends), by an equi-join of hashes.
    Of a rule's literals, that which the fewest paths hold is taken, so a directory that all paths and rules share joins nothing.
    """
    literals = keyed.select("rule", F.explode("keys").alias("literal"))
    lengths = {"p": [], "z": []}
    for r in literals.where("literal not like 's:%'").select(F.left("literal", F.lit(1)).alias("kind"), (F.length("literal") - 2).alias("n")).distinct().collect():  # no more than a name is long
        lengths[r["kind"]].append(r["n"])

    def parts_of(segment: Column) -> Column:
        def cut(kind: str, side) -> Column:
            fits = F.filter(F.lit(lengths[kind]).cast("array<int>"), lambda n: n <= F.length(segment))
            return F.transform(fits, lambda n: F.xxhash64(F.concat(F.lit(f"{kind}:"), side(segment, n))))

        return F.concat(F.array(F.xxhash64(F.concat(F.lit("s:"), segment))), cut("p", F.left), cut("z", F.right))

    held = paths.select("path", F.explode(F.array_distinct(F.flatten(F.transform(F.split("path", "/"), parts_of)))).alias("key"))
    often = held.groupBy("key").agg(F.count("*").alias("n"))
    counted = literals.select("rule", F.xxhash64("literal").alias("key")).join(often, "key", "left")
    rarest = counted.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("x")).where("x.n > 0").select("rule", "x.key")
    sought = work.stored(keyed.drop("keys").join(rarest, "rule").drop("rule"), "sought-rules")
    return held.join(sought, "key").drop("key")


def last_match(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` with ``is_ignored`` by rules that are data, as many as there are: (layer, ord, base, regex, negated).

    Rules meet their ``candidates`` only, and what meets is matched. Rules without any literal meet every path: they are
    counted first, and too many of them are an error.
    """
    keys = F.udf(patterns.literal_keys, "array<string>", useArrow=True)  # once for each rule
    keyed = rules.where(F.col("regex") != patterns.NEVER).withColumn("keys", keys("regex", "base"))
    keyed = work.stored(keyed.withColumn("rule", F.monotonically_increasing_id()), "keyed-rules")
    wild = keyed.where("size(keys) = 0")
    if (n_wild := wild.limit(MOST_WILD_RULES + 1).count()) > MOST_WILD_RULES:
        raise ValueError(f"more than {MOST_WILD_RULES} rules name no part of a path")
    paths = files.select("path").distinct()
    met = candidates(paths, keyed)
    local = F.expr("rlike(if(base = '', path, substr(path, length(base) + 2)), regex)")
    if n_wild:
        every = paths.withColumn("key", F.when(F.length("path") >= 0, "*"))
        met = met.unionByName(every.join(F.broadcast(wild.drop("keys", "rule").withColumn("key", F.lit("*"))), "key").drop("key"))
    hits = met.where(F.expr("base = '' or startswith(path, base || '/')") & local)
    decided = hits.groupBy("path").agg(F.max_by(~F.col("negated"), F.struct("layer", "ord")).alias("hit"))
    return files.join(decided, "path", "left").withColumn("is_ignored", F.coalesce("hit", F.lit(False))).drop("hit")


def hard_skipped(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, fixed.HARD_SKIP_DIRS)))


def globbed(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Whether a path passes: it matches an include glob, if there are any, and no exclude glob."""
    keep = F.lit(True)
    if include := list(include):
        keep = path.rlike("|".join(f"(?:{patterns.filter_regex(g)})" for g in include))
    for glob in exclude:
        keep = keep & ~path.rlike(patterns.filter_regex(glob))
    return keep


def restricted(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The files whose path is among the changed ones."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def changed_paths(entries: DataFrame, untracked: DataFrame | None = None) -> DataFrame:
    """Distinct paths of (path, status) rows that are not deletions, and of the untracked ones."""
    paths = entries.where("status <> 'D'").select("path")
    return (paths.unionByName(untracked.select("path")) if untracked is not None else paths).distinct()


def diffstat(entries: DataFrame, untracked: DataFrame) -> DataFrame:
    """(path, added, removed): the later row of a path wins; untracked paths that are not listed count 0 and 0."""
    last = entries.groupBy("path").agg(F.max_by(F.struct("added", "removed"), "ord").alias("x")).select("path", "x.added", "x.removed")
    fresh = untracked.select("path").distinct().join(last, "path", "left_anti")
    return last.unionByName(fresh.select("path", F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("removed")))


def relative(paths: DataFrame, prefix: str) -> DataFrame:
    """(ord, path) below ``prefix``, which is dropped; the first of equal paths stays."""
    prefix = prefix.strip("/")
    cut = paths if not prefix else paths.where(F.col("path").startswith(prefix + "/")).withColumn("path", F.substring("path", F.lit(len(prefix) + 2), F.length("path")))
    return cut.groupBy("path").agg(F.min("ord").alias("ord"))

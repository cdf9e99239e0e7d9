"""Command line: pack (the default), count, explain, calibrate."""

from __future__ import annotations

import argparse
import fnmatch
import json
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry import work
from textquarry.functions import columns as C
from textquarry.functions import tokens as T
from textquarry.operators import accuracy, filters, ranking
from textquarry.operators.selection import Budget
from textquarry.plans import config, pack
from textquarry.sources import git, tree
from textquarry.streaming import watch

COMMANDS = ("pack", "count", "explain", "calibrate")
DEFAULTS = {"budget": 32_000, "format": "markdown", "mode": "balanced", "manifest": "full", "max_scan": 3000, "max_per_dir": 8, "max_per_ext": 0, "dedupe": True, "dedupe_threshold": 0.85, "truncate": True, "outline": False, "max_size": None, "include": [], "exclude": []}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("textquarry", description="Bundle what matters of a corpus within a token budget.")
    subs = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = subs.add_parser(name, argument_default=argparse.SUPPRESS)
        p.add_argument("path", nargs="*" if name == "calibrate" else "?", default=["."] if name == "calibrate" else ".")
        p.add_argument("-C", "--root", dest="root")
        p.add_argument("-x", "--exclude", action="append")
        p.add_argument("-i", "--include", action="append")
        p.add_argument("-e", "--vocabulary")
        p.add_argument("--calibration", type=float)
        p.add_argument("--max-size", type=config.parse_size)
        p.add_argument("--no-default-ignores", dest="default_ignores", action="store_false", default=True)
        p.add_argument("--no-gitignore", dest="ignore_files", action="store_false", default=True)
        p.add_argument("--no-config", dest="use_config", action="store_false", default=True)
        p.add_argument("--show-config", action="store_true", default=False)
        if name in ("pack", "count"):
            p.add_argument("--diff")
            for flag in ("staged", "uncommitted", "untracked"):
                p.add_argument(f"--{flag}", action="store_true", default=False)
        if name == "pack":
            p.add_argument("-b", "--budget", type=int)
            p.add_argument("-f", "--format", choices=list(pack.SINKS))
            p.add_argument("-m", "--mode", choices=("balanced", "coverage", "depth"))
            p.add_argument("-o", "--output")
            p.add_argument("--manifest", choices=("full", "paths", "none"))
            for flag in ("per-file-frac", "per-dir-frac", "per-ext-frac", "dedupe-threshold"):
                p.add_argument(f"--{flag}", type=float)
            for flag in ("max-per-dir", "max-per-ext", "max-scan"):
                p.add_argument(f"--{flag}", type=int)
            p.add_argument("--no-dedupe", dest="dedupe", action="store_false")
            p.add_argument("--no-truncate", dest="truncate", action="store_false")
            p.add_argument("--stats", action="store_true", default=False)
            p.add_argument("-q", "--quiet", action="store_true", default=False)
            p.add_argument("--reach-weight", type=float, default=0.0)
            p.add_argument("--factor-shared", action="store_true", default=False)
            p.add_argument("--shared-min-lines", type=int, default=4)
            p.add_argument("--shared-min-occurrences", type=int, default=3)
            p.add_argument("--outline", action="store_true")
            p.add_argument("--outline-min-ratio", type=float, default=2.0)
            p.add_argument("--watch", action="store_true", default=False)
            p.add_argument("--watch-interval", type=float, default=None)
            p.add_argument("--watch-settle", type=float, default=0.4)
        if name in ("count", "explain", "calibrate"):
            p.add_argument("-n", "--limit", type=int, default={"count": 40, "explain": 30, "calibrate": 600}[name])
        if name in ("count", "explain"):
            p.add_argument("--json", action="store_true", default=False)
        if name == "explain":
            p.add_argument("-p", "--filter", default="")
        if name == "calibrate":
            p.add_argument("--write", action="store_true", default=False)
    return top


def _files(spark, args, opts):
    root = getattr(args, "root", None) or args.path
    scan = tree.walk(root, opts["include"], opts["exclude"], opts["max_size"], args.default_ignores, args.ignore_files)
    files = tree.relation(spark, scan)
    if any(getattr(args, f, None) not in (None, False) for f in ("diff", "staged", "uncommitted", "untracked")):
        top = git.top_level(root if os.path.isdir(root) else os.path.dirname(os.path.abspath(root)))
        changed = git.changes(spark, top, getattr(args, "diff", None) or "", args.staged, args.uncommitted, args.untracked)
        local = git.relative([r["path"] for r in changed.collect()], top, scan.root)
        files = filters.restricted(files, spark.createDataFrame([(p,) for p in local], "path string"))
        if files.isEmpty():
            raise ValueError("no changed files here")
    return scan, files


def _pack(spark, args, opts) -> str:
    budget = Budget(opts["budget"], **{k: v for k, v in opts.items() if k in Budget.__dataclass_fields__ and k not in ("total",)} | {k: getattr(args, k) for k in ("per_file_frac", "per_dir_frac", "per_ext_frac") if hasattr(args, k)})
    scan, files = _files(spark, args, opts)
    bundle = pack.pack(
        files, budget, opts["mode"], scan.root, read=tree.texts, transform=pack.outlined(args.outline_min_ratio) if opts["outline"] else None, reach_weight=args.reach_weight,
        calibration=getattr(args, "calibration", None) or T.load_calibration(), factor_shared=args.factor_shared and not opts["outline"], shared_min_lines=args.shared_min_lines,
        shared_min_occurrences=args.shared_min_occurrences, ignored=scan.ignored,
    )
    text = pack.render(bundle, opts["format"])
    if getattr(args, "output", None):
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    if (args.stats or getattr(args, "output", None)) and not args.quiet:
        print(f"{pack.stats_line(bundle)}; accounted {bundle.accounted:,}, rendered {T.estimate(text):,} tokens", file=sys.stderr)
    return text


def _count(spark, args, opts) -> None:
    _, files = _files(spark, args, opts)
    shown = C.with_tokens(tree.texts(ranking.top(files, args.limit)).where("text is not null"))
    rows = shown.select("path", "size", "tokens", C.chars_per_token(F.length("text"), F.col("tokens")).alias("chars_per_token"), "score", C.line_count(F.col("text")).alias("lines")).orderBy(F.desc("score"), "path").collect()
    total = sum(r["tokens"] for r in rows)
    if args.json:
        print(json.dumps({"files": [r.asDict() for r in rows], "total_tokens": total}, indent=2))
    else:
        for r in rows:
            print(f"{r['tokens']:>9,}  {r['size']:>10,}  {r['path']}")
        print(f"{total:>9,}  in {len(rows):,} files")


def _explain(spark, args, opts) -> None:
    _, files = _files(spark, args, opts)
    if args.filter:
        files = files.where(F.col("path").rlike(r"\A" + fnmatch.translate(args.filter).removesuffix(r"\Z").removesuffix(r"\z") + r"\z"))
    shown = ranking.explained(ranking.scored(files)).orderBy(F.desc("score"), "path")
    rows = (shown.limit(args.limit) if args.limit else shown).collect()
    print(json.dumps([{"path": r["path"], "score": r["score"], "line": r["line"]} for r in rows], indent=2) if args.json else "\n".join(r["line"] for r in rows))


def _calibrate(spark, args, opts) -> None:
    if not getattr(args, "vocabulary", None):
        raise ValueError("calibration needs --vocabulary, a file of exact tokens")
    scans = [tree.walk(root, opts["include"], opts["exclude"], opts["max_size"], args.default_ignores, args.ignore_files) for root in args.path]
    texts = [tree.texts(accuracy.round_robin(tree.relation(spark, scan), args.limit)).where("text is not null") for scan in scans]
    chosen = accuracy.round_robin(reduce(DataFrame.unionByName, texts), args.limit)
    counted = C.with_exact_tokens(C.with_tokens(chosen).withColumnRenamed("tokens", "estimate"), args.vocabulary)
    pairs = work.stored(counted.select("estimate", F.col("tokens").alias("truth")), "calibration")
    n = pairs.count()
    if n < 5:
        raise ValueError("calibration needs at least five files")
    factor = accuracy.factor(pairs).first()["factor"]
    before = accuracy.error(pairs).first()["mape"]
    after = accuracy.error(pairs.withColumn("estimate", F.col("estimate") * factor)).first()["mape"]
    print(f"raw {before:.2%}, factor {factor:.4f}, after {after:.2%}, {n:,} files")
    if args.write:
        print(T.save_calibration(factor, n, after))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done, 1 or 2: the user's mistake, 130: interrupted; a closed pipe is fine."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or (argv[0] not in COMMANDS and argv[0] not in ("-h", "--help")):
        argv.insert(0, "pack")
    elif len(argv) == 1 and argv[0] in COMMANDS and os.path.exists(argv[0]):
        print(f"{argv[0]!r} is a command and a path; write ./{argv[0]} for the path", file=sys.stderr)
        return 2
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        root = (args.path[0] if args.path else ".") if isinstance(args.path, list) else args.path
        found = config.find(root) if args.use_config and os.path.exists(root) else None
        settings = config.load(found, root) if found else None
        if settings and (hints := settings.hints()) and not getattr(args, "quiet", False):
            print("\n".join(hints), file=sys.stderr)
        typed = {k: v for k, v in vars(args).items() if k in DEFAULTS}
        opts = config.merge(DEFAULTS, settings, typed)
        if args.show_config:
            print((settings or config.Settings()).describe())
            return 0
        own = spark or SparkSession.builder.appName("textquarry").getOrCreate()
        job = {"pack": _pack, "count": _count, "explain": _explain, "calibrate": _calibrate}[args.command]
        job(own, args, opts)
        if args.command == "pack" and args.watch:
            scan, _ = _files(own, args, opts)
            names = [f[0] for f in scan.files]
            watch.run(lambda: watch.stamps(names, scan.root), lambda _: _pack(own, args, opts), watch.interval(args.watch_interval), args.watch_settle, on_error=lambda e: print(e, file=sys.stderr))
    except (ValueError, OSError) as e:
        if isinstance(e, BrokenPipeError):
            return 0
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())

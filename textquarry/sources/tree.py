"""A directory tree as files(path, abs_path, text, size): pruned on the driver, read where Spark wants."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import columns as C
from textquarry.functions import fixed, patterns
from textquarry.sources import corpus

IGNORE_FILES = (".gitignore", ".quarryignore")


@dataclass
class Scan:
    """What a walk found, and how much it left out."""

    root: str
    files: list[tuple[str, str, int, int]] = field(default_factory=list)  # path, absolute path, size, mtime in ns
    ignored: int = 0
    directories: int = 0
    too_large: int = 0
    symlinks: int = 0
    binary: int = 0
    rules: int = 0

    @property
    def total_bytes(self) -> int:
        return sum(f[2] for f in self.files)


class _Layers:
    """Ignore rules of the directories above, outermost first; the last match decides."""

    def __init__(self, base: list[patterns.Rule]):
        import re

        self._re, self.layers = re, [("", [(re.compile(r.regex), r.negated) for r in base])]

    def push(self, folder: str, rules: list[patterns.Rule]) -> None:
        self.layers.append((folder, [(self._re.compile(r.regex), r.negated) for r in rules]))

    def ignored(self, path: str) -> bool:
        out = False
        for base, rules in self.layers:
            if base and not path.startswith(base + "/"):
                continue
            local = path[len(base) + 1 :] if base else path
            for regex, negated in rules:
                if regex.search(local):
                    out = not negated
        return out


def walk(root: str, include: Iterable[str] = (), exclude: Iterable[str] = (), max_size: int | None = None, default_ignores: bool = True, ignore_files: bool = True) -> Scan:
    """Files below ``root``. An ignored directory is never entered, so nothing below it comes back.

    Links to directories are not followed, and counted unless they are ignored; a link to a file has the link's own size.
    Unreadable entries are skipped; a root that is a file skips every filter. The root is one of the directories.
    """
    import re

    root = os.path.abspath(root)
    if not os.path.exists(root):
        raise ValueError(f"no such file or directory: {root}")
    if os.path.isfile(root):
        stat = os.stat(root)
        return Scan(root, [(os.path.basename(root), root, stat.st_size, stat.st_mtime_ns)])
    base = [r for line in fixed.DEFAULT_IGNORES if (r := patterns.ignore_rule(line))] if default_ignores else []
    layers, scan = _Layers(base), Scan(root, rules=len(base))
    wanted, unwanted = ([re.compile(patterns.filter_regex(g)) for g in globs] for globs in (include, exclude))

    def enter(folder: str) -> None:
        where = os.path.join(root, folder)
        try:
            entries = sorted(os.scandir(where), key=lambda e: e.name)
        except OSError:
            return
        finally:
            scan.directories += 1
        depth = len(layers.layers)
        names = {e.name for e in entries} if ignore_files else ()
        for name in IGNORE_FILES:
            if name in names:
                try:
                    with open(os.path.join(where, name), encoding="utf-8", errors="replace") as lines:
                        rules = patterns.ignore_rules(lines.read())
                except OSError:
                    continue
                scan.rules += len(rules)
                layers.push(folder, rules)
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            try:
                if entry.is_dir():
                    if entry.name in fixed.HARD_SKIP_DIRS or layers.ignored(path):
                        scan.ignored += 1
                    elif entry.is_symlink():
                        scan.symlinks += 1
                    else:
                        enter(path)
                    continue
                if not entry.is_file():
                    continue
                stat = entry.stat(follow_symlinks=False)
            except OSError:
                continue
            if layers.ignored(path) or (wanted and not any(r.search(path) for r in wanted)) or any(r.search(path) for r in unwanted):
                scan.ignored += 1
            elif max_size is not None and stat.st_size > max_size:
                scan.too_large += 1
            else:
                try:
                    with open(entry.path, "rb") as f:
                        if b"\x00" in f.read(fixed.SNIFF_BYTES):
                            scan.binary += 1
                            continue
                except OSError:
                    continue
                scan.files.append((path, entry.path, stat.st_size, stat.st_mtime_ns))
        del layers.layers[depth:]

    enter("")
    scan.files.sort()
    return scan


def relation(spark: SparkSession, scan: Scan) -> DataFrame:
    """files(path, abs_path, size, ext, name, depth, dirname) of a scan; no text is read."""
    rows = [(p, a, s) for p, a, s, _ in scan.files]
    return corpus.with_parts(spark.createDataFrame(rows, "path string, abs_path string, size long"))


def texts(files: DataFrame) -> DataFrame:
    """``files`` with ``text``, null where it can't be read or is binary; each file is read by one task."""
    from collections.abc import Iterator

    import pandas as pd

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["abs_path"]:
                try:
                    with open(path, "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": frame["path"], "content": out})

    content = files.select("path", "abs_path").mapInPandas(read, "path string, content binary")
    return files.join(content, "path", "left").withColumn("text", C.decoded(F.col("content"))).drop("content")


def stored_files(spark: SparkSession, url: str, glob: str = "*") -> DataFrame:
    """files(path, text, size, mtime_ns) below a URL of any store that Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(url)
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    base = "/" + url.split(":", 1)[-1].strip("/") + "/"
    return raw.select(F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path).alias("path"), C.decoded(F.col("content")).alias("text"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def snapshot(spark: SparkSession, paths: Iterable[str], root: str) -> DataFrame:
    """snapshot(path, mtime_ns, size); a path that is gone has no row."""
    rows = []
    for path in paths:
        try:
            stat = os.stat(os.path.join(root, path))
        except OSError:
            continue
        rows.append((path, stat.st_mtime_ns, stat.st_size))
    return spark.createDataFrame(rows, "path string, mtime_ns long, size long")

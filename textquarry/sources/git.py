"""Changed paths from git, on the driver, as changes(path, status, old_path, added, removed)."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from textquarry.operators import filters

TIMEOUT = 30.0
DIFF = ["diff", "-M", "-C", "--find-copies-harder", "-z"]


class GitError(ValueError):
    pass


@dataclass(frozen=True)
class Revisions:
    base: str | None = None
    head: str | None = None
    merge_base: bool = False

    def arguments(self) -> list[str]:
        if self.base is None:
            return ["HEAD"]
        if self.head is None:
            return [self.base]
        return [f"{self.base}...{self.head}"] if self.merge_base else [self.base, self.head]


def parse_revisions(spec: str) -> Revisions:
    """``""``, ``a``, ``a..b`` or ``a...b``; a side that is left out is HEAD."""
    spec = spec.strip()
    if not spec:
        return Revisions()
    dots = "..." if "..." in spec else ".." if ".." in spec else ""
    base, _, head = spec.partition(dots) if dots else (spec, "", "")
    if dots and not base and not head:
        raise GitError(f"no revision on either side of {spec!r}")
    sides = [base or "HEAD", (head or "HEAD") if dots else None]
    for ref in sides:
        if ref is not None and (ref.startswith("-") or not ref.isprintable() or any(c.isspace() for c in ref)):
            raise GitError(f"not a revision: {ref!r}")
    return Revisions(sides[0], sides[1], dots == "...")


def run(root: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=float(os.environ.get("TEXTQUARRY_GIT_TIMEOUT", TIMEOUT)))
    except FileNotFoundError as e:
        raise GitError("git is not installed") from e
    except subprocess.TimeoutExpired as e:
        raise GitError(f"git took too long: {' '.join(args)}") from e
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip() or f"git failed with {done.returncode}")
    return done.stdout.decode(errors="surrogateescape")


def is_repository(root: str) -> bool:
    try:
        return run(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except GitError:
        return False


def top_level(root: str) -> str:
    if not is_repository(root):
        raise GitError(f"not a git work tree: {root}")
    return run(root, "rev-parse", "--show-toplevel").strip()


def name_status(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(path, status, old path) of NUL-separated output; renames and copies name two paths, the new one counts."""
    parts = iter(text.split("\0"))
    for status in parts:
        if not status:
            continue
        old = next(parts, None) if status[0] in "RC" else None
        path = next(parts, None)
        if path:
            yield path, status[0], old


def numstat(text: str) -> Iterator[tuple[str, int, int]]:
    """(path, added, removed); binary files count 0 and 0, a rename's empty third field is followed by two paths."""
    parts = iter(text.split("\0"))
    for entry in parts:
        fields = entry.split("\t", 2)
        if len(fields) < 3:
            continue
        path = fields[2]
        if not path:
            next(parts, None)
            path = next(parts, "")
        if path:
            added, removed = (int(x) if x.isdigit() else 0 for x in fields[:2])
            yield path, added, removed


def _diff(root: str, what: str, revisions: Revisions, staged: bool, uncommitted: bool) -> str:
    revs = ["--cached"] if staged else ["HEAD"] if uncommitted else revisions.arguments()
    try:
        return run(root, *DIFF, what, *revs)
    except GitError:
        if not revisions.merge_base:
            raise
        base = run(root, "merge-base", revisions.base, revisions.head).strip()
        return run(root, *DIFF, what, base, revisions.head)


def untracked(root: str) -> list[str]:
    return [p for p in run(root, "ls-files", "--others", "--exclude-standard", "-z", "--full-name", top_level(root)).split("\0") if p]


def changes(spark: SparkSession, root: str, spec: str = "", staged: bool = False, uncommitted: bool = False, include_untracked: bool = False) -> DataFrame:
    """Distinct changed paths, deletions left out; untracked files count only where the work tree is one side."""
    revisions = parse_revisions(spec)
    rows = list(name_status(_diff(root, "--name-status", revisions, staged, uncommitted)))
    entries = spark.createDataFrame([(p, s) for p, s, _ in rows], "path string, status string")
    fresh = untracked(root) if include_untracked and revisions.head is None else []
    return filters.changed_paths(entries, spark.createDataFrame([(p,) for p in fresh], "path string"))


def diffstat(spark: SparkSession, root: str, spec: str = "", include_untracked: bool = False) -> DataFrame:
    revisions = parse_revisions(spec)
    rows = [(p, a, r, k) for k, (p, a, r) in enumerate(numstat(_diff(root, "--numstat", revisions, False, False)))]
    fresh = untracked(root) if include_untracked and revisions.head is None else []
    return filters.diffstat(spark.createDataFrame(rows, "path string, added long, removed long, ord int"), spark.createDataFrame([(p,) for p in fresh], "path string"))


def relative(paths: Iterable[str], top: str, root: str) -> list[str]:
    """``paths`` below ``top`` as seen from ``root``; those outside go, the first of equal ones stays."""
    top, root = os.path.realpath(top), os.path.realpath(root)
    if os.path.isfile(root):
        return [os.path.basename(root)] if any(os.path.join(top, p) == root for p in paths) else []
    prefix = os.path.relpath(root, top)
    head = "" if prefix == "." else prefix.replace(os.sep, "/") + "/"
    return list(dict.fromkeys(p[len(head) :] for p in paths if p.startswith(head)))

"""Watching: a polling loop with debounce, and the same diff and debounce over streams."""

from __future__ import annotations

import os
import time
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import changes

Stamps = dict[str, tuple[int, int]]


def stamps(paths: Iterable[str], root: str = "") -> Stamps:
    """(mtime in ns, size) of the paths that exist."""
    out: Stamps = {}
    for path in paths:
        try:
            stat = os.stat(os.path.join(root, path))
        except OSError:
            continue
        out[path] = (stat.st_mtime_ns, stat.st_size)
    return out


def mtime(path: str) -> float:
    """Seconds of the last change; -1 if the path is gone."""
    try:
        return os.stat(path).st_mtime
    except OSError:
        return -1.0


def diff(before: Stamps, after: Stamps) -> list[tuple[str, str]]:
    """(path, kind) by path, deletions last."""
    kept = [(p, "modified" if p in before else "added") for p in sorted(after) if before.get(p) != after[p]]
    return kept + [(p, "deleted") for p in sorted(set(before) - set(after))]


def interval(typed: float | None = None, variable: str = "TEXTQUARRY_INTERVAL", default: float = 0.5) -> float:
    """Seconds between polls: the typed value, else the environment's, else the default, within [0.05, 60]."""
    value = typed
    if value is None:
        try:
            value = float(os.environ.get(variable, default))
        except ValueError:
            value = default
    return min(60.0, max(0.05, value)) if value == value else default


def run(
    look: Callable[[], Stamps], rebuild: Callable[[list[tuple[str, str]]], None], every: float = 0.5, settle: float = 0.4, most: float = 5.0,
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, on_error: Callable[[Exception], None] | None = None, rounds: int | None = None,
) -> int:
    """Poll; after a change wait until nothing changes for ``settle``, ``most`` at the latest; then rebuild once.

    An error of a rebuild goes to ``on_error`` and the loop goes on. Ends after ``rounds`` polls, or at an interrupt.
    """
    base = seen = look()
    first = due = None
    built = polls = 0
    while rounds is None or polls < rounds:
        polls += 1
        sleep(every)
        now, at = look(), clock()
        if now != seen:
            first = at if first is None else first
            due, seen = min(at + settle, first + most), now
        if first is not None and at >= due:
            changed, base, first = diff(base, seen), seen, None
            if changed:
                built += 1
                try:
                    rebuild(changed)
                except Exception as e:
                    if on_error is None:
                        raise
                    on_error(e)
    return built


def stream_changes(snapshots: DataFrame) -> DataFrame:
    """(path, kind) for every new stamp in a stream of (path, mtime_ns, size); state is one stamp a path.

    A size below 0 says that the path is gone.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for frame in frames:
            for mtime, size in sorted(zip(frame["mtime_ns"], frame["size"])):
                new = None if size < 0 else (int(mtime), int(size))
                if new != last:
                    rows.append((key[0], "deleted" if new is None else "modified" if last else "added"))
                last = new
        if last is None:
            state.remove()
        else:
            state.update(last)
        yield pd.DataFrame(rows, columns=["path", "kind"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return snapshots.groupBy("path").applyInPandasWithState(step, "path string, kind string", "mtime_ns long, size long", "append", GroupStateTimeout.NoTimeout)


def stream_bursts(events: DataFrame, settle: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Extension: bursts of changes in event time (ts, key), by session windows with a watermark."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", settle)).agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def stream_rebuilds(events: DataFrame, settle: float, most: float, late: str = "10 seconds") -> DataFrame:
    """(key, at, n) over a stream of (ts, key): a rebuild ``settle`` seconds after the last of a burst's events, ``most`` after the
    first at the latest, as in batch. Times of rebuilds are in seconds.

    Events wait in their key's state until the watermark passes them, so they are folded in time order whatever batch they
    came in; a timer wakes the key when its next event or its rebuild is due. Rows later than the watermark are dropped.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, first, due, n = ([*state.get[0]], *state.get[1:]) if state.exists else ([], 0.0, 0.0, 0)
        for frame in frames:
            waiting += [t.timestamp() for t in frame["ts"]]
        passed = state.getCurrentWatermarkMs() / 1000
        waiting.sort()
        ready, rows = bisect_right(waiting, passed), []
        for t in waiting[:ready]:
            if n and t > due:
                rows.append((key[0], due, n))
                n = 0
            first = t if not n else first
            due, n = min(t + settle, first + most), n + 1
        waiting = waiting[ready:]
        if n and due < passed:  # no event before the rebuild can come any more
            rows.append((key[0], due, n))
            n = 0
        if waiting or n:
            state.update((waiting, first, due, n))
            state.setTimeoutTimestamp(int(max(passed, min([*waiting[:1], *([due] if n else [])])) * 1000) + 1)
        else:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "at", "n"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows, kind = events.select("ts", "key").withWatermark("ts", late), events.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at double, n long", "waiting array<double>, first double, due double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ns, size) of all files below ``root`` now; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def watch_folder(spark: SparkSession, root: str, checkpoint: str, rebuild: Callable[[DataFrame, int], None], keep: Callable[[DataFrame], DataFrame] = lambda rows: rows, every: str = "1 second"):
    """A streaming query that looks at ``root`` each ``every`` and rebuilds from the changes (path, kind): new files, changed ones
    and deleted ones. ``keep`` picks the watched rows of each listing anew, so the watch set may grow.

    The listing of a batch is a table beside the checkpoint; it is compared with that of the last batch before it. A batch
    that is run again after a failure compares with the same one. The first listing changes nothing.
    """
    from pyspark.errors import AnalysisException

    base = f"{checkpoint.rstrip('/')}/listings"

    def look(_: DataFrame, number: int) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        known = sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []
        try:
            now = keep(listing(spark, root))
            now.write.mode("overwrite").parquet(f"{base}/{number}")
        except AnalysisException:  # the folder is gone: nothing is there
            spark.createDataFrame([], "path string, mtime_ns long, size long").write.mode("overwrite").parquet(f"{base}/{number}")
        if before := [k for k in known if k < number]:
            moved = changes.diff(spark.read.parquet(f"{base}/{before[-1]}"), spark.read.parquet(f"{base}/{number}"))
            if not moved.isEmpty():
                rebuild(moved, number)
            for old in before[:-1]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{old}"), True)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(look).option("checkpointLocation", f"{checkpoint.rstrip('/')}/ticks").trigger(processingTime=every)


def stream_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Extension: counts and sums of events (ts, event_type, value) by tumbling or sliding windows; late rows are dropped."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(span, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def each_batch(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, on_error: Callable[[Exception], None] | None = None):
    """A streaming query that rebuilds once for each batch with changes; an error does not end it if ``on_error`` is given."""

    def work(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            rebuild(batch, number)
        except Exception as e:
            if on_error is None:
                raise
            on_error(e)

    return changes.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode("append")

"""Synthetic corpora with awkward shapes, the grid of bundles made from them, and comparison with an earlier grid."""

from __future__ import annotations

import json
import time
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.selection import Budget
from textquarry.plans import pack
from textquarry.sources import corpus

SCHEMA = "shape string, budget long, mode string, packed long, discovered long, fill double, over long, truncated long, duplicates long, seconds double"


def shapes(spark: SparkSession) -> dict[str, DataFrame]:
    """files(path, size, ext, name, depth, dirname, text) by shape."""
    same = "".join(f"value_number_{k} = compute_something({k})\n" for k in range(40))
    texts = {
        "identical": [("README.md", "# Same\n")] + [(f"src/m{k}.py", same) for k in range(200)],
        "one_long": [("README.md", "# Long\n"), ("src/long.py", "".join(f"def f{k}():\n    return {k}\n" for k in range(10_000)))],
        "tiny": [(f"d{k % 40}/f{k}.py", f"x = {k}\n") for k in range(1_500)],
        "long_name": [("a" * 40 + "/deep.py", "x = 1\n" * 80)],
        "mixed": [("README.md", "# Mixed\n\nWords.\n"), ("src/main.py", same), ("src/types.ts", "export type A = 1\n" * 60), ("config.json", '{"a": 1}\n'), ("docs/guide.md", "step\n" * 200)],
    }
    out = {}
    for shape, files in texts.items():
        rows = spark.createDataFrame(files, "path string, text string").withColumn("size", F.octet_length("text").cast("long"))
        out[shape] = corpus.with_parts(rows)
    return out


def grid(spark: SparkSession, budgets=(2_000, 10_000, 60_000), modes=("balanced", "coverage", "depth"), only: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each shape, budget and mode."""
    rows = []
    for shape, files in shapes(spark).items():
        if only and shape not in only:
            continue
        for total in budgets:
            for mode in modes:
                at = time.monotonic()
                b = pack.pack(files, Budget(total), mode, shape)
                rows.append((shape, total, mode, len(b.files), b.discovered, b.accounted / total, b.accounted - total, sum(f["truncated"] for f in b.files), len(b.duplicates), time.monotonic() - at))
    return spark.createDataFrame(rows, SCHEMA)


def packing_table(rows: DataFrame) -> DataFrame:
    """Mean fill, largest overrun and slowest cell of every shape."""
    return rows.groupBy("shape").agg(F.round(F.avg("fill"), 4).alias("mean_fill"), F.max("over").alias("max_over"), F.max("seconds").alias("max_seconds"))


def regressions(now: DataFrame, before: DataFrame, fill_drop: float = 0.10) -> DataFrame:
    """Shapes whose mean fill fell by more than ``fill_drop``, and those with any overrun."""
    old = before.select("shape", F.col("mean_fill").alias("old_fill"))
    joined = now.join(old, "shape", "left")
    return joined.where((F.col("mean_fill") < F.col("old_fill") - fill_drop) | (F.col("max_over") > 0)).select("shape", "mean_fill", "old_fill", "max_over")


HOSTILE = {
    "fence.md": "```\n````\n`````\n", "cdata.xml": "]]>]]]]>", "control.txt": "\x00\x01\x1f\x7f", "noncharacter.txt": "\ufffe\uffff", "empty.py": "", "crlf.txt": "a\r\nb\r", "astral.txt": "\U0001f600\U0010ffff",
    "quote'\".json": '{"a": "<&>"}', "new\nline.md": "# x", "tick`s.py": "x = '`'", "markup.html": "</file><script>", "long.txt": "x" * 5_000,
}


def integrity_problems(spark: SparkSession) -> list[str]:
    """What of a hostile corpus doesn't come back from the sinks."""
    rows = spark.createDataFrame([(p, t) for p, t in HOSTILE.items()], "path string, text string").withColumn("size", F.octet_length("text").cast("long"))
    b = pack.pack(corpus.with_parts(rows), Budget(60_000, max_per_dir=99), root="hostile")
    out = []
    data = json.loads(pack.render(b, "json"))
    if {f["path"]: f["content"] for f in data["files"]} != {f["path"]: f["text"] for f in b.files}:
        out.append("json: contents differ")
    try:
        if len(ET.fromstring(pack.render(b, "xml")).find("files")) != len(b.files):
            out.append("xml: files are missing")
    except ET.ParseError as e:
        out.append(f"xml: {e}")
    if pack.render(b, "markdown").count("\n### ") != len(b.files):
        out.append("markdown: headings differ")
    if len(b.files) + len(b.duplicates) != len(HOSTILE):
        out.append("files are missing")
    return out

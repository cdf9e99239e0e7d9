"""The library as one object: a corpus and what can be asked of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import columns as C
from textquarry.operators import blocks, duplicates, factoring, filters, graph, outline, ranking
from textquarry.operators.selection import Budget
from textquarry.plans import pack as plan
from textquarry.sources import corpus, tree


class Corpus:
    """files(path, size, ext, name, depth, dirname), and a way to their texts.

    Every method gives a new corpus or a DataFrame; nothing is read before it is needed.
    """

    def __init__(self, files: DataFrame, texts=None, root: str = "", ignored: int = 0):
        self.files, self._texts, self.root, self.ignored = files, texts, root, ignored

    @classmethod
    def tree(cls, spark: SparkSession, root: str, **options) -> "Corpus":
        """A directory tree; options are those of the walk."""
        scan = tree.walk(root, **options)
        return cls(tree.relation(spark, scan), tree.texts, scan.root, scan.ignored)

    @classmethod
    def table(cls, rows: DataFrame, root: str = "") -> "Corpus":
        """Any rows with a path and a text."""
        rows = corpus.with_parts(rows.withColumn("size", F.octet_length("text").cast("long")))
        return cls(rows.drop("text"), lambda files: files.join(rows.select("path", "text"), "path", "left"), root)

    def _with(self, files: DataFrame) -> "Corpus":
        return Corpus(files, self._texts, self.root, self.ignored)

    def where(self, include: Iterable[str] = (), exclude: Iterable[str] = (), max_size: int | None = None) -> "Corpus":
        files = self.files.where(filters.globbed(F.col("path"), include, exclude))
        return self._with(files.where(F.col("size") <= max_size) if max_size is not None else files)

    def without_ignored(self, rules=None) -> "Corpus":
        return self._with(filters.ignored(self.files, rules or filters.default_rules()).where("not is_ignored").drop("is_ignored"))

    def changed(self, paths: DataFrame) -> "Corpus":
        return self._with(filters.restricted(self.files, paths))

    def texts(self) -> DataFrame:
        return self._texts(self.files)

    def ranked(self, limit: int = 0) -> DataFrame:
        return ranking.top(ranking.scored(self.files), limit)

    def explained(self) -> DataFrame:
        return ranking.explained(ranking.scored(self.files))

    def counted(self, limit: int = 0, calibration: float = 1.0) -> DataFrame:
        """Token counts of the first ``limit`` files by rank; only these are read."""
        return C.with_tokens(self._texts(self.ranked(limit)).where("text is not null"), calibration=calibration)

    def imports(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Edges, entry points and hop distances."""
        return graph.analysed(self.texts())

    def near_duplicates(self, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
        """Similar pairs of texts that differ, and the class of equal ones that each file is in."""
        return duplicates.similar_pairs(self.texts().where("text is not null"), threshold)

    def shared_blocks(self, **options) -> list[blocks.Block]:
        return blocks.find_blocks(self.texts().where("text is not null"), **options)

    def factored(self, min_lines: int = 4, min_occurrences: int = 3) -> tuple[DataFrame, DataFrame]:
        """All texts with their repeated blocks replaced by markers, and the blocks."""
        texts = self.texts().where("text is not null")
        return factoring.factored(texts, factoring.found_blocks(texts, min_lines), min_occurrences)

    def outlines(self) -> DataFrame:
        return outline.rendered(outline.nodes(self.texts()))

    def pack(self, budget: int | Budget, mode: str = "balanced", **options) -> plan.Bundle:
        budget = Budget(budget) if isinstance(budget, int) else budget
        return plan.pack(self.files, budget, mode, self.root, read=self._texts, ignored=self.ignored, **options)

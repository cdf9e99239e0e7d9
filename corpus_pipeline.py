"""Documents to a weighted training set: five stages, each one operator of textquarry.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import common, decontaminate, jaccard_join, mixing, quality, secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    trees = quality.train(docs, common.table(spark, sf_dir, "labels"))
    (name,) = common.fresh(docs.columns, ["score"])
    return quality.scored(docs, trees, name).where(F.col(name) >= 0.5).select(common.columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id."""
    return jaccard_join.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its domain posterior, its rate, and the wanted and reached shares of the domains; none goes, as the
    least rate is above 0.

    A column of the documents that is called like a new one keeps its name; the new one then ends in ``_``.
    """
    weighted = mixing.mixed(docs, common.table(spark, sf_dir, "labels"))
    n_tokens, p, rate, wanted, reached = weighted.columns[len(docs.columns) :]
    by_domain = [(F.col(c)[k], f"{name}_{d}") for c, name in ((p, "p"), (wanted, "wanted"), (reached, "reached")) for k, d in enumerate(mixing.DOMAINS)]
    names = common.fresh([*docs.columns, n_tokens, rate], [name for _, name in by_domain])
    new = [value.alias(name) for (value, _), name in zip(by_domain, names)]
    return weighted.select(*common.columns(docs), n_tokens, *new[:3], rate, *new[3:])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]

#: The classifiers and the rates are not expressible in SQL; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

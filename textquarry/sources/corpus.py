"""Corpora as DataFrames: files(path, text, size), from tables or from a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import columns as C

#: A path for every row of ``documents``, valid in Spark's and in DuckDB's SQL.
DOCUMENT_PATH = """CASE
  WHEN doc_id % 50 = 0  THEN lang || '/p' || CAST(doc_id AS STRING) || '/README.md'
  WHEN doc_id % 16 = 1  THEN 'src/' || lang || '/' || source || '/mod_' || CAST(doc_id AS STRING) || '.py'
  WHEN doc_id % 16 = 2  THEN 'src/' || lang || '/w' || CAST(doc_id AS STRING) || '/index.ts'
  WHEN doc_id % 16 = 3  THEN 'lib/t' || CAST(doc_id AS STRING) || '/types.ts'
  WHEN doc_id % 16 = 4  THEN 'tests/' || lang || '/' || source || '/test_' || CAST(doc_id AS STRING) || '.py'
  WHEN doc_id % 16 = 5  THEN source || '/vendor/' || lang || '/dep_' || CAST(doc_id AS STRING) || '.js'
  WHEN doc_id % 16 = 6  THEN 'app/' || source || '/bundle_' || CAST(doc_id AS STRING) || '.min.js'
  WHEN doc_id % 16 = 7  THEN 'docs/' || lang || '/guide_' || CAST(doc_id AS STRING) || '.md'
  WHEN doc_id % 16 = 8  THEN source || '/c' || CAST(doc_id AS STRING) || '/CHANGELOG.md'
  WHEN doc_id % 16 = 9  THEN 'pkg/a/b/c/d/' || source || '/deep_' || CAST(doc_id AS STRING) || '.go'
  WHEN doc_id % 16 = 10 THEN source || '/settings_' || CAST(doc_id AS STRING) || '_config.yaml'
  WHEN doc_id % 16 = 11 THEN 'doc_' || CAST(doc_id AS STRING) || '.txt'
  WHEN doc_id % 16 = 12 THEN 'core/' || lang || '/x' || CAST(doc_id AS STRING) || '_server.py'
  WHEN doc_id % 16 = 13 THEN 'build/' || lang || '/out_' || CAST(doc_id AS STRING) || '.log'
  WHEN doc_id % 16 = 14 THEN source || '/.hidden_' || CAST(doc_id AS STRING)
  ELSE 'cmd/m' || CAST(doc_id AS STRING) || '/main.go'
END"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_parts(files: DataFrame) -> DataFrame:
    """``files`` with ext, name, depth and dirname of the path."""
    path = F.col("path")
    return files.withColumns({"ext": C.extension(path), "name": C.name(path), "depth": C.depth(path), "dirname": C.dirname(path)})


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files make fewer splits than there are cores; larger tables stay as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str, even: bool = True) -> DataFrame:
    """files(doc_id, path, size, text, lang, source) of the documents table."""
    docs = read(spark, sf_dir, "documents")
    docs = spread(docs) if even else docs
    return docs.select("doc_id", F.expr(DOCUMENT_PATH).alias("path"), F.octet_length("text").cast("long").alias("size"), "text", "lang", "source")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, even=False).select("doc_id", "path", "size")

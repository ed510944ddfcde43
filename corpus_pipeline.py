"""The corpus pipeline: each stage reads what its predecessor kept, written as Parquet between.

1. language: documents whose language can't be told go.
2. exact: of equal texts one row stays, the one with the smallest id.
3. near: of each group of near copies the document with the smallest id stays.
4. mix: each document is repeated as often as the mix takes it, or goes.
5. pack: all that is left is packed into sequences.

Rows keep all columns, of whatever names, up to the last stage. Repeated rows and null ids are
rows of their own: exact leaves one of equal rows; null ids come last where the smallest id stays.
Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import exact_dedup, mixing, ngram_join, packing, queries
from vellumine.llm.common import materialise, shared_dir

#: Posterior under which a language counts as not told.
LEAST_SCORE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of ``docs`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row, and that column. It is doc_id where that is
    unique and never null; otherwise rows are numbered in its order (nulls last) and written once,
    so that the numbers hold."""
    row = _free(docs, "_row")
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.withColumn(row, F.col("doc_id")), row
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last())
    return materialise(ordered.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _operand(rows: DataFrame, row: str, *columns: str) -> DataFrame:
    return rows.select(F.col(row).alias("doc_id"), *columns)


def _semi(rows: DataFrame, row: str, kept: DataFrame, columns: list[str]) -> DataFrame:
    chosen = _free(rows, "_kept")
    return rows.join(kept.select(F.col("doc_id").alias(chosen)), F.col(row) == F.col(chosen), "left_semi").select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = {c: _free(docs, f"_{c.lower()}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    found = queries.identified(docs.withColumnsRenamed(named))
    told = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return told.select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _rows(docs)
    return _semi(rows, row, exact_dedup.exact_dedup(_operand(rows, row, "text")).filter("kept"), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _rows(docs)
    return _semi(rows, row, ngram_join.jaccard_components(_operand(rows, row, "text")).filter("doc_id = component_id"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _rows(docs)
    ident, copies, copy = (_free(rows, c) for c in ("_mixed", "_copies", "_copy"))
    taken = mixing.mix(_operand(rows, row, "text", "source")).filter("copies > 0").select(F.col("doc_id").alias(ident), F.col("copies").alias(copies))
    repeated = rows.join(taken, F.col(row) == F.col(ident))
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Language models and packing are beyond SQL; the tests compare with brute force instead.
ORACLE_SQL = None

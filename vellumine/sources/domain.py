"""Canonical tables of the domain, mapped from the test tables: line items are alignments, orders
are reads, parts are features, events are repeat fragments (S8: only needed columns are read)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.ordering import global_row_number

READ_LENGTH = 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    start = F.expr("p_partkey div 5") * 40
    return load(spark, sf_dir, "part").select(
        k.alias("feature_id"), (k % 5).alias("seqname"), (start + 1).alias("f_start"), (start + F.col("p_size")).alias("f_end"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (k % 7 != 0).alias("is_te"),
        F.col("p_brand").alias("rep_name"), F.col("p_type").alias("rep_family"),
        F.element_at(F.array(*map(F.lit, ("LTR", "LINE", "SINE", "DNA"))), (k % 4 + 1).cast("int")).alias("rep_class"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema A; ``aln_id`` numbers a unique order of the rows."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = global_row_number(rows, F.expr("l_orderkey div 4096"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "aln_id")
    start = F.expr("l_partkey div 5") * 40 + 1 + F.col("l_suppkey") % 37
    from pyspark.sql import Window

    first = F.min("aln_id").over(Window.partitionBy("l_linestatus", "l_orderkey"))
    strand = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("*")
    return rows.select(
        "aln_id", F.col("l_linestatus").alias("sample_id"), F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % 5).alias("seqname"),
        start.alias("a_start"), (start + READ_LENGTH - 1).alias("a_end"), strand.alias("strand"), F.lit(READ_LENGTH).alias("qwidth"),
        F.col("l_quantity").cast("int").alias("as_score"), F.round(F.col("l_discount") * 100).cast("int").alias("nm"), F.round(F.col("l_tax") * 100).cast("int").alias("clip"),
        (F.col("l_linenumber") * 5).cast("int").alias("xs"), F.when(F.col("aln_id") == first, 0).otherwise(1).alias("is_secondary"),
    )


def rmsk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema D as far as the events give it."""
    names = F.create_map(*[F.lit(x) for pair in (("click", "ROO_LTR"), ("view", "ROO_I"), ("purchase", "BEL_LTR"), ("signup", "BEL_I"), ("error", "DOC")) for x in pair])
    minute = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', date_trunc('MINUTE', ts))") + 1
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("frag_id"), (F.col("user_id") % 5).alias("seqname"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        names[F.col("event_type")].alias("rep_name"), minute.cast("long").alias("g_start"), (minute + F.floor("value")).cast("long").alias("g_end"), (F.col("event_id") % 300).alias("milli_div"),
    )

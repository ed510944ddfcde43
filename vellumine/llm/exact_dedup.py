"""Exact dedup by content sort, with DataFrame operations only.

Sampled splitters range-partition the normalised texts (``repartitionByRange``) by their first
characters and hash, an external sort in each partition places equal texts next to each other, and a window compares whole
neighbouring texts and numbers each run of equal ones.

Copies of one text would all fall into one range. Texts with more rows than a quarter of an
average partition are therefore found first, by counting 64-bit hashes (at most four times as
many as partitions, so that table may be broadcast; a collision only salts a text in vain), and
their rows are split by a salt of the id within the sort key. Each salted run sends its head
alone to a second sort, which compares heads in full.

Results: null texts count as empty; null ids come last, a group of them has a null keep_id;
exactly one row of each group is kept, also if rows repeat; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import materialise, partitions, text_or_empty

#: Characters of a text in the sort's range key; whole texts are compared within a range.
KEY_CHARS = 64
#: A text with fewer rows is never salted.
LEAST_HOT = 64


def exact_dedup(df: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.
    ``keep`` says which id of equal texts stays: "smallest" or "largest"."""
    n = partitions(df.sparkSession)
    ident = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    text = text_or_empty()
    base = df.select("doc_id", (normalise(text) if normalise else text).alias("text")).withColumn("h", F.xxhash64("text"))
    hot_rows = max(LEAST_HOT, df.count() // (4 * n))

    hot = base.groupBy("h").count().filter(F.col("count") > hot_rows)
    hot = hot.select(F.col("h").alias("hot_h"), F.ceil(F.col("count") / hot_rows).alias("parts"))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("salt")), F.col("parts")))
    keyed = base.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left").withColumn("salt", salt.cast("int"))

    # Splitters are sampled to the driver, so the range key is bounded: the first characters, then
    # the hash to part texts that begin alike. Equal texts have equal keys.
    key = [F.substring("text", 1, KEY_CHARS).alias("start"), "h", "salt"]
    ranged = keyed.select("doc_id", "text", F.col("parts").isNotNull().alias("hot"), *key).repartitionByRange(n, "start", "h", "salt")
    run = Window.partitionBy("start", "h", "salt", "text")
    level = ranged.select(
        "doc_id", "text", "salt", "hot",
        F.row_number().over(run.orderBy(ident)).alias("rn"),
        F.first("doc_id").over(run.orderBy(ident)).alias("head"),
        F.count(F.lit(1)).over(run).alias("n"),
    )
    level = level.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "salt", "hot", "rn", "head", "n", F.when(F.col("hot") & (F.col("rn") == 1), F.col("text")).alias("head_text"))
    level = materialise(level, "dedup")

    cold = level.filter(~F.col("hot")).select("doc_id", F.col("head").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rn") == 1).alias("kept"), "text_sha256")
    heads = level.filter(F.col("hot") & (F.col("rn") == 1)).select("head_text", "doc_id", "n", "text_sha256", "salt", F.substring("head_text", 1, KEY_CHARS).alias("start"), F.xxhash64("head_text").alias("h")).repartitionByRange(n, "start", "h")
    same = Window.partitionBy("start", "h", "head_text")
    heads = heads.select(
        F.col("text_sha256").alias("s"), F.col("salt").alias("p"),
        F.first("doc_id").over(same.orderBy(ident)).alias("keep_id"),
        (F.row_number().over(same.orderBy(ident)) == 1).alias("top"),
        F.sum("n").over(same).alias("group_size"),
    )
    members = level.filter("hot").join(heads, (F.col("text_sha256") == F.col("s")) & (F.col("salt") == F.col("p")))
    members = members.select("doc_id", "keep_id", "group_size", (F.col("top") & (F.col("rn") == 1)).alias("kept"), "text_sha256")
    return cold.unionByName(members)

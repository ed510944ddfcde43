"""SAM text files as the canonical alignment table (S2, S5-S8), for batch and streaming readers alike.

A line's place in the table is its place in its file: rows are numbered inside each block of a file
and blocks by a small table of their sizes, so no window spans a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions import aligned_blocks, clipped, has_flag, passes_flags, query_width, reference_width

SECONDARY, REVERSE, FIRST_MATE, LAST_MATE = 0x100, 0x10, 0x40, 0x80
#: Integer tags that methods ask for, by column.
TAGS = {"as_score": "AS", "nm": "NM", "n_m": "nM", "nh": "NH", "xs": "XS"}


def _tag(rest: Column, tag: str) -> Column:
    return F.regexp_extract(rest, rf"(?:^|\t){tag}:i:(-?\d+)(?:\t|$)", 1).try_cast("int")


def _sample(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(sam|txt)(\.gz)?$", "")


def parse(lines: DataFrame, tags: dict[str, str] = TAGS) -> DataFrame:
    """Alignments of raw lines (a column ``value``; others stay). Header and blank lines go; a
    field that is ``*`` is null, as are tags that a line lacks. Positions are 1-based, ends closed."""
    others = [c for c in lines.columns if c != "value"]
    fields = F.split("value", "\t", 12)
    raw = lines.filter(~F.col("value").startswith("@") & (F.trim("value") != "")).select(*others, fields.alias("f"))
    at = lambda k: F.when(F.get("f", F.lit(k)) != "*", F.get("f", F.lit(k)))
    rows = raw.select(
        *others, F.get("f", F.lit(0)).alias("read_id"), at(1).try_cast("int").alias("flag"), at(2).alias("seqname"),
        at(3).try_cast("long").alias("a_start"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_seqname"), at(7).try_cast("long").alias("mate_start"),
        *[_tag(F.get("f", F.lit(11)), tag).alias(name) for name, tag in tags.items()],
    )
    return derived(rows)


def derived(rows: DataFrame) -> DataFrame:
    """Columns that follow from position, CIGAR and flag."""
    return rows.select(
        "*",
        F.when(has_flag(F.col("flag"), REVERSE), "-").otherwise("+").alias("strand"),
        (F.col("a_start") + reference_width(F.col("cigar")) - 1).alias("a_end"),
        aligned_blocks(F.col("a_start"), F.col("cigar")).alias("blocks"), query_width(F.col("cigar")).alias("qwidth"), clipped(F.col("cigar")).alias("clip"),
        has_flag(F.col("flag"), SECONDARY).cast("int").alias("is_secondary"),
        F.when(has_flag(F.col("flag"), FIRST_MATE), 1).when(has_flag(F.col("flag"), LAST_MATE), 2).alias("mate_ix"),
    )


def read_sam(spark: SparkSession, paths: str | list[str], tags: dict[str, str] = TAGS) -> DataFrame:
    """The files' alignments with ``sample_id`` and ``aln_id``, ascending in the order of files (by
    path) and of lines in them."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    sizes = lines.groupBy("_path", "_block").count()
    blocks = Window.orderBy("_path", "_block")  # a row a block of a file, not a line
    ahead = sizes.select(F.col("_path").alias("_p"), F.col("_block").alias("_b"), (F.sum("count").over(blocks) - F.col("count")).alias("_ahead"))
    numbered = lines.withColumn("_n", F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_at")))
    placed = numbered.join(ahead, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    placed = placed.select(_sample(F.col("_path")).alias("sample_id"), (F.col("_ahead") + F.col("_n")).alias("aln_id"), "value")
    return parse(placed, tags)


def aligner(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per sample the aligner of its first program line, in lower case; no row without one."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"))
    named = lines.filter((F.col("b") == 0) & F.col("value").startswith("@PG")).withColumn("at", F.monotonically_increasing_id())
    first = named.groupBy("p").agg(F.min_by("value", "at").alias("line"))
    return first.select(_sample(F.col("p")).alias("sample_id"), F.lower(F.regexp_extract("line", r"\tPN:([^\t]+)", 1)).alias("aligner")).filter("aligner <> ''")


def scan(alns: DataFrame, method: str, single_end: bool = True, fragments: bool = False, primary_only: bool = False) -> DataFrame:
    """What a method's scan lets through."""
    return alns.filter(passes_flags(F.col("flag"), method, single_end, fragments, primary_only))

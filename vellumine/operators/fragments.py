"""Views of paired reads: mates side by side, or a read's alignments as a list (S3, R3, R20, W12,
X1-X8, X21, H3). Rows of a read are told apart by ``pair_ix`` and, within a pair, ``mate_ix`` 1 or 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions import pair_ceiling_mean, pair_minimum
from vellumine.operators.weights import READ

#: Longest span of a pair that counts as one fragment.
MOST_SPAN = 500
PAIR = [*READ, "pair_ix"]


def numbered_mates(alns: DataFrame) -> DataFrame:
    """Adds pair_ix and mate_ix by scan order, for tables that don't tell them."""
    k = F.row_number().over(Window.partitionBy(*READ).orderBy("aln_id")) - 1
    return alns.withColumn("_k", k).withColumn("pair_ix", F.floor(F.col("_k") / 2).cast("int")).withColumn("mate_ix", (F.col("_k") % 2 + 1).cast("int")).drop("_k")


def pairs(alns: DataFrame, score: Callable[[Column, Column], Column] = pair_ceiling_mean) -> DataFrame:
    """One row a pair: both mates' place and width, ``as_score`` and ``clip`` and ``nm`` by the summary
    function, ``xs`` as the smaller, secondary if either mate is. A missing mate's columns are null."""
    one = lambda c, m: F.max(F.when(F.col("mate_ix") == m, F.col(c))).alias(f"{c}_{m}")
    columns = ("seqname", "a_start", "a_end", "qwidth", "as_score", "clip", "nm", "xs", "is_secondary")
    wide = alns.groupBy(*PAIR).agg(F.min("aln_id").alias("aln_id"), *[one(c, m) for c in columns for m in (1, 2)])
    summary = [score(F.col(f"{c}_1"), F.col(f"{c}_2")).cast("long").alias(c) for c in ("as_score", "clip", "nm")]
    secondary = F.greatest("is_secondary_1", "is_secondary_2").alias("is_secondary")
    place = [f"{c}_{m}" for c in ("seqname", "a_start", "a_end", "qwidth") for m in (1, 2)]
    return wide.select(*PAIR, "aln_id", *place, *summary, pair_minimum(F.col("xs_1"), F.col("xs_2")).alias("xs"), secondary)


def lists(alns: DataFrame) -> DataFrame:
    """One row a read's pair: its alignments as ``mates``, in mate order, at most a few."""
    mate = F.struct("mate_ix", "aln_id", "seqname", "a_start", "a_end", "qwidth", "as_score", "is_secondary")
    return alns.groupBy(*PAIR).agg(F.array_sort(F.collect_list(mate)).alias("mates"))


def pair_span() -> Column:
    """Bases from the first to the last of a pair of one sequence."""
    return F.greatest("a_end_1", "a_end_2") - F.least("a_start_1", "a_start_2") + 1


def list_length() -> Column:
    """A list's length (X7): the smaller of its span and its widths' sum; the widths' median where a
    mate is missing or on another sequence."""
    total = F.aggregate("mates", F.lit(0).cast("long"), lambda a, m: a + m["qwidth"])
    span = F.array_max(F.transform("mates", lambda m: m["a_end"])) - F.array_min(F.transform("mates", lambda m: m["a_start"])) + 1
    widths = F.array_sort(F.transform("mates", lambda m: m["qwidth"]))
    n = F.size("mates")
    low, high = F.get(widths, F.floor((n - 1) / 2).cast("int")), F.get(widths, F.floor(n / 2).cast("int"))
    mated = (n > 1) & (F.size(F.array_distinct(F.transform("mates", lambda m: m["seqname"]))) == 1)
    return F.when(mated, F.least(span, total).cast("double")).otherwise((low + high) / 2)


def fragment_length() -> Column:
    """A pair's fragment length: distance of the starts plus the last mate's width (X8); a lone mate's
    own width."""
    both = F.abs(F.col("a_start_1") - F.col("a_start_2")) + F.col("qwidth_2")
    return F.coalesce(both, F.col("qwidth_1"), F.col("qwidth_2"))


def mean_fragment_length(p: DataFrame, most: int = MOST_SPAN) -> DataFrame:
    """(sample_id, mean_length) over pairs of unique reads whose starts are at most ``most`` apart."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*READ))
    near = p.withColumn("_n", n).filter((F.col("_n") == 1) & (F.abs(F.col("a_start_1") - F.col("a_start_2")) <= most))
    return near.withColumn("_l", fragment_length()).groupBy("sample_id").agg(F.avg("_l").alias("mean_length"))


def mate_names(alns: DataFrame) -> DataFrame:
    """Every alignment's name: its read's and its number within the read."""
    k = F.row_number().over(Window.partitionBy(*READ).orderBy("pair_ix", "mate_ix", "aln_id"))
    return alns.withColumn("mate_name", F.concat_ws(".", F.col("read_id").cast("string"), k.cast("string")))

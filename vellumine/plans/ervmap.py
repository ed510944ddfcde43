"""Read-filter counting (A6, A7, E17, R1-R6): per-alignment quality filters, a suboptimal-alignment
filter, interval join and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators.weights import READ, arbitrate, cells, unique_reads

NO_SECONDARY = -99


def passes_quality(rate: float) -> Column:
    """Clipping and mismatches both under ``rate`` of the read."""
    return (F.col("clip") / F.col("qwidth") < rate) & (F.col("nm") / F.col("qwidth") < rate)


def passes_suboptimal_tag(cutoff: float) -> Column:
    return F.col("as_score") - F.col("xs") >= cutoff  # R2


def primary() -> Column:
    return F.col("is_secondary") == 0


def suboptimal_by_secondary(alns: DataFrame, cutoff: float) -> DataFrame:
    """Reads whose best primary score exceeds their best secondary one by the cutoff."""
    best = alns.groupBy(*READ).agg(F.max(F.when(primary(), F.col("as_score"))).alias("p"), F.max(F.when(~primary(), F.col("as_score"))).alias("s"))
    return best.filter(F.col("p") - F.coalesce("s", F.lit(NO_SECONDARY)) >= cutoff).select(*READ)


def matrix_counts(hits: DataFrame, feats: DataFrame, alns: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """Counts of primary cells after gene and TE arbitration (A6, A9): (sample_id, feature_id, n)."""
    kept = hits.join(reads, READ, "left_semi") if reads is not None else hits
    c = cells(kept, primary().cast("double"), "last").filter("w > 0")
    return arbitrate(c, feats, unique_reads(alns)).groupBy("sample_id", "feature_id").agg(F.count(F.lit(1)).alias("n"))

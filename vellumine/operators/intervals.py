"""Interval joins and interval windows.

A range predicate alone plans as a nested loop; here features are put into bins of a width near
their own length (levels, each eight times as wide as the one before), so a feature is in two bins
at most however long it is. Reads look into each level that features have. Pairs are joined by
(seqname, level, bin) and checked exactly; a pair that meets in two bins is kept in the one of the
later start, so nothing needs a distinct. A bin that very many reads share is a skewed key, which
adaptive execution splits. Features small enough by their size in the plan are broadcast by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bin width of the lowest level, widening by level, and the highest level.
BIN = 64
WIDER = 8
TOP_LEVEL = 8


def _level(width: Column, bin_width: int) -> Column:
    """The lowest level whose bins are as wide as an interval, the highest if none is."""
    out = F.lit(TOP_LEVEL)
    for k in range(TOP_LEVEL - 1, -1, -1):
        out = F.when(width <= bin_width * WIDER**k, F.lit(k)).otherwise(out)
    return out


def _width_of(level: Column, bin_width: int) -> Column:
    return F.element_at(F.array(*[F.lit(bin_width * WIDER**k) for k in range(TOP_LEVEL + 1)]), level + 1)


def _bins(df: DataFrame, start: str, end: str, width: Column) -> DataFrame:
    lo, hi = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.withColumn("_bin", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def strands_agree(a: Column, b: Column) -> Column:
    """Strand test: equal, or either is '*' (J1)."""
    return (a == b) | (a == "*") | (b == "*")


def interval_join(reads: DataFrame, feats: DataFrame, how: str = "any", ignore_strand: bool = True, width: int = BIN) -> DataFrame:
    """Pairs of reads (seqname, a_start, a_end, strand) and features (feature_id, seqname, f_start,
    f_end, strand): "any" overlap of a base, or "within" the feature. Feature columns seqname and
    strand are dropped; closed coordinates."""
    longest = feats.agg(F.max(_level(F.col("f_end") - F.col("f_start") + 1, width))).first()[0] or 0
    levels = F.explode(F.array(*[F.lit(k) for k in range(longest + 1)])) if longest else F.lit(0)
    left = _bins(reads.withColumn("_level", levels), "a_start", "a_end", _width_of(F.col("_level"), width) if longest else F.lit(width))
    right = feats.withColumnRenamed("seqname", "f_seqname").withColumnRenamed("strand", "f_strand").withColumn("_f_level", _level(F.col("f_end") - F.col("f_start") + 1, width))
    right = _bins(right, "f_start", "f_end", _width_of(F.col("_f_level"), width)).withColumnRenamed("_bin", "_f_bin")
    cond = (F.col("seqname") == F.col("f_seqname")) & (F.col("_level") == F.col("_f_level")) & (F.col("_bin") == F.col("_f_bin"))
    cond &= (F.col("a_start") <= F.col("f_end")) & (F.col("f_start") <= F.col("a_end"))
    if how == "within":
        cond &= (F.col("f_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("f_end"))
    if not ignore_strand:
        cond &= strands_agree(F.col("strand"), F.col("f_strand"))
    cond &= F.col("_bin") == F.floor(F.greatest("a_start", "f_start") / _width_of(F.col("_level"), width))
    return left.join(right, cond).drop("_level", "_f_level", "_bin", "_f_bin", "f_seqname", "f_strand")


def spliced_join(reads: DataFrame, ranges: DataFrame, how: str = "any", ignore_strand: bool = True) -> DataFrame:
    """Reads with ``blocks`` (array of start and end, the parts between introns) and features of one
    or more ranges (a row each, by feature_id): "any" if a block overlaps a range, "within" if each
    block lies in one of the feature's ranges (J1, J2). One row a read and feature, with the read's
    columns but no extent of the feature, which has several."""
    own = F.struct(*[F.col(c) for c in reads.columns])
    parts = reads.select(own.alias("_read"), "aln_id", "seqname", "strand", F.size("blocks").alias("_n"), F.posexplode("blocks").alias("_ix", "_b"))
    parts = parts.select("_read", "aln_id", "seqname", "strand", "_n", "_ix", F.col("_b.start").alias("a_start"), F.col("_b.end").alias("a_end"))
    met = interval_join(parts, ranges.select("feature_id", "seqname", "strand", "f_start", "f_end"), how, ignore_strand)
    pairs = met.groupBy("aln_id", "feature_id").agg(F.first("_read").alias("_read"), F.first("_n").alias("_n"), F.count_distinct("_ix").alias("_in"))
    if how == "within":
        pairs = pairs.filter("_in = _n")
    return pairs.select("_read.*", "feature_id")


def compound_overlap_length(reads: DataFrame, ranges: DataFrame, ignore_strand: bool = True) -> DataFrame:
    """(aln_id, feature_id, ov_len): the most bases that a read's extent shares with one of a feature's
    ranges (J4)."""
    met = interval_join(reads.select("aln_id", "seqname", "strand", "a_start", "a_end"), ranges.select("feature_id", "seqname", "strand", "f_start", "f_end"), "any", ignore_strand)
    return met.groupBy("aln_id", "feature_id").agg(F.max(overlap_length()).alias("ov_len"))


def unique_hits(hits: DataFrame) -> DataFrame:
    """Only alignments with exactly one hit (inter-feature rule of J1, J2; A2)."""
    return hits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("aln_id"))).filter("_n = 1").drop("_n")


def _by_mode(reads: DataFrame, feats: DataFrame, how: str, ignore_strand: bool) -> DataFrame:
    return spliced_join(reads, feats, how, ignore_strand) if "blocks" in reads.columns else interval_join(reads, feats, how, ignore_strand)


def overlap_union(reads: DataFrame, feats: DataFrame, ignore_strand: bool, inter_feature: bool = True) -> DataFrame:
    """Mode "ovUnion" (J1)."""
    hits = _by_mode(reads, feats, "any", ignore_strand)
    return unique_hits(hits) if inter_feature else hits


def overlap_intersection_strict(reads: DataFrame, feats: DataFrame, ignore_strand: bool, inter_feature: bool = True) -> DataFrame:
    """Mode "ovIntersectionStrict" (J2)."""
    hits = _by_mode(reads, feats, "within", ignore_strand)
    return unique_hits(hits) if inter_feature else hits


#: Overlap modes by name; a parameter object takes any callable of this form as well.
MODES: dict[str, Callable[..., DataFrame]] = {"ovUnion": overlap_union, "ovIntersectionStrict": overlap_intersection_strict}


def overlap_length() -> Column:
    """Shared bases of a hit's alignment and feature extents."""
    return F.greatest(F.lit(0), F.least("a_end", "f_end") - F.greatest("a_start", "f_start") + 1).cast("long")


def count_by_feature(hits: DataFrame, feats: DataFrame, samples: DataFrame) -> DataFrame:
    """Hits of each feature in each sample, 0 where there is none (A1)."""
    counts = hits.groupBy("sample_id", "feature_id").count()
    grid = samples.select("sample_id").distinct().crossJoin(feats.select("feature_id"))  # samples are few: files of a study
    return grid.join(counts, ["sample_id", "feature_id"], "left").select("sample_id", "feature_id", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def gap_merge(frags: DataFrame, keys: list[str], insert: int, start: str = "g_start", end: str = "g_end") -> DataFrame:
    """Gap and islands (W4): ``frags`` with ``island`` (from 1 within ``keys``); a fragment joins the
    island before it if the gap is at most ``insert``."""
    w = Window.partitionBy(*keys).orderBy(start, end, "frag_id")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) - reach - 1 > insert), 1).otherwise(0)
    return frags.withColumn("_open", opens).withColumn("island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_open")


def lag_merge(frags: DataFrame, keys: list[str], minus: Column | None = None) -> DataFrame:
    """Consensus-guided merge (W6): a fragment stays with the one before while start and end
    ascend, the step plus width is under twice the consensus length, and consensus positions
    ascend ('+') or descend ('-'). Needs cons_len, c_start, c_end."""
    w = Window.partitionBy(*keys).orderBy("g_start", "g_end", "frag_id")
    ps, pe, pcs, pce = (F.lag(c).over(w) for c in ("g_start", "g_end", "c_start", "c_end"))
    up = (F.col("c_start") > pcs) & (F.col("c_end") > pce)
    down = (F.col("c_start") < pcs) & (F.col("c_end") < pce)
    close = F.col("g_start") - ps + (F.col("g_end") - F.col("g_start") + 1) < 2 * F.col("cons_len")
    stays = (F.col("g_start") > ps) & (F.col("g_end") > pe) & close & (F.when(minus, down).otherwise(up) if minus is not None else up)
    opens = F.when(ps.isNull() | ~stays, 1).otherwise(0)
    return frags.withColumn("_open", opens).withColumn("island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_open")

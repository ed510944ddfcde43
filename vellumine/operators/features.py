"""Feature preparation and result assembly (FP1-FP8, A3, A14, A15, J19, J20, H6, U1-U5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESERVED_KEYS = frozenset({"Status", "RelLength", "Class", "status", "rel_length"})


class FeatureError(ValueError):
    pass


def unite(te: DataFrame, genes: DataFrame | None, name: str = "name") -> DataFrame:
    """TEs, then genes, with ``is_te`` (FP1, FP2). Genes without ``type`` are exons; names of the two
    may not meet; neither may be empty."""
    out = te.withColumn("is_te", F.lit(True))
    if genes is None:
        return out
    if genes.isEmpty():
        raise FeatureError("no gene features")
    if not te.join(genes.select(name).distinct(), name, "left_semi").isEmpty():
        raise FeatureError("TE and gene names overlap")
    genes = genes if "type" in genes.columns else genes.withColumn("type", F.lit("exon"))
    return out.unionByName(genes.withColumn("is_te", F.lit(False)), allowMissingColumns=True)


def group_exons(features: DataFrame, name: str = "name") -> DataFrame:
    """Compound features by name (FP3, FP4): TEs and exons only; ranges in (start, end) order."""
    kept = features.filter(F.col("is_te") | (F.col("type") == "exon"))
    ranges = F.array_sort(F.collect_list(F.struct("f_start", "f_end", "seqname", "strand")))
    return kept.groupBy(name, "is_te").agg(ranges.alias("ranges"), F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("f_end") - F.col("f_start") + 1).alias("width"))


def aggregation_key(columns: list[str]) -> Column:
    """One column itself, several joined by ':' with NA for nulls (FP6)."""
    if RESERVED_KEYS.intersection(columns):
        raise FeatureError("cannot aggregate by status, relative length or class")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws(":", *parts)


def aggregate_counts(counts: DataFrame, features: DataFrame, columns: list[str], n: str = "n") -> DataFrame:
    """Counts summed by key for TEs; genes keep their ids."""
    key = F.when(F.col("is_te"), aggregation_key(columns)).otherwise(F.col("feature_id").cast("string"))
    return counts.join(features, "feature_id").groupBy("sample_id", key.alias("key")).agg(F.sum(n).alias(n))


def consolidate(features: DataFrame, columns: list[str]) -> DataFrame:
    """Row metadata of aggregated results (FP7): distinct classes and mean width by key; genes as is."""
    key = F.when(F.col("is_te"), aggregation_key(columns)).otherwise(F.col("feature_id").cast("string"))
    return features.groupBy(key.alias("key"), "is_te").agg(F.array_join(F.array_sort(F.collect_set("rep_class")), ",").alias("classes"), F.avg(F.col("f_end") - F.col("f_start") + 1).alias("mean_width"), F.count(F.lit(1)).alias("n_members"))


def check_unique(features: DataFrame, name: str) -> None:
    """Names of TEs must be unique (FP8)."""
    if not features.groupBy(name).count().filter("count > 1").isEmpty():
        raise FeatureError("TE names are not unique")


def outer_metadata(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge on an id (FP5, J7)."""
    return left.join(right, key, "full_outer")


def pivot(counts: DataFrame, samples: list[str], key: str = "feature_id", n: str = "n") -> DataFrame:
    """Feature by sample table, 0 where a sample lacks the feature."""
    return counts.groupBy(key).pivot("sample_id", samples).agg(F.sum(n)).na.fill(0)


def with_phenodata(samples: DataFrame, phenodata: DataFrame) -> DataFrame:
    """Sample table with its metadata (H6); the numbers of rows must agree."""
    if phenodata.count() != samples.count():
        raise FeatureError("phenodata must have one row per sample")
    return samples.join(phenodata, "sample_id", "left")


def harmonise(alns: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Sequence names of alignments to the features' style (S14): ``seqinfo`` has seqname, style
    name and whether lengths agree; disagreeing and unknown sequences go. One row a sequence."""
    ok = seqinfo.filter("lengths_agree").select(F.col("seqname").alias("_s"), "target")
    return alns.join(F.broadcast(ok), F.col("seqname") == F.col("_s")).withColumn("seqname", F.col("target")).drop("_s", "target")


def ucsc_style(name: Column) -> Column:
    """'1' and 'MT' as 'chr1' and 'chrM'."""
    return F.when(name.startswith("chr"), name).when(name == "MT", "chrM").otherwise(F.concat(F.lit("chr"), name))

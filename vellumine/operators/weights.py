"""Read by feature weights as rows (sample_id, read_id, feature_id, w): J9-J18, A4-A13, W13, W14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.shared import written

READ = ["sample_id", "read_id"]
NO_FEATURE = -1


def by_read(*more: str):
    return Window.partitionBy(*READ, *more)


def settled(q: DataFrame) -> DataFrame:
    """``q`` written, then dealt by read and kept: every step's windows over reads find it dealt so,
    and what a lost executor held is read again from the table."""
    return written(q, "cells").repartition(*READ).persist()


def unique_reads(alns: DataFrame) -> DataFrame:
    """(sample_id, read_id, is_unique): one alignment in all that were scanned."""
    return alns.groupBy(*READ).agg((F.count(F.lit(1)) == 1).alias("is_unique"))


def row_normalise(q: DataFrame, w: str = "w") -> DataFrame:
    total = F.sum(w).over(by_read())
    return q.withColumn(w, F.when(total > 0, F.col(w) / total).otherwise(0.0))


def cells(hits: DataFrame, value: Column, how: str) -> DataFrame:
    """Hits to cells: the value of the last alignment, the largest, or the sum."""
    agg = {"last": F.max_by(value, F.col("aln_id")), "max": F.max(value), "sum": F.sum(value), "any": F.lit(1.0)}[how]
    return hits.groupBy(*READ, "feature_id").agg(agg.alias("w"))


def arbitrate(q: DataFrame, te: DataFrame, uniq: DataFrame) -> DataFrame:
    """Reads that hit TEs and genes: multi-mapping ones keep TEs, unique ones genes (A9, A10). The
    no-feature column is neither. Adds ``is_te`` (null there) and ``is_unique``."""
    j = q.join(te.select("feature_id", "is_te"), "feature_id", "left").join(uniq, READ)
    j = j.withColumn("_te", F.max(F.coalesce("is_te", F.lit(False))).over(by_read())).withColumn("_gene", F.max(F.coalesce(~F.col("is_te"), F.lit(False))).over(by_read()))
    lost = F.col("_te") & F.col("_gene") & (F.col("is_te") == F.col("is_unique"))
    return j.filter(~F.coalesce(lost, F.lit(False))).drop("_te", "_gene")


def proportional(q: DataFrame, base: str) -> Column:
    """Share of each cell in its read by ``base``; equal shares if that is 0 all over the read."""
    total = F.sum(base).over(by_read())
    return F.when(total > 0, F.col(base) / total).otherwise(1.0 / F.count(F.lit(1)).over(by_read()))


def unique_counts(q: DataFrame) -> DataFrame:
    """Counts of unique reads per feature (A11), from arbitrated cells."""
    u = q.filter("is_unique").withColumn("_n", F.count(F.lit(1)).over(by_read()))
    genes = u.filter("not is_te").select("sample_id", "feature_id", (1.0 / F.col("_n")).alias("u"))
    te = u.filter("is_te")
    single = te.filter("_n = 1").groupBy("sample_id", "feature_id").agg(F.count(F.lit(1)).cast("double").alias("u"))
    shared = te.filter("_n > 1").join(single, ["sample_id", "feature_id"], "left").withColumn("u0", F.coalesce("u", F.lit(0.0)))
    shared = shared.withColumn("u", proportional(shared, "u0"))
    return genes.unionByName(single).unionByName(shared.select("sample_id", "feature_id", "u")).groupBy("sample_id", "feature_id").agg(F.sum("u").alias("u"))


def multi_gene_counts(q: DataFrame, u: DataFrame, hits: DataFrame, te: DataFrame) -> DataFrame:
    """Multi-mapping reads on genes: split by unique counts, over the alignments that hit genes."""
    g = q.filter("not is_unique and not is_te").join(u, ["sample_id", "feature_id"], "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
    alns = hits.join(te.filter("not is_te").select("feature_id"), "feature_id", "left_semi").groupBy(*READ).agg(F.countDistinct("aln_id").alias("n_aln"))
    g = g.withColumn("share", proportional(g, "u")).join(alns, READ)
    return g.groupBy("sample_id", "feature_id").agg(F.sum(F.col("share") / F.col("n_aln")).alias("g"))


def alignment_split(hits: DataFrame, te: DataFrame) -> DataFrame:
    """TE cell weights: 1 over the TEs of the last alignment that hits several features."""
    w = Window.partitionBy("aln_id")
    h = hits.join(te.select("feature_id", "is_te"), "feature_id").withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.count_if("is_te").over(w)).filter("is_te")
    split = F.max_by(F.when(F.col("_n") > 1, 1.0 / F.col("_k")), F.when(F.col("_n") > 1, F.col("aln_id")))
    return h.groupBy(*READ, "feature_id").agg(F.coalesce(split, F.lit(1.0)).alias("w"))


def best_overlap(hits: DataFrame, length: Column, min_fraction: float) -> DataFrame:
    """Of hits longer than the fraction of the read, the first longest per alignment."""
    kept = hits.withColumn("ov_len", length).filter(F.col("ov_len") > min_fraction * F.col("qwidth"))
    rank = F.row_number().over(Window.partitionBy("aln_id").orderBy(F.col("ov_len").desc(), "feature_id"))
    return kept.withColumn("_r", rank).filter("_r = 1").drop("_r")


def no_feature_hits(alns: DataFrame, hits: DataFrame, uniq: DataFrame) -> DataFrame:
    """Alignments without a hit of multi-mapping reads that have one elsewhere."""
    touched = hits.select(*READ).distinct()
    rest = alns.join(uniq.filter("not is_unique").select(*READ), READ, "left_semi").join(touched, READ, "left_semi")
    return rest.join(hits.select("aln_id"), "aln_id", "left_anti").withColumn("feature_id", F.lit(NO_FEATURE).cast("long"))


def rescale_expm1(alns: DataFrame) -> DataFrame:
    """Scores by the exponential of the rank in the sample's range (X11, A24): adds ``s``. The
    extremes are one row a sample, so they are broadcast."""
    ext = alns.groupBy("sample_id").agg(F.min("as_score").alias("_lo"), F.max(F.col("as_score") + F.col("qwidth")).alias("_hi"))
    j = alns.join(F.broadcast(ext), "sample_id")
    return j.withColumn("s", F.expm1(100.0 * (F.col("as_score") - F.col("_lo") + 1 + F.col("qwidth")) / (F.col("_hi") - F.col("_lo") + 1))).drop("_lo", "_hi")


def rescale_softmax(alns: DataFrame) -> DataFrame:
    """exp(AS - logsumexp(AS)) over the sample (X12, A23): adds ``s``."""
    top = alns.groupBy("sample_id").agg(F.max("as_score").alias("_m"))
    j = alns.join(F.broadcast(top), "sample_id")
    total = j.groupBy("sample_id").agg(F.sum(F.exp((F.col("as_score") - F.col("_m")).cast("double"))).alias("_t"))
    return j.join(F.broadcast(total), "sample_id").withColumn("s", F.exp(F.col("as_score") - F.col("_m") - F.log("_t"))).drop("_m", "_t")


def key_no_feature(q: DataFrame) -> DataFrame:
    """No-feature cells keyed by the set of the read's other columns (E14): ``feature_id`` becomes text,
    "no_feature:" and the others' ids in order for those cells, so that each pattern is a column."""
    others = F.array_sort(F.collect_set(F.when((F.col("feature_id") != NO_FEATURE) & (F.col("w") > 0), F.col("feature_id"))).over(by_read()))
    pattern = F.array_join(F.transform(others, lambda x: x.cast("string")), "_")
    key = F.when(F.col("feature_id") == NO_FEATURE, F.concat(F.lit("no_feature:"), pattern)).otherwise(F.col("feature_id").cast("string"))
    return q.withColumn("feature_id", key)


def patterns(q: DataFrame) -> DataFrame:
    """Mass and first read of each no-feature column of ``key_no_feature``."""
    none = q.filter(F.col("feature_id").startswith("no_feature:"))
    return none.groupBy("sample_id", "feature_id").agg(F.min("read_id").alias("first_read"), F.sum("w").alias("mass"))

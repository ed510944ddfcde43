"""Repeat annotations by genome (S12, H1) and sequence names that agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.features import harmonise, ucsc_style


class AnnotationError(ValueError):
    pass


def title_date(title: Column) -> Column:
    """The month in a title's brackets, as " (Mar2020) " (X23); null without one."""
    return F.to_date(F.concat(F.lit("1"), F.nullif(F.regexp_extract(title, r" \(([A-Za-z]{3}[0-9]{4})\) ", 1), F.lit(""))), "dMMMyyyy")


def newest(tracks: DataFrame, genome: str | None = None, track_id: int | str | None = None) -> DataFrame:
    """The one track (id, genome, title, path) asked for: by id, or the newest of a genome by its
    title's month; of equal months the first id."""
    found = tracks.filter(F.col("id") == track_id) if track_id is not None else tracks.filter(F.col("genome") == genome)
    return found.orderBy(title_date(F.col("title")).desc_nulls_last(), "id").limit(1)


def load_rmsk(spark: SparkSession, tracks: DataFrame, genome: str | None = None, parsefun: Callable[..., DataFrame] = lambda df: df, track_id: int | str | None = None, **more) -> DataFrame:
    """The track's table, Parquet or tab-separated text with a header, through ``parsefun``."""
    row = newest(tracks, genome, track_id).first()
    if row is None:
        raise AnnotationError(f"no track {track_id}" if track_id is not None else f"no tracks for genome {genome}")
    path = row["path"]
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    return parsefun(raw, **more)


def style(seqinfo: DataFrame) -> str:
    """"UCSC" if names start with chr, else "NCBI"."""
    return "UCSC" if seqinfo.filter(F.col("seqname").startswith("chr")).limit(1).count() else "NCBI"


def _plain(name: Column) -> Column:
    return F.when(name == "chrM", "MT").otherwise(F.regexp_replace(name, "^chr", ""))


def match_sequences(alns: DataFrame, own: DataFrame, features: DataFrame) -> DataFrame:
    """``alns`` with sequence names in the features' style. ``own`` and ``features``: (seqname, length)
    of the alignments' header and of the annotation. Where the styles agree nothing is changed;
    else sequences that the two don't share, or of another length, go. All other: an error."""
    if style(own) == style(features):
        return alns
    target = ucsc_style(F.col("seqname")) if style(features) == "UCSC" else _plain(F.col("seqname"))
    info = own.select("seqname", target.alias("target"), "length").join(features.select(F.col("seqname").alias("target"), F.col("length").alias("_l")), "target")
    info = info.select("seqname", "target", (F.col("length") == F.col("_l")).alias("lengths_agree"))
    if info.filter("lengths_agree").isEmpty():
        raise AnnotationError("no sequence of the alignments has the length of the annotation's")
    return harmonise(alns, info)

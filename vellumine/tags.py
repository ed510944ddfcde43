"""What tags alignments have."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records that are looked at; a fixed number, as probing asks only what kind of file it is.
PROBED = 1000
#: Columns of the tags; a suboptimal tag must be on every record, the others on any.
COLUMNS = {"NH": "nh", "NM": "nm", "nM": "n_m", "AS": "as_score", "XS": "xs"}
SUBOPTIMAL = ("XS",)


class TagError(ValueError):
    pass


def probe(alns: DataFrame, records: int = PROBED) -> DataFrame:
    """One row, a boolean a tag, from the first primary records in scan order; a pair is looked at in
    its first mate, if mates are known. No record: no tag."""
    first = alns.filter("is_secondary = 0")
    if "mate_ix" in alns.columns:
        first = first.filter("mate_ix is null or mate_ix = 1")
    first = first.orderBy("aln_id").limit(records)
    there = lambda c, every: (F.bool_and if every else F.bool_or)(F.col(c).isNotNull())
    known = {t: c for t, c in COLUMNS.items() if c in alns.columns}
    return first.agg(*[F.coalesce(there(c, t in SUBOPTIMAL), F.lit(False)).alias(f"has_{t}" if t != "nM" else "has_n_m") for t, c in known.items()])


def present(alns: DataFrame, records: int = PROBED) -> dict[str, bool]:
    row = probe(alns, records).first().asDict()
    return {t: row.get(f"has_{t}" if t != "nM" else "has_n_m", False) for t in COLUMNS}


def mismatches(alns: DataFrame, there: dict[str, bool]) -> Column:
    """NM where the file has it, else nM (X3): a choice for the file, not for each row."""
    if there.get("NM"):
        return F.col("nm")
    if there.get("nM"):
        return F.col("n_m")
    raise TagError("neither NM nor nM in the alignments")


def multi_by_nh(alns: DataFrame) -> DataFrame:
    """(sample_id, read_id, is_unique) by the NH tag, where there are no secondary alignments to
    tell multi-mapping reads by (X9, A9): more than two reported alignments are several."""
    return alns.groupBy("sample_id", "read_id").agg((F.max("nh") <= 2).alias("is_unique"))


def check_scan(hits: DataFrame, alns: DataFrame) -> None:
    """Something must overlap; without secondary alignments multi-mapping can't be told."""
    if hits.isEmpty():
        raise ValueError("no alignment overlaps a feature")
    if alns.filter("is_secondary = 1").isEmpty():
        warnings.warn("no secondary alignments: every read counts as uniquely mapping", stacklevel=2)

"""Column functions on CIGAR strings, flags and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNMAPPED, PROPER_PAIR, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x4, 0x2, 0x100, 0x200, 0x400, 0x800


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Bases in the given operations."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{ops}]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))


def clipped(cigar: Column) -> Column:
    return cigar_sum(cigar, "HS")


def query_width(cigar: Column) -> Column:
    return cigar_sum(cigar, "MIS=X")


def reference_width(cigar: Column) -> Column:
    return cigar_sum(cigar, "MDN=X")


def aligned_blocks(start: Column, cigar: Column) -> Column:
    """The parts of an alignment between introns (N), as an array of (start, end), closed."""
    sizes = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda x: x.cast("long"))
    ops = F.regexp_extract_all(cigar, F.lit(r"\d+([MDN=X])"), F.lit(1))
    steps = F.arrays_zip(sizes.alias("size"), ops.alias("op"))
    zero = F.struct(start.cast("long").alias("at"), start.cast("long").alias("begin"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + x["size"]
        cut = F.when(a["at"] > a["begin"], F.concat(a["done"], F.array(F.struct(a["begin"].alias("start"), (a["at"] - 1).alias("end"))))).otherwise(a["done"])
        gap = x["op"] == "N"
        return F.struct(end.alias("at"), F.when(gap, end).otherwise(a["begin"]).alias("begin"), F.when(gap, cut).otherwise(a["done"]).alias("done"))

    last = lambda a: F.when(a["at"] > a["begin"], F.concat(a["done"], F.array(F.struct(a["begin"].alias("start"), (a["at"] - 1).alias("end"))))).otherwise(a["done"])
    return F.aggregate(steps, zero, step, last)


def pair_ceiling_mean(a: Column, b: Column) -> Column:
    """Ceiling of the mates' mean; a missing mate takes the other's value."""
    return F.ceil((F.coalesce(a, b) + F.coalesce(b, a)) / 2)


def pair_minimum(a: Column, b: Column) -> Column:
    """Minimum that is null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def fragment_score(scores: Column, mated: Column) -> Column:
    """Sum of mated scores, else twice the mean, as a whole number."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when(mated, total).otherwise(2 * total / F.size(scores)).cast("int")


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def passes_flags(flag: Column, method: str, single_end: bool, fragments: bool, primary_only: bool = False) -> Column:
    """Flag filter of a method's scan."""
    mask = UNMAPPED | DUPLICATE | QC_FAIL
    if method == "ervmap":
        mask |= SUPPLEMENTARY | (SECONDARY if primary_only else 0)
    ok = flag.bitwiseAND(mask) == 0
    paired = not single_end and (method == "tetranscripts" or not fragments)
    return ok & has_flag(flag, PROPER_PAIR) if paired else ok


def effective_length(width: Column, read_length: Column | float) -> Column:
    """Width less read length plus 1, never below 0."""
    return F.greatest(F.lit(0.0), (width - read_length + 1).cast("double"))


def without_question_mark(c: Column) -> Column:
    return F.translate(c, "?", "")


def sample_name(path: Column) -> Column:
    """File name without the alignment suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r".bam$", "")

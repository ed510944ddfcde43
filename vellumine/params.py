"""Parameter objects of the four quantification methods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.operators.features import aggregation_key, unite
from vellumine.operators.intervals import MODES

REASSIGN_MODES = ("exclude", "choose", "average", "conf")
GENE_COUNT_MODES = ("all", "ervmap")

#: A prior: one number for all features, or a table (feature_id, prior) that names every one.
Prior = float | DataFrame


class ParameterError(ValueError):
    pass


def _one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ParameterError(f"{name} must be one of {', '.join(map(str, allowed))}, not {value!r}")


@dataclass(frozen=True, repr=False, eq=False)
class MethodParam:
    """What every method is given: alignments (a canonical table, or paths of SAM or BAM files),
    TE and gene features (feature_id, seqname, f_start, f_end, strand and metadata), the overlap
    mode (a name or a function of reads, features, ignore_strand, inter_feature that gives hits)
    and the columns by which counts of TEs are summed."""

    alignments: DataFrame | str | list[str]
    te_features: DataFrame
    aggregate_by: tuple[str, ...] = ()
    ov_mode: str | Callable[..., DataFrame] = "ovUnion"
    gene_features: DataFrame | None = None
    single_end: bool = True
    ignore_strand: bool = False
    strand_mode: int = 1
    fragments: bool = False

    def __post_init__(self) -> None:
        if not callable(self.ov_mode):
            _one_of("ov_mode", self.ov_mode, MODES)
        _one_of("strand_mode", self.strand_mode, (0, 1, 2))
        if not isinstance(self.alignments, DataFrame) and not self.path:
            raise ParameterError("no alignment files")
        if self.aggregate_by:
            aggregation_key(list(self.aggregate_by))
            missing = [c for c in self.aggregate_by if c not in self.te_features.columns]
            if missing:
                raise ParameterError(f"TE features lack {', '.join(missing)}")
        if self.single_end and self.fragments:
            raise ParameterError("fragments are of paired ends")

    @property
    def path(self) -> list[str]:
        """The alignment files; none if a table was given."""
        given = self.alignments
        return [] if isinstance(given, DataFrame) else [given] if isinstance(given, str) else list(given)

    @cached_property
    def features(self) -> DataFrame:
        """TEs, then genes, with ``is_te``."""
        return unite(self.te_features, self.gene_features, "feature_id")

    @property
    def overlap(self) -> Callable[..., DataFrame]:
        return self.ov_mode if callable(self.ov_mode) else MODES[self.ov_mode]

    @property
    def has_genes(self) -> bool:
        return self.gene_features is not None

    def __repr__(self) -> str:
        lines = [type(self).__name__]
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, DataFrame):
                value = f"table of {', '.join(value.columns[:4])}{', ...' if len(value.columns) > 4 else ''}"
            elif isinstance(value, list | tuple) and len(value) > 4:
                value = f"{', '.join(map(str, value[:2]))}, ..., {value[-1]} ({len(value)})"
            lines.append(f"  {f.name}: {value}")
        return "\n".join(lines)


@dataclass(frozen=True, repr=False, eq=False)
class ErvmapParam(MethodParam):
    """Counting with read-quality filters. ``suboptimal_tag``: "auto" (XS where the files' aligner is
    bwa), a tag's two letters, or "none"; ``suboptimal_cutoff`` None leaves that filter out."""

    ignore_strand: bool = True
    max_mismatch_rate: float = 0.02
    suboptimal_tag: str = "auto"
    suboptimal_cutoff: float | None = 5
    gene_count_mode: str = "all"
    aligner: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        _one_of("gene_count_mode", self.gene_count_mode, GENE_COUNT_MODES)
        if self.suboptimal_tag not in ("auto", "none") and len(self.suboptimal_tag) != 2:
            raise ParameterError("suboptimal_tag must be auto, none or a tag's two letters")


@dataclass(frozen=True, repr=False, eq=False)
class TetranscriptsParam(MethodParam):
    """Ratio EM over multi-mapping reads on TEs."""

    tolerance: float = 1e-4
    max_iter: int = 100


@dataclass(frozen=True, repr=False, eq=False)
class _PairParam(MethodParam):
    pi_prior: Prior = 0.0
    theta_prior: Prior = 0.0
    em_epsilon: float = 1e-7
    max_iter: int = 100
    reassign_mode: str = "exclude"
    conf_prob: float = 0.9

    def __post_init__(self) -> None:
        super().__post_init__()
        _one_of("reassign_mode", self.reassign_mode, REASSIGN_MODES)
        if not 0 <= self.conf_prob <= 1:
            raise ParameterError("conf_prob must be between 0 and 1")


@dataclass(frozen=True, repr=False, eq=False)
class TelescopeParam(_PairParam):
    """Two-parameter EM over each alignment's best overlap. Its priors are numbers."""

    min_overlap_fraction: float = 0.2

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.pi_prior, DataFrame) or isinstance(self.theta_prior, DataFrame):
            raise ParameterError("priors by feature belong to SoftmaxParam")


@dataclass(frozen=True, repr=False, eq=False)
class SoftmaxParam(_PairParam):
    """Two-parameter EM over alignments of one feature, with no-feature columns by read pattern."""


def with_prior(state: DataFrame, prior: Prior, column: str) -> DataFrame:
    """``state`` with a feature's prior (P8, P9): a number for every column, or a table's value, which
    must name every feature; no-feature columns then have 0."""
    if not isinstance(prior, DataFrame):
        return state.withColumn(column, F.lit(float(prior)))
    named = prior.select(F.col("feature_id").cast("string").alias("_f"), F.col("prior").cast("double").alias("_p"))
    joined = state.drop(column).join(named, F.col("feature_id").cast("string") == F.col("_f"), "left")
    return joined.withColumn(column, F.coalesce("_p", F.lit(0.0))).drop("_f", "_p")


def check_prior(features: DataFrame, prior: Prior) -> None:
    if isinstance(prior, DataFrame) and not features.join(prior.select("feature_id"), "feature_id", "left_anti").isEmpty():
        raise ParameterError("a prior by feature must name every feature")


def suboptimal_tag(param: ErvmapParam, aligner: str | None) -> str | None:
    """The tag that tells of suboptimal alignments."""
    if param.suboptimal_tag == "auto":
        return "XS" if aligner is not None and aligner.startswith("bwa") else None
    return None if param.suboptimal_tag == "none" else param.suboptimal_tag


def suboptimal_available(param: ErvmapParam, tag: str | None, present: dict[str, bool]) -> bool:
    """Whether the suboptimal filter runs on a tag (R19, S11): a tag asked for by name must be there;
    without a cutoff no filter runs."""
    if param.suboptimal_cutoff is None:
        return False
    found = tag is not None and present.get(tag, False)
    if tag is not None and not found and param.suboptimal_tag not in ("auto", "none"):
        raise ParameterError(f"no tag {tag} in the alignments; tags there: {', '.join(t for t, there in present.items() if there) or 'none'}")
    return found

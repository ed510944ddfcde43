"""Shared helpers of the text operators: shared folders, materialisation, empty-safe columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.shared import discard, shared_dir
from vellumine.shared import written as materialise

__all__ = ["discard", "materialise", "shared_dir"]


_model: dict = {}


def one_model(key, load):
    """The worker's model of that key. A worker serves one stage after another and keeps the last
    stage's model alone, so what several stages remember does not add up."""
    if key not in _model:
        _model.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can't, pages stay with the process
            ctypes.CDLL(None).malloc_trim(0)
        _model[key] = load()
    return _model[key]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that separate words in the word-based contracts: blank and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"

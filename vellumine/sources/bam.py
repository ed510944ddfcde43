"""Binary alignment files (S1-S4, S8): BGZF-compressed records as the canonical table.

A file is one task's stream: records of unknown size follow each other across its compressed
blocks, so a reader needs the start. Memory is one batch of rows, whatever the file's size, and a
study's many files are read side by side. ``aln_id`` ascends by file (in path order) and record.
"""

from __future__ import annotations

import contextlib
import gzip
import struct
import warnings
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vellumine.sources.sam import TAGS, derived, read_sam

MAGIC = b"BAM\1"
ROWS = 20_000
#: Records of a file that ``aln_id`` leaves room for.
FILE_BITS = 40
# Cigar operations, and integer tag types with their formats.
CIGAR = "MIDNSHP=X"
INTEGERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_RECORD = struct.Struct("<iiBBHHHiiii")


class AlignmentFileError(ValueError):
    pass


def check_paths(paths: str | list[str], single_end: bool = True, as_mates: bool = False) -> list[str]:
    """The alignment files of a study."""
    found = [paths] if isinstance(paths, str) else list(paths)
    if not found or not all(found):
        raise AlignmentFileError("no alignment files")
    if single_end and as_mates:
        raise AlignmentFileError("mates are of paired ends")
    return found


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    try:
        return system.open_input_stream(inner, compression=None)
    except FileNotFoundError as e:
        raise AlignmentFileError(f"no file {path}") from e


def _exactly(stream: BinaryIO, n: int, path: str) -> bytes:
    raw = stream.read(n)
    if len(raw) != n:
        raise AlignmentFileError(f"{path} ends within a record")
    return raw


def header(stream: BinaryIO, path: str) -> tuple[str, list[str], list[int]]:
    """Text, sequence names and lengths."""
    if stream.read(4) != MAGIC:
        raise AlignmentFileError(f"{path} is no BAM file")
    text = _exactly(stream, struct.unpack("<i", _exactly(stream, 4, path))[0], path).rstrip(b"\0").decode()
    names, lengths = [], []
    for _ in range(struct.unpack("<i", _exactly(stream, 4, path))[0]):
        name = _exactly(stream, struct.unpack("<i", _exactly(stream, 4, path))[0], path)
        names.append(name.rstrip(b"\0").decode())
        lengths.append(struct.unpack("<i", _exactly(stream, 4, path))[0])
    return text, names, lengths


def _tags(raw: bytes, at: int, wanted: dict[str, str]) -> dict[str, int]:
    """The wanted integer tags of a record, by column."""
    found = {}
    column = {tag: c for c, tag in wanted.items()}
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind in INTEGERS:
            if tag in column:
                found[column[tag]] = struct.unpack_from(INTEGERS[kind], raw, at)[0]
            at += _SIZES[kind]
        elif kind in ("Z", "H"):
            at = raw.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            at += _SIZES[kind]
    return found


def records(stream: BinaryIO, path: str, tags: dict[str, str]) -> Iterator[dict]:
    _, names, _ = header(stream, path)
    name_of = lambda k: names[k] if k >= 0 else None
    while size := stream.read(4):
        if len(size) < 4:
            raise AlignmentFileError(f"{path} ends within a record")
        raw = _exactly(stream, struct.unpack("<i", size)[0], path)
        ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate_ref, mate_pos, _ = _RECORD.unpack_from(raw)
        at = _RECORD.size
        name = raw[at : at + l_name - 1].decode()
        at += l_name
        ops = struct.unpack_from(f"<{n_ops}I", raw, at)
        at += 4 * n_ops + (l_seq + 1) // 2 + l_seq
        yield {
            "read_id": name, "flag": flag, "seqname": name_of(ref), "a_start": pos + 1 if pos >= 0 else None, "mapq": mapq,
            "cigar": "".join(f"{o >> 4}{CIGAR[o & 15]}" for o in ops) or None, "mate_seqname": name_of(mate_ref),
            "mate_start": mate_pos + 1 if mate_pos >= 0 else None, **_tags(raw, at, tags),
        }


def read_bam(spark: SparkSession, paths: str | list[str], tags: dict[str, str] = TAGS) -> DataFrame:
    """The files' alignments with ``sample_id`` and ``aln_id``; a file a task."""
    found = sorted(check_paths(paths))
    schema = T.StructType.fromDDL("sample_id string, aln_id long, read_id string, flag int, seqname string, a_start long, mapq int, cigar string, mate_seqname string, mate_start long" + "".join(f", {c} int" for c in tags))
    types = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in schema.fields])

    def run(batches):
        for batch in batches:
            for ix, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sample = path.rsplit("/", 1)[-1].removesuffix(".bam")
                with contextlib.closing(_open(path)) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows = []
                    for k, r in enumerate(records(stream, path, tags)):
                        rows.append({"sample_id": sample, "aln_id": (ix << FILE_BITS) + k, **r})
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, types)

    files = spark.createDataFrame(list(enumerate(found)), "ix long, path string").repartition(len(found), "ix")
    return derived(files.mapInArrow(run, schema))


def aligner(paths: str | list[str]) -> str | None:
    """The aligner that the files' first program lines name, in lower case (S2): headers alone are
    read. Files that differ, or name none, are told of; the first that names one wins."""
    named = []
    for path in check_paths(paths):
        with contextlib.closing(_open(path)) as raw, gzip.GzipFile(fileobj=raw) as stream:
            text = header(stream, path)[0]
        line = next((x for x in text.splitlines() if x.startswith("@PG")), "")
        named.append(next((x[3:].lower() for x in line.split("\t") if x.startswith("PN:")), None))
    known = list(dict.fromkeys(n for n in named if n))
    if not known:
        warnings.warn("no alignment file names its aligner", stacklevel=2)
    elif len(known) > 1 or None in named:
        warnings.warn(f"the files' aligners differ; {known[0]} is taken", stacklevel=2)
    return known[0] if known else None


def sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(seqname, length) of the first file's header."""
    path = check_paths(paths)[0]
    with contextlib.closing(_open(path)) as raw, gzip.GzipFile(fileobj=raw) as stream:
        _, names, lengths = header(stream, path)
    return spark.createDataFrame(list(zip(names, lengths)), "seqname string, length long")


def read_alignments(spark: SparkSession, paths: str | list[str], tags: dict[str, str] = TAGS) -> DataFrame:
    """SAM or BAM files by their names' ends."""
    found = check_paths(paths)
    binary = [p.endswith(".bam") for p in found]
    if any(binary) != all(binary):
        raise AlignmentFileError("SAM and BAM files can't be mixed")
    return (read_bam if all(binary) else read_sam)(spark, found, tags)

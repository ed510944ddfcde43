"""Best-fit packing of documents into sequences of at most ``limit`` tokens.

Bulk-synchronous best fit. Lengths and gaps are whole numbers up to ``limit``, so both sorted
sides are runs of equal values, and one superstep serves a whole run at a time: all pieces of one
length, longest first, sweep over the gaps' successors (smallest gap that holds the length
first). Pieces that compete for the same run of gaps are told apart by rank: piece number r of
its length takes place number r of the run. Gaps are updated and the next superstep begins.

The sweep itself needs only the two histograms (``limit`` numbers each, whatever the input), so
it runs on the driver; ranks are given on the executors, in salted buckets, and each row finds
its place by joining its (length, rank) with the sweep's intervals, a table bounded by the
square of ``limit`` and in practice a few thousand rows. No row waits on another.

The result is best-fit decreasing: pieces of over half the limit open sequences, and each other
piece goes where it fits tightest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.bpe import END_ID, VOCABULARY, encoder
from vellumine.llm.common import materialise

LIMIT = 1024
#: Rows of one length in a bucket that is ranked by itself.
BUCKET_ROWS = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the limit."""
    head = (n - 1) % limit + 1 if n else 0
    return [(0, head), *((at, limit) for at in range(head, n, limit))] if n else []


def pieces(df: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``doc_id, text``: null and empty texts have the end id alone; repeated rows
    have pieces of their own; long texts are cut, never shortened."""

    def run(batches):
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                rows += [(doc, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, limit))]
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select("doc_id", "text").mapInArrow(run, PIECES)


def sweep(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps over runs: (length, first rank, end rank, first sequence, pieces of this length
    in each sequence, offset of the first of them)."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, count))

    def fill(length: int, rank: int, left: int, gap: int, first: int, count: int) -> int:
        """Put pieces into ``count`` sequences with that gap; the number of pieces placed."""
        each = gap // length
        full = min(count, left // each)
        if full:
            out.append((length, rank, rank + full * each, first, each, limit - gap))
            put(gap - each * length, first, full)
        placed, rest = full * each, left - full * each
        if rest and full < count:
            out.append((length, rank + placed, rank + left, first + full, rest, limit - gap))
            put(gap - rest * length, first + full, 1)
            placed, full = left, full + 1
        put(gap, first + full, count - full)
        return placed

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while rank < n and (k := bisect_left(sizes, length)) < len(sizes):
            gap = sizes.pop(k)
            runs = gaps.pop(gap)
            while runs and rank < n:
                rank += fill(length, rank, n - rank, gap, *runs.pop())
            for run in runs:
                put(gap, *run)
        if rank < n:
            opened = -(-(n - rank) // (limit // length))
            fill(length, rank, n - rank, limit, sequences, opened)
            sequences += opened
    return out


def pack(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``items`` (a materialised table with a column ``length``, 1 to ``limit``) with
    ``sequence_id`` and ``offset``. Its columns ``length_rank`` and the like are not kept."""
    spark = items.sparkSession
    counts = items.groupBy("length").count().collect()  # at most `limit` rows
    histogram = {r["length"]: r["count"] for r in counts}
    if any(n is None or not 0 < n <= limit for n in histogram):
        raise ValueError(f"lengths must be 1 to {limit}")
    plan = sweep(histogram, limit)
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    schema = "p_length long, p_from long, p_to long, p_first long, p_each long, p_offset long"
    places = spark.createDataFrame(plan, schema)

    buckets = max(1, -(-max(histogram.values(), default=1) // BUCKET_ROWS) * 4)
    key = F.pmod(F.xxhash64(*columns), F.lit(buckets))
    salted = items.select(*columns).withColumn("_bucket", key)
    tally = salted.groupBy("length", "_bucket").count()
    ahead = tally.select(
        F.col("length").alias("_l"), F.col("_bucket").alias("_b"),
        (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_ahead"),
    )
    order = [F.col(c) for c in columns if c != "length"]
    local = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = salted.withColumn("_local", local).join(ahead, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    rank = F.col("_rank")
    placed = ranked.withColumn("_rank", F.col("_ahead") + F.col("_local")).join(
        F.broadcast(places), (F.col("length") == F.col("p_length")) & (rank >= F.col("p_from")) & (rank < F.col("p_to"))
    )
    inside = rank - F.col("p_from")
    sequence = F.col("p_first") + F.floor(inside / F.col("p_each")).cast("long")
    offset = F.col("p_offset") + F.pmod(inside, F.col("p_each")) * F.col("length")
    return placed.select(*columns, sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(df: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Cut and pack all documents. The pieces' table is written once: it holds no ids, so it is
    small against the text. An empty table gives an empty result."""
    return pack(materialise(pieces(df, limit, vocabulary), "pieces"), limit)


def sequences(packed: DataFrame, documents: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """The packed ids themselves: sequence_id, ids (binary, 32-bit little-endian). A sequence is
    at most ``limit`` ids, so its group is bounded. doc_id must be unique here."""

    def run(batches):
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            seqs, offsets, parts = [], [], []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                for p in places:
                    seqs.append(p["sequence_id"])
                    offsets.append(p["offset"])
                    parts.append(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(parts, pa.binary())], names=["sequence_id", "offset", "ids"])

    places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    joined = documents.select("doc_id", "text").join(places, "doc_id").select("text", "places")
    parts = joined.mapInArrow(run, "sequence_id long, offset long, ids binary")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

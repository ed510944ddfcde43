"""Token-id output: an adaptive context-mixing range coder in independent, checksummed blocks.

A block holds whole documents' ids. Its ids are laid out over lanes of at most ``LANE`` ids,
and all lanes are coded in step, one id of each at a time, against models that the block's
lanes share and that start afresh with each block:

* order 2 predicts the id that most often followed the same two ids (hashed), with a confidence;
* order 1 is the distribution of all ids that followed the same id, by adaptive counts;
* order 0 is the adaptive distribution of the ids that neither foresaw.

For each id the coder first codes which order gives it. That choice mixes three adaptive
distributions (of increasingly narrow contexts: the order-2 confidence and the lane's last choice;
that confidence and how settled order 1 is; all of them) by weights that follow how well each has
done. Then order 1 or order 0 codes the id. Counts take in new ids after each quarter more. All
arithmetic is on integers, so the reader follows the writer exactly. The range coder keeps
64 bits, emits 32-bit words and carries into them.

A block begins with the list of its distinct ids, so ids may be any unsigned 32-bit numbers. Files
are Parquet rows, one coded block each, so that Spark's committer writes them to any store and a
lost task is written again. Every block has a CRC-32 of its bytes and one of its ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.bpe import END_ID, VOCABULARY, encoder
from vellumine.llm.common import partitions, shared_dir

MAGIC = b"VIC2"
LANE = 256
#: A block closes with the document that reaches so many ids.
BLOCK_IDS = 1 << 21
#: Blocks whose starts (two numbers each) may be broadcast.
BROADCAST_BLOCKS = 1 << 20
_CTX2_BITS = 18
_STEP = 8
_HEADER = struct.Struct("<4sIIIIII")
_U32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)
_TOP = np.uint64(1) << np.uint64(32)
_CHOICE = np.uint64(4096)
_ONE = np.uint64(1)
#: Steps after which the choice's distributions take in what was chosen.
_MIX_STEPS = 8
#: Confidence x how settled x last choice, and the narrower contexts of each.
_GRID = np.arange(4 * 32 * 3)
_PARTS = (_GRID // 96 * 3 + _GRID % 3, _GRID // 3, _GRID)
_SIZES = (12, 128, 384)
_POWERS = 1 << np.arange(1, 8)


class CorruptBlock(ValueError):
    pass


class _Models:
    """What writer and reader know alike before each step. Ids are places in the block's list of
    distinct ids; the place ``alphabet`` stands for none."""

    def __init__(self, lanes: int, alphabet: int):
        self.lanes, self.alphabet, self.stride = lanes, alphabet, alphabet + 1
        #: Order 2: 4 x guess + confidence, so that a step looks up and stores one number a lane.
        self.guesses = np.full(1 << _CTX2_BITS, 4 * alphabet, np.int32 if alphabet < 1 << 29 else np.int64)
        self.prev1, self.prev2 = np.full(lanes, alphabet), np.full(lanes, alphabet)
        self.last = np.full(lanes, 6)
        self.by = [np.full((n, 3), 4, np.int64) for n in _SIZES]
        self.weight = np.full((3, len(_GRID)), 1 << 14, np.int64)
        self.chosen: list[np.ndarray] = []
        self.mix()
        #: Order 0, and order 1: ascending (id before, id) keys with an end mark, and their counts.
        self.count = np.ones(alphabet, np.int64)
        self.keys, self.counts = np.array([1 << 62]), np.zeros(1, np.int64)
        self.seen = 0
        self._index()

    def know(self, keys: np.ndarray) -> None:
        """The writer knows all keys from the start; those not seen yet count nothing."""
        self.keys, self.counts = np.append(keys, 1 << 62), np.zeros(len(keys) + 1, np.int64)
        self._index()

    def _index(self) -> None:
        self.first = np.searchsorted(self.keys, np.arange(self.alphabet + 2) * self.stride)

    def follow(self, keys: np.ndarray) -> None:
        """Count new (id before, id) keys, as the reader meets them."""
        new, times = np.unique(keys, return_counts=True)
        at = np.searchsorted(self.keys, new)
        old = self.keys[at] == new
        self.counts[at[old]] += times[old]
        if not old.all():
            fresh = np.flatnonzero(~old)
            put = at[fresh] + np.arange(len(fresh))
            kept = np.ones(len(self.keys) + len(fresh), bool)
            kept[put] = False
            kept = np.flatnonzero(kept)
            keys, counts = np.empty(len(kept) + len(fresh), np.int64), np.empty(len(kept) + len(fresh), np.int64)
            keys[kept], counts[kept], keys[put], counts[put] = self.keys, self.counts, new[fresh], times[fresh]
            self.keys, self.counts = keys, counts
            self._index()

    def take_in(self) -> int:
        """Make the counts distributions; the number of steps until this is due again. Order 0's
        counts follow those of order 1, as if of one more id before: ``alphabet + 1``."""
        self.known = np.concatenate([self.counts, self.count])
        self.cum = np.concatenate([[0], np.cumsum(self.known)])
        first, self.ids_at = self.first, len(self.counts)
        base = self.cum[first[:-1]]
        total1 = self.cum[first[1:]] - base
        kinds = np.concatenate([[0], np.cumsum(self.counts > 0)])
        kinds = np.minimum(4 * (kinds[first[1:]] - kinds[first[:-1]]) // np.maximum(total1, 1), 3)
        self.settled = (np.searchsorted(_POWERS, total1, "right") * 4 + kinds) * 9
        start = self.cum[self.ids_at]
        self.base, self.total = np.append(base, start), np.append(total1, self.cum[-1] - start)
        return max(1, max(256, self.seen >> 2) // self.lanes)

    def lay_out(self) -> None:
        """For the reader: a place for each count, so that a value finds its key or id at once, and
        side by side what the reader needs of it: where its counts begin, how many, its id."""
        self.key_at = np.repeat(np.arange(len(self.known), dtype=np.int32), self.known)
        self.row_of = np.zeros((len(self.known), 4), np.int32 if self.cum[-1] < 1 << 31 else np.int64)
        self.row_of[:, 0], self.row_of[:, 1] = self.cum[:-1], self.known
        self.row_of[: self.ids_at - 1, 2] = self.keys[:-1] - np.repeat(np.arange(self.alphabet + 1) * self.stride, np.diff(self.first))
        self.row_of[self.ids_at :, 2] = np.arange(self.alphabet)

    def miss(self, literals: np.ndarray) -> None:
        self.count += np.bincount(literals, minlength=self.alphabet) * _STEP

    def mix(self) -> None:
        """Take the choices that were seen into their distributions and mix these anew."""
        if self.chosen:
            seen = np.bincount(np.concatenate(self.chosen), minlength=3 * len(_GRID)).reshape(-1, 3)
            for k, (b, o) in enumerate(zip(self.by, _PARTS)):
                b += np.bincount((o[:, None] * 3 + np.arange(3)).ravel(), seen.ravel(), b.size).astype(np.int64).reshape(b.shape)
                b[b.sum(axis=1) > 1 << 14] //= 2
                np.maximum(b, 1, out=b)
                gain = ((self.parts[k] - self.mixed) * seen).sum(axis=1)
                self.weight[k] = np.clip(self.weight[k] + (gain >> 4), 256, 1 << 16)
            self.chosen = []
        self.parts = [((b * 4032) // b.sum(axis=1, keepdims=True) + 16)[o] for b, o in zip(self.by, _PARTS)]
        mixed = sum(w[:, None] * p for w, p in zip(self.weight, self.parts)) // self.weight.sum(axis=0)[:, None]
        self.mixed = np.maximum(mixed, 1)
        self.mixed[:, 2] = 4096 - self.mixed[:, 0] - self.mixed[:, 1]
        self.size = self.mixed.ravel().astype(np.uint64)
        self.low = np.concatenate([np.zeros((len(_GRID), 1), np.int64), np.cumsum(self.mixed[:, :2], axis=1)], axis=1).ravel()
        self.low = self.low.astype(np.uint64)

    def look(self, settled: np.ndarray) -> None:
        """The step's guesses and contexts (times 3)."""
        at2 = self.prev2 * 40503
        at2 += self.prev1 * 9973
        at2 >>= 2
        at2 &= (1 << _CTX2_BITS) - 1
        state = self.guesses[at2].astype(np.int64)
        self.at2, self.guess, self.conf = at2, state >> 2, state & 3
        self.context = self.conf * 288 + settled
        self.context += self.last

    def learn(self, ids: np.ndarray, choice: np.ndarray, place: np.ndarray) -> None:
        self.chosen.append(place)
        if len(self.chosen) == _MIX_STEPS:
            self.mix()
        wrong, conf = choice != 0, self.conf
        state = self.guess - ids  # a guess goes once its confidence is down to 1
        state *= conf >> 1
        state += ids
        state <<= 2
        state += np.minimum(np.maximum(conf + 1 - 2 * wrong, 1), 3)
        self.guesses[self.at2] = state
        self.seen += self.lanes
        self.prev2, self.prev1, self.last = self.prev1, ids, choice * 3


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
        self.words = np.zeros(lanes * (2 * steps + 4), np.uint32)
        self.first = np.arange(lanes) * (2 * steps + 4)
        self.at = self.first.copy()

    def _carry(self, lanes: np.ndarray) -> None:
        k = self.at[lanes] - 1
        while len(lanes):
            self.words[k] += np.uint32(1)
            over = np.flatnonzero(self.words[k] == 0)
            lanes, k = lanes[over], k[over] - 1

    def code(self, low, size, total, lanes=None) -> None:
        """Code a part of each lane's range, or of some lanes'."""
        before, unit = (self.low, self.range // total) if lanes is None else (self.low[lanes], self.range[lanes] // total)
        after = before + unit * low
        over = np.flatnonzero(after < before)
        if len(over):
            self._carry(over if lanes is None else lanes[over])
        width = unit * size
        short = np.flatnonzero(width < _TOP)
        if len(short):
            part, lane = after[short], short if lanes is None else lanes[short]
            at = self.at[lane]
            self.words[at] = part >> _U32
            self.at[lane] = at + 1
            after[short] = part << _U32
            width[short] <<= _U32
        if lanes is None:
            self.low, self.range = after, width
        else:
            self.low[lanes], self.range[lanes] = after, width

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """One more word a lane: the range is wide enough to hold a number with 32 zeros."""
        last = self.low + _LOW32
        self._carry(np.flatnonzero(last < self.low))
        self.words[self.at] = last >> _U32
        sizes, words = self.at - self.first + 1, self.words.reshape(len(self.at), -1)
        return sizes, words[np.arange(words.shape[1])[None, :] < sizes[:, None]]


class _Reader:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        grid = np.zeros((len(sizes), int(sizes.max()) + 4), np.uint32)
        grid[np.arange(grid.shape[1])[None, :] < sizes[:, None]] = words
        self.words, wide = grid.ravel(), grid[:, :2].astype(np.uint64)
        self.code = (wide[:, 0] << _U32) | wide[:, 1]
        self.at, self.range = np.arange(len(sizes)) * grid.shape[1] + 2, np.full(len(sizes), ~np.uint64(0))

    def choose(self, second, third) -> np.ndarray:
        """Each lane's choice, by where the second and the third begin."""
        self.unit = self.range // _CHOICE
        return (self.code >= self.unit * second).astype(np.int64) + (self.code >= self.unit * third)

    def value(self, total, lanes) -> np.ndarray:
        self.unit = self.range[lanes] // total
        return np.minimum(self.code[lanes] // self.unit, total - _ONE).view(np.int64)

    def accept(self, low, size, lanes=None) -> None:
        code, width = (self.code if lanes is None else self.code[lanes]) - self.unit * low, self.unit * size
        short = np.flatnonzero(width < _TOP)
        if len(short):
            lane = short if lanes is None else lanes[short]
            at = self.at[lane]
            code[short] = (code[short] << _U32) | self.words[np.minimum(at, len(self.words) - 1)]
            self.at[lane] = at + 1
            width[short] <<= _U32
        if lanes is None:
            self.code, self.range = code, width
        else:
            self.code[lanes], self.range[lanes] = code, width


def _ranked(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's rank among the distinct keys (all under ``bound``), and these, ascending. Where
    key and place fit one number, sorting these numbers is quicker than hashing."""
    bits = len(keys).bit_length()
    if bound.bit_length() + bits > 63:
        return pd.factorize(keys, sort=True)
    packed = keys << bits
    packed |= np.arange(len(keys))
    packed.sort()
    place = packed & ((1 << bits) - 1)
    packed >>= bits
    first = np.append(0, np.flatnonzero(packed[1:] != packed[:-1]) + 1)
    rank = np.empty(len(keys), np.int32)
    rank[place] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(keys)))
    return rank, packed[first]


def encode_ids(ids: np.ndarray) -> bytes:
    """One block of ids (unsigned 32-bit) as bytes."""
    n = len(ids)
    steps = min(LANE, n)
    lanes = -(-n // steps) if n else 0
    places, known = pd.factorize(np.asarray(ids, np.int64), sort=True)
    listed = zlib.compress(np.ascontiguousarray(np.diff(known, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 9)
    body = struct.pack("<I", len(listed)) + listed
    if n:
        grid = np.zeros(lanes * steps, np.int64)
        grid[:n] = places
        grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
        m, w, due = _Models(lanes, len(known)), _Writer(lanes, steps), 0
        before = np.concatenate([m.prev1[None, :], grid[:-1]])
        rank, keys = _ranked((before * m.stride + grid).ravel(), m.stride * m.stride)
        m.know(keys)
        rank = rank.reshape(grid.shape)
        while due < steps:
            begin, due = due, min(steps, due + m.take_in())  # counts stay until then: these steps at once
            at, rows, b = rank[begin:due], grid[begin:due], before[begin:due]
            other, settled = 2 - (m.counts[at] > 0), m.settled[b]
            low, size = np.empty(rows.shape, np.uint64), np.empty(rows.shape, np.uint64)
            for k, row in enumerate(rows):
                m.look(settled[k])
                other[k] *= row != m.guess
                place = m.context + other[k]
                low[k], size[k] = m.low[place], m.size[place]
                m.learn(row, other[k], place)
            missed = np.flatnonzero(other)
            one = other.ravel()[missed] == 1
            key = np.where(one, at.ravel()[missed], m.ids_at + rows.ravel()[missed])
            under = np.where(one, b.ravel()[missed], m.alphabet + 1)
            low2, size2, total2 = (x.view(np.uint64) for x in (m.cum[key] - m.base[under], m.known[key], m.total[under]))
            ends = np.searchsorted(missed, np.arange(len(rows) + 1) * lanes)
            for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                w.code(low[k], size[k], _CHOICE)
                w.code(low2[i:j], size2[i:j], total2[i:j], missed[i:j] - k * lanes)
            m.counts[:-1] += np.bincount(at.ravel(), minlength=len(keys))
            m.miss(rows[other == 2])
        sizes, words = w.end()
        body += sizes.astype("<u2").tobytes() + words.astype("<u4").tobytes()
    check = zlib.crc32(np.asarray(ids, "<u4").tobytes())
    return _HEADER.pack(MAGIC, n, lanes, steps, len(known), check, zlib.crc32(body)) + body


def decode_ids(block: bytes) -> np.ndarray:
    """The block's ids; raises CorruptBlock if a checksum fails."""
    if len(block) < _HEADER.size:
        raise CorruptBlock("short block")
    magic, n, lanes, steps, alphabet, check, body_check = _HEADER.unpack_from(block)
    body = block[_HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != body_check:
        raise CorruptBlock("the block's bytes are damaged")
    if not n:
        return np.zeros(0, "<u4")
    listed = struct.unpack_from("<I", body)[0]
    planes = np.frombuffer(zlib.decompress(body[4 : 4 + listed]), np.uint8).reshape(4, alphabet)
    known = np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.int64)
    sizes = np.frombuffer(body, "<u2", lanes, 4 + listed).astype(np.int64)
    r = _Reader(sizes, np.frombuffer(body, "<u4", int(sizes.sum()), 4 + listed + 2 * lanes))
    m, grid, due = _Models(lanes, alphabet), np.zeros((steps, lanes), np.int64), 0
    choices = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        if t == due:
            if t:
                before = np.concatenate([start[None, :], grid[begin : t - 1]])
                m.follow(before * m.stride + grid[begin:t])
                m.miss(grid[begin:t][choices[begin:t] == 2])
            begin, start, due = t, m.prev1, t + m.take_in()
            m.lay_out()
        m.look(m.settled[m.prev1])
        choice = r.choose(m.low[m.context + 1], m.low[m.context + 2])
        place = m.context + choice
        r.accept(m.low[place], m.size[place])
        row = m.guess.astype(np.int64)
        missed = np.flatnonzero(choice)
        one, b = choice[missed] == 1, m.prev1[missed]
        under = np.where(one, b, alphabet + 1)
        total, base = m.total[under].view(np.uint64), m.base[under]
        found = m.row_of.take(m.key_at[base + r.value(total, missed)], axis=0)
        r.accept((found[:, 0] - base).view(np.uint64), found[:, 1].astype(np.uint64), missed)
        row[missed] = found[:, 2]
        m.learn(row, choice, place)
        grid[t], choices[t] = row, choice
    places = grid.T.reshape(-1)[:n]
    if (places >= alphabet).any() or (places < 0).any():
        raise CorruptBlock("the block's ids are damaged")
    ids = known[places].astype("<u4")
    if zlib.crc32(ids.tobytes()) != check:
        raise CorruptBlock("the block's ids are damaged")
    return ids


BLOCKS = "shard int, block int, n_ids long, documents binary, payload binary"


def _index(doc_ids: list[int | None], sizes: list[int]) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(sizes, "<u4").tobytes()


def _read_index(raw: bytes) -> tuple[list[int | None], np.ndarray]:
    n = len(raw) // 13
    known, ids = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n)
    return [int(d) if k else None for d, k in zip(ids, known)], np.frombuffer(raw, "<u4", n, 9 * n)


def write_ids(df: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode ``doc_id, text`` in ascending doc_id order (null ids first, equal ids by the texts'
    hashes, so that rows of one id may spread over ranges) and write coded blocks under ``path``.
    Null and empty texts have the end id only; every row is written, repeated ones too; other
    columns don't matter. A block holds whole documents: a worker's buffer is one block's ids and
    those of its last text."""

    def run(batches):
        from pyspark import TaskContext

        shard, block, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        docs, sizes, parts, total = [], [], [], 0

        def close():
            payload = encode_ids(np.frombuffer(b"".join(parts), "<u4").astype(np.int64))
            cells = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([total], pa.int64()), pa.array([_index(docs, sizes)], pa.binary()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["shard", "block", "n_ids", "documents", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.many(batch.column(1))):
                ids += end
                docs.append(doc)
                sizes.append(len(ids) // 4)
                parts.append(ids)
                total += len(ids) // 4
                if total >= BLOCK_IDS:
                    yield close()
                    docs, sizes, parts, total, block = [], [], [], 0, block + 1
        if docs:
            yield close()

    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(partitions(df.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of coded files: doc_id, start, n_tokens, ids_crc32, and ``ids`` (binary, 32-bit
    little-endian) on request. ``start`` comes from the blocks' own counts, summed by shard: two
    numbers a block, broadcast up to ``BROADCAST_BLOCKS`` of them, so that payloads stay in place;
    beyond that the documents' rows, not the payloads, are joined with their block's start."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    counts = blocks.select("shard", "block", "n_ids")
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select(F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block")
    starts = counts.select(F.col("shard").alias("s"), F.col("block").alias("b"), (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("block_start")).join(before, "s")
    starts = starts.select("s", "b", (F.col("shard_start") + F.col("block_start")).alias("block_at"))
    if blocks.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    fields = [("s", T.IntegerType()), ("b", T.IntegerType()), ("doc_id", T.LongType()), ("at", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields + [("ids", T.BinaryType())] * with_ids])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, block, documents, payload = (batch.column(c)[k].as_py() for c in range(4))
                raw = decode_ids(payload).tobytes()
                docs, sizes = _read_index(documents)
                at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                own = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                cells = [pa.array([shard] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(at[:-1], pa.int64())]
                cells += [pa.array(sizes, pa.int64()), pa.array(map(zlib.crc32, own), pa.int64())] + [pa.array(own, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    documents = blocks.select("shard", "block", "documents", "payload").mapInArrow(run, schema)
    placed = documents.join(starts, ["s", "b"])
    return placed.select("doc_id", (F.col("block_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def encode_and_read_back(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the table's ids to a new folder in the shared one and read the files back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(df, path, vocabulary)
    return read_ids(spark, path)

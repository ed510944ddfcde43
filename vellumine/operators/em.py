"""Expectation maximisation over read by feature weights.

Two executions of the same fixed points: rows in Spark for a set number of steps (the plan is
cut to a table after each), and arrays, on the driver over equivalence classes. Reads with the
same weights over the same features add alike to every step, so classes and their counts give
the same result; there are as many as distinct feature sets, far fewer than reads, and their
number is checked before they come to the driver.

``ratio_fit`` and ``pair_fit`` run the fixed points to their tolerance by SQUAREM, sample by sample:
over classes, or beyond ``MOST_CELLS`` or ``MOST_CLASSES`` over blocks of cells on the executors, where
each evaluation is a job and only vectors, a few numbers a feature, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.weights import READ, by_read
from vellumine.shared import written

#: Cells, and classes of them, that may come to the driver; beyond either they stay on the executors.
MOST_CELLS = 2_000_000
MOST_CLASSES = 2_000_000
#: Cells of a block and slices of columns, where cells stay on the executors.
BLOCK = 500_000
SLICES = 16


def _corrected(df: DataFrame, raw: str, eff: str) -> DataFrame:
    """Divide by the effective length where it is positive, then normalise by sample."""
    x = df.withColumn("_x", F.when(F.col(eff) > 0, F.col(raw) / F.col(eff)).otherwise(0.0))
    total = F.sum("_x").over(Window.partitionBy("sample_id"))
    return x.withColumn("pi", F.when(total > 0, F.col("_x") / total).otherwise(0.0)).drop("_x")


def ratio_start(q: DataFrame, lengths: DataFrame) -> DataFrame:
    """(sample_id, feature_id, eff, pi): column sums, length-corrected (E4). ``lengths``: feature_id, eff,
    and sample_id where reads differ in length by sample."""
    sums = q.groupBy("sample_id", "feature_id").agg(F.sum("w").alias("c")).join(lengths, [c for c in ("sample_id", "feature_id") if c in lengths.columns])
    return _corrected(sums, "c", "eff").select("sample_id", "feature_id", "eff", "pi")


def ratio_step(q: DataFrame, pi: DataFrame) -> DataFrame:
    """E step, M step and length correction with binary weights."""
    x = q.select(*READ, "feature_id").join(pi, ["sample_id", "feature_id"])
    total = F.sum("pi").over(by_read())
    m = x.withColumn("x", F.when(total > 0, F.col("pi") / total).otherwise(0.0)).groupBy("sample_id", "feature_id", "eff").agg(F.sum("x").alias("x"))
    return _corrected(m, "x", "eff").select("sample_id", "feature_id", "eff", "pi")


def ratio_assign(q: DataFrame, pi: DataFrame) -> DataFrame:
    """Reads split by the final probabilities: (sample_id, feature_id, m)."""
    x = q.select(*READ, "feature_id").join(pi, ["sample_id", "feature_id"])
    total = F.sum("pi").over(by_read())
    return x.withColumn("x", F.when(total > 0, F.col("pi") / total).otherwise(0.0)).groupBy("sample_id", "feature_id").agg(F.sum("x").alias("m"))


def ratio_log_likelihood(q: DataFrame, pi: DataFrame) -> DataFrame:
    """(sample_id, log_likelihood): the sum over reads and their features of the read's share times the
    logarithm of the feature's probability (E5)."""
    x = q.select(*READ, "feature_id").join(pi, ["sample_id", "feature_id"])
    total = F.sum("pi").over(by_read())
    x = x.withColumn("x", F.when(total > 0, F.col("pi") / total).otherwise(0.0))
    return x.filter("pi > 0").groupBy("sample_id").agg(F.sum(F.col("x") * F.log("pi")).alias("log_likelihood"))


def multi_flag(q: DataFrame) -> DataFrame:
    """Adds ``is_multi``: the read has more than one positive cell."""
    return q.withColumn("is_multi", F.count_if(F.col("w") > 0).over(by_read()) > 1)


def pair_start(q: DataFrame, a: float = 0.0, b: float = 0.0, uniform: bool = True) -> DataFrame:
    """State (sample_id, feature_id, pi, theta, a, b): uniform, or column sums of the
    row-normalised weights over all and over multi reads (E11, E15)."""
    if uniform:
        s = q.select("sample_id", "feature_id").distinct().withColumn("pi", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("sample_id"))).withColumn("theta", F.col("pi"))
    else:
        s = q.groupBy("sample_id", "feature_id").agg(F.sum("w").alias("pi"), F.sum(F.when(F.col("is_multi"), F.col("w")).otherwise(0.0)).alias("theta"))
    return s.withColumn("a", F.lit(float(a))).withColumn("b", F.lit(float(b)))


def pair_expect(q: DataFrame, state: DataFrame) -> DataFrame:
    """E step: x in proportion to w * pi, times theta for multi reads, normalised by read."""
    x = q.select(*READ, "feature_id", "w", "is_multi").join(state, ["sample_id", "feature_id"])
    x = x.withColumn("x", F.col("w") * F.col("pi") * F.when(F.col("is_multi"), F.col("theta")).otherwise(1.0))
    total = F.sum("x").over(by_read())
    return x.withColumn("x", F.when(total > 0, F.col("x") / total).otherwise(0.0))


def pair_step(q: DataFrame, state: DataFrame) -> DataFrame:
    """E step, then M steps with priors: pi = (sum + a) / (all + sum of a), theta = (multi sum + b) /
    (multi reads + sum of b) (E8-E10, E13)."""
    x = pair_expect(q, state)
    m = x.groupBy("sample_id", "feature_id", "a", "b").agg(F.sum("x").alias("sx"), F.sum(F.when(F.col("is_multi"), F.col("x")).otherwise(0.0)).alias("mx"))
    w = Window.partitionBy("sample_id")
    pi = (F.col("sx") + F.col("a")) / F.sum(F.col("sx") + F.col("a")).over(w)
    base = F.sum(F.col("mx") + F.col("b")).over(w)
    theta = F.when(base > 0, (F.col("mx") + F.col("b")) / base).otherwise(0.0)
    return m.select("sample_id", "feature_id", pi.alias("pi"), theta.alias("theta"), "a", "b")


def iterate(step: Callable[[DataFrame], DataFrame], state: DataFrame, times: int, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``times`` steps; ``cut`` (a checkpoint or a written table) ends each step's lineage."""
    for _ in range(times):
        state = step(state)
        if cut:
            state = cut(state)
    return state


def reassign(x: DataFrame, mode: str, conf: float = 0.9, seed: int = 0) -> DataFrame:
    """Final probabilities (x) to counts (sample_id, feature_id, n): E12. Ties are equal at 12
    digits; "choose" picks a tie by hash, the same at every run."""
    top = F.max("x").over(by_read())
    best = F.abs(F.col("x") - top) <= 1e-12 * top
    t = x.withColumn("best", best & (F.col("x") > 0)).withColumn("ties", F.count_if(best & (F.col("x") > 0)).over(by_read()))
    if mode == "exclude":
        out = t.filter("best and ties = 1").withColumn("n", F.lit(1.0))
    elif mode == "average":
        out = t.filter("best").withColumn("n", 1.0 / F.col("ties"))
    elif mode == "choose":
        r = F.row_number().over(by_read().orderBy(F.xxhash64(*READ, F.col("feature_id"), F.lit(seed)), "feature_id"))
        out = t.filter("best").withColumn("_r", r).filter("_r = 1").withColumn("n", F.lit(1.0))
    elif mode == "conf":
        high = t.filter(F.col("x") >= conf)
        out = high.withColumn("n", F.col("x") / F.sum("x").over(by_read()))
    else:
        raise ValueError(f"unknown reassign_mode: {mode}")
    return out.groupBy("sample_id", "feature_id").agg(F.sum("n").alias("n"))


class TooManyClasses(ValueError):
    pass


@dataclass
class Classes:
    """Equivalence classes of one sample: class k has count[k] reads and the cells first[k]:first[k+1]."""

    features: list
    count: np.ndarray
    row: np.ndarray
    column: np.ndarray
    weight: np.ndarray


def classes(q: DataFrame) -> dict[str, Classes]:
    """Distinct (feature, weight) rows with counts, by sample."""
    cell = F.array_sort(F.collect_list(F.struct("feature_id", F.round("w", 12).alias("w"))))
    per = q.groupBy(*READ).agg(cell.alias("cells")).groupBy("sample_id", "cells").count()
    if per.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise TooManyClasses("too many equivalence classes for the driver; iterate in Spark")
    table = per.toArrow()
    cells = table.column("cells").combine_chunks()
    row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    feature, weight = cells.flatten().field("feature_id"), cells.flatten().field("w").to_numpy(zero_copy_only=False).astype(float)
    feature = feature.to_numpy(zero_copy_only=False)
    sample, count = np.array(table.column("sample_id").to_pylist(), object), table.column("count").to_numpy().astype(float)
    out = {}
    for name in dict.fromkeys(sample.tolist()):
        mine = sample == name
        held = mine[row]
        feats, column = np.unique(feature[held], return_inverse=True)
        place = np.cumsum(mine) - 1
        out[name] = Classes(feats.tolist(), count[mine], place[row[held]], column, weight[held])
    return out


def ratio_map(c: Classes, eff: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The fixed point of ``ratio_step`` on arrays."""

    def step(pi: np.ndarray) -> np.ndarray:
        x = pi[c.column]
        total = np.bincount(c.row, x, len(c.count))
        with np.errstate(invalid="ignore", divide="ignore"):
            x = np.where(total[c.row] > 0, x / total[c.row], 0.0) * c.count[c.row]
        m = np.bincount(c.column, x, len(c.features))
        m = np.where(eff > 0, m / np.where(eff > 0, eff, 1.0), 0.0)
        return m / m.sum() if m.sum() > 0 else m

    return step


def pair_map(c: Classes, a: np.ndarray, b: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The fixed point of ``pair_step`` on arrays; the vector is pi then theta."""
    n = len(c.features)
    multi = np.bincount(c.row, c.weight > 0, len(c.count))[c.row] > 1

    def step(v: np.ndarray) -> np.ndarray:
        x = c.weight * v[c.column] * np.where(multi, v[n + c.column], 1.0)
        total = np.bincount(c.row, x, len(c.count))
        with np.errstate(invalid="ignore", divide="ignore"):
            x = np.where(total[c.row] > 0, x / total[c.row], 0.0) * c.count[c.row]
        pi, theta = np.bincount(c.column, x, n) + a, np.bincount(c.column, x * multi, n) + b
        return np.concatenate([pi / max(pi.sum(), 1e-300), theta / theta.sum() if theta.sum() > 0 else theta])

    return step


def squarem_steps(start: np.ndarray, tolerance: float = 1e-7, most: int = 1500):
    """Squared extrapolation of a fixed point (E16), as a generator: yields points, is sent their images,
    and returns result, evaluations, converged. A step length is bounded and its bound grows fourfold
    when reached; a bad extrapolation falls back."""
    p, used, longest = start, 0, 1.0
    while used < most:
        p1 = yield p
        q1 = p1 - p
        used += 1
        if np.sqrt(q1 @ q1) < tolerance:
            return p1, used, True
        p2 = yield p1
        q2 = p2 - p1
        used += 1
        size = np.sqrt(q2 @ q2)
        if size < tolerance:
            return p2, used, True
        v = q2 - q1
        alpha = np.sqrt((q1 @ q1) / max(v @ v, 1e-300))
        alpha = max(1.0, min(longest, alpha))
        new = p + 2 * alpha * q1 + alpha**2 * v
        del q1, q2, v, p1
        if abs(alpha - 1) > 0.01:
            again = yield new
            used += 1
            r = again - new
            new = again if np.isfinite(again).all() and np.sqrt(r @ r) <= size + 1.0 else p2
        if alpha == longest:
            longest *= 4
        p = new
    return p, used, False


def squarem(start: np.ndarray, step: Callable[[np.ndarray], np.ndarray], tolerance: float = 1e-7, most: int = 1500) -> tuple[np.ndarray, int, bool]:
    """``squarem_steps`` with ``step`` as the map."""
    run = squarem_steps(start, tolerance, most)
    try:
        at = next(run)
        while True:
            with np.errstate(all="ignore"):
                image = step(at)
            at = run.send(image)
    except StopIteration as end:
        return end.value


#: Evaluations used and whether the tolerance was reached, by sample.
Report = dict[str, tuple[int, bool]]


def _fit(q: DataFrame, state: DataFrame, on_classes, on_blocks, finish, tolerance: float, most: int) -> tuple[DataFrame, Report]:
    """``state`` with its ``pi`` (and what else the steps keep) run to tolerance. ``on_classes`` makes the
    step of ``pi`` for a sample's classes and columns of the state; ``on_blocks`` is the weights, what a
    column offers to a read of several cells, and the M step (see ``_fit_blocks``)."""
    if q.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        return _fit_blocks(q, state, *on_blocks, finish, tolerance, most)
    try:
        found = classes(q.join(state.select("sample_id", "feature_id"), ["sample_id", "feature_id"], "left_semi"))
    except TooManyClasses:
        return _fit_blocks(q, state, *on_blocks, finish, tolerance, most)
    table = state.orderBy("sample_id", "feature_id").toArrow()
    names = table.column("sample_id").to_pylist()
    report: Report = {}
    done = {f: [] for f in table.column_names}
    first = 0
    while first < len(names):
        last = first
        while last < len(names) and names[last] == names[first]:
            last += 1
        part = table.slice(first, last - first)
        v = {f: part.column(f).to_pylist() if f.endswith("_id") else part.column(f).to_numpy().astype(float) for f in table.column_names}
        sample, first = names[first], last
        pi, used, reached = squarem(v["pi"], on_classes(found[sample], v), tolerance, most)
        v["pi"] = finish(np.maximum(pi, 0.0))
        report[sample] = used, reached
        for f, values in v.items():
            done[f].extend(values)
    return q.sparkSession.createDataFrame(pa.table({f: pa.array(done[f], table.schema.field(f).type) for f in table.column_names}), state.schema), report


def _numbered(state: DataFrame) -> DataFrame:
    """``state`` in order of sample and feature, written, with ``_ix`` counting its rows from 0."""
    t = written(state.orderBy("sample_id", "feature_id").withColumn("_m", F.monotonically_increasing_id()), "columns")
    part = F.shiftright("_m", 33)
    sizes = sorted(map(tuple, t.groupBy(part.alias("_p")).count().collect()))  # a row a task
    ahead = [(p, sum(n for _, n in sizes[:k])) for k, (p, _) in enumerate(sizes)]
    ahead = t.sparkSession.createDataFrame(ahead, "_p long, _ahead long")
    t = t.join(F.broadcast(ahead), part == F.col("_p"))
    return t.withColumn("_ix", F.col("_ahead") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_ahead")


def _blocks(cells: DataFrame) -> DataFrame:
    """Cells (_ix, w, _first), reads together, as arrays: ``at`` the columns that occur, ``col`` places in it,
    ``row`` where reads begin, ``w``. A block ends with a read, after ``BLOCK`` cells."""

    def encode(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0

        def block(ix, w, first):
            at, col = np.unique(ix, return_inverse=True)
            kept = {"at": at.astype(np.int64), "col": col.astype(np.int32), "row": np.flatnonzero(first).astype(np.int32), "w": w.astype(float)}
            return pa.RecordBatch.from_pydict({"block": [task << 31 | k], **{f: [x.tobytes()] for f, x in kept.items()}})

        held, n = [], 0
        for b in batches:
            ix, w, first = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if n >= BLOCK and first.any():
                cut = int(first.argmax())
                held.append((ix[:cut], w[:cut], first[:cut]))
                yield block(*map(np.concatenate, zip(*held)))
                k += 1
                held, n, ix, w, first = [], 0, ix[cut:], w[cut:], first[cut:]
            held.append((ix, w, first))
            n += len(ix)
        if n:
            yield block(*map(np.concatenate, zip(*held)))

    return cells.select("_ix", "w", "_first").mapInArrow(encode, "block long, at binary, col binary, row binary, w binary")


def _shared_out(blocks: DataFrame, offer: np.ndarray) -> np.ndarray:
    """Every read dealt over its cells in proportion to w times its column's ``offer``: sums by column.
    Blocks are summed by slice of columns on the executors, in the blocks' order."""
    spark, n = blocks.sparkSession, len(offer)
    given, width = spark.sparkContext.broadcast(offer), max(1, -(-n // SLICES))

    def deal(batches):
        for b in batches:
            for number, *raw in zip(*(b.column(i) for i in range(5))):
                at, col, row, w = (np.frombuffer(x.as_buffer(), t) for x, t in zip(raw, (np.int64, np.int32, np.int32, float)))
                x = w * given.value[at][col]
                total = np.repeat(np.add.reduceat(x, row), np.diff(np.append(row, len(x))))
                x = np.bincount(col, np.divide(x, total, out=np.zeros_like(x), where=total > 0), len(at))
                cut = np.searchsorted(at, np.arange(SLICES + 1) * width)
                there = [k for k in range(SLICES) if cut[k] < cut[k + 1]]
                parts = {f: [y[cut[k] : cut[k + 1]].tobytes() for k in there] for f, y in (("at", at), ("x", x))}
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([number.as_py()] * len(there), pa.int64()), pa.array(parts["at"], pa.binary()), pa.array(parts["x"], pa.binary())], ["slice", "block", "at", "x"])

    def add(t: pa.Table) -> pa.Table:
        k = t.column("slice")[0].as_py()
        out = np.zeros(width)
        for i in np.argsort(t.column("block").to_numpy()):
            at, x = (np.frombuffer(t.column(f)[int(i)].as_buffer(), d) for f, d in (("at", np.int64), ("x", float)))
            out[at - k * width] += x
        return pa.table({"slice": pa.array([k], pa.int32()), "x": pa.array([out.tobytes()], pa.binary())})

    parts = blocks.mapInArrow(deal, "slice int, block long, at binary, x binary").groupBy("slice").applyInArrow(add, "slice int, x binary").toArrow()
    sums = np.zeros(SLICES * width)
    for k, x in zip(parts.column("slice"), parts.column("x")):
        sums[k.as_py() * width : (k.as_py() + 1) * width] = np.frombuffer(x.as_buffer())
    given.destroy()
    return sums[:n]


def _fit_blocks(q: DataFrame, state: DataFrame, weight, offer, update, finish, tolerance: float, most: int) -> tuple[DataFrame, Report]:
    """The fit with all cells on the executors. The driver holds vectors over the state's rows, without
    names; all samples that still run share a job for each evaluation. Reads of one cell add 1 to its
    column whenever that is positive, so only their number by column is kept; the others lie in
    ``_blocks``. ``offer(v)``: a column's part in the E step; ``update(one, several, v)``: M step."""
    columns = _numbered(state)
    cells = q.select(*READ, "feature_id", weight.alias("w")).filter("w > 0").join(columns.select("sample_id", "feature_id", "_ix"), ["sample_id", "feature_id"])
    cells = cells.withColumn("_n", F.count(F.lit(1)).over(by_read())).withColumn("_first", F.row_number().over(by_read().orderBy("_ix")) == 1).select("_ix", "w", "_first", "_n").persist()
    blocks = written(_blocks(cells.filter("_n > 1")), "blocks").persist()
    bounds = {r[0]: slice(r[1], r[2] + 1) for r in columns.groupBy("sample_id").agg(F.min("_ix"), F.max("_ix")).collect()}  # a row a sample
    n = max((s.stop for s in bounds.values()), default=0)

    def vector(df: DataFrame) -> np.ndarray:
        t, out = df.toArrow(), np.zeros(n)
        out[t.column(0).to_numpy()] = t.column(1).to_numpy()
        return out

    numbers = [f for f in state.columns if not f.endswith("_id")]
    v = {f: vector(columns.select("_ix", F.col(f).cast("double"))) for f in numbers}
    one = vector(cells.filter("_n = 1").groupBy("_ix").agg(F.count(F.lit(1)).cast("double")))
    cells.unpersist()
    runs = {s: squarem_steps(v["pi"][at].copy(), tolerance, most) for s, at in bounds.items()}
    report: Report = {}

    def turn(s, image: np.ndarray | None) -> None:
        try:
            v["pi"][bounds[s]] = runs[s].send(image)
        except StopIteration as end:
            v["pi"][bounds[s]], report[s] = finish(np.maximum(end.value[0], 0.0)), end.value[1:]

    for s in bounds:
        turn(s, None)
    while len(report) < len(bounds):
        offered = np.zeros(n)
        for s in bounds.keys() - report.keys():
            offered[bounds[s]] = offer({f: x[bounds[s]] for f, x in v.items()})
        several = _shared_out(blocks, offered)
        for s in bounds.keys() - report.keys():
            at = bounds[s]
            with np.errstate(all="ignore"):
                image, kept = update(np.where(v["pi"][at] > 0, one[at], 0.0), several[at], {f: x[at] for f, x in v.items()})
                for f, x in kept.items():
                    v[f][at] = x
                turn(s, image)
    blocks.unpersist()
    given, order = q.sparkSession.sparkContext.broadcast({f: v[f] for f in numbers}), state.columns

    def fill(batches):
        for b in batches:
            at = b.column(b.schema.get_field_index("_ix")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(given.value[f][at]) if f in numbers else b.column(b.schema.get_field_index(f)) for f in order], order)

    done = written(columns.mapInArrow(fill, state.schema), "fitted")
    given.destroy()
    return done, report


def ratio_fit(q: DataFrame, lengths: DataFrame, tolerance: float = 1e-4, most: int = 100) -> tuple[DataFrame, Report]:
    """(sample_id, feature_id, eff, pi) at the fixed point, clamped and renormalised (E4); counts by ``ratio_assign``."""

    def update(one: np.ndarray, several: np.ndarray, v: dict):
        m = np.where(v["eff"] > 0, (one + several) / np.where(v["eff"] > 0, v["eff"], 1.0), 0.0)
        return m / m.sum() if m.sum() > 0 else m, {}

    return _fit(
        q, ratio_start(q, lengths), lambda c, v: ratio_map(c, v["eff"]), (F.lit(1.0), lambda v: v["pi"], update),
        lambda pi: pi / pi.sum() if pi.sum() > 0 else pi, tolerance, most,
    )


def ratio_counts(q: DataFrame, lengths: DataFrame, tolerance: float = 1e-4, most: int = 100) -> DataFrame:
    """Counts of multi reads (sample_id, feature_id, m) at the fixed point."""
    return ratio_assign(q, ratio_fit(q, lengths, tolerance, most)[0])


def pair_fit(q: DataFrame, state: DataFrame, tolerance: float = 1e-7, most: int = 100) -> tuple[DataFrame, Report]:
    """``state`` (of ``pair_start``) at the fixed point, pi clamped. As in the reference, pi alone is
    extrapolated and tested; theta is that of the last evaluation (E10, E11, E15)."""

    def on_classes(c: Classes, v: dict):
        step, n = pair_map(c, v["a"], v["b"]), len(c.features)

        def run(pi: np.ndarray) -> np.ndarray:
            out = step(np.concatenate([pi, v["theta"]]))
            v["theta"] = out[n:]
            return out[:n]

        return run

    def update(one: np.ndarray, several: np.ndarray, v: dict):
        pi, theta = one + several + v["a"], several + v["b"]
        return pi / max(pi.sum(), 1e-300), {"theta": theta / theta.sum() if theta.sum() > 0 else theta}

    return _fit(q, state, on_classes, (F.col("w"), lambda v: v["pi"] * v["theta"], update), lambda pi: pi, tolerance, most)


def pair_counts(q: DataFrame, state: DataFrame, mode: str, conf: float = 0.9, seed: int = 0, tolerance: float = 1e-7, most: int = 100) -> DataFrame:
    """Counts (sample_id, feature_id, n) after a final E step at the fixed point."""
    return reassign(pair_expect(q, pair_fit(q, state, tolerance, most)[0]), mode, conf, seed)

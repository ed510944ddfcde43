"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are hashed into groups of about ``GROUP_ROWS``. In a group, every dimension has a list of
the vectors sorted by that component. For a query the lists are read from the end that its sign
prefers, some ranks deeper at a time; vectors seen for the first time get their whole score, and
the sum over the dimensions of query times last component read bounds everything unseen. The query
stops when that bound is below its k-th score so far (an equal bound goes on, as ties go to the
smaller id). What leaves a group is at most k rows a query.

The work is one group and one block of ``BLOCK`` queries a task, both of bounded size whatever the
table's; a group's rows travel once a query block and a query once a group. Each query against all
rows is what is asked, so this grows with queries times rows; the bound alone saves work.

How deep it reads is the data's affair: ``depths`` measures it. On the given vectors (64
dimensions, directions spread evenly) a bound that adds up the best of every list stays above the
best scores until nearly all vectors have been seen, so no list stops early; the README has figures.
Where few components carry a query's score, it stops after few ranks (tests).

Vectors that are null, hold a null or a non-finite component, or have a null id take no part. A
query meets every row but those of its own id; repeated rows count each as candidates, and are
asked once as queries. Of equal scores the
smaller id is first. Queries without candidates have no rows; extra columns don't matter. Only
vectors of one dimension meet. Scores are exact 64-bit numbers: a table whose components are so large that
a score might not fit is refused with an error rather than answered wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import partitions

BLOCK = 4096
GROUP_ROWS = 16384
#: Small tables are split further, down to so many rows, to give every core some.
LEAST_ROWS = 2048
SCALE = 1024.0


class Lists:
    """A group's sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()  # dimension x rank, ascending
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the k best, best first, and the depth to which the lists were read."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        if not len(used):  # every score is 0: the smallest ids
            ids = self.ids[self.ids != query_id][:k]
            return np.zeros(len(ids), np.int64), ids, 0
        down = q[used] > 0
        seen = np.zeros(n, bool)
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, 16
        while depth < n:
            reach = min(n, depth + step)
            ranks = np.arange(depth, reach)
            places = np.where(down[:, None], n - 1 - ranks[None, :], ranks[None, :])
            met = np.zeros(n, bool)
            met[self.lists[used[:, None], places].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            fresh = fresh[self.ids[fresh] != query_id]
            scores, ids = np.concatenate([scores, self.vectors[fresh] @ q]), np.concatenate([ids, self.ids[fresh]])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            depth, step = reach, step * 2
            if seen.all():
                break
            last = self.values[used, np.where(down, n - depth, depth - 1)]
            if len(ids) == k and last @ q[used] < scores[-1]:
                break
        return scores, ids, depth


def depths(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int = 10) -> list[float]:
    """The share of the lists that each query (a place in ``ids``) reads."""
    lists = Lists(ids, vectors)
    return [lists.top(int(ids[q]), vectors[q], k)[2] / len(ids) for q in queries]


def quantised(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def top_k(df: DataFrame, query: Column, k: int = 10, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``df`` where ``query`` holds, against all
    rows. ``floor(1024 * component)`` are the vectors that count."""
    held = df.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull())
    held = held.filter(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    held = held.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"), query.alias("is_query"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")) * SCALE + 1))
    n, asked, most, dims = held.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(largest), F.max(F.size("v"))).first()
    if n and dims * most * most >= 2.0**63:
        raise OverflowError(f"components up to {most / SCALE} in {dims} dimensions: scores may exceed 64 bits")
    rows = held.withColumn("v", quantised(F.col("v")))
    groups = max(1, -(-n // GROUP_ROWS), min(partitions(df.sparkSession), -(-n // LEAST_ROWS)))
    blocks = max(1, -(-asked // BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("grp"), spread(blocks).alias("blk"))
    right = rows.filter("is_query").select("id", "v").distinct().select("id", "v", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int").alias("blk"), spread(groups).alias("grp"))

    def matrix(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By dimension: ids and vectors."""
        lists = t.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        ids, flat = t.column("id").to_numpy(), lists.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        return {int(d): (ids[sizes == d], flat[(at[sizes == d][:, None] + np.arange(d)[None, :])]) for d in np.unique(sizes)}

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if candidates.num_rows and asked.num_rows:
            held = matrix(candidates)
            for d, (ids, vectors) in matrix(asked).items():
                if d in held:
                    lists = Lists(*held[d])
                    for i, q in zip(ids, vectors):
                        scores, near, _ = lists.top(int(i), q, k)
                        found.append((np.full(len(near), i), near, scores))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    found = left.groupBy("grp", "blk").cogroup(right.groupBy("grp", "blk")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)

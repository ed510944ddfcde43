"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Each source gets a target: its share, by weight, of a multiple of all sizes, but at most a
multiple of its own size, the excess going to the others by weight (water filling, in closed
form over the sorted ratios of bound to weight). Target over size is the expected number of
copies of each of its documents: the whole part is certain, the fraction is rounded.

Rounding is pivotal: of two documents with fractions p, q and sizes a, b, one direction is drawn
at random and as much mass p*a against q*b is transferred as makes one fraction 0 or 1. Drawing
in proportion to the opposite distance keeps each document's expectation, and the sum of p*a
stays, so a source's words end within one document of its target. Documents meet in hashed
groups of about ``GROUP`` per source, large ones first; each group leaves one residual, and
residuals meet again in groups, level by level, until a source has one, which is drawn. Any
source, however large, is spread over all groups, and a level is a table in the shared folder.

Draws are hashes of ids and the seed, so reruns agree. Null texts have size 0; documents of size
0 take 0 words; the null source is a source, the last one; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import WORD, materialise

GROUP = 128
_ITEM = "struct<size:bigint, doc_id:bigint, copies:int, p:double>"
_STATE = f"struct<has:boolean, c:{_ITEM}, done:array<struct<size:bigint, doc_id:bigint, copies:int>>>"


def targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with ``target``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    aim = F.sum("source_size").over(everything) * float(total)
    rows = rows.withColumn("k", F.row_number().over(by_ratio)).withColumn("level", (aim - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))
    rows = rows.withColumn("fill", F.min(free).over(everything)["level"])
    return rows.select("source", "source_size", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fill") * F.col("w"))).alias("target"))


def _pivot_sql(seed: int, level: int) -> str:
    """The fold's step on state ``s`` and item ``x``. The pair's distances are bound by a
    one-element transform, so that each is computed once."""
    done = "struct({0}.size AS size, {0}.doc_id AS doc_id, cast({0}.copies + {1} AS int) AS copies)"
    carry = "struct({0}.size AS size, {0}.doc_id AS doc_id, {0}.copies AS copies, cast({1} AS double) AS p)"
    outcome = lambda one, bit, other, p: f"named_struct('has', true, 'c', {carry.format(other, p)}, 'done', concat(s.done, array({done.format(one, bit)})))"
    draw = f"pmod(xxhash64({seed}, {level}, x.doc_id, s.c.doc_id, x.size, s.c.size), 1073741824) / 1073741824D"
    up = f"CASE WHEN 1 - s.c.p <= d.q THEN {outcome('s.c', 1, 'x', 'greatest(0D, x.p - (1 - s.c.p) / d.r)')} ELSE {outcome('x', 0, 's.c', 'least(1D, s.c.p + d.q)')} END"
    down = f"CASE WHEN s.c.p <= d.n THEN {outcome('s.c', 0, 'x', 'least(1D, x.p + s.c.p / d.r)')} ELSE {outcome('x', 1, 's.c', 'greatest(0D, s.c.p - d.n)')} END"
    pair = "named_struct('r', x.size / s.c.size, 'q', x.p * x.size / s.c.size, 'n', (1 - x.p) * x.size / s.c.size)"
    chosen = f"CASE WHEN {draw} * (least(1 - s.c.p, d.q) + least(s.c.p, d.n)) < least(s.c.p, d.n) THEN {up} ELSE {down} END"
    met = f"element_at(transform(array({pair}), d -> {chosen}), 1)"
    return f"CASE WHEN s.has THEN {met} ELSE named_struct('has', true, 'c', x, 'done', s.done) END"


def _fold(items: DataFrame, seed: int, level: int) -> DataFrame:
    """One level: per (source, grp) what was decided and the residual."""
    start = f"cast(named_struct('has', false, 'c', NULL, 'done', array()) AS {_STATE})"
    grouped = items.groupBy("source", "grp").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "doc_id", "copies", "p")))).alias("items"))
    folded = grouped.withColumn("s", F.expr(f"aggregate(cast(items AS array<{_ITEM}>), {start}, (s, x) -> cast({_pivot_sql(seed, level)} AS {_STATE}))"))
    return materialise(folded.select("source", "grp", F.col("s.c").alias("c"), F.col("s.done").alias("done")), "mixing")


def mix(df: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), total: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """One row per row of ``df`` (doc_id, text, source): doc_id, source, size, source_size,
    target, taken (size times copies). ``weights`` repeat over the sources in code-point order;
    targets add up to ``total`` times all sizes; none exceeds ``most`` times its source's."""
    sized = df.select("doc_id", "source", F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long").alias("size"))
    sized = materialise(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    aims = targets(sources.select("source", "source_size"), weights, total, most)
    aims = aims.withColumnRenamed("source", "s").join(sources.select(F.col("source").alias("s2"), "n"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    aims = materialise(aims, "targets")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = F.ceil(F.col("n") / GROUP)
    items = sized.join(aims, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    items = items.select("source", "doc_id", "size", F.floor("rate").cast("int").alias("copies"), (F.col("rate") - F.floor("rate")).alias("p"), F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), groups).alias("grp"))
    settled = (F.col("size") == 0) | (F.col("p") <= 0)
    decided = items.filter(settled).select("source", "doc_id", "size", "copies")
    open_items, level = items.filter(~settled), 0
    most_groups = aims.agg(F.max(groups)).first()[0] or 1
    while True:
        folded = _fold(open_items, seed, level)
        decided = decided.unionByName(folded.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.copies"))
        if most_groups <= 1:
            break
        open_items = folded.filter(F.col("c").isNotNull()).select("source", "c.*", F.floor(F.col("grp") / GROUP).cast("long").alias("grp"))
        most_groups, level = -(-most_groups // GROUP), level + 1
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), F.col("c.doc_id"), F.col("c.size")), F.lit(1 << 30)) / float(1 << 30)
    last = folded.filter(F.col("c").isNotNull()).select("source", "c.doc_id", "c.size", (F.col("c.copies") + (draw < F.col("c.p")).cast("int")).alias("copies"))
    result = decided.unionByName(last).join(aims, F.col("source").eqNullSafe(F.col("s")))
    return result.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")

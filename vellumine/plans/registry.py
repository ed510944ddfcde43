"""The registered queries of the expression engine and their SQL counterparts.

Every query runs an operator of this library over whole test tables; the SQL states the same on
the raw tables, as common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine import methods as M
from vellumine import params as P
from vellumine import tags
from vellumine.operators import annotation as A
from vellumine.operators import em as E
from vellumine.operators import features as FE
from vellumine.operators import fragments as FR
from vellumine.operators import intervals as I
from vellumine.operators import weights as W
from vellumine.plans import ervmap as V
from vellumine.shared import written
from vellumine.sources.domain import READ_LENGTH, alignments, features, rmsk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_RATE, _CUTOFF, _INSERT = 0.25, 5, 500

_CTE = {
    "feat": """SELECT p_partkey AS feature_id, p_partkey % 5 AS seqname, (p_partkey // 5) * 40 + 1 AS f_start, (p_partkey // 5) * 40 + p_size AS f_end,
        CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey % 7 <> 0 AS is_te, p_brand AS rep_name, p_type AS rep_family,
        CASE p_partkey % 4 WHEN 0 THEN 'LTR' WHEN 1 THEN 'LINE' WHEN 2 THEN 'SINE' ELSE 'DNA' END AS rep_class FROM part""",
    "aln0": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS aln_id, l_linestatus AS sample_id, l_orderkey AS read_id,
        l_partkey % 5 AS seqname, (l_partkey // 5) * 40 + 1 + l_suppkey % 37 AS a_start, (l_partkey // 5) * 40 + 20 + l_suppkey % 37 AS a_end,
        CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '*' END AS strand, 20 AS qwidth, CAST(l_quantity AS INT) AS as_score,
        CAST(round(l_discount * 100) AS INT) AS nm, CAST(round(l_tax * 100) AS INT) AS clip, CAST(l_linenumber * 5 AS INT) AS xs FROM lineitem""",
    "aln": "SELECT *, CASE WHEN aln_id = min(aln_id) OVER (PARTITION BY sample_id, read_id) THEN 0 ELSE 1 END AS is_secondary FROM aln0",
    "uniq": "SELECT sample_id, read_id, count(*) = 1 AS is_unique FROM aln0 GROUP BY ALL",
    "hits": """SELECT a.*, f.feature_id, f.f_start, f.f_end, f.is_te FROM aln a JOIN feat f ON a.seqname = f.seqname AND a.a_start <= f.f_end AND f.f_start <= a.a_end""",
    "frag": """SELECT event_id AS frag_id, user_id % 5 AS seqname, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
        CASE event_type WHEN 'click' THEN 'ROO_LTR' WHEN 'view' THEN 'ROO_I' WHEN 'purchase' THEN 'BEL_LTR' WHEN 'signup' THEN 'BEL_I' ELSE 'DOC' END AS rep_name,
        1 + date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) AS g_start,
        1 + date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) + CAST(floor(value) AS BIGINT) AS g_end, event_id % 300 AS milli_div FROM events""",
    # arbitration of distinct cells
    "cell": "SELECT DISTINCT sample_id, read_id, feature_id, is_te FROM hits",
    "arb": """SELECT sample_id, read_id, feature_id, is_te, is_unique FROM (SELECT c.*, u.is_unique, bool_or(is_te) OVER r AS t, bool_or(NOT is_te) OVER r AS g
        FROM cell c JOIN uniq u USING (sample_id, read_id) WINDOW r AS (PARTITION BY c.sample_id, c.read_id)) WHERE NOT (t AND g AND is_te = is_unique)""",
    "uq": "SELECT *, count(*) OVER (PARTITION BY sample_id, read_id) AS k FROM arb WHERE is_unique",
    "u0": "SELECT sample_id, feature_id, CAST(count(*) AS DOUBLE) AS u FROM uq WHERE is_te AND k = 1 GROUP BY ALL",
    "ucount": """SELECT sample_id, feature_id, sum(u) AS u FROM (SELECT sample_id, feature_id, u FROM u0 UNION ALL SELECT sample_id, feature_id, 1.0 / k FROM uq WHERE NOT is_te UNION ALL
        SELECT sample_id, feature_id, CASE WHEN s > 0 THEN u / s ELSE 1.0 / k END FROM (SELECT q.*, coalesce(u0.u, 0) AS u, sum(coalesce(u0.u, 0)) OVER (PARTITION BY q.sample_id, q.read_id) AS s
        FROM uq q LEFT JOIN u0 USING (sample_id, feature_id) WHERE q.is_te AND q.k > 1)) GROUP BY ALL""",
    "galn": "SELECT sample_id, read_id, count(DISTINCT aln_id) AS n_aln FROM hits WHERE NOT is_te GROUP BY ALL",
    "gcount": """SELECT sample_id, feature_id, sum(CASE WHEN s > 0 THEN u / s ELSE 1.0 / k END / n_aln) AS g FROM (SELECT q.*, coalesce(c.u, 0) AS u, sum(coalesce(c.u, 0)) OVER r AS s, count(*) OVER r AS k
        FROM arb q LEFT JOIN ucount c USING (sample_id, feature_id) WHERE NOT q.is_unique AND NOT q.is_te WINDOW r AS (PARTITION BY q.sample_id, q.read_id)) JOIN galn USING (sample_id, read_id) GROUP BY ALL""",
    "hn": "SELECT *, count(*) OVER (PARTITION BY aln_id) AS nh, count(*) FILTER (is_te) OVER (PARTITION BY aln_id) AS nt FROM hits",
    "asplit": "SELECT sample_id, read_id, feature_id, coalesce(max_by(1.0 / nt, aln_id) FILTER (nh > 1), 1.0) AS w FROM hn WHERE is_te GROUP BY ALL",
    "mte": "SELECT a.sample_id, a.read_id, a.feature_id, s.w FROM arb a JOIN asplit s USING (sample_id, read_id, feature_id) WHERE NOT a.is_unique AND a.is_te",
    "eff": "SELECT feature_id, greatest(0.0, CAST(f_end - f_start + 1 - 20 + 1 AS DOUBLE)) AS eff FROM feat WHERE is_te",
    # telescope
    "ext": "SELECT sample_id, min(as_score) AS lo, max(as_score + qwidth) AS hi FROM aln GROUP BY ALL",
    "tsa": "SELECT a.*, exp(100.0 * (as_score - lo + 1 + qwidth) / (hi - lo + 1)) - 1 AS s FROM aln a JOIN ext USING (sample_id)",
    "ovl": "SELECT *, greatest(0, least(a_end, f_end) - greatest(a_start, f_start) + 1) AS ov_len FROM hits",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY ov_len DESC, feature_id) AS rk FROM ovl WHERE ov_len > 0.2 * qwidth) WHERE rk = 1",
    "nofeat": """SELECT a.sample_id, a.read_id, a.aln_id FROM aln a JOIN uniq u USING (sample_id, read_id) WHERE NOT u.is_unique
        AND EXISTS (SELECT 1 FROM best b WHERE b.sample_id = a.sample_id AND b.read_id = a.read_id) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.aln_id = a.aln_id)""",
    "tsh": "SELECT sample_id, read_id, aln_id, feature_id, is_te FROM best UNION ALL SELECT sample_id, read_id, aln_id, -1, NULL FROM nofeat",
    "tscell": "SELECT h.sample_id, h.read_id, h.feature_id, h.is_te, max(s) AS w FROM tsh h JOIN tsa USING (aln_id) GROUP BY ALL",
    "atn": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY aln_id) AS c FROM hits) WHERE c = 1",
    "atnof": """SELECT a.sample_id, a.read_id, a.aln_id FROM aln a JOIN uniq u USING (sample_id, read_id) WHERE NOT u.is_unique
        AND EXISTS (SELECT 1 FROM atn b WHERE b.sample_id = a.sample_id AND b.read_id = a.read_id) AND NOT EXISTS (SELECT 1 FROM atn b WHERE b.aln_id = a.aln_id)""",
    "ath": "SELECT sample_id, read_id, aln_id, feature_id, is_te FROM atn UNION ALL SELECT sample_id, read_id, aln_id, -1, NULL FROM atnof",
    "top": "SELECT sample_id, max(as_score) AS m FROM aln GROUP BY ALL",
    "tot": "SELECT sample_id, sum(exp(as_score - m)) AS t FROM aln JOIN top USING (sample_id) GROUP BY ALL",
    "ata": "SELECT a.*, exp(as_score - m - ln(t)) AS s FROM aln a JOIN top USING (sample_id) JOIN tot USING (sample_id)",
    "atcell": "SELECT h.sample_id, h.read_id, h.feature_id, h.is_te, sum(s) AS w FROM ath h JOIN ata USING (aln_id) GROUP BY ALL",
}
_KEYED = "SELECT sample_id, read_id, CASE WHEN feature_id = -1 THEN 'no_feature:' || coalesce(pattern, '') ELSE CAST(feature_id AS VARCHAR) END AS feature_id, w FROM atarb LEFT JOIN (SELECT sample_id, read_id, string_agg(CAST(feature_id AS VARCHAR), '_' ORDER BY feature_id) AS pattern FROM atarb WHERE feature_id <> -1 GROUP BY ALL) USING (sample_id, read_id)"
for _p in ("ts", "at"):
    _CTE[f"{_p}arb"] = f"""SELECT * FROM (SELECT c.*, u.is_unique, bool_or(coalesce(is_te, false)) OVER r AS t, bool_or(coalesce(NOT is_te, false)) OVER r AS g FROM {_p}cell c JOIN uniq u USING (sample_id, read_id)
        WINDOW r AS (PARTITION BY c.sample_id, c.read_id)) WHERE NOT coalesce(t AND g AND is_te = is_unique, false)"""
    _CTE[f"{_p}key"] = "SELECT * FROM tsarb" if _p == "ts" else _KEYED
    _CTE[f"{_p}q"] = f"SELECT sample_id, read_id, feature_id, w / sum(w) OVER r AS w, count(*) FILTER (w > 0) OVER r > 1 AS is_multi FROM {_p}key WINDOW r AS (PARTITION BY sample_id, read_id)"
# rmsk chain
_CTE |= {
    "dict": "SELECT * FROM (VALUES ('ROO_LTR', 'ROO_I'), ('BEL_LTR', 'BEL_I')) t(ltr_name, int_name)",
    "roles0": "SELECT f.*, CASE rep_name WHEN 'ROO_LTR' THEN 'ROO_I' WHEN 'ROO_I' THEN 'ROO_I' WHEN 'BEL_LTR' THEN 'BEL_I' WHEN 'BEL_I' THEN 'BEL_I' END AS pair, CASE WHEN rep_name LIKE '%_I' THEN 1 ELSE 0 END AS i, CASE WHEN rep_name LIKE '%_LTR' THEN 1 ELSE 0 END AS l FROM frag f",
    "roles1": """SELECT *, coalesce(sum(i) OVER (PARTITION BY pair, seqname, strand ORDER BY g_start RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later,
        coalesce(sum(l) OVER (PARTITION BY pair, seqname, strand ORDER BY g_start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
        pair IS NOT NULL AND sum(i) OVER (PARTITION BY pair, seqname, strand) > 0 AND sum(l) OVER (PARTITION BY pair, seqname, strand) > 0 AS both_there FROM roles0""",
    "roles": "SELECT frag_id, seqname, strand, rep_name, g_start, g_end, milli_div, pair, CASE WHEN both_there AND i = 1 THEN 'int' WHEN both_there AND l = 1 THEN 'LTR' ELSE 'noLTR' END AS role, CASE WHEN both_there AND i = 1 THEN earlier WHEN both_there AND l = 1 THEN later ELSE 0 END AS cut FROM roles1",
    "isl0": "SELECT *, max(g_end) OVER (PARTITION BY rep_name, seqname, strand, cut ORDER BY g_start, g_end, frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM roles",
    "isl": f"SELECT *, sum(CASE WHEN reach IS NULL OR g_start - reach - 1 > {_INSERT} THEN 1 ELSE 0 END) OVER (PARTITION BY rep_name, seqname, strand, cut ORDER BY g_start, g_end, frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM isl0",
    "elem": "SELECT rep_name, seqname, strand, cut, island, role, pair, min(g_start) AS g_start, max(g_end) AS g_end, sum(g_end - g_start + 1) AS width, avg(milli_div) AS milli_div, sum(milli_div) AS div_sum, count(*) AS n_frags, min(frag_id) AS elem_id FROM isl GROUP BY ALL",
    "cons": "SELECT rep_name, cons_len FROM (SELECT rep_name, 400 + milli_div % 7 * 100 AS cons_len, row_number() OVER (PARTITION BY rep_name ORDER BY count(*) DESC, cons_len) AS k FROM frag GROUP BY rep_name, cons_len) WHERE k = 1",
    "pat0": """SELECT e.*, c.cons_len, lag(role) OVER w AS lr, lead(role) OVER w AS nr, lag(pair) OVER w AS lp, lead(pair) OVER w AS np, lag(g_end) OVER w AS le, lead(g_start) OVER w AS ns, lag(cons_len) OVER w AS lc
        FROM elem e LEFT JOIN cons c USING (rep_name) WHERE role <> 'noLTR' WINDOW w AS (PARTITION BY seqname, strand ORDER BY g_start, elem_id)""",
    "pat1": "SELECT *, coalesce(role = 'int' AND lr = 'LTR' AND lp = pair AND g_start - le < lc / 2, false) AS up0, coalesce(role = 'int' AND nr = 'LTR' AND np = pair AND ns - g_end < coalesce(lc, cons_len) / 2, false) AS down FROM pat0",
    "pat": "SELECT *, up0 AND NOT coalesce(lag(down, 2) OVER (PARTITION BY seqname, strand ORDER BY g_start, elem_id), false) AS up FROM pat1",
    "asm0": "SELECT *, CASE WHEN up AND down THEN 'full-lengthLTR' WHEN up THEN 'partialLTR_up' WHEN down THEN 'partialLTR_down' END AS own FROM pat",
    "asm1": "SELECT *, coalesce(lag(down) OVER w, false) AS pd, coalesce(lead(up) OVER w, false) AS nu, lag(elem_id) OVER w AS pe, lead(elem_id) OVER w AS ne, lag(own) OVER w AS po, lead(own) OVER w AS no FROM asm0 WINDOW w AS (PARTITION BY seqname, strand ORDER BY g_start, elem_id)",
    "asm": """SELECT elem_id, rep_name, role, seqname, strand, g_start, g_end, width, div_sum, n_frags, CASE WHEN role = 'LTR' AND pd THEN pe WHEN role = 'LTR' AND nu THEN ne ELSE elem_id END AS assembly,
        CASE WHEN role = 'LTR' AND pd THEN po WHEN role = 'LTR' AND nu THEN no ELSE coalesce(own, role) END AS status FROM asm1
        UNION ALL SELECT elem_id, rep_name, role, seqname, strand, g_start, g_end, width, div_sum, n_frags, elem_id, 'noLTR' FROM elem WHERE role = 'noLTR'""",
    "rel0": "SELECT assembly, status, seqname, strand, arg_min(rep_name, CASE WHEN role = 'int' THEN 0 ELSE 1 END * 1000000000000 + elem_id) AS rep_name, max(CASE WHEN role = 'int' THEN 1 ELSE 0 END) AS has_int, min(g_start) AS g_start, max(g_end) AS g_end, sum(width) AS width, sum(div_sum) / sum(n_frags) AS milli_div FROM asm GROUP BY ALL",
    "rel": """SELECT r.*, least(r.width / CAST(CASE WHEN has_int = 1 THEN c.cons_len + 2 * lc.cons_len ELSE c.cons_len END AS DOUBLE), 1.0) AS rel_length FROM rel0 r LEFT JOIN cons c USING (rep_name)
        LEFT JOIN dict d ON r.rep_name = d.int_name LEFT JOIN cons lc ON lc.rep_name = d.ltr_name""",
    "annot": "SELECT f.*, CASE WHEN feature_id % 3 = 0 THEN 'full-lengthLTR' WHEN feature_id % 3 = 1 THEN 'partialLTR_up' ELSE 'LTR' END AS status, CAST(f_end - f_start + 1 AS DOUBLE) / 50 AS rel_length FROM feat f",
    "pass": f"SELECT * FROM hits WHERE is_secondary = 0 AND clip / qwidth < {_RATE} AND nm / qwidth < {_RATE}",
}


def _with(body: str, names: str) -> str:
    """The CTEs in order, then the body."""
    need: list[str] = []

    def add(n: str) -> None:
        if n in need:
            return
        for other in _CTE:
            if other != n and any(t in _CTE[n].replace("(", " ").replace(")", " ").replace(",", " ").split() for t in (other,)):
                add(other)
        need.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n]})" for n in need) + "\n" + body


def query(name: str, ctes: str = "", sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = _with(sql, ctes) if ctes else sql
        return f

    return put


def _hits(spark, sf, how="any", ignore_strand=True):
    return I.interval_join(alignments(spark, sf), features(spark, sf), how, ignore_strand)


# ---- overlaps -------------------------------------------------------------------------------
@query("ov_union", "hits", "SELECT aln_id, feature_id FROM hits")
def _(spark, sf):
    return _hits(spark, sf).select("aln_id", "feature_id")


@query("ov_union_unique", "hits", "SELECT aln_id, feature_id FROM (SELECT *, count(*) OVER (PARTITION BY aln_id) c FROM hits) WHERE c = 1")
def _(spark, sf):
    return I.overlap_union(alignments(spark, sf), features(spark, sf), True).select("aln_id", "feature_id")


@query("ov_within", "hits", "SELECT aln_id, feature_id FROM hits WHERE f_start <= a_start AND a_end <= f_end")
def _(spark, sf):
    return I.overlap_intersection_strict(alignments(spark, sf), features(spark, sf), True, False).select("aln_id", "feature_id")


@query("ov_union_stranded", "feat aln", "SELECT aln_id, feature_id FROM aln a JOIN feat f ON a.seqname = f.seqname AND a_start <= f_end AND f_start <= a_end AND (a.strand = f.strand OR a.strand = '*')")
def _(spark, sf):
    return _hits(spark, sf, ignore_strand=False).select("aln_id", "feature_id")


@query("ov_length", "ovl", "SELECT aln_id, feature_id, CAST(ov_len AS BIGINT) AS ov_len FROM ovl")
def _(spark, sf):
    return _hits(spark, sf).select("aln_id", "feature_id", I.overlap_length().alias("ov_len"))


@query("hits_per_alignment", "hits", "SELECT aln_id, count(*) AS n FROM hits GROUP BY ALL")
def _(spark, sf):
    return _hits(spark, sf).groupBy("aln_id").agg(F.count(F.lit(1)).alias("n"))


@query("compound_features", "feat", "SELECT rep_name, is_te, count(*) AS n_ranges, CAST(sum(f_end - f_start + 1) AS BIGINT) AS width FROM feat GROUP BY ALL")
def _(spark, sf):
    f = features(spark, sf).withColumn("type", F.lit("exon"))
    return FE.group_exons(f, "rep_name").select("rep_name", "is_te", F.col("n_ranges").cast("long").alias("n_ranges"), "width")


# ---- scans and predicates -------------------------------------------------------------------
for _m, _single in (("ervmap", True), ("tetranscripts", False), ("telescope", True)):
    _mask = {"ervmap": "(f & 3588) = 0", "tetranscripts": "(f & 1540) = 0 AND (f & 2) <> 0", "telescope": "(f & 1540) = 0"}[_m]

    def _flags(spark, sf, m=_m, single=_single):
        from vellumine.functions import passes_flags

        a = spark.read.parquet(f"{sf}/lineitem.parquet").select(((F.col("l_orderkey") * 31 + F.col("l_suppkey") * 7) % 4096).cast("int").alias("f"))
        return a.filter(passes_flags(F.col("f"), m, single, False)).groupBy("f").agg(F.count(F.lit(1)).alias("n"))

    QUERIES[f"flag_filter_{_m}"] = _flags
    ORACLE_SQL[f"flag_filter_{_m}"] = f"SELECT f, count(*) AS n FROM (SELECT CAST((l_orderkey * 31 + l_suppkey * 7) % 4096 AS INT) AS f FROM lineitem) WHERE {_mask} GROUP BY f"


@query("unique_read_mask", "uniq", "SELECT sample_id, read_id, is_unique FROM uniq")
def _(spark, sf):
    return W.unique_reads(alignments(spark, sf))


@query("quality_filter", "aln", f"SELECT sample_id, count(*) AS n FROM aln WHERE is_secondary = 0 AND clip / qwidth < {_RATE} AND nm / qwidth < {_RATE} GROUP BY ALL")
def _(spark, sf):
    return alignments(spark, sf).filter(V.primary() & V.passes_quality(_RATE)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


# ---- read-filter counting -------------------------------------------------------------------
def _te(f):
    return f.filter("is_te")


@query("ervmap_counts", "pass feat", "SELECT s.sample_id, f.feature_id, count(p.aln_id) AS n FROM (SELECT DISTINCT l_linestatus AS sample_id FROM lineitem) s CROSS JOIN (SELECT feature_id FROM feat WHERE is_te) f LEFT JOIN pass p ON p.sample_id = s.sample_id AND p.feature_id = f.feature_id GROUP BY ALL")
def _(spark, sf):
    a, f = alignments(spark, sf), _te(features(spark, sf))
    hits = I.interval_join(a.filter(V.primary() & V.passes_quality(_RATE)), f)
    return I.count_by_feature(hits, f, spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linestatus").alias("sample_id")))


_ERV = f"""k AS (SELECT * FROM hits WHERE is_secondary = 1 OR (clip / qwidth < {_RATE} AND nm / qwidth < {_RATE})),
 c0 AS (SELECT sample_id, read_id, feature_id, is_te, max_by(1 - is_secondary, aln_id) AS w FROM k GROUP BY ALL),
 c1 AS (SELECT c.*, u.is_unique, bool_or(is_te) OVER r AS t, bool_or(NOT is_te) OVER r AS g FROM c0 c JOIN uniq u USING (sample_id, read_id) WHERE w > 0 WINDOW r AS (PARTITION BY c.sample_id, c.read_id)),
 m AS (SELECT sample_id, feature_id, count(*) AS n FROM c1 WHERE NOT (t AND g AND is_te = is_unique) GROUP BY ALL)"""


def _genes(spark, sf, mode):
    a, f = alignments(spark, sf), features(spark, sf)
    keep = a.filter(V.passes_quality(_RATE) | ~V.primary())
    counts = V.matrix_counts(I.interval_join(keep, f.drop("is_te")), f, a)
    if mode == "all":
        lost = I.interval_join(a.filter(V.primary() & ~V.passes_quality(_RATE)), f.filter("not is_te").drop("is_te"))  # R6, J5
        counts = counts.unionByName(lost.groupBy("sample_id", "feature_id").agg(F.count(F.lit(1)).alias("n"))).groupBy("sample_id", "feature_id").agg(F.sum("n").alias("n"))
    return counts


@query("ervmap_counts_genes_ervmap")
def _(spark, sf):
    return _genes(spark, sf, "ervmap")


@query("ervmap_counts_genes_all")
def _(spark, sf):
    return _genes(spark, sf, "all")


ORACLE_SQL["ervmap_counts_genes_ervmap"] = _with("", "hits uniq").rstrip() + ",\n" + _ERV + " SELECT sample_id, feature_id, n FROM m"
ORACLE_SQL["ervmap_counts_genes_all"] = _with("", "hits uniq").rstrip() + ",\n" + _ERV + f""" SELECT sample_id, feature_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM m UNION ALL
 SELECT sample_id, feature_id, count(*) AS n FROM hits WHERE NOT is_te AND is_secondary = 0 AND NOT (clip / qwidth < {_RATE} AND nm / qwidth < {_RATE}) GROUP BY ALL) GROUP BY ALL"""


@query("ervmap_subopt_tag", "pass", f"SELECT sample_id, feature_id, count(*) AS n FROM pass WHERE is_te AND as_score - xs >= {_CUTOFF} GROUP BY ALL")
def _(spark, sf):
    a = alignments(spark, sf).filter(V.primary() & V.passes_quality(_RATE) & V.passes_suboptimal_tag(_CUTOFF))
    return I.interval_join(a, _te(features(spark, sf))).groupBy("sample_id", "feature_id").agg(F.count(F.lit(1)).alias("n"))


@query("ervmap_subopt_secondary", "aln", f"SELECT sample_id, read_id FROM aln GROUP BY ALL HAVING max(as_score) FILTER (is_secondary = 0) - coalesce(max(as_score) FILTER (is_secondary = 1), -99) >= {_CUTOFF}")
def _(spark, sf):
    return V.suboptimal_by_secondary(alignments(spark, sf), _CUTOFF)


# ---- features and results -------------------------------------------------------------------
@query("feature_union", "feat", "SELECT rep_name AS name, true AS is_te, 'te' AS type, feature_id FROM feat WHERE is_te UNION ALL SELECT 'gene' || feature_id, false, 'exon', feature_id FROM feat WHERE NOT is_te")
def _(spark, sf):
    f = features(spark, sf)
    te = _te(f).select(F.col("rep_name").alias("name"), F.lit("te").alias("type"), "feature_id")
    genes = f.filter("not is_te").select(F.concat(F.lit("gene"), F.col("feature_id").cast("string")).alias("name"), "feature_id")
    return FE.unite(te, genes).select("name", "is_te", "type", "feature_id")


@query("exon_grouping", "feat", "SELECT rep_family AS name, count(*) AS n_ranges, CAST(sum(f_end - f_start + 1) AS BIGINT) AS width FROM feat WHERE NOT is_te GROUP BY ALL")
def _(spark, sf):
    genes = features(spark, sf).filter("not is_te").withColumnRenamed("rep_family", "name").withColumn("type", F.lit("exon"))
    return FE.group_exons(genes).select("name", F.col("n_ranges").cast("long").alias("n_ranges"), "width")


_KEY = "CASE WHEN is_te THEN {} ELSE CAST(f.feature_id AS VARCHAR) END"
for _name, _cols, _expr in (("aggregate_by_one", ["rep_name"], "rep_name"), ("aggregate_by_two", ["rep_name", "rep_class"], "rep_name || ':' || rep_class")):

    def _agg(spark, sf, cols=_cols):
        f = features(spark, sf)
        counts = I.interval_join(alignments(spark, sf).filter(V.primary() & V.passes_quality(_RATE)), f.drop("is_te", "rep_name", "rep_class", "rep_family")).groupBy("sample_id", "feature_id").agg(F.count(F.lit(1)).alias("n"))
        return FE.aggregate_counts(counts, f, cols)

    QUERIES[_name] = _agg
    ORACLE_SQL[_name] = _with(f"SELECT sample_id, {_KEY.format(_expr).replace('is_te', 'f.is_te')} AS key, count(*) AS n FROM pass p JOIN feat f USING (feature_id) GROUP BY ALL".replace("CAST(f.feature_id", "CAST(feature_id"), "pass feat")


@query("consolidate_features", "feat", "SELECT CASE WHEN is_te THEN rep_name ELSE CAST(feature_id AS VARCHAR) END AS key, is_te, string_agg(DISTINCT rep_class, ',' ORDER BY rep_class) AS classes, round(avg(f_end - f_start + 1), 6) AS mean_width, count(*) AS n_members FROM feat GROUP BY 1, 2")
def _(spark, sf):
    return FE.consolidate(features(spark, sf), ["rep_name"]).withColumn("mean_width", F.round("mean_width", 6))


@query("assay_pivot", "pass", "SELECT feature_id, count(*) FILTER (sample_id = 'F') AS F, count(*) FILTER (sample_id = 'O') AS O FROM pass WHERE is_te GROUP BY ALL")
def _(spark, sf):
    hits = I.interval_join(alignments(spark, sf).filter(V.primary() & V.passes_quality(_RATE)), _te(features(spark, sf)))
    return FE.pivot(hits.groupBy("sample_id", "feature_id").agg(F.count(F.lit(1)).alias("n")), ["F", "O"])


@query("phenodata_join", "", "SELECT s.sample_id, CASE s.sample_id WHEN 'F' THEN 'control' ELSE 'knockdown' END AS condition FROM (SELECT DISTINCT l_linestatus AS sample_id FROM lineitem) s")
def _(spark, sf):
    samples = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linestatus").alias("sample_id")).distinct()
    return FE.with_phenodata(samples, spark.createDataFrame([("F", "control"), ("O", "knockdown")], "sample_id string, condition string"))


@query("metadata_full_outer", "feat", "SELECT coalesce(a.feature_id, b.feature_id) AS feature_id, rep_name, rep_class FROM (SELECT feature_id, rep_name FROM feat WHERE is_te) a FULL JOIN (SELECT feature_id, rep_class FROM feat WHERE feature_id % 3 = 0) b ON a.feature_id = b.feature_id")
def _(spark, sf):
    f = features(spark, sf)
    return FE.outer_metadata(_te(f).select("feature_id", "rep_name"), f.filter("feature_id % 3 = 0").select("feature_id", "rep_class"), "feature_id")


@query("harmonise_seqnames", "aln", "SELECT 'chr' || seqname AS seqname, count(*) AS n FROM aln WHERE seqname <> 4 GROUP BY ALL")
def _(spark, sf):
    info = spark.range(5).select(F.col("id").cast("string").alias("seqname"), FE.ucsc_style(F.col("id").cast("string")).alias("target"), (F.col("id") != 4).alias("lengths_agree"))
    return FE.harmonise(alignments(spark, sf).withColumn("seqname", F.col("seqname").cast("string")), info).groupBy("seqname").agg(F.count(F.lit(1)).alias("n"))


# ---- annotation -----------------------------------------------------------------------------
def _dict(spark):
    return spark.createDataFrame([("ROO_LTR", "ROO_I"), ("BEL_LTR", "BEL_I")], "ltr_name string, int_name string")


def _cons(spark, sf):
    return A.consensus_lengths(rmsk(spark, sf), 400 + F.col("milli_div") % 7 * 100)


def _as_rmsk(f):
    q = F.when(F.col("feature_id") % 11 == 0, F.concat("rep_name", F.lit("?"))).otherwise(F.col("rep_name"))
    cls = F.when(F.col("feature_id") % 13 == 0, "Simple_repeat").when(F.col("feature_id") % 17 == 0, "RC").otherwise(F.col("rep_class"))
    fam = F.when(F.col("feature_id") % 17 == 0, "Helitron").when(F.col("feature_id") % 5 == 0, "Unknown").otherwise(F.col("rep_family"))
    return f.select(F.col("feature_id").alias("frag_id"), q.alias("rep_name"), cls.alias("rep_class"), fam.alias("rep_family"), "strand")


_CTE["rm"] = "SELECT feature_id AS frag_id, CASE WHEN feature_id % 11 = 0 THEN rep_name || '?' ELSE rep_name END AS rep_name, CASE WHEN feature_id % 13 = 0 THEN 'Simple_repeat' WHEN feature_id % 17 = 0 THEN 'RC' ELSE rep_class END AS rep_class, CASE WHEN feature_id % 17 = 0 THEN 'Helitron' WHEN feature_id % 5 = 0 THEN 'Unknown' ELSE rep_family END AS rep_family, strand FROM feat"
_CTE["rmb"] = "SELECT frag_id, replace(rep_name, '?', '') AS rep_name, rep_class, rep_family FROM rm WHERE rep_class <> 'Simple_repeat'"


@query("rmsk_basic", "rmb", "SELECT frag_id, rep_class, CASE WHEN count(*) OVER (PARTITION BY rep_name) > 1 THEN rep_name || '_dup' || row_number() OVER (PARTITION BY rep_name ORDER BY frag_id) ELSE rep_name END AS name, CASE WHEN rep_family IN ('Unknown', 'Other') THEN rep_name ELSE rep_family END AS rep_family FROM rmb")
def _(spark, sf):
    return A.basic_parser(_as_rmsk(features(spark, sf))).select("frag_id", "rep_class", "name", "rep_family")


@query("rmsk_filter_tes", "rm", "SELECT frag_id, CASE WHEN rep_class = 'RC' AND rep_family = 'Helitron' THEN 'DNA' ELSE rep_class END AS rep_class, CASE WHEN rep_class = 'RC' AND rep_family = 'Helitron' THEN 'RC' ELSE rep_family END AS rep_family FROM rm WHERE rep_class IN ('DNA', 'SINE', 'LINE', 'LTR') OR (rep_class = 'RC' AND rep_family = 'Helitron')")
def _(spark, sf):
    return A.only_tes(_as_rmsk(features(spark, sf))).select("frag_id", "rep_class", "rep_family")


@query("rmsk_cons_length", "cons", "SELECT rep_name, cons_len FROM cons")
def _(spark, sf):
    return _cons(spark, sf)


@query("rmsk_gap_merge", "frag", f"""SELECT rep_name, seqname, strand, island, min(g_start) AS g_start, max(g_end) AS g_end, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR g_start - reach - 1 > {_INSERT} THEN 1 ELSE 0 END) OVER (PARTITION BY rep_name, seqname, strand ORDER BY g_start, g_end, frag_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
    FROM (SELECT *, max(g_end) OVER (PARTITION BY rep_name, seqname, strand ORDER BY g_start, g_end, frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM frag)) GROUP BY ALL""")
def _(spark, sf):
    m = I.gap_merge(rmsk(spark, sf), ["rep_name", "seqname", "strand"], _INSERT)
    return m.groupBy("rep_name", "seqname", "strand", "island").agg(F.min("g_start").alias("g_start"), F.max("g_end").alias("g_end"), F.count(F.lit(1)).alias("n"))


@query("rmsk_lag_merge", "frag", """SELECT rep_name, seqname, strand, island, count(*) AS n, min(frag_id) AS elem_id FROM (SELECT *, CAST(sum(CASE WHEN ps IS NULL OR NOT (g_start > ps AND g_end > pe AND g_start - ps + g_end - g_start + 1 < 8000 AND CASE WHEN strand = '-' THEN c_start < pcs AND c_end < pce ELSE c_start > pcs AND c_end > pce END) THEN 1 ELSE 0 END)
    OVER (PARTITION BY rep_name, seqname, strand ORDER BY g_start, g_end, frag_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, lag(g_start) OVER w AS ps, lag(g_end) OVER w AS pe, lag(c_start) OVER w AS pcs, lag(c_end) OVER w AS pce
    FROM (SELECT *, milli_div AS c_start, milli_div + g_end - g_start AS c_end FROM frag) WINDOW w AS (PARTITION BY rep_name, seqname, strand ORDER BY g_start, g_end, frag_id))) GROUP BY ALL""")
def _(spark, sf):
    r = rmsk(spark, sf).withColumn("c_start", F.col("milli_div")).withColumn("c_end", F.col("milli_div") + F.col("g_end") - F.col("g_start")).withColumn("cons_len", F.lit(4000))
    m = I.lag_merge(r, ["rep_name", "seqname", "strand"], F.col("strand") == "-")
    return m.groupBy("rep_name", "seqname", "strand", "island").agg(F.count(F.lit(1)).alias("n"), F.min("frag_id").alias("elem_id"))


@query("rmsk_counterpart_rank", "roles", "SELECT frag_id, role, CAST(cut AS BIGINT) AS cut FROM roles")
def _(spark, sf):
    return A.counterpart_rank(rmsk(spark, sf), _dict(spark)).select("frag_id", "role", F.col("cut").cast("long").alias("cut"))


def _elements(spark, sf):
    return A.merge_fragments(A.counterpart_rank(rmsk(spark, sf), _dict(spark)), _INSERT)


@query("rmsk_ltr_int_pattern", "pat", "SELECT elem_id, role, up, down FROM pat")
def _(spark, sf):
    return A.ltr_int_patterns(_elements(spark, sf), _cons(spark, sf)).select("elem_id", "role", "up", "down")


@query("rmsk_assemble", "asm", "SELECT elem_id, assembly, status FROM asm")
def _(spark, sf):
    return A.assemble(_elements(spark, sf), _cons(spark, sf)).select("elem_id", "assembly", "status")


@query("rmsk_rel_length", "rel", "SELECT assembly, status, rep_name, CAST(width AS BIGINT) AS width, round(rel_length, 6) AS rel_length FROM rel")
def _(spark, sf):
    p = A.assembly_parser(rmsk(spark, sf), insert=_INSERT, dictionary=_dict(spark), cons=_cons(spark, sf))
    return p.select("assembly", "status", "rep_name", "width", F.round("rel_length", 6).alias("rel_length"))


@query("rmsk_strict", "elem", "SELECT elem_id, CAST(width AS BIGINT) AS width FROM elem WHERE width >= 80 AND milli_div < 200")
def _(spark, sf):
    return A.strict(_elements(spark, sf)).select("elem_id", "width")


@query("rmsk_element_names", "elem", "SELECT elem_id, rep_name || '.' || row_number() OVER (ORDER BY seqname, g_start, elem_id) AS name FROM elem")
def _(spark, sf):
    from vellumine.operators.ordering import global_row_number

    e = global_row_number(_elements(spark, sf), F.col("seqname") * 1_000_000 + F.expr("g_start div 10000"), ["seqname", "g_start", "elem_id"], "k")
    return e.select("elem_id", F.concat_ws(".", "rep_name", F.col("k").cast("string")).alias("name"))


def _names(spark, sf):
    """LTR-class names made from brands: families with an LTR and an internal region."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.translate("p_brand", "#", "").alias("b"), "p_partkey")
    return p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat("b", F.lit("-int"))).when(F.col("p_partkey") % 3 == 1, F.concat("b", F.lit("_LTR"))).otherwise(F.col("b")).alias("rep_name"), F.col("p_partkey").alias("ix"))


_NAMES_SQL = "n AS (SELECT rep_name, min(p_partkey) AS ix FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN b || '-int' WHEN 1 THEN b || '_LTR' ELSE b END AS rep_name FROM (SELECT replace(p_brand, '#', '') AS b, p_partkey FROM part)) GROUP BY rep_name)"
_PREFIX_SQL = f"""{_NAMES_SQL}, p AS (SELECT l.rep_name AS ltr_name, l.ix AS ltr_ix, i.rep_name AS int_name, i.ix AS int_ix, (SELECT count(*) FROM range(1, 100) t(k) WHERE k <= least(len(l.rep_name), len(i.rep_name)) AND left(l.rep_name, k) = left(i.rep_name, k)) + 1 AS lcp
    FROM n l JOIN n i ON l.rep_name LIKE '%_LTR' AND i.rep_name LIKE '%-int'), s AS (SELECT *, lcp / CAST(len(ltr_name) AS DOUBLE) AS score FROM p WHERE lcp >= 6),
    d AS (SELECT ltr_name, int_name, ltr_ix FROM (SELECT *, row_number() OVER (PARTITION BY ltr_name ORDER BY score DESC, int_ix) AS k FROM s WHERE score >= 0.5) WHERE k = 1)"""


@query("dict_prefix", "", f"WITH {_PREFIX_SQL} SELECT ltr_name, int_name FROM d")
def _(spark, sf):
    return A.prefix_dictionary(_names(spark, sf)).select("ltr_name", "int_name")


@query("dict_inverse", "", f"WITH {_PREFIX_SQL} SELECT int_name, string_agg(ltr_name, ':' ORDER BY ltr_ix) AS ltr_names FROM d GROUP BY int_name")
def _(spark, sf):
    return A.inverse_dictionary(A.prefix_dictionary(_names(spark, sf)))


@query("dict_rules", "", f"WITH {_NAMES_SQL} SELECT l.rep_name AS ltr_name, i.rep_name AS int_name FROM n l JOIN n i ON (l.rep_name LIKE '%!_LTR' ESCAPE '!' AND replace(l.rep_name, '_LTR', '-int') = i.rep_name) OR (l.rep_name NOT LIKE '%LTR' AND l.rep_name NOT LIKE '%-int' AND l.rep_name || '-int' = i.rep_name) OR (l.rep_name LIKE '%!_LTR' ESCAPE '!' AND replace(l.rep_name, '_LTR', '') = i.rep_name AND replace(l.rep_name, '_LTR', '-int') NOT IN (SELECT rep_name FROM n))")
def _(spark, sf):
    return A.rule_dictionary(_names(spark, sf))


def _annot(spark, sf):
    k = F.col("feature_id") % 3
    return features(spark, sf).withColumn("status", F.when(k == 0, "full-lengthLTR").when(k == 1, "partialLTR_up").otherwise("LTR")).withColumn("rel_length", (F.col("f_end") - F.col("f_start") + 1) / 50.0)


@query("get_ltrs", "annot", "SELECT feature_id FROM annot WHERE is_te AND rep_class = 'LTR' AND rel_length > 0.5 AND status IN ('full-lengthLTR', 'partialLTR_up', 'partialLTR_down')")
def _(spark, sf):
    return A.get_ltrs(_annot(spark, sf), 0.5, partial=True).select("feature_id")


@query("get_ltrs_mask", "annot", "SELECT feature_id, is_te AND rep_class = 'LTR' AND rel_length > 0.5 AND status = 'LTR' AS mask FROM annot")
def _(spark, sf):
    return A.get_ltrs(_annot(spark, sf), 0.5, full_length=False, solo_ltr=True, return_mask=True).select("feature_id", "mask")


for _n, _c, _f in (("get_lines", "LINE", A.get_lines), ("get_sines", "SINE", A.get_sines), ("get_dna", "DNA", A.get_dna_transposons)):
    QUERIES[_n] = lambda spark, sf, f=_f: f(_annot(spark, sf), 0.5).select("feature_id")
    ORACLE_SQL[_n] = _with(f"SELECT feature_id FROM annot WHERE is_te AND rep_class = '{_c}' AND rel_length > 0.5", "annot")


# ---- unique counts and ratio EM -------------------------------------------------------------
def _tt(spark, sf):
    a, f = written(alignments(spark, sf)), features(spark, sf)
    hits = written(I.interval_join(a, f.select("feature_id", "seqname", "f_start", "f_end", "strand")).select("aln_id", "sample_id", "read_id", "feature_id"))
    q = W.arbitrate(W.cells(hits, F.lit(1.0), "any"), f, W.unique_reads(a))
    return f, hits, q


@query("read_feature_cells", "cell", "SELECT sample_id, read_id, feature_id FROM cell")
def _(spark, sf):
    return W.cells(_hits(spark, sf), F.lit(1.0), "any").select("sample_id", "read_id", "feature_id")


@query("tt_arbitration", "arb", "SELECT sample_id, read_id, feature_id FROM arb")
def _(spark, sf):
    return _tt(spark, sf)[2].select("sample_id", "read_id", "feature_id")


@query("tt_unique_counts", "ucount", "SELECT sample_id, feature_id, round(u, 6) AS u FROM ucount")
def _(spark, sf):
    return W.unique_counts(_tt(spark, sf)[2]).withColumn("u", F.round("u", 6))


@query("tt_multi_gene_counts", "gcount", "SELECT sample_id, feature_id, round(g, 6) AS g FROM gcount")
def _(spark, sf):
    f, hits, q = _tt(spark, sf)
    return W.multi_gene_counts(q, W.unique_counts(q), hits, f).withColumn("g", F.round("g", 6))


@query("tt_alignment_split", "asplit", "SELECT sample_id, read_id, feature_id, round(w, 6) AS w FROM asplit")
def _(spark, sf):
    f, hits, _ = _tt(spark, sf)
    return W.alignment_split(hits, f).withColumn("w", F.round("w", 6))


def _mte(spark, sf):
    """Weights of multi-mapping reads on TEs, and the TEs' effective lengths."""
    from vellumine.functions import effective_length

    f, hits, q = _tt(spark, sf)
    w = q.filter("not is_unique and is_te").select(*W.READ, "feature_id").join(W.alignment_split(hits, f), [*W.READ, "feature_id"])
    return w, _te(f).select("feature_id", effective_length(F.col("f_end") - F.col("f_start") + 1, READ_LENGTH).alias("eff"))


_RATIO0 = """c0 AS (SELECT sample_id, feature_id, eff, CASE WHEN eff > 0 THEN sum(w) / eff ELSE 0 END AS x FROM mte JOIN eff USING (feature_id) GROUP BY sample_id, feature_id, eff),
 p0 AS (SELECT sample_id, feature_id, eff, x / sum(x) OVER (PARTITION BY sample_id) AS pi FROM c0)"""


def _ratio_sql(k: int) -> str:
    return f""",
 e{k} AS (SELECT m.sample_id, m.read_id, m.feature_id, eff, pi, sum(pi) OVER (PARTITION BY m.sample_id, m.read_id) AS s FROM mte m JOIN p{k - 1} USING (sample_id, feature_id)),
 m{k} AS (SELECT sample_id, feature_id, eff, sum(CASE WHEN s > 0 THEN pi / s ELSE 0 END) AS x FROM e{k} GROUP BY ALL),
 n{k} AS (SELECT *, CASE WHEN eff > 0 THEN x / eff ELSE 0 END AS y FROM m{k}),
 p{k} AS (SELECT sample_id, feature_id, eff, y / sum(y) OVER (PARTITION BY sample_id) AS pi FROM n{k})"""


_RATIO3 = _with("", "mte eff").rstrip() + ",\n" + _RATIO0 + "".join(map(_ratio_sql, (1, 2, 3)))


@query("tt_effective_length")
def _(spark, sf):
    return E.ratio_start(*_mte(spark, sf)).select("sample_id", "feature_id", F.round("pi", 9).alias("pi"))


ORACLE_SQL["tt_effective_length"] = _with("", "mte eff").rstrip() + ",\n" + _RATIO0 + " SELECT sample_id, feature_id, round(pi, 9) AS pi FROM p0"


def _ratio3(spark, sf):
    w, eff = _mte(spark, sf)
    w = W.settled(w)
    return w, E.iterate(lambda s: E.ratio_step(w, s), E.ratio_start(w, eff), 3, written)


@query("tt_em_k3")
def _(spark, sf):
    return _ratio3(spark, sf)[1].select("sample_id", "feature_id", F.round("pi", 9).alias("pi"))


ORACLE_SQL["tt_em_k3"] = _RATIO3 + " SELECT sample_id, feature_id, round(pi, 9) AS pi FROM p3"


@query("tt_multi_counts_k3")
def _(spark, sf):
    w, pi = _ratio3(spark, sf)
    return E.ratio_assign(w, pi).withColumn("m", F.round("m", 6))


ORACLE_SQL["tt_multi_counts_k3"] = _RATIO3 + " SELECT sample_id, feature_id, round(sum(CASE WHEN s > 0 THEN pi / s ELSE 0 END), 6) AS m FROM (SELECT m.*, p.pi, sum(p.pi) OVER (PARTITION BY m.sample_id, m.read_id) AS s FROM mte m JOIN p3 p USING (sample_id, feature_id)) GROUP BY ALL"


# ---- best overlap, no-feature and two-parameter EM --------------------------------------------
def _ts_hits(spark, sf):
    a, f = written(alignments(spark, sf)), features(spark, sf)
    best = W.best_overlap(I.interval_join(a, f.drop("is_te")), I.overlap_length(), 0.2)
    return a, f, best, W.no_feature_hits(a, best, W.unique_reads(a))


def _ts_q(spark, sf):
    a, f, best, none = _ts_hits(spark, sf)
    s = W.rescale_expm1(a).select("aln_id", "s")
    hits = best.select(*W.READ, "aln_id", "feature_id").unionByName(none.select(*W.READ, "aln_id", "feature_id")).join(s, "aln_id")
    return f, E.multi_flag(W.row_normalise(W.arbitrate(W.cells(hits, F.col("s"), "max"), f, W.unique_reads(a))))


@query("ts_min_overlap_best", "best", "SELECT aln_id, feature_id, CAST(ov_len AS BIGINT) AS ov_len FROM best")
def _(spark, sf):
    return _ts_hits(spark, sf)[2].select("aln_id", "feature_id", "ov_len")


@query("ts_no_feature", "nofeat", "SELECT aln_id FROM nofeat")
def _(spark, sf):
    return _ts_hits(spark, sf)[3].select("aln_id")


@query("ts_rescale", "tsa", "SELECT aln_id, round(ln(s + 1), 6) AS log_s FROM tsa")
def _(spark, sf):
    return W.rescale_expm1(alignments(spark, sf)).select("aln_id", F.round(F.log(F.col("s") + 1), 6).alias("log_s"))


@query("ts_q_matrix", "tsq", "SELECT sample_id, read_id, feature_id, round(w, 9) AS w, is_multi FROM tsq")
def _(spark, sf):
    return _ts_q(spark, sf)[1].select("sample_id", "read_id", "feature_id", F.round("w", 9).alias("w"), "is_multi")


def _pair_sql(q: str, k: int) -> str:
    return f""",
 x{k} AS (SELECT *, CASE WHEN t > 0 THEN y / t ELSE 0 END AS x FROM (SELECT q.*, a, b, y, sum(y) OVER (PARTITION BY q.sample_id, q.read_id) AS t FROM (SELECT q.*, a, b, w * pi * CASE WHEN is_multi THEN theta ELSE 1 END AS y FROM {q} q JOIN s{k - 1} USING (sample_id, feature_id)) q)),
 a{k} AS (SELECT sample_id, feature_id, a, b, sum(x) AS sx, sum(CASE WHEN is_multi THEN x ELSE 0 END) AS mx FROM x{k} GROUP BY ALL),
 s{k} AS (SELECT sample_id, feature_id, (sx + a) / sum(sx + a) OVER w AS pi, (mx + b) / sum(mx + b) OVER w AS theta, a, b FROM a{k} WINDOW w AS (PARTITION BY sample_id))"""


_TS3 = _with("", "tsq").rstrip() + ",\n s0 AS (SELECT DISTINCT sample_id, feature_id, 1.0 / k AS pi, 1.0 / k AS theta, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT sample_id, feature_id, (SELECT count(DISTINCT feature_id) FROM tsq z WHERE z.sample_id = y.sample_id) AS k FROM tsq y))" + "".join(_pair_sql("tsq", k) for k in (1, 2, 3))
_TSX = _TS3 + _pair_sql("tsq", 4).rsplit(",\n a4", 1)[0]


def _ts3(spark, sf):
    f, q = _ts_q(spark, sf)
    q = W.settled(q)
    return q, E.iterate(lambda s: E.pair_step(q, s), E.pair_start(q), 3, written)


@query("ts_em_k3")
def _(spark, sf):
    return _ts3(spark, sf)[1].select("sample_id", "feature_id", F.round("pi", 9).alias("pi"), F.round("theta", 9).alias("theta"))


ORACLE_SQL["ts_em_k3"] = _TS3 + " SELECT sample_id, feature_id, round(pi, 9) AS pi, round(theta, 9) AS theta FROM s3"

_BEST = " , z AS (SELECT *, x > 0 AND abs(x - max(x) OVER r) <= 1e-12 * max(x) OVER r AS best FROM x4 WINDOW r AS (PARTITION BY sample_id, read_id)), z2 AS (SELECT *, count(*) FILTER (best) OVER (PARTITION BY sample_id, read_id) AS ties FROM z) "
for _mode, _sql in (
    ("exclude", _BEST + "SELECT sample_id, feature_id, CAST(count(*) AS DOUBLE) AS n FROM z2 WHERE best AND ties = 1 GROUP BY ALL"),
    ("average", _BEST + "SELECT sample_id, feature_id, round(sum(1.0 / ties), 6) AS n FROM z2 WHERE best GROUP BY ALL"),
    ("conf", " SELECT sample_id, feature_id, round(sum(x / t2), 6) AS n FROM (SELECT *, sum(x) OVER (PARTITION BY sample_id, read_id) AS t2 FROM x4 WHERE x >= 0.9) GROUP BY ALL"),
    ("choose", None),
):

    def _re(spark, sf, mode=_mode):
        q, s = _ts3(spark, sf)
        return E.reassign(E.pair_expect(q, s), mode).withColumn("n", F.round("n", 6))

    QUERIES[f"ts_reassign_{_mode}"] = _re
    if _sql:
        ORACLE_SQL[f"ts_reassign_{_mode}"] = _TSX + _sql


# ---- soft-max scores, pattern-keyed no-feature, vector priors -----------------------------------
def _param(cls, spark, sf, genes=True, **more):
    f = features(spark, sf)
    return cls(alignments(spark, sf), _te(f).drop("is_te"), gene_features=f.filter("not is_te").drop("is_te") if genes else None, ignore_strand=True, **more)


def _at_q(spark, sf):
    return M.softmax_cells(_param(P.SoftmaxParam, spark, sf), written(alignments(spark, sf)))


@query("at_softmax", "ata", "SELECT aln_id, round(ln(s), 6) AS log_s FROM ata")
def _(spark, sf):
    return W.rescale_softmax(alignments(spark, sf)).select("aln_id", F.round(F.log("s"), 6).alias("log_s"))


@query("at_q_matrix", "atq", "SELECT sample_id, read_id, feature_id, round(w, 9) AS w FROM atq")
def _(spark, sf):
    return _at_q(spark, sf).select("sample_id", "read_id", "feature_id", F.round("w", 9).alias("w"))


@query("at_multi_nofeature", "atq", "SELECT sample_id, feature_id, min(read_id) AS first_read, round(sum(w), 6) AS mass FROM atq WHERE feature_id LIKE 'no_feature:%' GROUP BY ALL")
def _(spark, sf):
    return W.patterns(_at_q(spark, sf)).withColumn("mass", F.round("mass", 6))


@query("at_em_k3_priors")
def _(spark, sf):
    q = W.settled(_at_q(spark, sf))
    prior = lambda k: features(spark, sf).select("feature_id", (F.col("feature_id") % k * 0.1).alias("prior"))
    state = P.with_prior(P.with_prior(E.pair_start(q, uniform=False), prior(3), "a"), prior(2), "b")
    s = E.iterate(lambda s: E.pair_step(q, s), state, 3, written)
    return s.select("sample_id", "feature_id", F.round("pi", 9).alias("pi"), F.round("theta", 9).alias("theta"))


ORACLE_SQL["at_em_k3_priors"] = _with("", "atq").rstrip() + ",\n s0 AS (SELECT sample_id, feature_id, sum(w) AS pi, sum(CASE WHEN is_multi THEN w ELSE 0 END) AS theta, coalesce(try_cast(feature_id AS BIGINT) % 3, 0) * 0.1::DOUBLE AS a, coalesce(try_cast(feature_id AS BIGINT) % 2, 0) * 0.1::DOUBLE AS b FROM atq GROUP BY ALL)" + "".join(_pair_sql("atq", k) for k in (1, 2, 3)) + " SELECT sample_id, feature_id, round(pi, 9) AS pi, round(theta, 9) AS theta FROM s3"


# ---- whole methods --------------------------------------------------------------------------------
_WIDE = "SELECT k.key, coalesce(sum(n) FILTER (sample_id = 'F'), 0)::BIGINT AS F, coalesce(sum(n) FILTER (sample_id = 'O'), 0)::BIGINT AS O FROM ({keys}) k LEFT JOIN ({counts}) c USING (key) GROUP BY k.key"
_TE_KEYS = "SELECT DISTINCT rep_name AS key FROM feat WHERE is_te"
_ALL_KEYS = "SELECT CAST(feature_id AS VARCHAR) AS key FROM feat"
_GOOD = f"(clip / qwidth < {_RATE} AND nm / qwidth < {_RATE})"


@query("qtex_ervmap_tag", "hits", _WIDE.format(keys=_TE_KEYS, counts=f"SELECT sample_id, rep_name AS key, count(*) AS n FROM hits JOIN (SELECT feature_id, rep_name FROM feat) USING (feature_id) WHERE is_te AND is_secondary = 0 AND {_GOOD} AND as_score - xs >= {_CUTOFF} GROUP BY ALL"))
def _(spark, sf):
    return M.qtex(_param(P.ErvmapParam, spark, sf, False, aggregate_by=("rep_name",), max_mismatch_rate=_RATE, aligner="bwa")).assay()


_BEST3 = f"SELECT sample_id, read_id FROM aln GROUP BY ALL HAVING max(as_score) FILTER (is_secondary = 0) - coalesce(max(as_score) FILTER (is_secondary = 1), -99) >= {_CUTOFF}"


@query("qtex_ervmap_secondary", "hits", _WIDE.format(keys=_ALL_KEYS + " WHERE is_te", counts=f"""SELECT sample_id, CAST(feature_id AS VARCHAR) AS key, count(*) AS n FROM (SELECT sample_id, read_id, feature_id, max_by(1 - is_secondary, aln_id) AS w FROM hits
    JOIN ({_BEST3}) USING (sample_id, read_id) WHERE is_te AND (is_secondary = 1 OR {_GOOD}) GROUP BY ALL) WHERE w > 0 GROUP BY ALL"""))
def _(spark, sf):
    return M.qtex(_param(P.ErvmapParam, spark, sf, False, max_mismatch_rate=_RATE, suboptimal_tag="none")).assay()


@query("qtex_ervmap_genes")
def _(spark, sf):
    return M.qtex(_param(P.ErvmapParam, spark, sf, max_mismatch_rate=_RATE, suboptimal_cutoff=None)).assay()


ORACLE_SQL["qtex_ervmap_genes"] = _with("", "hits uniq").rstrip() + ",\n" + _ERV + ", c AS (SELECT sample_id, CAST(feature_id AS VARCHAR) AS key, n FROM m UNION ALL SELECT sample_id, CAST(feature_id AS VARCHAR), count(*) FROM hits WHERE NOT is_te AND is_secondary = 0 AND NOT " + _GOOD + " GROUP BY ALL) " + _WIDE.format(keys=_ALL_KEYS, counts="SELECT * FROM c")


@query("qtex_tetranscripts")
def _(spark, sf):
    return M.qtex(_param(P.TetranscriptsParam, spark, sf, aggregate_by=("rep_name",))).assay()


@query("qtex_telescope")
def _(spark, sf):
    return M.qtex(_param(P.TelescopeParam, spark, sf), auxiliary=True).assay()


@query("qtex_softmax")
def _(spark, sf):
    return M.qtex(_param(P.SoftmaxParam, spark, sf, pi_prior=0.1), auxiliary=False).assay()


@query("tag_probe", "aln", "SELECT bool_or(nm IS NOT NULL) AS has_NM, bool_or(as_score IS NOT NULL) AS has_AS, bool_and(xs IS NOT NULL) AS has_XS FROM (SELECT aln_id, nm, as_score, CASE WHEN xs < 35 THEN xs END AS xs FROM aln WHERE is_secondary = 0 ORDER BY aln_id LIMIT 1000)")
def _(spark, sf):
    return tags.probe(alignments(spark, sf).withColumn("xs", F.when(F.col("xs") < 35, F.col("xs"))))


# ---- spliced alignments, compound features, paired views --------------------------------------------
_CTE["splice"] = "SELECT aln_id, seqname, strand, a_start, a_start + 7 AS e1, a_start + 8 + 40 * (nm % 3) AS s2, a_end + 40 * (nm % 3) AS a_end, nm % 3 > 0 AS two FROM aln"
_CTE["block"] = "SELECT aln_id, seqname, CASE WHEN two THEN 2 ELSE 1 END AS n, 1 AS ix, a_start AS b, CASE WHEN two THEN e1 ELSE a_end END AS e FROM splice UNION ALL SELECT aln_id, seqname, 2, 2, s2, a_end FROM splice WHERE two"
_CTE["comp"] = "SELECT feature_id // 10 * 5 + feature_id % 5 AS comp_id, seqname, f_start, f_end FROM feat"


def _spliced(spark, sf):
    from vellumine.functions import aligned_blocks

    a = alignments(spark, sf)
    gap = 40 * (F.col("nm") % 3)
    cigar = F.when(gap > 0, F.concat(F.lit("8M"), gap.cast("string"), F.lit("N12M"))).otherwise(F.lit("20M"))
    a = a.withColumn("blocks", aligned_blocks(F.col("a_start"), cigar)).withColumn("a_end", F.col("a_end") + gap)
    ranges = features(spark, sf).select(F.expr("feature_id div 10 * 5 + feature_id % 5").alias("feature_id"), "seqname", "strand", "f_start", "f_end")
    return a, ranges


@query("ov_spliced_union", "block comp", "SELECT DISTINCT aln_id, comp_id FROM block b JOIN comp c ON b.seqname = c.seqname AND b <= f_end AND f_start <= e")
def _(spark, sf):
    return I.overlap_union(*_spliced(spark, sf), True, False).select("aln_id", F.col("feature_id").alias("comp_id"))


@query("ov_spliced_within", "block comp", "SELECT aln_id, comp_id FROM (SELECT aln_id, comp_id, n, count(DISTINCT ix) AS k FROM block b JOIN comp c ON b.seqname = c.seqname AND f_start <= b AND e <= f_end GROUP BY ALL) WHERE k = n")
def _(spark, sf):
    return I.overlap_intersection_strict(*_spliced(spark, sf), True, False).select("aln_id", F.col("feature_id").alias("comp_id"))


@query("ov_compound_length", "splice comp", "SELECT aln_id, comp_id, CAST(max(least(a_end, f_end) - greatest(a_start, f_start) + 1) AS BIGINT) AS ov_len FROM splice s JOIN comp c ON s.seqname = c.seqname AND a_start <= f_end AND f_start <= a_end GROUP BY ALL")
def _(spark, sf):
    return I.compound_overlap_length(*_spliced(spark, sf)).withColumnRenamed("feature_id", "comp_id")


@query("ov_levels", "aln feat", "SELECT aln_id, feature_id FROM aln a JOIN (SELECT feature_id, seqname, f_start - feature_id % 3 * 300 AS f_start, f_end + feature_id % 5 * 500 AS f_end FROM feat WHERE feature_id % 4 = 0) f ON a.seqname = f.seqname AND a_start <= f_end AND f_start <= a_end")
def _(spark, sf):
    f = features(spark, sf).filter("feature_id % 4 = 0")
    f = f.withColumn("f_start", F.col("f_start") - F.col("feature_id") % 3 * 300).withColumn("f_end", F.col("f_end") + F.col("feature_id") % 5 * 500)
    return I.interval_join(alignments(spark, sf), f).select("aln_id", "feature_id")


_CTE["mate"] = "SELECT *, (k - 1) // 2 AS pair_ix, (k - 1) % 2 + 1 AS mate_ix FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, read_id ORDER BY aln_id) AS k FROM aln)"
_CTE["pairrow"] = """SELECT o.sample_id, o.read_id, o.pair_ix, o.aln_id, o.a_start AS a_start_1, t.a_start AS a_start_2, CAST(CASE WHEN t.aln_id IS NULL THEN o.as_score ELSE ceil((o.as_score + t.as_score) / 2.0) END AS BIGINT) AS as_score,
    CASE WHEN t.aln_id IS NOT NULL THEN least(o.xs, t.xs) END AS xs, greatest(o.is_secondary, coalesce(t.is_secondary, 0)) AS is_secondary, CASE WHEN t.aln_id IS NULL THEN 20 ELSE abs(o.a_start - t.a_start) + 20 END AS frag_len,
    t.aln_id IS NOT NULL AND o.seqname = t.seqname AS mated, greatest(o.a_end, t.a_end) - least(o.a_start, t.a_start) + 1 AS span
    FROM (SELECT * FROM mate WHERE mate_ix = 1) o LEFT JOIN (SELECT * FROM mate WHERE mate_ix = 2) t USING (sample_id, read_id, pair_ix)"""


def _mates(spark, sf):
    return FR.numbered_mates(alignments(spark, sf))


@query("pair_view", "pairrow", "SELECT aln_id, as_score, xs, is_secondary, CAST(frag_len AS BIGINT) AS frag_len FROM pairrow")
def _(spark, sf):
    p = FR.pairs(_mates(spark, sf))
    return p.select("aln_id", "as_score", "xs", "is_secondary", FR.fragment_length().cast("long").alias("frag_len"))


@query("fragment_lists", "pairrow", "SELECT sample_id, read_id, pair_ix, CASE WHEN mated THEN least(span, 40) ELSE 20 END::DOUBLE AS len FROM pairrow")
def _(spark, sf):
    return FR.lists(_mates(spark, sf)).select("sample_id", "read_id", F.col("pair_ix").cast("long").alias("pair_ix"), FR.list_length().alias("len"))


@query("tt_mean_fragment_length", "pairrow", "SELECT sample_id, round(avg(frag_len), 6) AS mean_length FROM (SELECT *, count(*) OVER (PARTITION BY sample_id, read_id) AS n FROM pairrow) WHERE n = 1 AND abs(a_start_1 - a_start_2) <= 500 GROUP BY ALL")
def _(spark, sf):
    return FR.mean_fragment_length(FR.pairs(_mates(spark, sf))).withColumn("mean_length", F.round("mean_length", 6))


@query("mate_names", "mate", "SELECT aln_id, read_id || '.' || k AS mate_name FROM mate")
def _(spark, sf):
    return FR.mate_names(_mates(spark, sf)).select("aln_id", "mate_name")


# ---- consensus positions, tracks, sequence names ---------------------------------------------------
_CTE["pos"] = "SELECT frag_id, rep_name, strand, frag_id % 50 + 1 AS rep_start, 300 + frag_id % 40 AS rep_end, -(frag_id % 400) AS rep_left FROM frag"


def _positions(spark, sf):
    k = F.col("frag_id")
    return rmsk(spark, sf).select("frag_id", "rep_name", "strand", (k % 50 + 1).alias("rep_start"), (300 + k % 40).alias("rep_end"), (-(k % 400)).alias("rep_left"))


@query("rmsk_cons_positions", "pos", "SELECT rep_name, cons_len FROM (SELECT rep_name, cons_len, row_number() OVER (PARTITION BY rep_name ORDER BY count(*) DESC, cons_len) AS k FROM (SELECT rep_name, rep_end + CASE WHEN strand = '+' THEN abs(rep_left) ELSE abs(rep_start) END AS cons_len FROM pos) GROUP BY rep_name, cons_len) WHERE k = 1")
def _(spark, sf):
    return A.consensus_lengths(_positions(spark, sf), A.consensus_end())


@query("rmsk_cons_start", "pos", "SELECT frag_id, CASE WHEN s > rep_end THEN rep_end + 1 ELSE s END AS c_start FROM (SELECT *, CASE WHEN strand = '+' THEN abs(rep_start) ELSE abs(rep_left) END AS s FROM pos)")
def _(spark, sf):
    return _positions(spark, sf).select("frag_id", A.consensus_start().alias("c_start"))


@query("rmsk_strict_compound", "rel0", "SELECT assembly, CAST(width AS BIGINT) AS width FROM rel0 WHERE width >= 80 AND milli_div < 150")
def _(spark, sf):
    p = A.assembly_parser(rmsk(spark, sf), insert=_INSERT, dictionary=_dict(spark), cons=_cons(spark, sf))
    return p.filter((F.col("width") >= 80) & (F.col("milli_div") < 150)).select("assembly", "width")


_TRACK = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'hg38' WHEN 1 THEN 'mm10' ELSE 'dm6' END AS genome, 'UCSC RepeatMasker annotations (' || ['Jan','Mar','Oct'][p_partkey % 3 + 1] || (2000 + p_partkey % 23) || ') for it' AS title FROM part"


@query("annotation_newest", "", f"SELECT id, genome, title FROM (SELECT *, row_number() OVER (PARTITION BY genome ORDER BY strptime('1' || regexp_extract(title, ' \\(([A-Za-z]{{3}}[0-9]{{4}})\\) ', 1), '%d%b%Y') DESC, id) AS k FROM ({_TRACK})) WHERE k = 1")
def _(spark, sf):
    from vellumine.sources.annotations import newest

    k = F.col("p_partkey")
    month = F.element_at(F.array(F.lit("Jan"), F.lit("Mar"), F.lit("Oct")), (k % 3 + 1).cast("int"))
    tracks = spark.read.parquet(f"{sf}/part.parquet").select(
        k.alias("id"), F.element_at(F.array(F.lit("hg38"), F.lit("mm10"), F.lit("dm6")), (k % 3 + 1).cast("int")).alias("genome"),
        F.concat(F.lit("UCSC RepeatMasker annotations ("), month, (2000 + k % 23).cast("string"), F.lit(") for it")).alias("title"),
    )
    return newest(tracks, "hg38").unionByName(newest(tracks, "mm10")).unionByName(newest(tracks, "dm6"))


@query("match_sequences", "aln", "SELECT 'chr' || seqname AS seqname, count(*) AS n FROM aln WHERE seqname NOT IN (2, 4) GROUP BY ALL")
def _(spark, sf):
    from vellumine.sources.annotations import match_sequences

    own = spark.range(5).select(F.col("id").cast("string").alias("seqname"), (F.col("id") * 100 + 100).alias("length"))
    of = spark.range(4).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("seqname"), F.when(F.col("id") == 2, 7).otherwise(F.col("id") * 100 + 100).alias("length"))
    alns = alignments(spark, sf).withColumn("seqname", F.col("seqname").cast("string"))
    return match_sequences(alns, own, of).groupBy("seqname").agg(F.count(F.lit(1)).alias("n"))


@query("tt_log_likelihood")
def _(spark, sf):
    w, pi = _ratio3(spark, sf)
    return E.ratio_log_likelihood(w, pi).withColumn("log_likelihood", F.round("log_likelihood", 4))


ORACLE_SQL["tt_log_likelihood"] = _RATIO3 + " SELECT sample_id, round(sum(CASE WHEN pi > 0 THEN pi / s * ln(pi) END), 4) AS log_likelihood FROM (SELECT m.*, p.pi, sum(p.pi) OVER (PARTITION BY m.sample_id, m.read_id) AS s FROM mte m JOIN p3 p USING (sample_id, feature_id)) GROUP BY ALL"

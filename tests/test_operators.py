"""Operators on small hand-made tables: ties, nulls, strands, tags, EM."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine import functions as C
from vellumine.operators import annotation as A
from vellumine.operators import em as E
from vellumine.operators import features as FE
from vellumine.operators import intervals as I


def test_interval_join_edges(spark):
    reads = spark.createDataFrame([(1, "a", 10, 20, "+"), (2, "a", 21, 30, "-"), (3, "b", 10, 20, "*"), (4, "a", 200, 900, "+")], "aln_id long, seqname string, a_start long, a_end long, strand string")
    feats = spark.createDataFrame([(1, "a", 20, 21, "+"), (2, "a", 31, 40, "+"), (3, "b", 1, 100, "-"), (4, "a", 1, 1000, "-")], "feature_id long, seqname string, f_start long, f_end long, strand string")
    pairs = lambda d: sorted((r.aln_id, r.feature_id) for r in d.collect())
    assert pairs(I.interval_join(reads, feats)) == [(1, 1), (1, 4), (2, 1), (2, 4), (3, 3), (4, 4)]
    assert pairs(I.interval_join(reads, feats, "within")) == [(1, 4), (2, 4), (3, 3), (4, 4)]
    assert pairs(I.interval_join(reads, feats, ignore_strand=False)) == [(1, 1), (2, 4), (3, 3)]
    assert pairs(I.overlap_union(reads, feats, True)) == [(3, 3), (4, 4)]
    assert pairs(I.interval_join(reads.limit(0), feats)) == []


def test_cigar_columns(spark):
    rows = spark.createDataFrame([("50M",), ("5S45M",), ("3H47M",), ("20M100N30M",), ("10M2I10M3D10M",)], "c string")
    got = rows.select(C.clipped(F.col("c")), C.query_width(F.col("c")), C.reference_width(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(0, 50, 50), (5, 50, 45), (3, 47, 47), (0, 50, 150), (0, 32, 33)]


def test_pair_summaries(spark):
    r = spark.createDataFrame([(1, 2), (3, None)], "a int, b int").select(C.pair_ceiling_mean(F.col("a"), F.col("b")), C.pair_minimum(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in r] == [(2, 1), (3, None)]


def test_gap_merge_is_idempotent_and_merges_touching(spark):
    f = spark.createDataFrame([(1, "x", 1, 10), (2, "x", 11, 20), (3, "x", 22, 30), (4, "x", 5, 100)], "frag_id long, k string, g_start long, g_end long")
    assert {r.frag_id: r.island for r in I.gap_merge(f.filter("frag_id < 4"), ["k"], 0).collect()} == {1: 1, 2: 1, 3: 2}
    assert {r.island for r in I.gap_merge(f, ["k"], 0).collect()} == {1}


def test_consensus_tie_takes_smaller(spark):
    r = spark.createDataFrame([("a", 5), ("a", 7), ("b", 9)], "rep_name string, cons int")
    assert dict(map(tuple, A.consensus_lengths(r).collect())) == {"a": 5, "b": 9}


def test_pattern_full_and_partial(spark):
    e = spark.createDataFrame(
        [(1, "L", "LTR", "I", 1, 10), (2, "I", "int", "I", 12, 50), (3, "L", "LTR", "I", 52, 60), (4, "I", "int", "I", 62, 90), (5, "L", "LTR", "I", 500, 510)],
        "elem_id long, rep_name string, role string, pair string, g_start long, g_end long",
    ).withColumn("seqname", F.lit("c")).withColumn("strand", F.lit("+"))
    cons = spark.createDataFrame([("L", 20), ("I", 100)], "rep_name string, cons_len int")
    got = {r.elem_id: (r.up, r.down) for r in A.ltr_int_patterns(e, cons).collect()}
    assert got[2] == (True, True) and got[4] == (False, False)  # the shared LTR stays with the first


def test_fuzzy_dictionary(spark):
    n = spark.createDataFrame([("ABC_LTR",), ("ABC-int",), ("XYZ1_LTR",), ("XYZ-int",)], "rep_name string")
    plain = set(map(tuple, A.rule_dictionary(n).collect()))
    assert plain == {("ABC_LTR", "ABC-int")}
    assert ("XYZ1_LTR", "XYZ-int") in set(map(tuple, A.rule_dictionary(n, fuzzy=True).collect()))


def test_getters_need_a_kind(spark):
    with pytest.raises(ValueError):
        A.get_ltrs(spark.range(1), full_length=False)


def test_gene_and_te_names_may_not_meet(spark):
    t = spark.createDataFrame([("a",)], "name string")
    with pytest.raises(FE.FeatureError):
        FE.unite(t, t)


def test_two_keys_with_null(spark):
    d = spark.createDataFrame([("x", None)], "a string, b string")
    assert d.select(FE.aggregation_key(["a", "b"])).first()[0] == "x:NA"


def _q(spark):
    rows = [("s", r, f, 1.0) for r, fs in ((1, (1, 2)), (2, (1, 2)), (3, (2, 3)), (4, (1,))) for f in fs]
    return E.multi_flag(spark.createDataFrame(rows, "sample_id string, read_id long, feature_id long, w double"))


def test_classes_equal_rows(spark):
    q = _q(spark)
    state = E.iterate(lambda s: E.pair_step(q, s), E.pair_start(q), 2)
    want = {r.feature_id: (r.pi, r.theta) for r in state.collect()}
    c = E.classes(q)["s"]
    step = E.pair_map(c, np.zeros(3), np.zeros(3))
    v = step(step(np.full(6, 1 / 3)))
    for k, f in enumerate(c.features):
        assert want[f] == pytest.approx((v[k], v[3 + k]))


def test_squarem_reaches_the_same_point(spark):
    c = E.classes(_q(spark))["s"]
    step = E.ratio_map(c, np.array([10.0, 5.0, 20.0]))
    plain = np.full(3, 1 / 3)
    for _ in range(3000):
        plain = step(plain)
    fast, used, done = E.squarem(np.full(3, 1 / 3), step, 1e-10)
    assert done and used < 3000 and fast == pytest.approx(plain, abs=1e-5)


def test_reassign_modes_and_mass(spark):
    q = _q(spark)
    x = E.pair_expect(q, E.pair_start(q))
    n = {m: sum(r.n for r in E.reassign(x, m).collect()) for m in ("exclude", "average", "choose", "conf")}
    assert n == {"exclude": 1.0, "average": 4.0, "choose": 4.0, "conf": 1.0}


def test_fits_reach_the_fixed_point_by_classes_and_by_rows(spark, monkeypatch):
    rows = [(s, r, f, w) for s in ("s", "t") for r, fs in ((1, (1, 2)), (2, (1, 2)), (3, (2, 3)), (4, (1,)), (5, (1, 3))) for f, w in zip(fs, (0.4, 0.6) if len(fs) > 1 else (1.0,))]
    q = E.multi_flag(spark.createDataFrame(rows, "sample_id string, read_id long, feature_id long, w double")).persist()
    lengths = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 20.0)], "feature_id long, eff double")

    def plain(steps):
        w = np.array([[0.4, 0.6, 0], [0.4, 0.6, 0], [0, 0.4, 0.6], [1, 0, 0], [0.4, 0, 0.6]])
        many, eff = np.array([1, 1, 1, 0, 1.0]), np.array([10.0, 5.0, 20.0])
        pi, theta, rho = np.full(3, 1 / 3), np.full(3, 1 / 3), (w > 0).sum(axis=0) / eff
        for _ in range(steps):
            x = w * pi * np.where(many[:, None] > 0, theta, 1.0)
            x /= x.sum(axis=1, keepdims=True)
            pi, theta = (x.sum(axis=0) + 0.2) / (5 + 0.6), ((x * many[:, None]).sum(axis=0) + 0.1) / (4 + 0.3)
            y = (w > 0) * rho
            m = (y / y.sum(axis=1, keepdims=True)).sum(axis=0) / eff
            rho = m / m.sum()
        return pi, theta, rho

    pi, theta, rho = plain(5000)
    fitted, report = E.pair_fit(q, E.pair_start(q, 0.2, 0.1), 1e-9, 1000)
    assert set(report) == {"s", "t"} and all(reached for _, reached in report.values())
    for r in fitted.collect():
        assert (r.pi, r.theta) == pytest.approx((pi[r.feature_id - 1], theta[r.feature_id - 1]), abs=1e-6)
    assert sum(r.n for r in E.pair_counts(q, E.pair_start(q, 0.2, 0.1), "average").collect()) == pytest.approx(10.0)
    fitted, report = E.ratio_fit(q, lengths, 1e-8, 1000)
    assert all(reached for _, reached in report.values())
    for r in fitted.collect():
        assert r.pi == pytest.approx(rho[r.feature_id - 1], abs=1e-4)
    assert E.pair_fit(q, E.pair_start(q, 0.2, 0.1), 0.0, 1)[1]["s"][1] is False
    assert sum(r.m for r in E.ratio_counts(q, lengths).collect()) == pytest.approx(10.0)

    def few():
        pair, ratio = E.pair_fit(q, E.pair_start(q, 0.2, 0.1), 1e-9, 4), E.ratio_fit(q, lengths, 1e-8, 3)
        return [x for f, report in (pair, ratio) for x in [*sorted(report.items()), *[v for r in sorted(f.collect()) for v in r]]]

    by_classes = few()
    monkeypatch.setattr(E, "MOST_CLASSES", 0)
    for a, b in zip(few(), by_classes, strict=True):
        assert a == (pytest.approx(b, abs=1e-12) if isinstance(b, float) else b)

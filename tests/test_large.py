"""Forms of plans that large tables need, held on the smallest ones."""

import re

import pytest

from vellumine.operators import annotation as A
from vellumine.operators import em as E
from vellumine.plans import registry

DATA = "/root/testdata/sf0.001"

#: Queries over counterpart ranks.
RANKED = [
    "rmsk_counterpart_rank",
    "rmsk_assemble",
    "rmsk_element_names",
    "rmsk_ltr_int_pattern",
    "rmsk_rel_length",
    "rmsk_strict",
    "rmsk_strict_compound",
]


@pytest.mark.parametrize("name", RANKED)
def test_no_frame_is_summed_anew_at_each_row(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe" in plan
    assert not re.search(r"specifiedwindowframe\(\w+, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan)


def test_counterpart_rank_counts_ties_and_unplaced_fragments_as_sql(spark):
    names, starts = ("L", "I", "L", "I", "I", "L", "I", "X"), (1, 1, 5, 5, 9, 9, None, 3)
    frags = spark.createDataFrame([(k, n, "c", "+", s) for k, (n, s) in enumerate(zip(names, starts))], "frag_id long, rep_name string, seqname string, strand string, g_start long")
    d = spark.createDataFrame([("L", "I")], "ltr_name string, int_name string")
    got = {r.frag_id: (r.role, r.cut) for r in A.counterpart_rank(frags, d).collect()}
    assert got == {0: ("LTR", 3), 1: ("int", 0), 2: ("LTR", 2), 3: ("int", 1), 4: ("int", 2), 5: ("LTR", 1), 6: ("int", 3), 7: ("noLTR", 0)}


def _several_cells(spark):
    rows = [(s, r, f, w) for s in ("s", "t") for r in range(40) for f, w in ((f"f{r % 7}", 0.5), (f"f{r % 5 + 3}", 0.3), ("none", 0.0))]
    q = spark.createDataFrame(rows, "sample_id string, read_id long, feature_id string, w double").groupBy("sample_id", "read_id", "feature_id").sum("w").withColumnRenamed("sum(w)", "w")
    return E.multi_flag(q).persist()


def test_fit_over_blocks_of_cells_equals_the_one_over_classes(spark, monkeypatch):
    q = _several_cells(spark)
    fit = lambda: E.pair_fit(q, E.pair_start(q, 0.1, 0.2, uniform=False), 1e-9, 60)
    want, report = fit()
    want = sorted(map(tuple, want.collect()))
    for name, value in (("MOST_CELLS", 0), ("BLOCK", 5), ("SLICES", 3)):
        monkeypatch.setattr(E, name, value)
    monkeypatch.setattr(E, "classes", lambda q: pytest.fail("cells came to the driver"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # blocks end within and between batches
    try:
        got, again = fit()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again == report
    for a, b in zip(sorted(map(tuple, got.collect())), want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-12)

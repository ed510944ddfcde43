from vellumine.sources import sam
from vellumine.streaming import ingest

LINES = [
    "@HD\tVN:1.6", "@PG\tID:x\tPN:BWA\tVN:1", "@PG\tID:y\tPN:samtools",
    "r1\t0\tchr1\t100\t60\t5S10M2D5M\t*\t0\t0\tACGT\tFFFF\tNM:i:1\tAS:i:-3\tXS:i:7",
    "r1\t272\tchr2\t7\t0\t20M\t=\t50\t0\t*\t*\tAS:i:5", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tFF", "", "r3\t1089\tchr1\t9\t60\t4M\t*\t0\t0\tACGT\tFFFF\tXAS:i:9",
]


def test_sam_rows_order_and_header(spark, tmp_path):
    (tmp_path / "a.sam").write_text("\n".join(LINES) + "\n")
    (tmp_path / "b.sam").write_text("\n".join(LINES[3:5]) + "\n")
    rows = sam.read_sam(spark, str(tmp_path)).orderBy("aln_id").collect()
    assert [(r.sample_id, r.read_id) for r in rows] == [("a", "r1"), ("a", "r1"), ("a", "r2"), ("a", "r3"), ("b", "r1"), ("b", "r1")]
    assert len({r.aln_id for r in rows}) == 6
    a, b, c, d = rows[:4]
    assert (a.a_start, a.a_end, a.qwidth, a.clip, a.nm, a.as_score, a.xs, a.strand) == (100, 116, 20, 5, 1, -3, 7, "+")
    assert (b.is_secondary, b.strand, b.mate_seqname, b.mate_start, b.xs) == (1, "-", "chr2", 50, None)
    assert (c.seqname, c.a_end, c.cigar) == (None, None, None) and (d.as_score, d.mate_ix) == (None, 1)
    assert [tuple(r) for r in sam.aligner(spark, str(tmp_path)).collect()] == [("a", "bwa")]
    kept = sam.scan(sam.read_sam(spark, str(tmp_path / "a.sam")), "telescope")
    assert [r.read_id for r in kept.orderBy("aln_id").collect()] == ["r1", "r1"]


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder, table, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    for n, name in enumerate(("a", "b"), 1):
        (folder / f"{name}.sam").write_text("\n".join(LINES) + "\n")
        assert ingest.ingest(spark, str(folder), table, check).awaitTermination(60)
        assert spark.read.parquet(table).count() == 4 * n

"""Binary alignment files, written here block by block, against the same records as SAM text."""

import gzip
import struct

import pytest

from vellumine.sources import bam, sam

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n@PG\tID:a\tPN:BWA\n"
LINES = [
    ("r1", 0, "chr1", 10, 60, "5S20M100N30M", "*", 0, {"AS": 50, "NM": 1, "XS": 30}),
    ("r2", 272, "chr2", 7, 0, "3H47M", "=", 90, {"AS": -4, "NH": 3}),
    ("r3", 4, "*", 0, 0, "*", "*", 0, {}),
    ("r4", 83, "chr1", 400, 30, "10M2I10M3D10M", "chr2", 5, {"nM": 70000}),
]


def _sam(rows):
    return HEADER + "".join("\t".join(map(str, (*r[:8], 0, "*", "*", *(f"{t}:i:{v}" for t, v in r[8].items())))) + "\n" for r in rows)


def _bam(rows, block=37):
    names = {"chr1": 0, "chr2": 1, "*": -1}
    out = b"BAM\1" + struct.pack("<i", len(HEADER)) + HEADER.encode() + struct.pack("<i", 2)
    for n, size in (("chr1", 1000), ("chr2", 500)):
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    for name, flag, ref, pos, mapq, cigar, mate, mate_pos, tag in rows:
        ops, digits = [], ""
        for c in cigar if cigar != "*" else "":
            if c.isdigit():
                digits += c
            else:
                ops.append(int(digits) << 4 | bam.CIGAR.index(c))
                digits = ""
        other = names[ref] if mate == "=" else names[mate]
        raw = struct.pack("<iiBBHHHiiii", names[ref], pos - 1, len(name) + 1, mapq, 0, len(ops), flag, 5, other, mate_pos - 1, 0)
        raw += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + b"\x11" * 3 + b"\xff" * 5
        raw += b"RGZgroup\0" + b"XBBs" + struct.pack("<i2h", 2, 1, 2) + b"XFf" + struct.pack("<f", 1.5)
        for t, v in tag.items():
            raw += t.encode() + (b"c" + struct.pack("<b", v) if -128 <= v < 128 else b"i" + struct.pack("<i", v))
        out += struct.pack("<i", len(raw)) + raw
    return b"".join(gzip.compress(out[k : k + block]) for k in range(0, len(out), block))


def test_bam_equals_sam(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(_bam(LINES))
    (tmp_path / "b.bam").write_bytes(_bam(LINES[:0]))
    (tmp_path / "a.sam").write_text(_sam(LINES))
    got = bam.read_alignments(spark, [str(tmp_path / "b.bam"), str(tmp_path / "a.bam")])
    want = sam.read_sam(spark, str(tmp_path / "a.sam"))
    rows = lambda d: [tuple(r) for r in d.orderBy("aln_id").drop("aln_id").select(*[c for c in want.columns if c not in ("aln_id", "mate_start", "a_start", "a_end", "blocks")]).collect()]
    assert rows(got) == rows(want) and len(rows(got)) == 4
    placed = {r.read_id: r for r in got.collect()}
    assert [(b.start, b.end) for b in placed["r1"].blocks] == [(10, 29), (130, 159)] and placed["r1"].a_end == 159
    assert placed["r3"].a_start is None and placed["r4"].n_m == 70000
    assert bam.aligner([str(tmp_path / "a.bam")]) == "bwa"
    assert {(r.seqname, r.length) for r in bam.sequences(spark, str(tmp_path / "a.bam")).collect()} == {("chr1", 1000), ("chr2", 500)}


def test_bam_errors(spark, tmp_path):
    with pytest.raises(bam.AlignmentFileError):
        bam.read_alignments(spark, [])
    with pytest.raises(bam.AlignmentFileError):
        bam.check_paths("a.bam", single_end=True, as_mates=True)
    with pytest.raises(bam.AlignmentFileError):
        bam.read_alignments(spark, ["a.bam", "b.sam"])
    with pytest.raises(bam.AlignmentFileError):
        bam.aligner(str(tmp_path / "none.bam"))
    (tmp_path / "cut.bam").write_bytes(_bam(LINES)[:-200])
    with pytest.raises(Exception, match="ends within|end-of-stream|Error"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()

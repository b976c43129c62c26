import io
import json
import os
import subprocess
import sys

import pytest

from axisframe import cli
from axisframe.sources import alignments
from axisframe.streaming.reads import running_counts, stream_tips

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sam_text(shift=0):
    reads = [f"r{i}\t{flag}\tchr1\t{pos + i + shift}\t60\t10M\t*\t0\t0\tACGTACGTAC\tABCDEFGHIJ\tME:Z:Gypsy{i % 2}" for flag, pos in ((0, 100), (16, 130)) for i in range(6)]
    return "@SQ\tSN:chr1\tLN:1000\n" + "\n".join(reads) + "\n"


def test_fingerprint_and_filter(spark, tmp_path, capsys, monkeypatch):
    a, b, out = tmp_path / "a.sam", tmp_path / "b.sam", tmp_path / "out.gff"
    a.write_text(sam_text())
    b.write_text(sam_text(2))
    cli.main(["fingerprint", str(a), str(b), "-f", "Gypsy", "-m", "5", "-e", "10", "-n", "1", "-b", "2", "--gff", str(out), "--csv", str(tmp_path / "out.csv")])
    lines = out.read_text().splitlines()
    assert len(lines) == 2 and lines[0].split("\t")[3:5] == ["109", "116"] and "pair=Gypsy_chr1_-_130" in lines[0]
    assert (tmp_path / "out.csv").read_text().startswith('"reference","strand","category","start"')
    cli.main(["filter", str(out), "--all", "strand=-", "sample_?_count>=6"])
    assert capsys.readouterr().out.strip() == lines[1]
    cli.main(["extract", str(a), "-o", str(tmp_path / "x.fastq.gz")])
    assert (tmp_path / "x.fastq.gz").stat().st_size > 0
    # Standard input, tagged reads as BAM, folders of part files, and inputs that differ in their references.
    monkeypatch.setattr("sys.stdin", io.StringIO(out.read_text()))
    cli.main(["filter", "--any", "strand=+"])
    assert capsys.readouterr().out.strip() == lines[0]
    monkeypatch.setattr("sys.stdin", io.StringIO(out.read_text()))
    with pytest.raises(Exception, match="no number"):
        cli.main(["filter", "--strict", "--any", "strand>1"])
    cli.main(["filter", str(out), "-o", str(tmp_path / "kept"), "--parallel"])
    assert sorted(x for f in (tmp_path / "kept").glob("part-*") for x in f.read_text().splitlines()) == sorted(lines)
    c = tmp_path / "c.sam"
    c.write_text(sam_text().replace("chr1", "chr2"))
    with pytest.raises(ValueError, match="references"):
        cli.main(["fingerprint", str(a), str(c), "--gff", str(out)])


def test_tagged_reads(spark, tmp_path):
    reads = tmp_path / "pairs.sam"
    dangling = "\n".join(f"q{i}\t69\tg1\t5\t0\t*\t=\t5\t0\tACGTACGTAC\tABCDEFGHIJ" for i in range(5))
    reads.write_text("@SQ\tSN:g1\tLN:50\n" + dangling + "\n")
    again = tmp_path / "again.sam"
    again.write_text("@SQ\tSN:chr1\tLN:1000\n" + "\n".join(f"q{i}\t0\tchr1\t{9 + i}\t60\t10M\t*\t0\t0\tACGTACGTAC\tABCDEFGHIJ" for i in range(5)) + "\n")
    cli.main(["extract", str(reads), "--aligned", str(again), "-o", str(tmp_path / "tagged.bam")])
    rows = alignments.load(spark, str(tmp_path / "tagged.bam")).collect()
    assert sorted((r.qname, r.pos, r.tags[-1]) for r in rows) == [(f"q{i}", 9 + i, "ME:Z:g1") for i in range(5)]


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sam").write_text(sam_text())
    counts = running_counts(stream_tips(spark, str(folder), ["Gypsy"]))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    (folder / "b.sam").write_text(sam_text(2))
    q.processAllAvailable()
    q.stop()
    got = {(r.strand, r.source): (r.n, r.first_tip) for r in spark.table("running").collect()}
    assert got == {("+", "a.sam"): (6, 109), ("-", "a.sam"): (6, 130), ("+", "b.sam"): (6, 111), ("-", "b.sam"): (6, 132)}


def test_core_needs_no_llm():
    """The entry module and all other modules import without the optional subpackage."""
    code = "import sys; sys.modules['axisframe.llm'] = None; import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    names = json.loads(out)
    assert "p4_found" in names and "p6_ids" not in names and "fingerprint_job" in names

import gzip

import pytest
from pyspark.sql import functions as F

from axisframe.functions import predicates as P
from axisframe.functions import text as X
from axisframe.functions.filters import keep_features, parse_filter
from axisframe.operators import extract
from axisframe.operators.categorise import categorise
from axisframe.sources import alignments, bam, gff, sam, sinks

SEQ = "ACGTTGCAAC"


def record(name, flag, cigar, rname="g1", rnext="=", pos=11, pnext=50, mapq=60, seq=SEQ, tags="ME:Z:Gypsy1"):
    return "\t".join([name, str(flag), rname, str(pos), str(mapq), cigar, rnext, str(pnext), "0", seq, "ABCDEFGHIJ"[: len(seq)], tags])


HEADER = ["@HD\tVN:1.3", "@SQ\tSN:g1\tLN:100", "@SQ\tSN:g2\tLN:90"]
LINES = HEADER + [
    record("fwd_dangler", 69, "*"), record("rev_dangler", 69 + 16, "*", rnext="g2"), record("head_tail", 99, "4S6M"), record("rev_tail", 147, "7M3S"),
    record("short", 99, "2S8M"), record("tip", 73, "6M4S"), record("rev_tip", 73 + 16, "3S7M"), record("secondary", 99 + 256, "4S6M"), record("supplementary", 99 + 2048, "4S6M"),
]


@pytest.fixture
def reads(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text("\n".join(LINES) + "\n")
    return str(path)


def test_sam(spark, reads, tmp_path):
    df = sam.read_sam(spark, reads)
    assert df.count() == 9 and df.first().source == "x.sam"
    assert alignments.common_references(spark, reads) == [("g1", 100), ("g2", 90)]
    assert [r.reference for r in sam.references(sam.sam_lines(spark, reads)).collect()] == ["g1", "g2"]
    packed = tmp_path / "y.sam.gz"
    packed.write_bytes(gzip.compress("\n".join([HEADER[0], HEADER[2]] + LINES[3:]).encode()))
    assert sam.read_sam(spark, str(packed)).count() == 9
    with pytest.raises(ValueError):
        alignments.common_references(spark, reads, str(packed))
    assert sorted(r.value for r in sam.to_lines(df).collect()) == sorted(LINES[3:])
    tips = {(r.source, r.strand, r.tip, r.element) for r in sam.read_tips(df, ["Gyp", "Gypsy"], 30).collect()}
    assert tips == {("x.sam", "+", 16, "Gypsy1"), ("x.sam", "-", 11, "Gypsy1"), ("x.sam", "+", 18, "Gypsy1")}
    assert sam.aligned_reads(df, regions=["g1:17-30"]).count() == 3 and sam.aligned_reads(df, regions=["g2"]).count() == 0
    with pytest.raises(Exception, match="no tag"):
        df.select(sam.tag_value("XX", strict=True)).collect()


def test_extraction(spark, reads):
    df = sam.read_sam(spark, reads)
    rows = {r.name: (r.element, r.sequence, r.quality) for r in extract.informative_reads(df, min_clip=3).collect()}
    assert rows == {
        "fwd_dangler": ("g1", SEQ, "ABCDEFGHIJ"), "rev_dangler": ("g2", "GTTGCAACGT", "JIHGFEDCBA"),
        "head_tail": ("g1", SEQ[:5], "ABCDE"), "rev_tail": ("g1", "GTT", "JIH"),
    }
    tips = {r.name: r.sequence for r in extract.clip_tips(df, 3).collect()}
    assert tips == {"tip": "GTTG", "rev_tip": SEQ[:4]}
    assert extract.clip_tips(df, 3, strict=True).where("name = 'rev_tip'").first().sequence == SEQ[:3]
    assert extract.informative_reads(df, tips=True, min_clip=3).count() == 6
    assert extract.informative_reads(df, tails=False).count() == 2
    names = extract.name_elements(extract.clip_tips(df, 3), extract.danglers(df))
    tagged = extract.tag_reads(df.where("qname in ('tip', 'fwd_dangler')"), names)
    assert all(r.tags[-1] == "ME:Z:g1" for r in tagged.collect())
    with pytest.raises(Exception, match="no element"):
        extract.tag_reads(df, names).collect()
    assert sinks.fastq_lines(extract.clip_tips(df, 3)).where("value like '@tip%'").first().value == "@tip\nGTTG\n+\nJIHG"


def test_anchors(spark):
    rows = [record(n, 97, "10M", pos=p, pnext=q) for n, p, q in (("a", 1, 60), ("b", 5, 70), ("far", 1, 900), ("back", 50, 20))] + [record("c", 97 + 16, "10M")]
    df = sam.parse_records(spark.createDataFrame([(r, "s.bam") for r in rows], "value string, source string"))
    known = spark.createDataFrame([("g1", 100, 800)], "reference string, start long, stop long")
    got = [tuple(r) for r in extract.anchor_intervals(df, known.limit(0), insert_size=100).collect()]
    assert got == [("g1", "s.bam", 10, 70)]
    assert [tuple(r) for r in extract.anchor_intervals(df, known, insert_size=200).collect()] == [("g1", "s.bam", 10, 900)]


def test_bam(spark, reads, tmp_path):
    rows = [tuple(r) for r in sam.read_sam(spark, reads).collect()] * 800
    path = str(tmp_path / "t.bam")
    bam.write_file(path, "\n".join(HEADER) + "\n", [("g1", 100), ("g2", 90)], iter(rows))
    bam.register(spark)
    for split in (1 << 25, 3000):
        got = spark.read.format("bam").option("splitbytes", split).load(path)
        assert sorted(str(tuple(r)[:12]) for r in got.collect()) == sorted(str(r[:12]) for r in rows)
    assert gzip.decompress(sinks.bgzf(b"x" * 200_000)) == b"x" * 200_000
    # References: of one file, of SAM and BAM together, and files that differ.
    assert [tuple(r)[1:] for r in alignments.references(spark, path).orderBy("ord").collect()] == [(0, "g1", 100), (1, "g2", 90)]
    assert alignments.common_references(spark, path, reads) == [("g1", 100), ("g2", 90)]
    other = str(tmp_path / "o.bam")
    bam.write_file(other, "", [("g2", 90), ("g1", 100)], iter([]))
    with pytest.raises(ValueError):
        alignments.common_references(spark, path, other)
    assert spark.read.format("bam").load(other).count() == 0
    # A folder written in parallel reads back whole, whatever the splits.
    folder = str(tmp_path / "parts.bam")
    df = sam.read_sam(spark, reads).crossJoin(spark.range(50)).drop("id").repartition(3)
    assert bam.write_bam(df, folder, [("g1", 100), ("g2", 90)]) == 450
    assert alignments.load(spark, folder).drop("source").exceptAll(df.drop("source")).isEmpty()


def _reads_of(draw, lengths):
    for i, n in enumerate(lengths):
        seq = "".join(draw.choices("ACGTN", k=n))
        cigar = f"{n}M" if n < 30 else f"3S{n - 5}M2I"
        rname = draw.choice(["g1", "g2"])
        yield (f"read{i}", draw.choice([0, 16, 4, 99]), rname, 1 + i, i % 60, cigar, draw.choice(["=", "g2" if rname == "g1" else "g1", "*"]), 7, -i, seq, "".join(chr(33 + draw.randrange(60)) for _ in range(n)), ["ME:Z:Gypsy", f"NM:i:{i}", "XB:B:s,1,-2,3"], "x")


@pytest.mark.parametrize("lengths", [[50] * 4000, [20_000] * 40, [60_000] * 30, [100_000] * 30, [300_000] * 8, [50, 100_000, 70, 30_000, 300_000, 51] * 6, [1, 2, 3] * 900, []], ids=lambda x: f"{len(x)}x{x[0] if x else 0}")
def test_splits_lose_no_record(tmp_path, lengths):
    """Whatever the sizes of records and splits, the partitions together give each record once, in order."""
    import os
    import random

    draw = random.Random(len(lengths))
    rows = list(_reads_of(draw, lengths))
    path = str(tmp_path / "x.bam")
    bam.write_file(path, bam.sq_lines([("g1", 10**6), ("g2", 90)]), [("g1", 10**6), ("g2", 90)], iter(rows))
    size = os.path.getsize(path)
    for split in (size + 1, 333_333, 150_000, 70_000, 65_000, 9_973):
        got = [tuple(r.values()) for at in range(0, size, split) for b in bam.record_batches(path, at, min(at + split, size)) for r in b.to_pylist()]
        assert [r[:12] for r in got] == [r[:12] for r in rows]


def test_damaged_bam(tmp_path):
    import os
    import random

    path = str(tmp_path / "x.bam")
    bam.write_file(path, "", [("g1", 100), ("g2", 90)], _reads_of(random.Random(1), [30_000] * 20))
    whole = open(path, "rb").read()
    for cut in (len(whole) // 2, len(whole) - 100):
        open(path, "wb").write(whole[:cut])
        with pytest.raises(ValueError):
            list(bam.record_batches(path, 0, os.path.getsize(path)))


def test_text(spark):
    df = spark.createDataFrame([("aGtcn", "a;b=c&d,e%\tf", "3S4M2I1D5N6S")], "s string, t string, c string")
    row = df.select(X.reverse_complement("s").alias("rc"), X.encode_attribute("t").alias("e"), X.decode_attribute(X.encode_attribute("t")).alias("d"), X.cigar_span("c").alias("n"), X.clip_at("c", False).alias("a"), X.clip_at("c", True).alias("b"), X.decode_column(F.lit("%2509")).alias("twice"), X.quoted("s").alias("q"), X.basename(F.lit("/a/b.bam")).alias("base"), X.before_colon(F.lit("chr1:2-3")).alias("name")).first()
    assert tuple(row) == ("NGACT", "a%3Bb%3Dc%26d%2Ce%25%09f", "a;b=c&d,e%\tf", 10, 3, 6, "\t", '"aGtcn"', "b.bam", "chr1")


def test_predicates(spark):
    df = spark.createDataFrame([(10, 20)], "s long, e long")
    lo, hi = F.col("s"), F.col("e")
    cases = [(P.contains, 12, 18, True), (P.contains, 9, 18, False), (P.within, 9, 21, True), (P.within, 11, 30, False), (P.intersects_lower, 20, 30, True), (P.intersects_upper, 1, 10, True), (P.intersects, 12, 18, False), (P.overlaps, 12, 18, True), (P.intersects, 15, 30, True), (P.overlaps, 21, 30, False)]
    for f, a, b, want in cases:
        assert df.select(f(lo, hi, F.lit(a), F.lit(b))).first()[0] is want, f


def test_categories(spark):
    df = spark.createDataFrame([("Gypsy1", 1), ("Gyp", 2), ("other", 3), (None, 4), ("", 5)], "name string, n int")
    for cats in (["Gyp", "Gypsy", "X"], spark.createDataFrame([("Gyp",), ("Gypsy",), ("X",)], "c string"), [*(f"Z{i}" for i in range(400)), "Gyp", "Gypsy"]):
        assert {r.n: r.category for r in categorise(df, "name", cats).collect()} == {1: "Gypsy", 2: "Gyp"}
    assert categorise(df, "name", []).count() == 0


def test_filters(spark):
    assert parse_filter(" end >= 4") == ("end", ">=", "4") and parse_filter("a=b")[1] == "=="
    for bad in ("end", "a>=b=c"):
        with pytest.raises(ValueError):
            parse_filter(bad)
    lines = ["c1\tp\tx\t5\t9\t.\t+\t.\ta_0=07;a_1=3;pair=.;source=attr", "c2\tp\tx\t50\t90\t.\t-\t.\ta_0=1;a_1=9;pair=q;pair=r", "# no", ""]
    df = gff.parse_features(spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, ord int"))
    fields = {r.ord: r.fields for r in df.collect()}
    assert fields[0]["source"] == "p" and fields[1]["pair"] == "r" and len(fields) == 2
    keep = lambda a=(), o=(): [r.ord for r in keep_features(df, all_of=list(a), any_of=list(o)).orderBy("ord").collect()]
    assert keep() == [0, 1] and keep(["start>5"]) == [1] and keep(["a_0==7"]) == [0] and keep(["a_0=07"]) == [0]
    assert keep(["a_*>=3"]) == [0] and keep(o=["a_*>=8"]) == [1] and keep(["none*>1"]) == [] and keep(o=["none*!=1", "pair=."]) == [0]
    assert keep(["pair!=."]) == [1] and keep(["strand>1"]) == [] and keep(["a_[01]<9.5"]) == [0, 1]
    with pytest.raises(ValueError):
        keep(["start>x"])
    assert gff.format_features(df.where("ord = 1")).first().value == "c2\tp\tx\t50\t90\t.\t-\t.\ta_0=1;a_1=9;pair=r"


def test_compression_by_content(spark, tmp_path):
    import bz2

    from axisframe.sources.text import require_programs, sniffed_lines

    text = "\n".join(LINES).encode()
    for name, data in (("a.txt", gzip.compress(text)), ("b.txt", bz2.compress(text)), ("c.txt", text), ("d.gz", sinks.bgzf(text))):
        (tmp_path / name).write_bytes(data)
    got = sniffed_lines(spark, str(tmp_path)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == dict.fromkeys(("a.txt", "b.txt", "c.txt", "d.gz"), len(LINES))
    assert sam.parse_records(sniffed_lines(spark, str(tmp_path / "a.txt"))).count() == 9
    assert require_programs("sh")
    with pytest.raises(OSError, match="no-such-program"):
        require_programs("sh", "no-such-program")


def test_annotation_and_lines(spark):
    lines = ["chr1\tR\tGypsy-1;chr1:1-2\t3\t9\t1\t-\t.\tTarget \"M\" 1 2", "chr%09x\tR\tCopia\t1\t2\t.\t+\t.\t.", "chr1\tR\tLINE\t1\t2\t.\t+\t.\t."]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, ord long")
    got = [tuple(r) for r in gff.annotation_intervals(df, ["Gypsy", "Copia"]).orderBy("ord").collect()]
    assert got == [("chr1", "Gypsy", ".", 3, 9, "Gypsy-1;chr1:1-2", 0), ("chr\tx", "Copia", ".", 1, 2, "Copia", 1)]
    assert gff.annotation_intervals(df, ["Gypsy", "Copia"], ["chr1:5-9"]).count() == 1
    rows = spark.createDataFrame([("c", "+", 1, 2, "x;y", None)], "reference string, strand string, start long, stop long, note string, empty string")
    assert sinks.feature_lines(rows, "prog").first().value == "c\tprog\t.\t1\t2\t.\t+\t.\tnote=x%3By;empty=."
    assert sinks.tabular_lines(rows.drop("empty"), ",", True).first().value == '"c","+",1,2,"x;y"' and sinks.header_line(rows, ",")[:9] == "reference"

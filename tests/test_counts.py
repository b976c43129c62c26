import pytest

from axisframe.operators import annotate as A
from axisframe.operators import counts as C
from axisframe.operators import headers as H
from axisframe.plans.fingerprint import distinct_sources, fingerprint

KEY = ("chr1", "+", "gypsy")
#: Tips of two samples; the counts, medians, elements and pairs expected of them below are fixed too.
TIPS = [("bam1", t, e) for t, e in ((2, "gypsy1"), (4, "gypsy1"), (5, "gypsy4"), (7, "gypsy4"), (7, "gypsy1"), (7, "gypsy7"), (8, "gypsy1"), (8, "gypsy1"))] + [("bam2", t, "gypsy1") for t in (3, 4, 6, 7, 7, 7, 7)] + [("bam2", 50, "gypsy7")]


def tips(spark, rows=TIPS):
    return spark.createDataFrame([(*KEY, *r) for r in rows], "reference string, strand string, category string, source string, tip long, element string")


def bins(spark, *spans, key=KEY):
    return spark.createDataFrame([(*key, *s) for s in spans], "reference string, strand string, category string, start long, stop long")


BY = ["reference", "strand", "category"]


def test_counts(spark):
    rows = C.count_reads(tips(spark), bins(spark, (1, 15), (30, 60), (70, 80)), BY, 2).orderBy("start").collect()
    assert [(r.start, r.stop, r.median) for r in rows] == [(2, 8, 7), (50, 50, 50)]
    assert [(s["name"], s["count"], [tuple(e) for e in s["element"]]) for s in rows[0].samples] == [("bam1", 8, [("gypsy1", 5), ("gypsy4", 2)]), ("bam2", 7, [("gypsy1", 7), (".", 0)])]
    assert [(s["name"], s["count"], [tuple(e) for e in s["element"]]) for s in rows[1].samples] == [("bam1", 0, [(".", 0), (".", 0)]), ("bam2", 1, [("gypsy7", 1), (".", 0)])]
    whole = C.count_reads(tips(spark), bins(spark, (1, 15)), BY, trim=False).first()
    assert (whole.start, whole.stop) == (1, 15) and [s.asDict() for s in whole.samples] == [{"name": "bam1", "count": 8}, {"name": "bam2", "count": 7}]


def test_elements_tie_by_place(spark):
    df = tips(spark, [("s", 9, "a"), ("s", 1, "b"), ("s", 3, "b"), ("s", 2, "a"), ("s", 4, "c")])
    assert [e.name for e in C.top_elements(df, BY, 3).first().elements] == ["b", "a", "c"]


def test_flat_and_colours(spark):
    rows = C.count_reads(tips(spark), bins(spark, (1, 15), (30, 60)), BY, 1)
    wide = C.flatten_samples(C.proportions(rows), 2, 1)
    assert wide.columns == [*BY, "start", "stop", "median", "sample_0_name", "sample_0_count", "sample_0_element_0_name", "sample_0_element_0_count", "sample_1_name", "sample_1_count", "sample_1_element_0_name", "sample_1_element_0_count", "max_count_proportion", "color"]
    assert [(round(r.max_count_proportion, 3), r.color) for r in wide.orderBy("start").collect()] == [(0.533, "#C6DBEF"), (1.0, "#08306B")]
    alone = C.proportions(C.count_reads(tips(spark, TIPS[:8]), bins(spark, (1, 15)), BY)).first()
    assert (alone.max_count_proportion, alone.color) == (1.0, "#0112b6")


def test_ids(spark):
    rows = bins(spark, (1, 5), (7, 9)).unionByName(bins(spark, (3, 8), (9, 12), key=("chr1", "-", "gypsy")))
    assert [r.ID for r in A.contig_ids(rows).orderBy("ID").collect()] == ["gypsy_chr1_+_5", "gypsy_chr1_+_9", "gypsy_chr1_-_3", "gypsy_chr1_-_9"]


def clusters(spark, *rows):
    return spark.createDataFrame([("c", s, "g", a, b, m) for s, a, b, m in rows], "reference string, strand string, category string, start long, stop long, median long")


def test_known_first_and_last(spark):
    known = spark.createDataFrame([("c", "g", ".", 120, 150, "late", 2), ("c", "g", ".", 105, 300, "early", 1), ("c", "g", ".", 10, 95, "left", 3), ("c", "g", ".", 11, 96, "left2", 4), ("c", "h", ".", 105, 130, "other", 0)], "reference string, category string, source string, start long, stop long, element string, ord long")
    rows = clusters(spark, ("+", 90, 110, 100), ("-", 100, 120, 110), ("+", 500, 510, 505))
    for block in (7, 1 << 14):
        got = {(r.strand, r.start): r.known_element for r in A.match_known(rows, known, 15, block).collect()}
        assert got == {("+", 90): "early", ("-", 100): "left2", ("+", 500): "."}


def plain_pairs(rows, d, known=None, strict=False):
    order, out = sorted(rows, key=lambda r: (r[3], r[0])), {}
    name = lambda r: f"g_c_{r[0]}_{r[2] if r[0] == '+' else r[1]}"
    for a, b in zip(order, order[1:]):
        near = a[2] + d >= b[1] - d
        if known:
            near = near or (known[a] == known[b] and (not strict or known[a] != "."))
        if a[0] == "+" and b[0] == "-" and near:
            out[name(a)], out[name(b)] = name(b), name(a)
    return {name(r): out.get(name(r), ".") for r in rows}


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_pairs(spark, block):
    import random

    draw = random.Random(6)
    rows = []
    for strand in "+-":
        at = 0
        for _ in range(60):
            at += draw.randrange(5, 60)
            end = at + draw.randrange(1, 25)
            rows.append((strand, at, end, draw.randrange(at, end + 1)))
            at = end + 1
    known = {r: draw.choice([".", ".", "x", "y"]) for r in rows}
    df = A.contig_ids(clusters(spark, *rows))
    assert {r.ID: r.pair for r in A.pair(df, 5, block=block).collect()} == plain_pairs(rows, 5)
    tagged = df.join(spark.createDataFrame([(*r[:3], k) for r, k in known.items()], "strand string, start long, stop long, known_element string"), ["strand", "start", "stop"])
    for how in ("reference", "strict"):
        got = {r.ID: r.pair for r in A.pair(tagged, 5, True, how, block).collect()}
        assert got == plain_pairs(rows, 5, known, how == "strict")
    with pytest.raises(ValueError):
        A.pair(df, known_match="maybe")


def test_whole_job(spark):
    plus = [("a", 100 + i, "gypsy1") for i in range(6)] + [("b", 103 + i, "gypsy2") for i in range(6)]
    df = tips(spark, plus)
    minus = tips(spark, [("a", 120 + i, "gypsy1") for i in range(6)]).withColumn("strand", H.F.lit("-"))
    rows = fingerprint(df.unionByName(minus), 5, 10, n_elements=1, buffer=3, distance=10).orderBy("start").collect()
    assert [(r.strand, r.start, r.stop, r.median, r.pair) for r in rows] == [("+", 100, 108, 104, "gypsy_chr1_-_120"), ("-", 120, 125, 122, "gypsy_chr1_+_108")]
    assert [s["count"] for s in rows[1].samples] == [6, 0] and rows[1].color == "#08306B"
    assert [(r.source, r["index"]) for r in distinct_sources(df).collect()] == [("a", 0), ("b", 1)]
    assert fingerprint(df.limit(0), 5, 10, n_sources=2).count() == 0
    with pytest.raises(ValueError):
        fingerprint(df.drop("element"))


def test_more_samples_than_columns(spark):
    """A wide form that is too narrow is an error, never a sample less."""
    counted = C.count_reads(tips(spark), bins(spark, (1, 15)), BY)
    assert C.flatten_samples(counted, 2).count() == 1
    with pytest.raises(Exception, match="more than 1 samples"):
        C.flatten_samples(counted, 1).collect()


def test_output_order(spark):
    rows = [("b", "+", "x", 1, 2), ("a", "-", "y", 5, 9), ("a", "+", "y", 5, 9), ("a", "+", "x", 5, 9), ("a", "+", "x", 5, 7), ("a", "+", "x", 3, 99)]
    df = spark.createDataFrame(rows, "reference string, strand string, category string, start long, stop long")
    assert [tuple(r) for r in H.output_order(df.repartition(4)).collect()] == sorted(rows, key=lambda r: (r[0], r[3], r[4], r[2], r[1]))


def test_headers(spark):
    df = tips(spark)
    assert H.headers(df).count() == 2 and H.header_of(H.mutate_header(df, source=None)) == BY
    assert H.headers(H.mutate_header(df, strand=".", source=None)).collect()[0].strand == "."
    with pytest.raises(ValueError):
        H.append(df, df, strict=True)
    with pytest.raises(ValueError):
        H.append(df, df.drop("tip"))
    assert H.append(df, df).count() == 2 * df.count() and H.same_loci(df, df) and not H.same_loci(df, df.limit(3))
    assert H.loci_schema(df).names == ["tip", "element"] and H.header_schema(df).names == [*BY, "source"]
    with pytest.raises(ValueError):
        H.join_schemas(H.loci_schema(df), H.loci_schema(df))

from axisframe.operators.validation import clean_rows, rule_errors

GOOD = "chr1\tp\tgene\t5\t9\t.\t+\t.\tID=a;Note=\"x \"\"y\"\"\""


def lines():
    part = GOOD.split("\t")
    swap = lambda i, v: "\t".join([*part[:i], v, *part[i + 1 :]])
    return {
        1: (GOOD, None), 2: ("# x", "skip"), 3: ("  \t ", "skip"), 4: ("\r", "skip"), 5: (None, "skip"), 6: ("", "skip"),
        7: ("a\tb", "columns"), 8: (GOOD + "\t", "columns"), 9: (swap(0, "chr1 "), "seqid"), 10: (swap(0, ""), "seqid"), 11: (swap(0, "chr9"), "seqid"),
        12: (swap(3, "0"), "start"), 13: (swap(3, "10"), "start"), 14: (swap(3, "+5"), "start"), 15: (swap(3, ""), "start"), 16: (swap(3, "５"), "start"), 17: (swap(3, "9" * 40), "start"),
        18: (swap(3, "0009"), None), 19: (swap(8, 'ID="a'), "quoting"), 20: (swap(8, 'ID="a""'), "quoting"), 21: (GOOD + "\r", None), 22: (swap(4, "x"), None),
        23: (swap(0, "nope").replace("\t5\t", "\tzz\t"), "seqid"), 24: (swap(8, 'k="' + "v" * 200_000 + '"'), None), 25: (swap(3, "5\n"), "start"),
    }


def test_reasons(spark):
    cases = lines()
    df = spark.createDataFrame([(i, line, "x", "x") for i, (line, _) in cases.items()] * 2, "id long, line string, value string, reason string")
    refs = spark.createDataFrame([("chr1",), ("chr2",), (None,), ("chr1",)], "reference string")
    errors = rule_errors(df, "id", "line", refs)
    got = {r.id: r.reason for r in errors.collect()}
    assert got == {i: why for i, (_, why) in cases.items() if why not in (None, "skip")}
    clean = clean_rows(df, "id", "line", refs).collect()
    assert sorted(r.id for r in clean) == [i for i, (_, why) in cases.items() if why is None]
    first = next(r for r in clean if r.id == 21)
    assert (first.seqid, first.start, first.end_pos, first.attributes) == ("chr1", 5, 9, GOOD.split("\t")[8])
    empty = rule_errors(df.limit(0), "id", "line", refs)
    assert empty.count() == 0 and clean_rows(df.limit(0), "id", "line", refs).count() == 0


def test_one_id_with_two_lines(spark):
    """A faulty line does not take the good one of its id with it, and both good lines of an id load."""
    other = GOOD.replace("gene", "exon")
    df = spark.createDataFrame([(1, GOOD), (1, "a\tb"), (2, GOOD), (2, other), (None, other), (None, "x")], "id long, line string")
    refs = spark.createDataFrame([("chr1",)], "reference string")
    assert sorted((str(r.id), r.type) for r in clean_rows(df, "id", "line", refs).collect()) == [("1", "gene"), ("2", "exon"), ("2", "gene"), ("None", "exon")]
    assert sorted((str(r.id), r.reason) for r in rule_errors(df, "id", "line", refs).collect()) == [("1", "columns"), ("None", "columns")]

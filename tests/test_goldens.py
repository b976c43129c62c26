"""Results that are known for given input: the whole job on two small samples, splitting of a long vector, and filters."""

import numpy as np
import pytest

from axisframe.functions.filters import keep_features
from axisframe.operators import density as D
from axisframe.plans.fingerprint import fingerprint
from axisframe.sources import gff, sam, sinks

#: Flag, position, mapping quality, CIGAR and element family of the reads of two samples on chr1.
SAMPLE_A = """
    0 2353 60 100M Gypsy; 0 2407 60 100M Gypsy; 0 2454 60 100M Gypsy; 0 2467 60 100M Gypsy; 0 2478 60 100M Gypsy; 0 2478 60 100M Gypsy;
    0 2779 60 63M Gypsy; 0 2784 60 58M Gypsy; 0 2796 60 46M Gypsy; 0 2874 60 100M Gypsy; 0 2925 60 100M Gypsy; 0 2963 60 100M Gypsy;
    0 2997 60 43M5S Gypsy; 0 3039 60 100M Gypsy; 16 3217 60 100M Gypsy; 16 3226 60 100M Gypsy; 16 3246 60 100M Gypsy; 16 3405 60 81M Gypsy;
    16 3646 60 100M Gypsy; 16 3776 60 100M Gypsy; 16 3779 60 100M Gypsy; 16 3800 60 100M Gypsy; 0 21183 60 100M PIF-Harbinger; 0 21209 60 100M PIF-Harbinger;
    0 21336 60 100M PIF-Harbinger; 0 21349 60 100M PIF-Harbinger; 16 21834 60 100M PIF-Harbinger; 16 21945 60 100M PIF-Harbinger; 16 21968 60 100M PIF-Harbinger; 16 21982 60 100M PIF-Harbinger;
    0 23966 60 100M Gypsy; 0 24040 60 100M Copia; 0 24085 60 100M Gypsy; 0 24096 60 100M Gypsy; 0 24118 60 100M Gypsy; 0 24151 60 100M Copia;
    16 24742 60 100M CACTA; 16 24773 60 100M Copia; 16 24787 60 100M Gypsy; 16 24799 60 100M Gypsy; 16 24850 51 100M Gypsy; 16 24854 59 100M Gypsy;
    16 24857 60 100M Gypsy; 16 24860 60 100M Gypsy; 16 24872 59 100M Gypsy; 16 24877 60 100M Gypsy; 16 24894 60 100M Gypsy; 16 24895 57 100M Gypsy;
    16 24910 49 100M Gypsy; 16 24919 47 5S95M Gypsy"""
SAMPLE_B = """
    0 2353 60 100M Gypsy; 0 2407 60 100M Gypsy; 0 2454 60 100M Gypsy; 0 2467 60 100M Gypsy; 0 2478 60 100M Gypsy; 0 2478 60 100M Gypsy;
    0 2779 60 63M Gypsy; 0 2784 60 58M Gypsy; 0 2796 60 46M Gypsy; 0 2874 60 100M Gypsy; 0 2925 60 100M Gypsy; 0 2963 60 100M Gypsy;
    0 2997 60 43M5S Gypsy; 0 3039 60 100M Gypsy; 0 21183 60 100M PIF-Harbinger; 0 21209 60 100M PIF-Harbinger; 0 21336 60 100M PIF-Harbinger; 0 21349 60 100M PIF-Harbinger;
    16 21834 60 100M PIF-Harbinger; 16 21834 60 100M PIF-Harbinger; 16 21945 60 100M PIF-Harbinger; 16 21968 60 100M PIF-Harbinger; 16 21968 60 100M PIF-Harbinger; 16 21982 60 100M PIF-Harbinger;
    0 23966 60 100M Gypsy; 0 24040 60 100M Copia; 0 24085 60 100M Gypsy; 0 24085 60 100M Gypsy; 0 24085 60 100M Gypsy; 0 24096 60 100M Gypsy;
    0 24118 60 100M Gypsy; 0 24151 60 100M Copia; 16 24850 51 100M Gypsy; 16 24854 59 100M Gypsy; 16 24857 59 100M Gypsy; 16 24860 59 100M Gypsy;
    16 24872 59 100M Gypsy; 16 24877 59 100M Gypsy; 16 24894 59 100M Gypsy; 16 24895 57 100M Gypsy; 16 24910 49 100M Gypsy; 16 24919 47 5S95M Gypsy"""

#: Per run (samples, method, buffer) strand, category, start, stop, median, counts, ID and pair of each row.
RUNS = [
    ("A", "SDBICAN", 25, [
        ("+", "Gypsy", 2452, 24217, 2907, [18], "Gypsy_chr1_+_24217", "Gypsy_chr1_-_3217"),
        ("-", "Gypsy", 3217, 3800, 3525, [8], "Gypsy_chr1_-_3217", "Gypsy_chr1_+_24217"),
        ("-", "Gypsy", 24787, 24919, 24866, [12], "Gypsy_chr1_-_24787", "."),
    ]),
    ("A", "DBICAN", 25, [
        ("+", "Gypsy", 2452, 24217, 2907, [18], "Gypsy_chr1_+_24217", "Gypsy_chr1_-_3217"),
        ("-", "Gypsy", 3217, 24919, 24824, [20], "Gypsy_chr1_-_3217", "Gypsy_chr1_+_24217"),
    ]),
    ("AB", "SDBICAN", 10000, [
        ("+", "Gypsy", 2452, 24217, 2973, [18, 20], "Gypsy_chr1_+_24217", "Gypsy_chr1_-_3217"),
        ("-", "Gypsy", 3217, 3800, 3525, [8, 0], "Gypsy_chr1_-_3217", "Gypsy_chr1_+_24217"),
        ("-", "PIF", 21834, 21982, 21956, [4, 6], "PIF_chr1_-_21834", "."),
        ("-", "Gypsy", 24787, 24919, 24872, [12, 10], "Gypsy_chr1_-_24787", "."),
    ]),
    ("AB", "SDBICAN", 100000, [
        ("+", "Gypsy", 2452, 24217, 2973, [18, 20], "Gypsy_chr1_+_24217", "Gypsy_chr1_-_3217"),
        ("-", "Gypsy", 3217, 24919, 24857, [20, 10], "Gypsy_chr1_-_3217", "Gypsy_chr1_+_24217"),
        ("-", "PIF", 21834, 21982, 21956, [4, 6], "PIF_chr1_-_21834", "."),
    ]),
]
#: Proportion (three places) and colour by start, of the third run.
COLOURS = {2452: ("0.526", "#C6DBEF"), 3217: ("1.0", "#08306B"), 21834: ("0.6", "#9ECAE1"), 24787: ("0.545", "#C6DBEF")}

#: A vector of tips, and the slices it splits into with 10 points, epsilon 200 and a least epsilon of 10.
VECTOR = [
    0, 0, 60, 61, 61, 61, 76, 78, 122, 122, 141, 183, 251, 260, 260, 263, 263, 267, 267, 288, 288, 295, 300, 310, 310, 317, 317, 334, 334, 335, 338, 338, 338,
    338, 340, 342, 342, 344, 344, 358, 367, 370, 370, 377, 387, 402, 403, 410, 410, 410, 418, 418, 424, 424, 577, 857, 879, 921, 921, 1007, 1031, 1051, 1051,
    1059, 1071, 1071, 1080, 1094, 1094, 1110, 1110, 1113, 1113, 1183, 1189, 1200, 1200, 1217, 1234, 1234, 1591, 1620, 1620, 1662, 1686, 1707, 1755, 1828,
    1828, 1848, 1848, 1848, 1848, 1851, 1851, 1852, 1917,
]
SLICES = [(0, 55), (56, 80), (83, 97)]

#: Start, end, strand, whether paired, and the counts of ten features; the rows that each filter keeps.
FEATURES = """
    11908 12398 + q 13 12 01 00 12 10 01 01
    12766 13094 - q 07 07 00 00 12 10 02 00
    30929 31219 + q 10 09 01 00 05 05 00 00
    31648 32129 - q 14 14 00 00 06 06 00 00
    37856 38509 + q 79 18 09 08 76 17 10 09
    39674 39956 - q 46 13 06 05 39 10 07 05
    39778 40053 + . 52 51 01 00 49 49 00 00
    40740 41684 - . 79 17 15 14 65 14 11 11
    98385 98664 + q 10 10 00 00 06 06 00 00
    98864 99345 - q 08 08 00 00 11 11 00 00"""
COUNTS = ['sample_0_count', 'sample_0_element_0_count', 'sample_0_element_1_count', 'sample_0_element_2_count', 'sample_1_count', 'sample_1_element_0_count', 'sample_1_element_1_count', 'sample_1_element_2_count']
FILTERS = [
    ([], [], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]),
    (["end>40000"], [], [6, 7, 8, 9]),
    (["end>40000", "strand==-"], [], [7, 9]),
    ([], ["end>40000", "strand==-"], [1, 3, 5, 6, 7, 8, 9]),
    (["sample_0_element_*_count>=8"], [], [4, 7]),
    ([], ["sample_0_element_*_count>=8"], [0, 2, 3, 4, 5, 6, 7, 8, 9]),
    (["pair!=.", "strand=+"], ["sample_?_count<50"], [0, 2, 8]),
]


def lines_of(name, sample):
    for i, read in enumerate(sample.strip().split(";")):
        flag, pos, mapq, cigar, family = read.split()
        yield "\t".join([f"r{i}", flag, "chr1", pos, mapq, cigar, "*", "0", "0", "*", "*", f"ME:Z:{family}_x"]), f"test{name}.bam"


@pytest.mark.parametrize("samples,method,buffer,want", RUNS, ids=["split", "flat", "buffered", "joined"])
def test_whole_job(spark, samples, method, buffer, want):
    lines = [x for n in samples for x in lines_of(n, SAMPLE_A if n == "A" else SAMPLE_B)]
    reads = sam.parse_records(spark.createDataFrame(lines, "value string, source string"))
    tips = sam.read_tips(reads, ["Gypsy", "PIF"], 30)
    rows = fingerprint(tips, 5, 30000, 0, method, 0, buffer, None, 25).orderBy("start").collect()
    assert [(r.strand, r.category, r.start, r.stop, r.median, [s["count"] for s in r.samples], r.ID, r.pair) for r in rows] == want
    if buffer == 10000:
        assert {r.start: (str(r.max_count_proportion)[:5], r.color) for r in rows} == COLOURS


def test_split_of_a_long_vector(spark):
    t = np.array(VECTOR)
    assert D.fork_of(t, 10) == 454
    assert D.split(t, 10, 200, 10) == SLICES
    df = spark.createDataFrame([("a", v) for v in VECTOR], "key string, tip long")
    for block, ranks in ((1 << 20, 1 << 16), (64, 12)):
        assert D.fork_epsilons(df, ["key"], "tip", 10, block, ranks).first().fork_epsilon == 454
        found = D.sdbican(df, ["key"], "tip", 10, 200, 10, block=block)
        assert sorted((r.start, r.stop) for r in found.collect()) == [(VECTOR[a], VECTOR[b - 1]) for a, b in SLICES]


def test_filters(spark):
    values = []
    for i, row in enumerate(FEATURES.strip().split("\n")):
        start, end, strand, pair, *counts = row.split()
        attributes = ";".join([*(f"{n}={c}" for n, c in zip(COUNTS, counts)), f"pair={pair}"])
        values.append((f"chr1\tp\t.\t{start}\t{end}\t.\t{strand}\t.\t{attributes}", i))
    features = gff.parse_features(spark.createDataFrame(values, "value string, ord long"))
    for every, some, want in FILTERS:
        assert [r.ord for r in keep_features(features, all_of=every, any_of=some).orderBy("ord").collect()] == want


def test_lines_of_the_job(spark):
    tips = sam.read_tips(sam.parse_records(spark.createDataFrame(list(lines_of("A", SAMPLE_A)), "value string, source string")), ["Gypsy"], 30)
    from axisframe.operators.counts import flatten_samples

    rows = flatten_samples(fingerprint(tips, 5, 30000, method="DBICAN", distance=25), 1)
    assert sinks.feature_lines(rows.orderBy("start"), "prog").first().value == "chr1\tprog\t.\t2452\t24217\t.\t+\t.\tcategory=Gypsy;median=2907;sample_0_name=testA.bam;sample_0_count=18;ID=Gypsy_chr1_+_24217;pair=Gypsy_chr1_-_3217"

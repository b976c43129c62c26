import numpy as np

from axisframe.operators import intervals as I

U = [(3, 6), (6, 8), (7, 9), (10, 12), (13, 13), (15, 25), (16, 17), (19, 20)]


def frame(spark, rows, key="a"):
    return spark.createDataFrame([(key, s, e) for s, e in rows], "key string, start long, stop long")


def pairs(df):
    return sorted((r.start, r.stop) for r in df.collect())


def test_union(spark):
    for block in (4, 1 << 20):
        assert pairs(I.union(frame(spark, U), ["key"], block)) == [(3, 9), (10, 12), (13, 13), (15, 25)]
        assert pairs(I.union_buffered(frame(spark, U), ["key"], 5, block)) == [(-2, 9), (10, 12), (13, 14), (15, 30)]
        assert pairs(I.union_buffered(frame(spark, U), ["key"], 0, block)) == pairs(I.union(frame(spark, U), ["key"], block))
    assert I.union(frame(spark, U).limit(0), ["key"]).count() == 0


def test_buffers_never_overlap(spark):
    rng = np.random.default_rng(2)
    rows = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 4000, 300), rng.integers(0, 9, 300))]
    for b in (1, 7, 400):
        found = pairs(I.union_buffered(frame(spark, rows), ["key"], b, 64))
        assert all(x[1] < y[0] for x, y in zip(found, found[1:]))


def test_sweep_like_range_join(spark):
    rng = np.random.default_rng(3)
    disjoint = [(10, 40), (41, 41), (60, 400), (401, 402), (900, 900)]
    points = [(("a", "b")[i % 2], int(p), i) for i, p in enumerate(rng.integers(0, 1000, 500))] + [("a", None, -1), (None, 20, -2)]
    df = spark.createDataFrame(points, "key string, at long, n int")
    want = sorted((k, p, n, s, e) for k, p, n in points if k == "a" and p is not None for s, e in disjoint if s <= p <= e)
    for block in (8, 50, 1 << 20):
        assert sorted(map(tuple, I.sweep(df, frame(spark, disjoint), ["key"], "at", block).collect())) == want


def test_contained_length(spark):
    anchors = frame(spark, [(1, 10), (5, 50), (5, 50), (60, 61)])
    known = frame(spark, [(2, 4), (9, 12), (40, 50), (49, 51), (60, 61)])
    got = sorted((r.start, r.stop, r.contained) for r in I.contained_length(anchors, known, ["key"], 8).collect())
    assert got == [(1, 10, 3), (5, 50, 15), (5, 50, 15), (60, 61, 2)]

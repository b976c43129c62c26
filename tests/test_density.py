import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axisframe.operators import density as D

#: Two vectors of tips; the clusters expected of them and of the lists in the parameter tables below are fixed too.
V18 = [1, 2, 21, 22, 22, 22, 24, 38, 54, 54, 55, 56, 65, 65, 66, 67, 68, 90]
V12 = [0, 0, 3, 4, 4, 6, 26, 28, 28, 29, 32, 32]


def points(spark, *keys):
    return spark.createDataFrame([(k, v) for k, values in keys for v in values], "key string, tip long")


def intervals(df):
    return sorted((r.start, r.stop) for r in df.collect())


def brute_flat(values, m, eps):
    t, out = sorted(values), []
    for i in range(len(t) - m + 1):
        if t[i + m - 1] - t[i] <= eps:
            if out and i < out[-1][1]:
                out[-1][1] = i + m
            else:
                out.append([i, i + m])
    return [(a, b) for a, b in out]


def brute_split(t, m, eps, aggressive=False):
    """The recursion as it is defined, on a sorted list."""
    n = len(t)
    core = [min((t[i + m - 1] - t[i] for i in range(max(0, j - m + 1), min(j, n - m) + 1)), default=0) for j in range(n)]

    def fork(a, b):
        if b - a <= m:
            return None
        g = [min(t[i + m - 1] - t[i] for i in range(max(a, j - m + 2), min(j, b - m) + 1)) for j in range(a, b - 1)]
        g = [x for i, x in enumerate(g) if i == 0 or x != g[i - 1]]
        peaks = [g[i] for i in range(1, len(g) - 1) if g[i] > g[i - 1] and g[i] > g[i + 1]]
        return max(peaks) if peaks else None

    def visit(a, b, top):
        f = fork(a, b)
        if f is None or sum((top if aggressive else eps) - max(f, c) for c in core[a:b]) >= sum(max(0, f - c) for c in core[a:b]):
            return [(a, b)]
        return [s for x, y in brute_flat(t[a:b], m, f - 1) for s in visit(a + x, a + y, f)]

    return [s for a, b in brute_flat(t, m, eps) for s in visit(a, b, eps)]


def test_known_values(spark):
    df = points(spark, ("a", V18))
    assert intervals(D.sub_clusters(df, ["key"], "tip", 4, 5)) == [(21, 22), (22, 24), (54, 56), (65, 67), (65, 68)]
    assert intervals(D.dbican(df, ["key"], "tip", 4, 5)) == [(21, 24), (54, 56), (65, 68)]
    found = D.labels(df, D.dbican(df, ["key"], "tip", 4, 5), ["key"]).collect()
    assert {r.tip: r.label for r in found} == {1: -1, 2: -1, 21: 0, 22: 0, 24: 0, 38: -1, 54: 1, 55: 1, 56: 1, 65: 2, 66: 2, 67: 2, 68: 2, 90: -1}
    core = D.core_distances(points(spark, ("a", V12)), ["key"], "tip", 3).orderBy("tip").collect()
    assert sorted(r.core_dist for r in core) == sorted([3, 3, 1, 1, 1, 2, 2, 1, 1, 1, 3, 3])
    forks = D.fork_epsilons(points(spark, ("a", V12), ("b", [1]), ("c", [0, 4, 6, 7, 7, 7, 7, 7, 8, 10, 20])), ["key"], "tip", 3).collect()
    assert {r.key: r.fork_epsilon for r in forks} == {"a": 22, "b": None, "c": None}


@pytest.mark.parametrize("values,eps,aggressive,want", [
    ([0, 2, 3, 7, 8, 12, 13, 17], 5, False, [(0, 17)]),
    ([0, 2, 3, 7, 8, 12, 13, 16], 5, False, [(0, 3), (12, 16)]),
    ([2, 5, 6, 7, 10, 11, 13, 16, 20, 21, 22], 6, False, [(2, 13), (20, 22)]),
    ([2, 5, 6, 7, 10, 11, 13, 16, 20, 21, 22], 6, True, [(5, 7), (10, 13), (20, 22)]),
    ([1, 3, 4, 5, 7, 8, 9, 11], 4, False, [(1, 11)]),
    ([1, 3, 4, 5, 7, 8, 9, 11], 3, False, [(3, 5), (7, 9)]),
    ([1, 3, 4, 5, 7, 8, 9, 11], 2, False, [(3, 5), (7, 9)]),
])
def test_splitting(spark, values, eps, aggressive, want):
    t = np.array(values)
    assert [(t[a], t[b - 1]) for a, b in D.split(t, 3, eps, 0, aggressive)] == want
    method = "SDBICAN-aggressive" if aggressive else "SDBICAN"
    assert intervals(D.clusters(points(spark, ("a", values)), ["key"], "tip", 3, eps, method=method)) == want


def test_automatic_epsilon(spark):
    one, two = [0, 1, 2, 7, 8, 13, 14, 16, 21, 23, 28, 30], [0, 1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, 14]
    found = D.sdbican(points(spark, ("a", one), ("b", two), ("c", [1, 2])), ["key"], "tip", 3, None).collect()
    assert sorted((r.key, r.start, r.stop) for r in found) == [("a", 0, 2), ("a", 13, 16), ("b", 0, 5), ("b", 9, 14)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.integers(2, 5), st.integers(1, 25), st.booleans())
def test_split_like_recursion(values, m, eps, aggressive):
    t = sorted(values)
    assert D.flat(np.array(t, np.int64), m, eps) == brute_flat(t, m, eps)
    assert sorted(D.split(np.array(t, np.int64), m, eps, 0, aggressive)) == sorted(brute_split(t, m, eps, aggressive))


def test_spark_like_recursion(spark):
    rng = np.random.default_rng(8)
    keys = [(f"k{i}", rng.integers(0, 400, rng.integers(0, 90)).tolist()) for i in range(25)]
    df = points(spark, *keys)
    for m, eps, block in ((3, 12, 64), (4, 30, 16), (3, 40, 1 << 20)):
        for aggressive in (False, True):
            got = sorted((r.key, r.start, r.stop) for r in D.sdbican(df, ["key"], "tip", m, eps, 0, aggressive, block).collect())
            assert got == sorted((k, t[a], t[b - 1]) for k, v in keys for t in [sorted(v)] for a, b in brute_split(t, m, eps, aggressive))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(2, 5), st.integers(1, 25), st.booleans())
def test_positions_like_copies(values, m, eps, aggressive):
    """Positions with weights split as their copies do, also where one has many more than the least number."""
    t = np.sort(np.array(values + [7] * 9 + [8] * 20, np.int64))
    at, n = np.unique(t, return_counts=True)
    for least in (0, 3):
        assert D.split_positions(at, n, m, eps, least, aggressive) == [(t[a], t[b - 1]) for a, b in D.split(t, m, eps, least, aggressive)]


def test_in_blocks_of_ranks(spark):
    """Core distances and forks do not depend on how an axis is cut, nor on hot positions."""
    rng = np.random.default_rng(4)
    keys = [(f"k{i}", rng.integers(0, 300, rng.integers(0, 120)).tolist() + [5] * (40 * (i % 2))) for i in range(12)] + [(None, [1, 2, 3, 9, 9])]
    df = points(spark, *keys)
    for m in (2, 3, 6):
        want = {k: D.fork_of(np.sort(np.array(v)), m) for k, v in keys if v}
        core = {}
        for k, v in keys:
            t = sorted(v)
            if len(t) >= m:
                core[k] = sorted((t[j], min(t[i + m - 1] - t[i] for i in range(max(0, j - m + 1), min(j, len(t) - m) + 1))) for j in range(len(t)))
        for block, ranks in ((16, 7), (1 << 20, 1 << 16)):
            assert {r.key: r.fork_epsilon for r in D.fork_epsilons(df, ["key"], "tip", m, block, ranks).collect()} == want
            found = {}
            for r in D.core_distances(df, ["key"], "tip", m, block, ranks).collect():
                found.setdefault(r.key, []).append((r.tip, r.core_dist))
            assert {k: sorted(v) for k, v in found.items()} == core


def test_one_large_cluster_in_linear_time():
    """Twice the points of one cluster take about twice the time, from the batches on."""
    import time

    import pyarrow as pa

    def seconds(n):
        rng = np.random.default_rng(1)
        at = np.cumsum(rng.integers(1, 4, n))
        t = pa.table({"k": ["a"] * n, "start": np.zeros(n, np.int64), "stop": np.full(n, at[-1]), "_at": at, "_w": rng.integers(1, 5, n), "_e": np.full(n, 250)})
        begun = time.perf_counter()
        assert sum(b.num_rows for b in D._splitter(["k"], 10, 0, False)(t.to_batches(10_000)))
        return time.perf_counter() - begun

    seconds(50_000)
    assert seconds(800_000) < 8 * seconds(200_000) + 0.5


def test_bad_parameters(spark):
    df = points(spark, ("a", V18))
    with pytest.raises(ValueError):
        D.dbican(df, ["key"], "tip", 1, 5)
    with pytest.raises(ValueError):
        D.clusters(df, ["key"], method="other")
    assert D.sdbican(df.limit(0), ["key"], "tip", 3, 5).count() == 0

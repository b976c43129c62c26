import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from axisframe.llm.communities import joined, linked_edges, modularity_communities, neighbour_descent, scrambled, similarity_clusters, weighted_degrees


def plain(points, radius, members):
    """Clusters of one axis by the definition, on sorted points."""
    t, found = sorted(points), []
    for i in range(len(t) - members + 1):
        if t[i + members - 1] - t[i] <= radius:
            if found and found[-1][1] >= i:
                found[-1][1] = i + members - 1
            else:
                found.append([i, i + members - 1])
    return sorted((t[a], t[b], b - a + 1, min((sum(abs(x - y) for y in t[a : b + 1]), x) for x in t[a : b + 1])[1]) for a, b in found)


def exact_neighbours(group, at, k):
    """Sorted nodes: the next k on either side."""
    n = len(at)
    out = np.full((n, 2 * k), -1)
    for i in range(n):
        for step in range(1, k + 1):
            for j, c in ((i - step, step - 1), (i + step, k + step - 1)):
                if 0 <= j < n and group[j] == group[i]:
                    out[i, c] = j
    return out


def recall(found, exact):
    wanted = exact >= 0
    return float((found == exact)[wanted].mean()) if wanted.any() else 1.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=80, unique=True), st.integers(0, 99), st.integers(1, 5))
def test_descent_from_any_start(points, seed, k):
    """With its check descent is exact from random candidates and from none."""
    points = sorted(points)
    group, at = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    exact, n = exact_neighbours(group, at, k), len(at)
    for start in (scrambled(group, at, 50, k), np.random.default_rng(seed).integers(-1, n, (n, 2 * k)), np.full((n, 1), -1)):
        found, _ = neighbour_descent(group, at, k, start)
        assert np.array_equal(found, exact)


def test_recall_of_descent():
    """Without the check descent from the scrambled guess finds at least nine in ten neighbours, dense and sparse."""
    rng = np.random.default_rng(6)
    for span, n in ((60_000, 20_000), (60_000, 2_000), (4_000, 3_000), (10**6, 5_000)):
        at = np.unique(rng.integers(0, span, n))
        group = np.zeros(len(at), int)
        exact = exact_neighbours(group, at, 4)
        near = np.where((exact >= 0) & (np.abs(at[np.maximum(exact, 0)] - at[:, None]) <= 60), exact, -1)
        found, rounds = neighbour_descent(group, at, 4, scrambled(group, at, 61, 4), check=False)
        print(span, n, "recall", recall(found, exact), "of similar ones", recall(np.where(near >= 0, found, -1), near), "rounds", rounds)
        assert recall(np.where(near >= 0, found, -1), near) >= 0.9


def test_modularity_splits_and_joins():
    # Two triangles with one weak bridge: apart with resolution 1, one component with 0.
    a, b, w = np.array([0, 1, 0, 3, 4, 3, 2]), np.array([1, 2, 2, 4, 5, 5, 3]), np.array([3.0, 3, 3, 3, 3, 3, 0.5])
    one, none = modularity_communities(6, a, b, w, 1.0), modularity_communities(6, a, b, w, 0.0)
    assert len(set(none)) == 1
    assert len(set(one[:3])) == 1 and len(set(one[3:])) == 1 and one[0] != one[5]
    # Graphs side by side do not change each other.
    both = modularity_communities(12, np.append(a, a + 6), np.append(b, b + 6), np.append(w, w * 50), 1.0, np.repeat([0, 1], 6))
    assert len(set(both)) == 4


def test_isolated_nodes_have_no_links():
    at, count, group = np.array([1, 500, 510]), np.array([5, 2, 2]), np.zeros(3, int)
    a, b, inside = linked_edges(at, count, exact_neighbours(group, at, 4), 60, 5)
    assert len(a) == 0 and inside.tolist() == [True, False, False]


def test_degrees_like_all_pairs():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 2, 7, 30])
    first = np.cumsum(sizes) - sizes
    at = np.concatenate([np.sort(rng.choice(500, n, replace=False)) + 10**9 for n in sizes])
    count = rng.integers(1, 6, len(at))
    degree, n = weighted_degrees(at, count, first, sizes)
    for f, size, records in zip(first, sizes, n):
        x, c = at[f : f + size], count[f : f + size]
        extent = x[-1] - x[0] + 1
        want = [(c * (extent - abs(x - v))).sum() - extent for v in x]
        assert degree[f : f + size].tolist() == want and records == c.sum()


def test_modularity_matters_and_the_check_joins():
    """A long chain of groups falls into several communities; the exact check makes them one cluster."""
    at = np.arange(0, 6000, 12)
    graph = exact_neighbours(np.zeros(len(at), int), at, 4)
    a, b, inside = linked_edges(at, np.ones(len(at), int), graph, 60, 5)
    label = modularity_communities(len(at), a, b, 61.0 - (at[b] - at[a]), 1.0)
    assert inside.all() and 1 < len(set(label)) < len(at) / 5
    assert len(set(joined(label, a, b))) == 1


def test_operator_against_definition(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for key, count, span in (("a", 900, 6000), ("b", 60, 300), ("c", 4, 5), ("d", 2500, 9000)):
        for tip in rng.integers(-200, span, count):
            rows.append((n, key, int(tip), "x"))
            n += 1
    rows += [(n + i, "e", 77, "y") for i in range(7)]
    again = [(r[0], r[1], r[2], "again") for r in rows[::9]]
    dirty = [(9001, None, 5, "x"), (9002, "a", None, "x"), (9003, None, None, None)]
    df = spark.createDataFrame(rows + again + dirty, "id long, key string, at long, _n string")
    want = sorted((k, *c) for k in "abcde" for c in plain([r[2] for r in rows if r[1] == k], 20, 5))
    for block, resolution in ((64, 1.0), (256, 3.0), (1 << 16, 1.0)):
        got = similarity_clusters(df, ["key"], "at", "id", 20, 5, resolution, block)
        assert sorted(map(tuple, got.collect())) == want
    assert similarity_clusters(df.limit(0), ["key"], "at", "id", 20, 5).count() == 0

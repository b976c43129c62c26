import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from axisframe.operators.coverage import merge_states, periods_and_gaps, sorted_run


def plain(intervals):
    """Periods and gaps of one axis, position by position order."""
    out, periods = [], []
    for s, e in sorted(intervals):
        if periods and s <= periods[-1][1]:
            periods[-1][1] = max(periods[-1][1], e)
        else:
            periods.append([s, e])
    out += [("period", s, e) for s, e in periods]
    out += [("gap", a[1] + 1, b[0] - 1) for a, b in zip(periods, periods[1:]) if b[0] - a[1] > 1]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 200), st.integers(0, 40)), max_size=60))
def test_merge_is_a_monoid(rows):
    rows = [(g, s, s + n) for g, s, n in rows]
    cols = lambda r: [np.array([x[i] for x in r], np.int64) for i in range(3)]
    whole = sorted_run(*cols(rows))
    a, b, c = (sorted_run(*cols(rows[i::3])) for i in range(3))
    for parts in (merge_states(merge_states(a, b), c), merge_states(a, merge_states(b, c)), merge_states(c, merge_states(b, a))):
        assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    want = sorted((g, *p[1:]) for g in range(4) for p in plain([(s, e) for h, s, e in rows if h == g]) if p[0] == "period")
    assert sorted(zip(*(x.tolist() for x in whole))) == want


def test_blocks_are_stitched(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, n, span, longest in (("a", 400, 5000, 30), ("b", 50, 5000, 900), ("c", 3, 100, 4000)):
        for s, e in zip(rng.integers(-300, span, n), rng.integers(0, longest, n)):
            rows.append((key, "+", int(s), int(s + e), "clash"))
    dirty = [(None, "+", 1, 2, "x"), ("a", None, 1, 2, "x"), ("a", "+", None, 2, "x"), ("a", "+", 1, None, "x"), ("a", "+", 9, 3, "x")]
    df = spark.createDataFrame(rows + rows[::7] + dirty, "reference string, strand string, start long, stop long, kind string")
    want = sorted((k, *p) for k in "abc" for p in plain([r[2:4] for r in rows if r[0] == k]))
    for block, fan_in in ((16, 64), (128, 2), (1 << 20, 2)):  # 2: an upper level of the tree on four cores
        got = periods_and_gaps(df.repartition(6), ["reference", "strand"], block=block, fan_in=fan_in).collect()
        assert sorted((r.reference, r.kind, r.first_pos, r.last_pos) for r in got) == want
    assert periods_and_gaps(df.limit(0), ["reference", "strand"]).count() == 0


def test_touching_stays_apart(spark):
    df = spark.createDataFrame([("a", 7, 9), ("a", 10, 12), ("a", 14, 14), ("a", 14, 14)], "k string, start long, stop long")
    got = sorted((r.kind, r.first_pos, r.last_pos) for r in periods_and_gaps(df, ["k"]).collect())
    assert got == [("gap", 13, 13), ("period", 7, 9), ("period", 10, 12), ("period", 14, 14)]

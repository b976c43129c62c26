import numpy as np
import pyarrow as pa

from axisframe.operators.batches import group_codes, sorted_groups


def test_groups_stay_whole():
    rng = np.random.default_rng(5)
    keys = sorted((int(a), b) for a, b in zip(rng.integers(0, 9, 500), rng.choice(["x", "y", None], 500)) if b) + [(9, None)] * 40
    t = pa.table({"a": [k[0] for k in keys], "b": pa.array([k[1] for k in keys], pa.string()), "v": range(len(keys))})
    tables = list(sorted_groups(t.to_batches(37), ["a", "b"], 100))
    assert sum(x.num_rows for x in tables) == len(keys) and len(tables) > 2
    seen = [set(zip(x.column("a").to_pylist(), x.column("b").to_pylist())) for x in tables]
    assert sum(map(len, seen)) == len(set.union(*seen)) == len(set(keys))
    assert group_codes(t, ["a", "b"])[-1] == len(set(keys)) - 1
    assert list(sorted_groups([], ["a"])) == []

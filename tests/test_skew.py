import random
from statistics import median

from axisframe.operators.skew import _ranked, count_and_median, pack, plan_shards, spread


def plain(rows):
    keys = {}
    for i, k, v in set(rows):
        if v is not None:
            keys.setdefault(k, []).append(v)
    return {k: (len(v), int(median(v))) for k, v in keys.items()}


def test_pack_balances():
    loads = [((i,), n) for i, n in enumerate([50, 30, 30, 20, 10, 10, 5, 5])]
    bins = pack(loads, 4, [0.0] * 4)
    totals = [sum(n for (_, n), b in zip(loads, bins) if b == t) for t in range(4)]
    assert max(totals) <= 50


def test_shards_cover_all_values():
    shards = plan_shards({("a",): 100}, 100, {("a",): [5, 7, 7, 7, 9]}, 8, 16)
    ranges = [(s.above, s.upto) for s in shards]
    assert ranges[0][0] is None and ranges[-1][1] is None
    assert [r[1] for r in ranges[:-1]] == [r[0] for r in ranges[1:]]
    assert any(s.ways == 3 and s.above == 6 and s.upto == 7 for s in shards)


def test_against_definition(spark):
    draw = random.Random(3)
    rows, n = [], 0
    for key, count, span in (("hot", 4000, 900), ("point", 2500, 1), ("mixed", 1500, 40), ("two", 2, 9), ("one", 1, 9)):
        for _ in range(count):
            rows.append((n, key, draw.randrange(-span, span)))
            n += 1
    for k in range(60):
        rows.append((n, f"t{k}", draw.randrange(10**12)))
        n += 1
    rows += draw.sample(rows, 900) + [(n + 1, "hot", None), (n + 2, "empty", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, key string, v long, _v string")
    for tasks, target in ((4, None), (16, 100), (2, 10**9)):
        got = {r.key: (r.n, r.median) for r in count_and_median(df, ["key"], "v", "id", tasks=tasks, target_rows=target).collect()}
        assert got == plain(rows)
    assert count_and_median(df.limit(0), ["key"], "v", "id").count() == 0


def test_no_task_is_overloaded(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", i * 7919 % 5000) for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, key string, v long")
    placed, plan = spread(df, ["key"], "v", "id", tasks=8)
    sizes = [r["count"] for r in placed.groupBy("_bin").count().collect()]
    assert {s.key for s in plan if s.upto is not None} == {("hot",)} and max(sizes) <= 1.5 * 12_000 / 8


def test_little_reaches_the_driver(spark, monkeypatch):
    """200 tasks, one key with a third of all rows and a thousand others: loads and quantiles stay within their bound."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    rows = spark.range(60_000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('k', id % 1000) end as key", "id * 7919 % 50000 as v")
    seen = []
    plain_collect = Classic.collect

    def collect(self):
        out = plain_collect(self)
        seen.append(len(out) + sum(len(r["_q"]) for r in out if "_q" in r))
        return out

    monkeypatch.setattr(Classic, "collect", collect)
    spread(rows, ["key"], "v", "id", tasks=200)
    assert sum(seen) <= (8 + 2) * 200


def test_rows_travel_once(spark):
    """After the placement the counts stay in their tasks: no exchange lies between them and the join."""
    df = spark.range(5000).selectExpr("id", "id % 7 as key", "id % 100 as v")
    placed, _ = spread(df.selectExpr("key as _k0", "v as _v", "id as _id"), ["_k0"], "_v", "_id", tasks=4)
    counted = placed.groupBy("_bin", "_k0", "_shard", "_v", "_id").count().groupBy("_bin", "_k0", "_shard", "_v").agg({"*": "count"}).withColumnRenamed("count(1)", "_c").persist()
    counted.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _ranked(counted, ["_k0"], 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        counted.unpersist()
    left = plan[plan.index("Join [_bin") :].split("InMemoryTableScan")[0]
    assert "Exchange" not in left

"""Per-key results over keys of very unequal size: fragment and replicate by estimated load.

1. Loads: rows per key, pre-aggregated map-side in one scan. Only keys above ``target / SMALL`` leave the cluster;
   there are at most ``SMALL * tasks`` of them whatever the input, all others are small enough to be hashed.
2. Plan: medium keys are bin-packed to tasks, longest first; a key above ``target`` is cut into
   shards in proportion to its load. Shards are ranges of the value (from mergeable quantile
   sketches), and a value that alone exceeds a shard is cut further by the row id, so that every copy of a row
   meets in one shard and no shard depends on how rows are spread.
3. Rows go to their task by partition id and are aggregated there once. Each shard reports its size, and the wanted
   ranks (the matching side) are replicated only to the tasks of the shards that hold them, where they are joined
   in place: the rows themselves travel once.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.session import cut, shuffle_partitions

#: A key lighter than target / SMALL is hashed to a bin instead of being packed.
SMALL = 8


@dataclass(frozen=True)
class Shard:
    """Rows of one key whose value lies in (above, upto]; ``ways`` > 1 splits them by row id as well."""

    key: tuple
    shard: int
    above: int | None
    upto: int | None
    ways: int
    bins: tuple[int, ...]


def pack(loads: list[tuple[tuple, int]], tasks: int, base: list[float]) -> list[int]:
    """Bin of each load, longest processing time first, onto bins that already hold ``base``."""
    heap = [(load, b) for b, load in enumerate(base)]
    heapq.heapify(heap)
    bins = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: -loads[i][1]):
        load, b = heapq.heappop(heap)
        bins[i] = b
        heapq.heappush(heap, (load + loads[i][1], b))
    return bins


def plan_shards(loads: dict[tuple, int], total: int, quantiles: dict[tuple, list[int]], tasks: int, target: float) -> list[Shard]:
    """Shards of all keys in ``loads`` (the others are spread by hash and count as an even base load)."""
    pieces: list[tuple[tuple, int]] = []
    cuts: list[tuple] = []
    for key, load in sorted(loads.items(), key=lambda x: (-x[1], str(x[0]))):
        # A value that several quantiles fall on is heavy on its own; it becomes a shard split by row id.
        marks = quantiles.get(key, [])
        repeats = {v: marks.count(v) for v in marks}
        bounds = sorted(repeats)
        step = load / (len(marks) + 1)
        ranges: list[tuple[int | None, int | None, int, float]] = []
        above: int | None = None
        for v in bounds:
            if repeats[v] > 1:
                if above is None or above < v - 1:
                    ranges.append((above, v - 1, 1, step))
                ranges.append((v - 1, v, repeats[v], step * repeats[v]))
            else:
                ranges.append((above, v, 1, step))
            above = v
        ranges.append((above, None, 1, step))
        for n, (low, high, ways, weight) in enumerate(ranges):
            cuts.append((key, n, low, high, ways))
            pieces += [(key, weight / ways)] * ways
    rest = max(0, total - sum(loads.values()))
    bins = pack(pieces, tasks, [rest / tasks] * tasks)
    shards, at = [], 0
    for key, n, low, high, ways in cuts:
        shards.append(Shard(key, n, low, high, ways, tuple(bins[at : at + ways])))
        at += ways
    return shards


def shard_marks(rows: DataFrame, keys: list[str], value: str, large: dict[tuple, int], target: float) -> dict[tuple, list[int]]:
    """Bounds of the shards of each large key: one fewer than its shards, so at most two values a task for all keys."""
    if not large:
        return {}
    parts = {k: int(-(-v // target)) for k, v in large.items()}
    level = lambda n: (max(4 * n, min(16 * n, 512)) - 1).bit_length()
    sizes = rows.sparkSession.createDataFrame([(*k, n, level(n)) for k, n in parts.items()], T.StructType([*(rows.schema[k] for k in keys), T.StructField("_n", T.IntegerType()), T.StructField("_level", T.IntegerType())]))
    # The error of a sketch of size k is about 2.3 / k^0.9 of the rows: a fraction of a shard.
    size = min(65535, max(200, 16 * max(parts.values())))
    sketch = rows.join(F.broadcast(sizes), keys).groupBy(*keys, "_n", "_level").agg(F.kll_sketch_agg_bigint(F.col(value), size).alias("_s"))
    # A sketch is asked for constant ranks only: 2^level of them, of which each key takes its own, where the sketch is.
    fine = F.lit(None).cast("array<bigint>")
    for x in sorted({level(n) for n in parts.values()}):
        ranks = ", ".join(f"{i / 2**x!r}D" for i in range(1, 2**x))
        fine = F.when(F.col("_level") == x, F.expr(f"kll_sketch_get_quantile_bigint(_s, array({ranks}))")).otherwise(fine)
    own = F.expr("transform(sequence(1, _n - 1), i -> element_at(_fine, cast(round(pow(2, _level) * i / _n) as int)))")
    found = sketch.where("_n > 1").withColumn("_fine", fine).select(*keys, own.alias("_q"))
    return {tuple(r[k] for k in keys): list(r["_q"]) for r in found.collect()}


def spread(rows: DataFrame, keys: list[str], value: str, row_id: str, tasks: int | None = None, target_rows: int | None = None) -> tuple[DataFrame, list[Shard]]:
    """``rows`` with ``_bin`` (task) and ``_shard``, placed in their tasks, and the plan of the keys that are packed or cut.

    ``keys`` must hold no nulls. The driver sees at most SMALL * tasks loads and two quantiles a task.
    """
    spark = rows.sparkSession
    tasks = tasks or shuffle_partitions(spark)
    loads_all = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_load"))
    # One job: the total is a subquery over the same exchange. Where no key is large enough to come out it is not needed.
    total_of = loads_all.agg(F.sum("_load").alias("_total"))
    found = loads_all.withColumn("_total", total_of.scalar())
    least = F.lit(target_rows / SMALL) if target_rows else F.greatest(F.lit(1.0), F.col("_total") / tasks) / SMALL
    heavy = found.where(F.col("_load") > least).collect()
    total = heavy[0]["_total"] if heavy else 0
    target = target_rows or max(1.0, total / tasks)
    loads = {tuple(r[k] for k in keys): r["_load"] for r in heavy}
    shards = plan_shards(loads, total, shard_marks(rows, keys, value, {k: v for k, v in loads.items() if v > target}, target), tasks, target)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("_uptos", T.ArrayType(T.LongType())), T.StructField("_bins", T.ArrayType(T.ArrayType(T.IntegerType())))])
    by_key: dict[tuple, list[Shard]] = {}
    for s in shards:
        by_key.setdefault(s.key, []).append(s)
    plan = spark.createDataFrame([(*k, [s.upto for s in v if s.upto is not None], [list(s.bins) for s in v]) for k, v in by_key.items()], schema)
    placed = rows.join(F.broadcast(plan), keys, "left")
    shard = F.coalesce(F.size(F.filter("_uptos", lambda u: u < F.col(value))), F.lit(0))
    shard = F.when(F.col("_uptos").isNull(), 0).otherwise(shard)
    placed = placed.withColumn("_shard", shard.cast("int"))
    ways = F.element_at("_bins", F.col("_shard") + 1)
    by_hash = F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int")
    chosen = F.element_at(ways, (F.pmod(F.xxhash64(row_id), F.size(ways)) + 1).cast("int"))
    placed = placed.withColumn("_bin", F.when(F.col("_bins").isNull(), by_hash).otherwise(chosen)).drop("_uptos", "_bins")
    return placed.repartitionById(tasks, "_bin"), shards


def count_and_median(rows: DataFrame, keys: list[str], value: str, row_id: str, n_name: str = "n", median_name: str = "median", tasks: int | None = None, target_rows: int | None = None) -> DataFrame:
    """Number of distinct ``row_id`` and exact median of integer ``value`` per key.

    Repeated deliveries of a row id (equal key and value) count once. Keys must be non-null (fill them
    before), rows with a null value do not count, a null row id is an id of its own. The mean of the two
    middle values drops its fraction (towards zero). An empty table gives no rows.
    """
    tasks = tasks or shuffle_partitions(rows.sparkSession)
    slim = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).cast("long").alias("_v"), F.col(row_id).alias("_id")).where(F.col("_v").isNotNull())
    names = [f"_k{i}" for i in range(len(keys))]
    placed, _ = spread(slim, names, "_v", "_id", tasks, target_rows)
    once = placed.groupBy("_bin", *names, "_shard", "_v", "_id").agg(F.lit(1).alias("_one"))
    # Kept in its tasks (on disk, rebuilt from the shuffle if an executor is lost), as both the sizes and the join read it.
    counted = once.groupBy("_bin", *names, "_shard", "_v").agg(F.count(F.lit(1)).alias("_c")).persist(StorageLevel.DISK_ONLY)
    try:
        return cut(_ranked(counted, names, tasks).select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.col("_n").alias(n_name), F.col("_median").alias(median_name)))
    finally:
        counted.unpersist()


def _ranked(counted: DataFrame, names: list[str], tasks: int) -> DataFrame:
    sizes = counted.groupBy("_bin", *names, "_shard").agg(F.sum("_c").alias("_c"))
    # One row per shard and way; the ways of a shard hold one and the same value and rank together.
    axis, shard = Window.partitionBy(*names).orderBy("_shard"), Window.partitionBy(*names, "_shard")
    ranks = sizes.withColumns({
        "_upto": F.sum("_c").over(axis.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "_all": F.sum("_c").over(shard), "_ways": F.count(F.lit(1)).over(shard), "_n": F.sum("_c").over(Window.partitionBy(*names)),
    })
    ranks = ranks.withColumns({"_before": F.col("_upto") - F.col("_all"), "_lo": F.expr("(_n - 1) div 2"), "_hi": F.expr("_n div 2")})
    holds = lambda r: (F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_upto"))
    wanted = ranks.where(holds("_lo") | holds("_hi")).select("_bin", *names, "_shard", "_before", "_upto", "_ways", "_n", "_lo", "_hi")
    # At most two shards a key are wanted; they go to their bins, and the counts stay where they are.
    found = counted.join(wanted.withColumnRenamed("_upto", "_end").repartitionById(tasks, "_bin"), ["_bin", *names, "_shard"])
    inner = Window.partitionBy("_bin", *names, "_shard").orderBy("_v")
    found = found.withColumn("_to", F.when(F.col("_ways") > 1, F.col("_end")).otherwise(F.col("_before") + F.sum("_c").over(inner)))
    found = found.withColumn("_from", F.when(F.col("_ways") > 1, F.col("_before")).otherwise(F.col("_to") - F.col("_c")))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to")), F.col("_v")))
    result = found.groupBy(*names).agg(F.max("_n").alias("_n"), at("_lo").alias("_a"), at("_hi").alias("_b"))
    # Half of the sum without overflow of extreme values.
    return result.withColumn("_median", F.expr("cast((cast(_a as decimal(20,0)) + cast(_b as decimal(20,0))) / 2 as bigint)"))

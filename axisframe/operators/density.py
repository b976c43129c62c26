"""Density clusters of integer points: flat (DBICAN) and splitting (SDBICAN).

Flat clusters are the unions of all stretches of ``min_points`` successive points at most ``epsilon`` long, so
they come from one window over blocks of the axis (with a halo of ``epsilon``) and an interval union. Splitting
is decided from a cluster's own points: its core distances do not depend on points outside, so clusters are
independent, most are settled by one aggregate, and only those that may split reach Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.operators.batches import group_codes, sorted_groups
from axisframe.operators.coverage import BLOCK
from axisframe.operators.intervals import block_of, join_keys, sweep, union
from axisframe.session import cut, ship, shuffle_partitions

#: Points of a block of ranks.
RANKS = 1 << 16
METHODS = ("DBICAN", "SDBICAN", "SDBICAN-aggressive")


def _check(min_points: int, *epsilons: int | None) -> None:
    if min_points < 2:
        raise ValueError("min_points must be at least 2")
    if any(e is not None and e < 0 for e in epsilons):
        raise ValueError("epsilon must not be negative")


def _stretches(points: DataFrame, by: list[str], field: str, min_points: int, epsilon: int | Column, block: int, most: int | None = None, weight: str | None = None) -> DataFrame:
    """Every stretch of ``min_points`` points; with ``most`` only so many copies of a position are laid out.

    ``min_points`` copies leave the union of all stretches as it is. They are counted map-side (``weight`` says how many there
    are already), so a hot position, or a hot block, is no hot task.
    """
    _check(min_points, None if isinstance(epsilon, Column) else epsilon)
    reach = epsilon if isinstance(epsilon, Column) else F.lit(epsilon)
    p = points.select(*by, F.col(field).cast("long").alias("_at"), reach.cast("long").alias("_reach"), *([F.col(weight).alias("_copies")] if weight else [])).where("_at is not null and _reach is not null")
    if most:
        if not weight:
            p = p.groupBy(*by, "_at", "_reach").agg(F.count(F.lit(1)).alias("_copies"))
        p = p.select(*by, "_at", "_reach", F.explode(F.sequence(F.lit(1), F.least("_copies", F.lit(most)).cast("int"))).alias("_copy"))
    low, own = block_of(F.col("_at") - F.col("_reach"), block), block_of(F.col("_at"), block)
    near = not isinstance(epsilon, Column) and epsilon < block
    p = p.select(*by, "_at", "_reach", F.explode(F.array_distinct(F.array(own, low)) if near else F.sequence(low, own)).alias("_block"))
    w = Window.partitionBy(*by, "_block").orderBy("_at")
    p = p.withColumn("_hi", F.lead("_at", min_points - 1).over(w))
    p = p.where((F.col("_hi") - F.col("_at") <= F.col("_reach")) & (own == F.col("_block")))
    return p.select(*by, F.col("_at").alias("start"), F.col("_hi").alias("stop"), "_block")


def sub_clusters(points: DataFrame, by: list[str], field: str, min_points: int, epsilon: int, block: int = BLOCK) -> DataFrame:
    """Every stretch of ``min_points`` successive points at most ``epsilon`` long: by, ``start``, ``stop``."""
    return _stretches(points, by, field, min_points, epsilon, block).drop("_block")


def dbican(points: DataFrame, by: list[str], field: str = "tip", min_points: int = 10, epsilon: int | Column = 250, block: int = BLOCK, weight: str | None = None) -> DataFrame:
    """Flat clusters: by, ``start``, ``stop``. ``weight`` names a column with the number of points each row stands for; ``epsilon`` may be a column that is constant within a key; where it is null there are none."""
    return union(_stretches(points, by, field, min_points, epsilon, block, min_points, weight), by, block, "_block")


def with_size(points: DataFrame, clusters: DataFrame, by: list[str], field: str = "tip", block: int = BLOCK) -> DataFrame:
    """Clusters with the number of points inside, ``n``."""
    weights = points.groupBy(*by, F.col(field).alias("_at")).agg(F.count(F.lit(1)).alias("_w"))
    return sweep(weights, clusters, by, "_at", block).groupBy(*by, "start", "stop").agg(F.sum("_w").alias("n"))


def labels(points: DataFrame, clusters: DataFrame, by: list[str], field: str = "tip", block: int = BLOCK) -> DataFrame:
    """Distinct points with the start of their cluster, or null (noise), and ``label``: 0, 1, ... along each axis or -1.

    A numbering along an axis follows from the order of its clusters, not of its points.
    """
    order = Window.partitionBy(*by).orderBy("start")
    numbered = clusters.withColumn("label", F.row_number().over(order) - 1)
    distinct = points.select(*by, F.col(field).alias("_at")).where("_at is not null").distinct()
    inside = sweep(distinct, clusters, by, "_at", block)
    inside = inside.join(numbered.select(*by, "start", "label"), [*by, "start"])
    every = distinct.join(inside.select(*by, "_at", "label"), [*by, "_at"], "left")
    return every.select(*by, F.col("_at").alias(field), F.coalesce("label", F.lit(-1)).alias("label"))


def label_histogram(labelled: DataFrame, field: str = "tip") -> DataFrame:
    """Number of points per label and position."""
    return labelled.groupBy("label", field).agg(F.count(F.lit(1)).alias("n"))


def _in_ranks(points: DataFrame, by: list[str], field: str, m: int, block: int, ranks: int) -> DataFrame:
    """(by, ``_at``, ``_w``, ``_i``, ``_rb``): positions with at most ``m`` copies each, by their rank ``_i`` along the axis.

    More than ``m`` copies of a position change no stretch of ``m`` points, so a hot position is no hot task. Ranks come
    from counts per block of the axis; rows are then laid out in blocks of ranks, each with the ``m - 1`` ranks
    beyond either end, so no task holds a whole key.
    """
    ranks = max(ranks, m)
    w = points.where(F.col(field).isNotNull()).groupBy(*by, F.col(field).cast("long").alias("_at")).agg(F.count(F.lit(1)).alias("_w"))
    copies = w.withColumn("_b", block_of(F.col("_at"), block)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("_w", F.lit(m)).cast("int"))))
    per = copies.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    per = per.withColumn("_before", F.sum("_c").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_c")).drop("_c")
    inner = Window.partitionBy(*by, "_b").orderBy("_at")
    rows = join_keys(copies, per, [*by, "_b"])
    rows = rows.withColumn("_i", F.col("_before") + F.row_number().over(inner) - 1)
    at = lambda d: F.floor((F.col("_i") + F.lit(d)) / F.lit(ranks)).cast("long")
    return rows.select(*by, "_at", "_w", "_i", F.explode(F.array_distinct(F.array(at(1 - m), at(0), at(m - 1)))).alias("_rb")).withColumn("_own", at(0) == F.col("_rb"))


def core_distances(points: DataFrame, by: list[str], field: str = "tip", min_points: int = 10, block: int = BLOCK, ranks: int = RANKS) -> DataFrame:
    """Each point with ``core_dist``: the least length of a stretch of ``min_points`` that holds it; keys with fewer points are left out.

    All copies of a position have one core distance, so it is found per position and given to each copy.
    """
    _check(min_points)
    w = Window.partitionBy(*by, "_rb").orderBy("_i")
    p = _in_ranks(points, by, field, min_points, block, ranks)
    p = p.withColumn("_r", F.lead("_at", min_points - 1).over(w) - F.col("_at"))
    p = p.withColumn("core_dist", F.min("_r").over(w.rowsBetween(-(min_points - 1), 0))).where("_own and core_dist is not null")
    each = p.groupBy(*by, "_at").agg(F.min("core_dist").alias("core_dist"), F.first("_w").alias("_w"))
    return each.select(*by, F.col("_at").alias(field), "core_dist", F.explode(F.sequence(F.lit(1), F.col("_w").cast("int"))).alias("_copy")).drop("_copy")


def fork_epsilons(points: DataFrame, by: list[str], field: str = "tip", min_points: int = 10, block: int = BLOCK, ranks: int = RANKS) -> DataFrame:
    """The largest epsilon below which the points of each key fork into several clusters: by, ``fork_epsilon`` (null: they never do)."""
    _check(min_points)
    m = min_points
    w = Window.partitionBy(*by, "_rb").orderBy("_i")
    p = _in_ranks(points, by, field, m, block, ranks)
    p = p.withColumns({"_r": F.lead("_at", m - 1).over(w) - F.col("_at"), "_more": F.lead("_at").over(w).isNotNull()})
    # Per gap to the next point: the least stretch that spans it. Of equal gaps in a row one stays.
    p = p.withColumn("_g", F.when(F.col("_more"), F.min("_r").over(w.rowsBetween(-(m - 2), 0))))
    g = p.withColumn("_pg", F.when(F.col("_i") > 0, F.lag("_g").over(w))).where("_own and _g is not null and (_pg is null or _g <> _pg)")
    # Neighbours among those that stay: within a block of ranks, or from one row for each block.
    g = g.withColumns({"_before": F.lag("_g").over(w), "_after": F.lead("_g").over(w)})
    ends = g.groupBy(*by, "_rb").agg(F.min_by("_g", "_i").alias("_first"), F.max_by("_g", "_i").alias("_last"))
    axis = Window.partitionBy(*by).orderBy("_rb")
    ends = ends.select(*by, "_rb", F.lag("_last").over(axis).alias("_pl"), F.lead("_first").over(axis).alias("_nf"))
    g = join_keys(g, ends, [*by, "_rb"])
    g = g.withColumns({"_before": F.coalesce("_before", "_pl"), "_after": F.coalesce("_after", "_nf")})
    peaks = g.where("_g > _before and _g > _after").select(*by, F.col("_g").alias("_f"))
    keys = points.where(F.col(field).isNotNull()).select(*by, F.lit(None).cast("long").alias("_f"))
    return keys.unionByName(peaks).groupBy(*by).agg(F.max("_f").alias("fork_epsilon"))


def _least(r: np.ndarray, width: int, n: int) -> np.ndarray:
    """Minimum over the last ``width`` stretches that begin at or before each of ``n`` places."""
    padded = np.full(n + width - 1, np.iinfo(np.int64).max)
    padded[width - 1 : width - 1 + len(r)] = r
    return np.lib.stride_tricks.sliding_window_view(padded, width).min(axis=1)


def fork_of(t: np.ndarray, m: int) -> int | None:
    """Fork epsilon of sorted points, None where they do not fork."""
    if len(t) <= m:
        return None
    gap = _least(t[m - 1 :] - t[: len(t) - m + 1], m - 1, len(t) - 1)
    gap = gap[np.append(True, gap[1:] != gap[:-1])]
    inner = gap[1:-1]
    peaks = inner[(inner > gap[:-2]) & (inner > gap[2:])]
    return int(peaks.max()) if len(peaks) else None


def flat(t: np.ndarray, m: int, epsilon: int) -> list[tuple[int, int]]:
    """Half-open slices of the flat clusters of sorted points."""
    if len(t) < m:
        return []
    at = np.flatnonzero(t[m - 1 :] - t[: len(t) - m + 1] <= epsilon)
    if not len(at):
        return []
    head = np.append(True, np.diff(at) >= m)
    first = np.flatnonzero(head)
    return list(zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + m).tolist()))


def split(t: np.ndarray, m: int, epsilon: int, min_epsilon: int = 0, aggressive: bool = False, weight: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Slices of the clusters of sorted points after splitting: a cluster stays whole while it is supported at least as well as its children.

    ``weight`` is how many points each stands for in the supports.
    """
    if len(t) < m:
        return []
    weight = np.ones(len(t), np.int64) if weight is None else weight
    core = np.maximum(_least(t[m - 1 :] - t[: len(t) - m + 1], m, len(t)), min_epsilon or 0)
    open_ = [(a, b, epsilon) for a, b in reversed(flat(t, m, epsilon))]
    done = []
    while open_:
        a, b, top = open_.pop()
        fork = fork_of(t[a:b], m)
        if fork is not None:
            c, w = core[a:b], weight[a:b]
            own = (w * ((top if aggressive else epsilon) - np.maximum(fork, c))).sum()
            if own < (w * np.maximum(0, fork - c)).sum():
                open_ += [(a + x, a + y, fork) for x, y in reversed(flat(t[a:b], m, fork - 1))]
                continue
        done.append((a, b))
    return done


def split_positions(at: np.ndarray, n: np.ndarray, m: int, epsilon: int, min_epsilon: int = 0, aggressive: bool = False) -> list[tuple[int, int]]:
    """(start, stop) of the clusters of distinct sorted positions ``at``, ``n`` points each.

    At most ``m`` copies of a position are laid out, which leaves every stretch of ``m`` points as it is; the
    last of them stands for the rest, as all copies of a position have one core distance.
    """
    copies = np.minimum(n, m)
    t = np.repeat(at, copies)
    weight = np.ones(len(t), np.int64)
    weight[np.cumsum(copies) - 1] += n - copies
    return [(int(t[a]), int(t[b - 1])) for a, b in split(t, m, epsilon, min_epsilon, aggressive, weight)]


def sdbican(points: DataFrame, by: list[str], field: str = "tip", min_points: int = 10, epsilon: int | None = 250, min_epsilon: int = 0, aggressive: bool = False, block: int = BLOCK) -> DataFrame:
    """Splitting clusters: by, ``start``, ``stop``.

    ``epsilon=None`` takes, per key, one below the fork of all its points; keys that never fork have no
    clusters then. With the default method and ``min_epsilon`` <= ``epsilon`` only a cluster with more than
    ``min_points`` points and a fork above epsilon / 2 can split; all others are settled without Python. One that may
    split is one task's work, linear in its distinct positions, as the definition weighs all of its points together.
    """
    _check(min_points, epsilon, min_epsilon)
    ship(points.sparkSession)
    p = points.select(*by, F.col(field).cast("long").alias("_at")).where("_at is not null")
    reach: Column = F.lit(epsilon)
    if epsilon is None:
        # A row for each key that forks; Spark broadcasts it if it is small, and else splits large keys of the join.
        forks = cut(fork_epsilons(p, by, "_at", min_points, block).where("fork_epsilon is not null"))
        p = join_keys(p, forks.withColumn("_reach", F.col("fork_epsilon") - 1).drop("fork_epsilon"), by)
        reach = F.col("_reach")
    weights = cut(p.groupBy(*by, "_at").agg(F.count(F.lit(1)).alias("_w"), F.max(reach).cast("long").alias("_e")))
    clusters = cut(dbican(weights, by, "_at", min_points, F.col("_e") if epsilon is None else epsilon, block, "_w"))
    inside = sweep(weights, clusters, by, "_at", block)
    cluster = [*by, "start", "stop"]
    # A cluster without a gap wider than its densest stretch cannot fork; cheap tests first, then Python.
    w = Window.partitionBy(*cluster).orderBy("_at")
    sized = inside.withColumn("_n", F.sum("_w").over(Window.partitionBy(*cluster)))
    may = F.col("_n") > min_points
    if epsilon is not None and not aggressive and min_epsilon <= epsilon:
        # A fork is at least as wide as some gap between stretches; below epsilon / 2 nothing splits.
        far_of = F.max("_at").over(w.rangeBetween(0, epsilon // 2))
        whole = F.sum("_w").over(w.rangeBetween(0, epsilon // 2)) >= min_points
        sized = sized.withColumns({"_far": F.when(whole, far_of)})
        far = F.max("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))
        sized = sized.withColumn("_open", F.when(F.lead("_at").over(w) > F.coalesce(far, F.col("_at")), 1).otherwise(0))
        sized = sized.withColumn("_gaps", F.sum("_open").over(Window.partitionBy(*cluster)))
        may = may & (F.col("_gaps") > 0)
    # Every point of a cluster lies in a stretch of at most epsilon, so one at or below epsilon / 2 throughout never forks above it.
    settled = sized.where(~may).select(*cluster).distinct()

    nodes = sized.where(may).select(*cluster, "_at", "_w", "_e")
    placed = nodes.repartition(shuffle_partitions(points.sparkSession), *cluster).sortWithinPartitions(*cluster, "_at")
    schema = T.StructType([*(p.schema[k] for k in by), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    return settled.unionByName(placed.mapInArrow(_splitter(by, min_points, min_epsilon, aggressive), schema))


def _splitter(by: list[str], m: int, min_epsilon: int, aggressive: bool):
    """Clusters of sorted (by, start, stop, _at, _w, _e) rows, split; one pass over all clusters of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, [*by, "start", "stop"]):
            code = group_codes(t, [*by, "start", "stop"])
            first = np.append(np.flatnonzero(np.append(True, np.diff(code) > 0)), len(code))
            at, weight, reach = (np.asarray(t.column(c).combine_chunks()) for c in ("_at", "_w", "_e"))
            rows, starts, stops = [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                for x, y in split_positions(at[a:b], weight[a:b], m, int(reach[a]), min_epsilon, aggressive):
                    rows.append(a)
                    starts.append(x)
                    stops.append(y)
            columns = [t.column(k).combine_chunks().take(pa.array(rows, pa.int64())) for k in by]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], [*by, "start", "stop"])

    return run


def clusters(points: DataFrame, by: list[str], field: str = "tip", min_points: int = 10, epsilon: int = 250, min_epsilon: int = 0, method: str = "SDBICAN") -> DataFrame:
    """Intervals of the clusters found by one of METHODS."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "DBICAN":
        return dbican(points, by, field, min_points, epsilon)
    return sdbican(points, by, field, min_points, epsilon, min_epsilon, method == "SDBICAN-aggressive")

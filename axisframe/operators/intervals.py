"""Unions, buffers and sweeps of closed intervals, planned so that no axis is one task.

All of them work on blocks of the axis: rows of (keys, block) are sorted together, and what crosses a
block is carried over by a window on one row per block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.operators.coverage import BLOCK, periods


def block_of(at, block: int):
    return F.floor(at / F.lit(block)).cast("long")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` with the other columns of ``right`` where all keys are equal; null keys are equal to each other."""
    names = {k: f"_j{i}" for i, k in enumerate(keys)}
    right = right.select(*(F.col(k).alias(names[k]) if k in names else F.col(k) for k in right.columns))
    return left.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])).drop(*names.values())


def union(df: DataFrame, by: list[str], block: int = BLOCK, placed: str | None = None) -> DataFrame:
    """Intervals merged where they share positions: by, ``start``, ``stop``.

    ``9`` and ``10`` only touch and stay apart. Null ends and start > stop do not count, null keys are a key.
    Only the largest stop of each start matters, so copies are gone before anything is sorted. ``placed`` names a
    column that holds the block of each start already, by which ``df`` is distributed: nothing is shuffled again then.
    """
    return neighbours(df, by, block, placed).select(*by, "start", "stop")


def neighbours(df: DataFrame, by: list[str], block: int = BLOCK, placed: str | None = None) -> DataFrame:
    """The union with ``_prev`` (stop of the interval before) and ``_next`` (start of the one after), null at the ends."""
    marked = {k: f"_u{i}" for i, k in enumerate(by)}
    rows = df.select(*(F.col(k).alias(v) for k, v in marked.items()), F.col("start").cast("long").alias("s"), F.col("stop").cast("long").alias("e"), F.col(placed).alias("_block") if placed else block_of(F.col("start"), block).alias("_block")).where("s <= e")
    keys = [*marked.values(), "_block"]
    rows = rows.groupBy(*keys, "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy(*keys).orderBy("s")
    rows = rows.withColumn("_pm", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_k", F.sum(F.when(F.col("_pm").isNull() | (F.col("s") > F.col("_pm")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "_k").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    lists = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("x"))
    blocks = lists.select(*keys, F.col("x.s").alias("starts"), F.col("x.e").alias("stops"))
    found = periods(blocks, list(marked.values()))
    return found.select(*(F.col(v).alias(k) for k, v in marked.items()), F.col("s").alias("start"), F.col("e").alias("stop"), F.col("p").alias("_prev"), F.col("n").alias("_next"))


def union_buffered(df: DataFrame, by: list[str], buffer: int = 0, block: int = BLOCK) -> DataFrame:
    """Union, then each interval is widened by ``buffer``, sharing the gap to a neighbour where it is too small.

    The odd position of a shared gap goes to the left interval.
    """
    if buffer <= 0:
        return union(df, by, block)
    rows = neighbours(df, by, block)
    share = lambda gap: F.least(gap / F.lit(2.0), F.lit(float(buffer)))
    before = F.coalesce(F.floor(share(F.col("start") - F.col("_prev") - 1)), F.lit(buffer)).cast("long")
    after = F.coalesce(F.ceil(share(F.col("_next") - F.col("stop") - 1)), F.lit(buffer)).cast("long")
    return rows.select(*by, (F.col("start") - before).alias("start"), (F.col("stop") + after).alias("stop"))


def sweep(points: DataFrame, disjoint: DataFrame, by: list[str], at: str, block: int = BLOCK) -> DataFrame:
    """``points`` inside one of the disjoint intervals, with ``start`` and ``stop`` of it.

    Instead of comparing every point of a key with every interval, starts and points of a block are sorted
    together and the last start at or before a point is carried forward; the interval that reaches into a block
    comes from one row per block. Points must not have columns named start or stop.
    """
    payload = [c for c in points.columns if c not in by]
    p = points.where(F.col(at).isNotNull()).select(*by, F.col(at).cast("long").alias("_pos"), F.struct(*payload).alias("_row"), F.lit(None).cast("struct<start:bigint,stop:bigint>").alias("_new"))
    p = p.withColumn("_block", block_of(F.col("_pos"), block))
    # An interval shows up in every block it reaches, at its start or at the block's.
    i = disjoint.select(*by, F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).alias("_new"))
    i = i.withColumn("_block", F.explode(F.sequence(block_of(F.col("_new.start"), block), block_of(F.col("_new.stop"), block))))
    i = i.select(*by, F.greatest(F.col("_new.start"), F.col("_block") * block).alias("_pos"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), "_new", "_block")
    inside = Window.partitionBy(*by, "_block").orderBy("_pos", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(i).withColumn("_in", F.last("_new", ignorenulls=True).over(inside))
    hit = both.where(F.col("_row").isNotNull() & (F.col("_pos") <= F.col("_in.stop")))
    return hit.select(*by, "_row.*", F.col("_in.start").alias("start"), F.col("_in.stop").alias("stop"))


def contained_length(anchors: DataFrame, known: DataFrame, by: list[str], block: int = 1 << 14) -> DataFrame:
    """``anchors`` with ``contained``: summed lengths of the known intervals that lie wholly inside.

    Prefix sums over starts do not see stops, so this is a join, on keys and the blocks an anchor spans; a
    known interval belongs to the block of its start alone and is counted once.
    """
    own = [*by, "start", "stop"]
    names = [f"_a{i}" for i in range(len(by))]
    spans = anchors.select(*(F.col(k).alias(n) for k, n in zip(by, names)), F.col("start").alias("_s"), F.col("stop").alias("_e")).distinct()
    spans = spans.withColumn("_block", F.explode(F.sequence(block_of(F.col("_s"), block), block_of(F.greatest("_s", "_e"), block))))
    inner = known.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(by)), F.col("start").alias("_ks"), F.col("stop").alias("_ke")).withColumn("_kb", block_of(F.col("_ks"), block))
    on = (F.col("_block") == F.col("_kb")) & (F.col("_s") <= F.col("_ks")) & (F.col("_ke") <= F.col("_e"))
    for i in range(len(by)):
        on = on & (F.col(f"_a{i}") == F.col(f"_b{i}"))
    sums = spans.join(inner, on).groupBy(*names, "_s", "_e").agg(F.sum(F.col("_ke") - F.col("_ks") + 1).alias("contained"))
    sums = sums.select(*(F.col(n).alias(k) for k, n in zip(by, names)), F.col("_s").alias("start"), F.col("_e").alias("stop"), "contained")
    rows = anchors.join(sums, own, "left")
    return rows.select(*anchors.columns, F.coalesce("contained", F.lit(0)).cast("long").alias("contained"))

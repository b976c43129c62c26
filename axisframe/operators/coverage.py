"""Continuous periods and gaps of overlapping intervals.

The aggregate is a monoid: its state is a sorted list of disjoint closed intervals, merging two
states is a linear merge of two sorted lists. Map tasks build partial states per (keys, block of the
axis), a reduction tree merges the partial states, and blocks are then stitched to their neighbours: what crosses a
border is told by windows over a few numbers for each block, never by the lists themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.session import cut, ship, shuffle_partitions

#: Positions per block: no state holds more disjoint intervals than this.
BLOCK = 1 << 20
#: Partial states merged into one at each level of the reduction tree.
FAN_IN = 64
#: Intervals a task buffers before it merges or passes on.
BUFFER_ROWS = 1 << 20


Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def disjoint(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Run:
    """Union of closed intervals that are sorted by (group, start), linked only by shared positions; linear.

    The stops of a group are made to rise above those of all groups before it, so that one running maximum serves all.
    """
    if not len(group):
        return group, start, stop
    head = np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(group)) - 1
    # Each group takes the place after the one before it on a common line; beyond its last start no stop links anything.
    low, high = start[first], start[last]
    shift = np.cumsum(np.append(0, (high - low + 1)[:-1])) - low
    size = last - first + 1
    reach = np.maximum.accumulate(np.minimum(stop, np.repeat(high, size)) + np.repeat(shift, size))
    head[1:] |= (start + np.repeat(shift, size))[1:] > reach[:-1]
    first = np.flatnonzero(head)
    return group[first], start[first], np.maximum.reduceat(stop, first)


def sorted_run(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Run:
    """The state of rows in any order."""
    order = np.lexsort((start, group))
    return disjoint(group[order], start[order], stop[order])


def merge_states(x: Run, y: Run) -> Run:
    """The state of two states: both lists are sorted, so each row's place is its own number and that of its place in the other list.

    Groups are compared first; a row of ``y`` goes before an equal one of ``x``.
    """
    if not len(x[0]) or not len(y[0]):
        return x if len(x[0]) else y
    # (group, start) as one number: groups follow each other on a common line.
    codes = np.union1d(x[0], y[0])
    low, high = np.full(len(codes), np.iinfo(np.int64).max), np.full(len(codes), np.iinfo(np.int64).min)
    places = []
    for group, start, _ in (x, y):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        last = np.append(first[1:], len(group)) - 1
        own = np.searchsorted(codes, group[first])
        low[own], high[own] = np.minimum(low[own], start[first]), np.maximum(high[own], start[last])
        places.append(np.repeat(own, last - first + 1))
    shift = np.cumsum(np.append(0, (high - low + 1)[:-1])) - low
    a, b = (r[1] + shift[own] for r, own in zip((x, y), places))
    place = np.empty(len(a) + len(b), np.int64)
    at_b = np.arange(len(b)) + np.searchsorted(a, b)
    taken = np.zeros(len(place), bool)
    taken[at_b] = True
    place[~taken] = np.arange(len(a))
    place[taken] = np.arange(len(b))
    pick = lambda i: np.where(taken, y[i][np.minimum(place, len(b) - 1)], x[i][np.minimum(place, len(a) - 1)])
    return disjoint(pick(0), pick(1), pick(2))


class _States:
    """States of many groups, kept flat; ``names`` are the groups' key tuples."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.clear()

    def clear(self) -> None:
        self.codes: dict[tuple, int] = {}
        self.parts: list[Run] = []
        self.rows = 0

    def add(self, run: Run) -> None:
        self.parts.append(run)
        self.rows += len(run[0])

    def code(self, batch: pa.RecordBatch) -> np.ndarray:
        """A group code for each row of ``batch``, rising with the first appearance of its group."""
        columns = [batch.column(k).dictionary_encode() for k in self.keys]
        mixed = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            index = np.asarray(c.indices.fill_null(len(c.dictionary))).astype(np.int64)
            mixed = np.unique(mixed * (len(c.dictionary) + 1) + index, return_inverse=True)[1]
        _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
        # Numbered as they appear, so that sorted rows have rising codes.
        seen = np.argsort(first)
        values = [batch.column(k).take(pa.array(first[seen])).to_pylist() for k in self.keys]
        own = np.empty(len(first), np.int64)
        own[seen] = [self.codes.setdefault(v, len(self.codes)) for v in zip(*values)]
        return own[back]

    def merge(self) -> None:
        """All states to one, in pairs of like age, so every row takes part in few merges."""
        while len(self.parts) > 1:
            pairs = [merge_states(*self.parts[i : i + 2]) for i in range(0, len(self.parts) - 1, 2)]
            self.parts = pairs + self.parts[2 * len(pairs) :]
        self.rows = len(self.parts[0][0]) if self.parts else 0

    def batches(self, schema: pa.Schema, only: set[int] | None = None) -> Iterator[pa.RecordBatch]:
        self.merge()
        if not self.parts or not self.rows:
            return
        group, start, stop = self.parts[0]
        if only is not None:
            keep = np.isin(group, list(only))
            group, start, stop = group[keep], start[keep], stop[keep]
            if not len(group):
                return
        present, first = np.unique(group, return_index=True)
        offsets = pa.array(np.append(first, len(group)).astype(np.int32))
        names = list(self.codes)
        chosen = [names[g] for g in present]
        columns = [pa.array([v[i] for v in chosen], schema.field(k).type) for i, k in enumerate(self.keys)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)).cast(schema.field(n).type) for n, x in (("starts", start), ("stops", stop))]
        yield pa.RecordBatch.from_arrays([*columns, *lists], schema=schema)


def _arrow_schema(df: DataFrame, keys: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    longs = pa.list_(pa.field("element", pa.int64()))
    return pa.schema([pa.field(k, to_arrow_type(df.schema[k].dataType)) for k in keys] + [pa.field("starts", longs), pa.field("stops", longs)])


def _partial(keys: list[str], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = _States(keys)
        for batch in batches:
            states.add(sorted_run(states.code(batch), np.asarray(batch.column("start")), np.asarray(batch.column("stop"))))
            if states.rows > BUFFER_ROWS:
                states.merge()
                if states.rows > BUFFER_ROWS // 2:
                    yield from states.batches(schema)
                    states.clear()
        yield from states.batches(schema)

    return run


def _turns(codes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of rows (sorted by code) by how many of their group came before, and where each such turn begins and ends."""
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    turn = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    order = np.argsort(turn, kind="stable")
    return order, np.append(np.append(0, np.flatnonzero(np.diff(turn[order])) + 1), len(codes)).tolist()


def _combine(keys: list[str], schema: pa.Schema):
    """Input sorted by keys: all groups but the last of a batch are complete."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = _States(keys)
        for batch in batches:
            codes = states.code(batch)
            newest = int(codes[-1])
            starts, stops = batch.column("starts"), batch.column("stops")
            lengths = np.diff(np.asarray(starts.offsets))
            # Rows are states already. The first of each group, one after the other, are one sorted list, then the second of each.
            order, edges = _turns(codes)
            lengths, codes = lengths[order], codes[order]
            ends = np.append(0, np.cumsum(lengths))
            start, stop = (np.asarray(c.take(pa.array(order)).flatten()) for c in (starts, stops))
            for low, high in zip(edges, edges[1:]):
                a, b = ends[low], ends[high]
                states.add((np.repeat(codes[low:high], lengths[low:high]), start[a:b], stop[a:b]))
            if states.rows > BUFFER_ROWS and len(states.codes) > 1:
                last = newest
                yield from states.batches(schema, {c for c in states.codes.values() if c != last})
                group, start, stop = states.parts[0]
                keep = group == last
                name = list(states.codes)[last]
                states.clear()
                states.codes[name] = 0
                states.add((np.zeros(int(keep.sum()), np.int64), start[keep], stop[keep]))
        yield from states.batches(schema)

    return run


def disjoint_blocks(df: DataFrame, keys: list[str], start: str | Column, stop: str | Column, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per (keys, ``_block``) with ``starts``/``stops``: the disjoint intervals that start in the block."""
    start, stop = (F.col(c) if isinstance(c, str) else c for c in (start, stop))
    rows = df.select(*keys, start.cast("long").alias("start"), stop.cast("long").alias("stop")).where("start <= stop")
    rows = rows.withColumn("_block", F.floor(F.col("start") / F.lit(block)).cast("long"))
    ship(df.sparkSession)
    groups = [*keys, "_block"]
    arrow = _arrow_schema(rows, groups)
    fields = [rows.schema[k] for k in groups]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "stops")]
    states = rows.select(*groups, "start", "stop").mapInArrow(_partial(groups, arrow), T.StructType(fields + lists))
    lanes = df.sparkSession.sparkContext.defaultParallelism // fan_in
    while lanes > 1:  # upper levels of the tree, where more than fan_in tasks hold states of a block
        by = [*groups, "_lane"]
        laned = states.withColumn("_lane", F.spark_partition_id() % F.lit(lanes))
        arrow_lane = _arrow_schema(laned, by)
        states = laned.select(*by, "starts", "stops").repartition(*by).sortWithinPartitions(*by).mapInArrow(_combine(by, arrow_lane), T.StructType([*fields, T.StructField("_lane", T.IntegerType()), *lists])).drop("_lane")
        lanes //= fan_in
    return states.repartition(shuffle_partitions(df.sparkSession), *groups).sortWithinPartitions(*groups).mapInArrow(_combine(groups, arrow), T.StructType(fields + lists))


def periods(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Periods from the rows of :func:`disjoint_blocks`: keys, ``s``, ``e``, and the neighbours' ``p`` (stop before) and ``n`` (start after).

    The lists are written once and stay apart by block; windows along an axis see a few numbers for each block.
    """
    from axisframe.operators.intervals import join_keys

    lists, at = cut(blocks), [*keys, "_block"]
    axis = Window.partitionBy(*keys).orderBy("_block")
    before, after = axis.rowsBetween(Window.unboundedPreceding, -1), axis.rowsBetween(1, Window.unboundedFollowing)
    carried = lists.select(*at, F.element_at("stops", -1).alias("_e")).select(*at, F.max("_e").over(before).alias("_carry"))
    # How many intervals of a block begin within what reaches into it, and how far the last of those goes on.
    rows = join_keys(lists, carried, at)
    inside = F.when(F.col("_carry") >= F.expr("starts[0]"), F.size(F.filter("starts", lambda x: x <= F.col("_carry")))).otherwise(0)
    rows = rows.withColumn("_k", inside)
    rows = rows.select(*at, "_k", F.when(F.col("_k") > 0, F.expr("stops[_k - 1]")).alias("_ext"), (F.col("_k") < F.size("starts")).alias("_has"), F.expr("get(starts, _k)").alias("_s"), F.element_at("stops", -1).alias("_e"))
    rows = rows.withColumns({
        "_chain": F.coalesce(F.count(F.when(F.col("_has"), 1)).over(before), F.lit(0)),
        "_next": F.min(F.when(F.col("_has"), F.col("_s"))).over(after),
    })
    rows = rows.withColumn("_reach", F.max("_ext").over(Window.partitionBy(*keys, "_chain")))
    rows = rows.withColumn("_reach", F.lead("_reach").over(axis)).where("_has")
    rows = rows.withColumn("_last", F.greatest("_e", "_reach")).withColumn("_prev", F.lag("_last").over(axis))
    rows = join_keys(lists, rows.select(*at, "_k", "_last", "_prev", "_next"), at)
    rows = rows.withColumns({"_starts": F.expr("slice(starts, _k + 1, size(starts))"), "_stops": F.expr("slice(stops, _k + 1, size(stops))")})
    rows = rows.withColumns({
        "_prevs": F.expr("concat(array(_prev), slice(_stops, 1, size(_stops) - 1))"),
        "_nexts": F.expr("concat(slice(_starts, 2, size(_starts)), array(_next))"),
        "_stops": F.expr("concat(slice(_stops, 1, size(_stops) - 1), array(_last))"),
    })
    zipped = F.arrays_zip(F.col("_starts").alias("s"), F.col("_stops").alias("e"), F.col("_prevs").alias("p"), F.col("_nexts").alias("n"))
    return rows.select(*keys, F.explode(zipped).alias("x")).select(*keys, "x.*")


def stitch(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Periods and gaps from the rows of :func:`disjoint_blocks`: keys, ``kind``, ``first_pos``, ``last_pos``."""
    each = periods(blocks, keys)
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("first_pos"), F.col("e").alias("last_pos")),
        F.struct(F.lit("gap").alias("kind"), (F.col("e") + 1).alias("first_pos"), (F.col("n") - 1).alias("last_pos")),
    )
    return each.select(*keys, F.explode(kinds).alias("y")).select(*keys, "y.*").where("first_pos <= last_pos")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """Largest sets of intervals linked by shared positions (``kind`` = period) and the free positions between them (gap).

    Rows with a null key, start or stop, or with start > stop, do not count. Intervals that only touch
    (7-9, 10-12) stay apart. Repeated rows change nothing; an empty table gives no rows; columns other
    than the keys and the two ends are ignored, whatever their names.
    """
    rows = df.select(*keys, F.col(start).alias("_from"), F.col(stop).alias("_to")).dropna("any")
    return stitch(disjoint_blocks(rows, keys, "_from", "_to", block, fan_in), keys)

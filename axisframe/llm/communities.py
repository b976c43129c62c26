"""Clusters of mutually similar records on an axis: neighbour graph, modularity communities, typical members.

Records of one key are points on a line; two are similar when at most ``radius`` apart. Equal records are one
node with a weight. Nodes are cut into blocks of the axis, each with the ``radius`` beyond its end, so every
task holds at most ``BLOCK`` + ``radius`` nodes of a key, however many records there are.

1. Neighbour graph by neighbour descent: nodes start from a poor guess, others of the same coarse cells of the axis in
   scrambled order, and improve their nearest ``members - 1`` on either side (two-sided, so a dense side cannot
   crowd out the only link across a gap) by their neighbours' neighbours, until nothing changes. A check then
   adds the next node wherever it is not among a node's neighbours, and descent goes on; on a line that makes it exact.
2. Which nodes begin a group of ``members`` mutually similar records, which edges lie in such a group and which nodes
   are in any is read off the graph: ``members - 1`` neighbours on a side are all it takes.
3. Communities by modularity, w / W - resolution * d1 * d2 / (2 W^2): every community joins the neighbour that gains most
   if that one chooses it too, the graph is contracted, until no move gains.
4. An exact check joins communities that share a group, as a cluster is all that hangs together by shared records;
   modularity alone would cut long ones.
5. Clusters are described by size, extent and the member of highest internal weighted degree, the similarity of
   two members being the extent less their distance, summed over all members by prefix sums.

Clusters that reach a block's edge are joined across blocks by the interval union of the core, and only they
are described from their nodes once more, so results do not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.operators.batches import group_codes, sorted_groups
from axisframe.operators.coverage import periods_and_gaps
from axisframe.session import cut, ship, shuffle_partitions

#: Positions per block.
BLOCK = 1 << 16
#: Nodes whose candidates are compared at once: few enough that their arrays stay in a core's cache.
ROWS = 1 << 11
#: Nodes a task gathers before it works on them.
BATCH_NODES = 1 << 16


_FAR = np.iinfo(np.int64).max


def scrambled(group: np.ndarray, at: np.ndarray, cell: int, k: int) -> np.ndarray:
    """A poor first guess of shape (nodes, 4 k): nodes beside each other in two orders by coarse cell and, within, by a hash."""
    n = len(at)
    mixed = (at.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    out = []
    for shift in (0, cell // 2):
        order = np.lexsort((mixed, (at + shift) // cell, group))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        for step in [*range(-k, 0), *range(1, k + 1)]:
            other = place + step
            out.append(np.where((other >= 0) & (other < n), order[np.clip(other, 0, max(n - 1, 0))] if n else other, -1))
    return np.stack(out, axis=1) if n else np.zeros((0, 4 * k), np.int64)


def _nearest(group: np.ndarray, at: np.ndarray, rows: np.ndarray, candidates: np.ndarray, k: int) -> np.ndarray:
    """The k nearest candidates of ``rows`` on either side; ``candidates`` is (candidates, rows), -1 for none."""
    out = np.full((2 * k, len(rows)), -1, np.int64)
    some = np.maximum(candidates, 0)
    distance = at[some] - at[rows]
    fits = (candidates >= 0) & (group[some] == group[rows])
    for side, away in ((0, -distance), (k, distance)):
        # Distance and number in one value; the least is taken k times, all copies of it at once.
        packed = np.where(fits & (away > 0), away << 32 | some, _FAR)
        for i in range(k):
            least = packed.min(axis=0)
            found = least < _FAR
            if not found.any():
                break
            out[side + i] = np.where(found, least & 0xFFFFFFFF, -1)
            if i + 1 < k:
                np.copyto(packed, _FAR, where=packed == least)
    return out


def neighbour_descent(group: np.ndarray, at: np.ndarray, k: int, start: np.ndarray, check: bool = True) -> tuple[np.ndarray, int]:
    """Indices of the k nearest nodes of the same group to the left and to the right (-1: none), and the rounds it took.

    Nodes are sorted by (group, at) and distinct. ``start`` holds candidates for each node, however poor. Only nodes that
    saw a change among their neighbours are looked at again. ``check`` adds the next node on either side where it is
    missing and goes on; the result is then exact.
    """
    n = len(at)
    graph = np.full((2 * k, n), -1, np.int64)
    extra = start.T
    active, rounds, checked = np.arange(n), 0, False
    while len(active):
        rounds += 1
        better = graph.copy()
        for low in range(0, len(active), ROWS):
            rows = active[low : low + ROWS]
            own = graph[:, rows]
            theirs = np.where(own >= 0, graph[:, np.maximum(own, 0)], -1).reshape(-1, len(rows))
            parts = [own, theirs] if extra is None else [own, theirs, extra[:, rows]]
            better[:, rows] = _nearest(group, at, rows, np.concatenate(parts), k)
        changed = (better != graph).any(axis=0)
        graph, extra = better, None
        touched = changed | (changed[np.maximum(graph, 0)] & (graph >= 0)).any(axis=0)
        active = np.flatnonzero(touched)
        if not len(active) and check and not checked and n > 1:
            beside = np.flatnonzero(group[1:] == group[:-1])
            missed = np.zeros((2, n), bool)
            missed[1, beside] = graph[k, beside] != beside + 1
            missed[0, beside + 1] = graph[0, beside + 1] != beside
            extra = np.where(missed, np.arange(n) + np.array([[-1], [1]]), -1)
            active, checked = np.flatnonzero(missed.any(axis=0)), True
    return graph.T, rounds


def modularity_communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, graph: np.ndarray | None = None) -> np.ndarray:
    """Community of each node of a weighted graph; deterministic, ties go to the lower number.

    ``graph`` numbers separate graphs that are worked on together, each with a total weight of its own.
    """
    label = np.arange(n)
    of = np.zeros(n, np.int64) if graph is None else graph
    total = np.bincount(of[a], w)[of[a]] if len(a) else w
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    while len(a):
        gain = w / total - resolution * degree[a] * degree[b] / (2 * total * total)
        good = gain > 0
        if not good.any():
            break
        src, dst, g = np.concatenate([a[good], b[good]]), np.concatenate([b[good], a[good]]), np.concatenate([gain[good]] * 2)
        best = np.full(n, -np.inf)
        np.maximum.at(best, src, g)
        top = g == best[src]
        to = np.full(n, n)
        np.minimum.at(to, src[top], dst[top])
        to = np.where(to < n, to, np.arange(n))
        # With a positive resolution only mutual choices merge, so that no chain outgrows its gain; each round merges
        # at least the pair of greatest gain. Without one every choice may be followed.
        if resolution > 0:
            to = np.where(to[to] == np.arange(n), to, np.arange(n))
        root = np.minimum(np.arange(n), np.where(to[to] == np.arange(n), to, np.arange(n)))
        root = np.where((to != np.arange(n)) & (to[to] != np.arange(n)), to, root)
        while not np.array_equal(root, root[root]):
            root = root[root]
        names, small = np.unique(root, return_inverse=True)
        label = small[label]
        a, b, n = small[a], small[b], len(names)
        degree = np.bincount(small, degree, n)
        apart = a != b
        pair = np.minimum(a, b)[apart] * n + np.maximum(a, b)[apart]
        both, back = np.unique(pair, return_inverse=True)
        w, of_pair = np.bincount(back, w[apart], len(both)), np.zeros(len(both))
        of_pair[back] = total[apart]
        total = of_pair
        a, b = both // n, both % n
    return label


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Communities with those that an edge links made one."""
    names, small = np.unique(label, return_inverse=True)
    x, y = small[a], small[b]
    apart = x != y
    return modularity_communities(len(names), x[apart], y[apart], np.ones(int(apart.sum())), 0.0)[small]


def linked_edges(at: np.ndarray, count: np.ndarray, graph: np.ndarray, radius: int, members: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the neighbour graph whose ends lie in a common group of mutually similar records, and the nodes in any.

    ``graph`` holds ``members - 1`` neighbours on either side, or more. A group begins at a node if it and its right
    neighbours within the radius are ``members`` records; it reaches as far as the radius. If any group holds two nodes,
    one does that begins at the first of them or at one of its left neighbours.
    """
    k = graph.shape[1] // 2
    left, right = graph[:, :k], graph[:, k:]
    near = (right >= 0) & (at[np.maximum(right, 0)] - at[:, None] <= radius)
    begins = count + np.where(near, count[np.maximum(right, 0)], 0).sum(axis=1) >= members
    none = np.iinfo(np.int64).min
    until = np.where(begins, at + radius, none)
    before = np.where((left >= 0) & begins[np.maximum(left, 0)], at[np.maximum(left, 0)] + radius, none)
    until = np.maximum(until, before.max(axis=1, initial=none))
    keep = (right >= 0) & (at[np.maximum(right, 0)] <= until[:, None])
    a, column = np.nonzero(keep)
    return a, right[a, column], until >= at


def _cluster(keys: list[str], schema: pa.Schema, radius: int, members: int, resolution: float, block: int):
    """Nodes (keys, _block, _at, _n) to clusters: complete ones described, others as their own nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [*keys, "_block"]
        for t in sorted_groups(batches, groups, BATCH_NODES):
            code = group_codes(t, groups)
            at, count = np.asarray(t.column("_at").combine_chunks()), np.asarray(t.column("_n").combine_chunks())
            number = np.asarray(t.column("_block").combine_chunks())
            k = max(1, members - 1)
            graph, _ = neighbour_descent(code, at, k, scrambled(code, at, radius + 1, k))
            a, b, inside = linked_edges(at, count, graph, radius, members)
            similarity = radius + 1.0 - (at[b] - at[a])
            label = joined(modularity_communities(len(at), a, b, similarity * count[a] * count[b], resolution, code), a, b)
            chosen = np.flatnonzero(inside)
            if not len(chosen):
                continue
            order = chosen[np.lexsort((at[chosen], label[chosen]))]
            own = label[order]
            head = np.append(True, own[1:] != own[:-1])
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, len(order)))
            last = first + size - 1
            low, high, where = at[order[first]], at[order[last]], number[order[first]]
            whole = (low >= where * block + radius) & (high < (where + 1) * block)
            of = np.repeat(np.arange(len(first)), size)
            degree, n = weighted_degrees(at[order], count[order], first, size)
            best = np.flatnonzero(degree == np.maximum.reduceat(degree, first)[of])
            typical = order[best[np.unique(of[best], return_index=True)[1]]]
            # Nodes beyond the block's end too: they may be members only because of nodes of this block.
            edge = np.flatnonzero(~whole[of])
            spans = of[edge]
            done = np.flatnonzero(whole)
            rows = np.concatenate([order[first[done]], order[edge]])
            columns = [t.column(k).combine_chunks().take(pa.array(rows)) for k in keys]
            columns += [pa.array(np.concatenate(x)) for x in (
                (low[done], low[spans]), (high[done], high[spans]), (n[done], count[order[edge]]), (at[typical[done]], at[order[edge]]), (np.ones(len(done), bool), np.zeros(len(edge), bool)),
            )]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def weighted_degrees(at: np.ndarray, count: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Internal weighted degree of each node of clusters laid end to end (sorted by ``at``), and the records of each cluster.

    The similarity of two records is the extent of their cluster and one, less their distance; the degree of a record is the
    sum over all others of its cluster, found by prefix sums, as pairs are never laid out.
    """
    of = np.repeat(np.arange(len(first)), size)
    x = at - at[first][of]
    upto, sums = np.cumsum(count), np.cumsum(count * x)
    base, base_sum = (upto[first] - count[first])[of], (sums[first] - count[first] * x[first])[of]
    last = (first + size - 1)[of]
    p, s, n, total = upto - base, sums - base_sum, upto[last] - base, sums[last] - base_sum
    distance = x * (2 * p - n) + total - 2 * s
    extent = x[last] + 1
    return (n - 1) * extent - distance, n[first]


def _described(nodes: DataFrame, by: list[str], block: int) -> DataFrame:
    """Size and member of highest internal weighted degree of each cluster (``first`` .. ``last``), without a whole cluster in one task.

    The same prefix sums in two levels: of blocks along a cluster, and of nodes within a block.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    nodes = nodes.withColumn("_x", exact("_at") - exact("first")).withColumn("_b", F.floor(F.col("_at") / F.lit(block)))
    nodes = nodes.withColumn("_nx", (F.col("_x") * F.col("_n")).cast("decimal(38,0)"))
    parts = nodes.groupBy(*by, "_b").agg(F.sum("_n").alias("_c"), F.sum("_nx").cast("decimal(38,0)").alias("_s"))
    axis, all_ = Window.partitionBy(*by).orderBy("_b"), Window.partitionBy(*by)
    parts = parts.select(*by, "_b", (F.sum("_c").over(axis) - F.col("_c")).alias("_pc"), (F.sum("_s").over(axis) - F.col("_s")).cast("decimal(38,0)").alias("_ps"), F.sum("_c").over(all_).alias("_all"), F.sum("_s").over(all_).cast("decimal(38,0)").alias("_total"))
    inner = Window.partitionBy(*by, "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = nodes.join(parts, [*by, "_b"])
    p, s = F.col("_pc") + F.sum("_n").over(inner), F.col("_ps") + F.sum("_nx").over(inner)
    held = held.withColumn("_distance", (F.col("_x") * (2 * p - F.col("_all")) + F.col("_total") - 2 * s).cast("decimal(38,0)"))
    # The degree is a constant of the cluster less the total distance.
    return held.groupBy(*by).agg(F.max("_all").alias("n"), F.min_by("_at", F.struct("_distance", "_at")).alias("typical"))


def similarity_clusters(records: DataFrame, keys: list[str], value: str, row_id: str, radius: int, members: int, resolution: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(keys, ``first``, ``last``, ``n``, ``typical``): clusters of similar records.

    Rows with a null key or value do not count; a row id delivered again counts once, a null id is an id of
    its own. A cluster is a largest set made of groups of ``members`` records, any two of
    which differ by at most ``radius``, that hang together by shared records. ``typical`` is the member with the
    least total distance to the others, the smallest if several. An empty table has no clusters.
    ``resolution`` is that of the modularity communities, which the exact check joins where they share a group;
    neither it nor ``block`` changes the result.
    """
    ship(records.sparkSession)
    names = [f"_k{i}" for i in range(len(keys))]
    slim = records.select(*(F.col(k).alias(c) for k, c in zip(keys, names)), F.col(value).cast("long").alias("_at"), F.col(row_id).alias("_id")).dropna("any", subset=[*names, "_at"])
    # Copies of a delivery first (spread by id, so no hot value gathers in a task), then weights, summed map-side.
    nodes = slim.groupBy(*names, "_at", "_id").agg(F.lit(1).alias("_one")).groupBy(*names, "_at").agg(F.count(F.lit(1)).alias("_n"))
    home = F.floor(F.col("_at") / F.lit(block)).cast("long")
    halo = F.floor((F.col("_at") - F.lit(radius)) / F.lit(block)).cast("long")
    placed = nodes.select(*names, "_at", "_n", F.explode(F.array_distinct(F.array(home, halo))).alias("_block"))
    placed = placed.select(*names, "_block", "_at", "_n").repartition(shuffle_partitions(records.sparkSession), *names, "_block").sortWithinPartitions(*names, "_block", "_at")
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [T.StructField(c, slim.schema[c].dataType) for c in names]
    numbers = [T.StructField(c, T.LongType()) for c in ("_first", "_last", "_n", "_at")]
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in [*kinds, *numbers]] + [pa.field("_whole", pa.bool_())])
    found = cut(placed.mapInArrow(_cluster(names, arrow, radius, members, resolution, block), T.StructType([*kinds, *numbers, T.StructField("_whole", T.BooleanType())])))
    whole = found.where("_whole").select(*names, F.col("_first").alias("first"), F.col("_last").alias("last"), F.col("_n").alias("n"), F.col("_at").alias("typical"))
    # Communities at block edges: join what shares records, then describe from their nodes.
    edge = found.where("not _whole")
    joined = periods_and_gaps(edge.select(*names, "_first", "_last").distinct(), names, "_first", "_last", block).where("kind = 'period'")
    own = edge.groupBy(*names, "_at").agg(F.max("_n").alias("_n"))
    marked = own.select(*names, "_at", "_n", F.lit(None).cast("long").alias("_to")).unionByName(joined.select(*names, F.col("first_pos").alias("_at"), F.lit(None).cast("long").alias("_n"), F.col("last_pos").alias("_to")))
    # The cluster of a node is the last that began at or before it; in the node's block or carried from an earlier one.
    marked = marked.withColumn("_b", F.floor(F.col("_at") / F.lit(block)))
    inner = Window.partitionBy(*names, "_b").orderBy("_at", F.col("_n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.struct(F.col("_at").alias("first"), F.col("_to").alias("last"))
    marked = marked.withColumn("_in", F.last(F.when(F.col("_n").isNull(), begun), ignorenulls=True).over(inner))
    heads = marked.where("_n is null").groupBy(*names, "_b").agg(F.max(begun).alias("_lastin"))
    blocks = marked.select(*names, "_b").distinct().join(heads, [*names, "_b"], "left")
    carry = F.last("_lastin", ignorenulls=True).over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*names, "_b", carry.alias("_carry"))
    members_of = marked.where("_n is not null").join(blocks, [*names, "_b"]).withColumn("_c", F.coalesce("_in", "_carry"))
    held = members_of.select(*names, F.col("_c.first").alias("first"), F.col("_c.last").alias("last"), "_at", "_n")
    described = _described(held, [*names, "first", "last"], block)
    every = whole.unionByName(described.select(*names, "first", "last", "n", "typical"))
    return every.select(*(F.col(c).alias(k) for c, k in zip(names, keys)), "first", "last", "n", "typical")

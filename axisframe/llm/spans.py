"""Long exact spans shared between records, through a compacted de Bruijn graph of sampled k-mers.

Tokens are words. A k-mer is the text of ``KMER`` characters that begins at a token; of each stretch of
``WINDOW`` characters the k-mer of least hash is kept (minimizers), so that every stretch of ``SPAN`` characters
holds at least one kept k-mer, and the same one wherever the stretch stands: which tokens begin and which k-mers
are kept depends on no character outside it. ``LOOKBACK + WINDOW + KMER <= SPAN`` guarantees that, also for
text without blanks, where every position more than LOOKBACK characters into a run begins a token.

1. Kept k-mers of all records; those found in two records are the edges of the graph.
2. Edges that follow each other, with one successor and one predecessor in all records, are a nonbranching path;
   paths are compacted by joins that jump to the head known so far, until no edge moves.
3. A record runs along a path from its first to its last k-mer there: source coordinates of a candidate span.
4. Windows of SPAN characters at and around the ends of the candidates are looked at: those at k-mers settle the inside
   of a span; around every k-mer that ends a span of any record all windows are looked at, in all records
   that hold it; where the inside is not settled that way, all windows around its k-mers are looked at too. A window
   whose hash stands in two records gives a pair of source coordinates: its own and those of one other record.
5. Coordinates verify the spans: windows that run on side by side in two records are one stretch of either text, both
   texts are cut out and compared letter for letter. If a single stretch differs (two windows had one hash), windows
   are looked at once more with their text in place of the hash. So no result rests on hashes.

Hashes are polynomials with a base made from a seed, and only choose what is compared. Keys that many records share are
split by record before rows meet them; no step sends all pairs of a group anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.session import cut, discard, ship, shuffle_partitions

SPAN = 120
KMER, WINDOW, LOOKBACK = 28, 76, 16
#: Every so many windows one is looked at first.
GRID = 8
#: Bits per document in the filter that spares texts a shuffle, and its largest size (32 MB, broadcast); beyond that it is left out.
BITS_EACH, MOST_BITS = 8, 1 << 28
#: Rows of a key that are never split.
WHOLE = 10_000
#: Characters a task works on at once, and most characters of a stretch that are compared as one.
CHUNK, PIECE = 1 << 20, 1 << 16

_MASK = (1 << 64) - 1


def _base(seed: int) -> int:
    """An odd multiplier made from the seed."""
    x = (seed + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return (x ^ (x >> 31)) | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse, grown as needed."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def get(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls.known or len(cls.known[base][0]) < n:
            more = 1 << max(12, (n - 1).bit_length())
            grow = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(more - 1, b, np.uint64)]))
            cls.known[base] = grow(base), grow(pow(base, -1, 1 << 64))
        return cls.known[base]


class Texts:
    """Code points of several texts end to end, with hashes of any stretch.

    ``bits`` of each hash are kept; fewer make unequal stretches collide, which costs comparisons but changes no result.
    """

    def __init__(self, texts: list[str], seed: int = 0, bits: int = 64):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths)])
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.points)
        up, self.down = _Powers.get(_base(seed), n + 1)
        self.sums, self.bits = np.zeros(n + 1, np.uint64), np.uint64(_MASK >> (64 - bits))
        np.cumsum(_mix(self.points + np.uint32(1)) * up[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return (_mix((self.sums[at + length] - self.sums[at]) * self.down[at]) & self.bits).view(np.int64)

    def cut(self, at: np.ndarray, length: np.ndarray) -> list[str]:
        """The texts of stretches."""
        raw = self.points.tobytes()
        return [raw[4 * a : 4 * (a + n)].decode("utf-32-le", "surrogatepass") for a, n in zip(at.tolist(), length.tolist())]

    def tokens(self) -> np.ndarray:
        """Positions where a token begins."""
        p, n = self.points, len(self.points)
        if not n:
            return np.zeros(0, np.int64)
        blank = (p == 32) | ((p >= 9) & (p <= 13)) | (p == 0xA0)
        word = np.zeros(n, bool)
        word[1:] = blank[:-1] & ~blank[1:]
        word[self.starts[:-1][self.lengths > 0]] = False
        # Far from the last word start (or from the text's beginning) every position begins a token.
        mark = np.zeros(n, bool)
        mark[self.starts[:-1][self.lengths > 0]] = True
        at = np.arange(n, dtype=np.int32)
        since = at - np.maximum.accumulate(np.where(word | mark, at, 0))
        return np.flatnonzero(word | (since > LOOKBACK))

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the kept k-mers."""
        at = self.tokens()
        owner = np.searchsorted(self.starts, at, "right") - 1
        end = self.starts[owner + 1]
        fits = at + KMER <= end
        at, owner, end = at[fits], owner[fits], end[fits]
        h = self.hashes(at, KMER)
        n = len(at)
        # A k-mer is kept iff no smaller one lies within some window around it: the room between the nearest
        # smaller one to the left (ties count) and to the right must hold a window.
        low = np.maximum(self.starts[owner] - 1, at - WINDOW)
        high = np.minimum(end - KMER + 1, at + WINDOW)
        for side in (-1, 1):
            open_ = np.arange(n)
            step = 1
            while len(open_):
                j = open_ + side * step
                ok = (j >= 0) & (j < n)
                open_, j = open_[ok], j[ok]
                near = (at[j] > low[open_]) if side < 0 else (at[j] < high[open_])
                open_, j = open_[near], j[near]
                less = (h[j] <= h[open_]) if side < 0 else (h[j] < h[open_])
                hit = open_[less]
                if side < 0:
                    low[hit] = at[j[less]]
                else:
                    high[hit] = at[j[less]]
                open_ = open_[~less]
                step += 1
        keep = high - low - 1 >= WINDOW
        return at[keep], h[keep]


@dataclass(frozen=True)
class Hashing:
    """How windows are told apart: by hashes of a seed, or by their text."""

    seed: int = 0
    bits: int = 64
    by_text: bool = False

    def texts(self, texts: list[str]) -> Texts:
        return Texts(texts, self.seed, self.bits)

    def names(self, t: Texts, at: np.ndarray, span: int) -> pa.Array:
        """What windows are grouped by."""
        if self.by_text:
            return pa.array([x.encode("utf-8", "surrogatepass") for x in t.cut(at, np.full(len(at), span))], pa.binary())
        return pa.array(t.hashes(at, span))

    @property
    def kind(self) -> tuple[str, pa.DataType]:
        return ("binary", pa.binary()) if self.by_text else ("long", pa.int64())


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of batches of about CHUNK characters; column 1 is the text, null counts as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        low, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i == len(texts) - 1:
                yield batch.slice(low, i + 1 - low), texts[low : i + 1]
                low, size = i + 1, 0


def _kmers(schema: pa.Schema, how: Hashing):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            t = how.texts(texts)
            at, h = t.kept()
            owner = np.searchsorted(t.starts, at, "right") - 1
            first = np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array((np.arange(len(at)) - first).astype(np.int32)), pa.array((at - t.starts[owner]).astype(np.int32)), pa.array(h)], schema=schema)

    return run


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the closed ranges, and the range each comes from."""
    size = np.maximum(high - low + 1, 0)
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner], owner


def _places(batch: pa.RecordBatch, column: int, t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as places in the joined texts, and the row of each."""
    lists = batch.column(column)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
    return t.starts[owner] + np.asarray(lists.flatten()).astype(np.int64), owner


def _probes(schema: pa.Schema, span: int, how: Hashing):
    """Windows looked at first; rows are (doc, text, lows, highs, marks).

    Around each marked k-mer every GRID-th window, and the window that begins at each k-mer between lows and highs
    (``mark`` -1); each with its core, the part that it and the GRID - 1 windows before it have in common. A core that
    reaches the end of the text has no window of its own.
    """
    core, steps = span - GRID + 1, -(-(span - KMER + 1) // GRID)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            t = how.texts(texts)
            (low, _), (high, _), (mark, owner) = _places(batch, 2, t), _places(batch, 3, t), _places(batch, 4, t)
            at = (mark[:, None] - GRID * np.arange(steps)).ravel()
            home, of = np.repeat(owner, steps), np.repeat(mark - t.starts[owner], steps)
            good = (at >= t.starts[home]) & (at + core <= t.starts[home + 1])
            at, home, of = at[good], home[good], of[good]
            kept, _ = t.kept() if len(low) else (low, low)
            inner, _ = _ranges(np.searchsorted(kept, low), np.searchsorted(kept, high, "right") - 1)
            inner = kept[inner]
            own = np.searchsorted(t.starts, inner, "right") - 1
            good = inner + span <= t.starts[own + 1]
            inner, own = inner[good], own[good]
            c = np.concatenate([t.hashes(at, core), t.hashes(inner, core)])
            home, at = np.concatenate([home, own]), np.concatenate([at, inner])
            fits = at + span <= t.starts[home + 1]
            names = how.names(t, at[fits], span)
            place = np.cumsum(fits) - 1
            f = names.take(pa.array(place, mask=~fits))
            columns = [(at - t.starts[home]).astype(np.int32), np.concatenate([of, np.full(len(inner), -1)]).astype(np.int32), c]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(home)), *map(pa.array, columns), f], schema=schema)

    return run


def _between(schema: pa.Schema, span: int, how: Hashing):
    """The GRID - 1 windows before each place; rows are (doc, text, places)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            t = how.texts(texts)
            place, owner = _places(batch, 2, t)
            at, _ = _ranges(np.maximum(place - GRID + 1, t.starts[owner]), np.minimum(place - 1, t.starts[owner + 1] - span))
            at = np.unique(at)
            home = np.searchsorted(t.starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(home)), pa.array((at - t.starts[home]).astype(np.int32)), how.names(t, at, span)], schema=schema)

    return run


def _pieces(schema: pa.Schema):
    """The texts of stretches; rows are (doc, text, list of (low, size, pdoc, plow))."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(wanted.offsets)))
            low, size, pdoc, plow = wanted.flatten().flatten()
            texts = batch.column(1).to_pylist()
            held, n = [], 0
            for i, (o, a, k) in enumerate(zip(owner.tolist(), low.to_pylist(), size.to_pylist())):
                held.append(texts[o][a : a + k].encode("utf-8", "surrogatepass"))
                n += k
                if n >= CHUNK or i == len(owner) - 1:
                    begin = i + 1 - len(held)
                    yield pa.RecordBatch.from_arrays([pdoc.slice(begin, len(held)), plow.slice(begin, len(held)), size.slice(begin, len(held)), pa.array(held, pa.binary())], schema=schema)
                    held, n = [], 0

    return run


def kmers(docs: DataFrame, how: Hashing = Hashing()) -> DataFrame:
    """(doc, ordinal, at, h) of all kept k-mers; ``docs`` is (doc, text)."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc", pa.int64()), ("ordinal", pa.int32()), ("at", pa.int32()), ("h", pa.int64())])
    return docs.mapInArrow(_kmers(schema, how), "doc long, ordinal int, at int, h long")


def shared_keys(rows: DataFrame, key: str, places: bool = False) -> DataFrame:
    """(key, ways) of the values of ``key`` in two documents at least; with ``places`` also lo_doc, lo_at, hi_doc, hi_at: where it stands in the first and the last.

    Aggregated map-side in fixed-width buffers, so no hot value gathers and nothing is sorted. ``ways`` is in how many
    parts, by document, the rows of a value are to be worked on: more than one for fewer than four values a
    partition, however the rows are spread.
    """
    found = [F.min_by("at", "doc").alias("lo_at"), F.max_by("at", "doc").alias("hi_at")] if places else []
    each = rows.groupBy(key).agg(F.min("doc").alias("lo_doc"), F.max("doc").alias("hi_doc"), F.count(F.lit(1)).alias("_n"), *found).where("lo_doc < hi_doc")
    each = cut(each if places else each.select(key, "_n"))
    share = each.agg(F.greatest(F.lit(WHOLE), F.sum("_n") / (4 * shuffle_partitions(rows.sparkSession))).alias("x")).scalar()
    return each.withColumn("ways", F.greatest(F.lit(1), F.ceil(F.col("_n") / share)).cast("int")).drop("_n")


def split_join(rows: DataFrame, keys: DataFrame, key: str, how: str = "inner", ways: str = "ways") -> DataFrame:
    """``rows`` joined to the row of their key in ``keys``; what has many ways is met in parts, by document.

    ``keys`` has one row per key, with ``ways``. Rows that have no column ``ways`` yet get it from the keys of more than one
    way, of which there are fewer than four a partition, so that side may be broadcast.
    """
    if ways not in rows.columns:
        hot = keys.where("ways > 1").select(key, F.col("ways").alias(ways))
        rows = rows.join(F.broadcast(hot), key, "left").withColumn(ways, F.coalesce(ways, F.lit(1)))
    # Rows without a key, which a left join keeps, are spread too.
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc"), F.when(F.col(key).isNull(), F.lit(1024)).otherwise(F.col(ways))).cast("int"))
    parts = keys.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
    return rows.join(parts, [key, "_part"], how).drop("_part")


def compact(edges: DataFrame) -> DataFrame:
    """(h, head): the head of the nonbranching path of each edge of ``edges`` = (doc, ordinal, at, h, ways).

    A record's stretch of links gives each edge the head of that stretch; the farthest is taken over all records,
    and heads then jump to their own head until none moves. Where a closed path is cut is left
    open: paths only say which windows are looked at first.
    """
    by_doc = Window.partitionBy("doc").orderBy("ordinal")
    steps = edges.withColumns({"_p": F.lag("h").over(by_doc), "_po": F.lag("ordinal").over(by_doc)})
    steps = steps.withColumn("prev", F.when(F.col("_po") == F.col("ordinal") - 1, F.col("_p")))
    links = steps.where("prev is not null and prev <> h").select(F.col("prev").alias("u"), F.col("h").alias("v"))
    out = links.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("v2")).where("v = v2").select("u", "v")
    into = links.groupBy("v").agg(F.min("u").alias("u"), F.max("u").alias("u2")).where("u = u2").select("u", "v")
    plain = out.join(into, ["u", "v"])
    # An edge goes on a stretch if it follows the one predecessor it has.
    on = plain.select("u", F.col("v").alias("h")).join(edges.groupBy("h").agg(F.max("ways").alias("ways")), "h")
    marked = split_join(steps, on, "h", "left").withColumn("_on", F.col("prev") == F.col("u"))
    runs = marked.withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(by_doc))
    place = Window.partitionBy("doc", "_run").orderBy("ordinal")
    runs = runs.withColumns({"head": F.first("h").over(place), "dist": F.col("ordinal") - F.first("ordinal").over(place)})
    heads = cut(runs.groupBy("h").agg(F.max(F.struct("dist", "head")).alias("x")).select("h", "x.head"))
    left = None
    while True:
        jump = heads.select(F.col("h").alias("head"), F.col("head").alias("next"))
        moved = cut(heads.join(jump, "head", "left").select("h", "head", F.coalesce("next", "head").alias("next")))
        before, left = left, moved.where("next <> head").count()
        heads = moved.select("h", F.col("next").alias("head"))
        # On a path the edges that still move become fewer with every jump; those that never rest lie on closed paths.
        if not left or left == before:
            return heads


def candidate_spans(edges: DataFrame) -> DataFrame:
    """(doc, path, low, high, h_low, h_high): first and last k-mer of each stretch of a document along one path."""
    paths = compact(edges)
    ways = edges.groupBy("h").agg(F.max("ways").alias("ways"))
    on = split_join(edges, paths.join(ways, "h"), "h")
    by_doc = Window.partitionBy("doc").orderBy("ordinal")
    fresh = (F.lag("ordinal").over(by_doc) == F.col("ordinal") - 1) & (F.lag("head").over(by_doc) == F.col("head"))
    on = on.withColumn("_s", F.sum(F.when(fresh, 0).otherwise(1)).over(by_doc))
    return on.groupBy("doc", "_s").agg(F.first("head").alias("path"), F.min("at").alias("low"), F.max("at").alias("high"), F.min_by("h", "at").alias("h_low"), F.max_by("h", "at").alias("h_high")).drop("_s")


def prefilter(docs: DataFrame, ids: DataFrame, key: str = "doc") -> DataFrame:
    """``docs`` without most rows whose key is not in ``ids`` (a written table), to shuffle less; no key of ``ids`` is lost.

    A bitmap of about BITS_EACH bits for each id is broadcast. If that were more than MOST_BITS all rows are kept.
    """
    wanted = BITS_EACH * ids.count()
    if wanted > MOST_BITS:
        return docs
    bits = max(1 << 15, 1 << (wanted - 1).bit_length())
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    hashed = ids.select(bit(key).alias("_b"))
    maps = hashed.groupBy(F.expr("_b div 32768").alias("_bucket")).agg(F.bitmap_construct_agg(F.expr("_b % 32768")).alias("_map"))
    tested = docs.withColumn("_b", bit(key)).withColumn("_bucket", F.expr("_b div 32768")).join(F.broadcast(maps), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_map, cast((_b % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return tested.where(F.getbit(byte, F.expr("cast(_b % 8 as int)")) == 1).select(*docs.columns)


def _peer() -> list[Column]:
    """The place of a window in another document: the first, or for the first document itself the last."""
    other = F.col("lo_doc") != F.col("doc")
    return [F.when(other, F.col(f"lo_{c}")).otherwise(F.col(f"hi_{c}")).alias(f"p{c}") for c in ("doc", "at")]


def _once(rows: DataFrame) -> DataFrame:
    """One row for each window."""
    return rows.groupBy("doc", "at").agg(F.min("pdoc").alias("pdoc"), F.min_by("pat", "pdoc").alias("pat"))


def shared_windows(docs: DataFrame, marks: DataFrame, ranges: DataFrame | None, span: int, how: Hashing = Hashing()) -> DataFrame:
    """(doc, at, pdoc, pat) of windows that stand in two documents; between successive ones at most GRID apart all are.

    Which windows are looked at is a matter of the k-mers and the texts around them alone (``marks`` holds all
    occurrences of the marked ones), so a window is looked at in every document it stands in, or in none: a
    block of windows is opened wherever its core stands as soon as one document leaves it open. A document's
    lists are no longer than its k-mers.
    """
    each = marks.groupBy("doc").agg(F.collect_list("at").alias("marks"))
    none = F.array().cast("array<int>")
    if ranges is None:
        each = each.select("doc", none.alias("lows"), none.alias("highs"), "marks")
    else:
        lists = ranges.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("x"))
        each = lists.join(each, "doc", "left").select("doc", F.col("x.low").alias("lows"), F.col("x.high").alias("highs"), F.coalesce("marks", none).alias("marks"))
    each = cut(each)
    kind, arrow = how.kind
    schema = pa.schema([("doc", pa.int64()), ("at", pa.int32()), ("mark", pa.int32()), ("c", pa.int64()), ("f", arrow)])
    held = prefilter(docs, each).join(each, "doc").select("doc", "text", "lows", "highs", "marks")
    rows = cut(held.mapInArrow(_probes(schema, span, how), f"doc long, at int, mark int, c long, f {kind}"))
    # A window in two documents has its core in two: only rows that pass the one test take the other.
    cores = cut(split_join(rows, shared_keys(rows, "c"), "c").select("doc", "at", "mark", "c", "f", "ways"))
    flagged = split_join(cores, shared_keys(cores.where("f is not null"), "f", places=True), "f", "left", "fways")
    flagged = cut(flagged.select("doc", "at", "mark", "c", "ways", F.col("lo_doc").isNotNull().alias("fs"), *_peer()))
    by_mark = Window.partitionBy("doc", "mark").orderBy("at")
    settled = F.col("fs") & F.coalesce(F.lag("fs").over(by_mark) & (F.lag("at").over(by_mark) == F.col("at") - GRID), F.lit(False))
    blocks = cut(flagged.where("mark >= 0").select("doc", "at", "c", "ways", (~settled).alias("open")))
    opened = split_join(blocks.select("doc", "at", "c", "ways"), blocks.where("open").groupBy("c").agg(F.max("ways").alias("ways")), "c").select("doc", "at").distinct()
    places = cut(opened.groupBy("doc").agg(F.collect_list("at").alias("places")))
    schema = pa.schema([("doc", pa.int64()), ("at", pa.int32()), ("h", arrow)])
    held = prefilter(docs, places).join(places, "doc").select("doc", "text", "places")
    between = cut(held.mapInArrow(_between(schema, span, how), f"doc long, at int, h {kind}"))
    more = split_join(between, shared_keys(between, "h", places=True), "h").select("doc", "at", *_peer())
    every = cut(_once(flagged.where("fs").select("doc", "at", "pdoc", "pat").unionByName(more)))
    discard(each, rows, cores, flagged, blocks, places, between)
    return every


def unequal(docs: DataFrame, found: DataFrame, span: int) -> bool:
    """Whether any stretch of ``found`` differs from the one its peers' coordinates name: texts are compared, letter for letter.

    Windows that go on side by side in the same two documents are one stretch. All stretches that name one place of one
    document must be equal to it, which an aggregate tells that keeps the least and the greatest text; so a stretch travels
    once for each document, and a popular one is combined before.
    """
    beside = Window.partitionBy("doc", "pdoc", "_diagonal").orderBy("at")
    rows = found.select("doc", "at", "pdoc", (F.col("at") - F.col("pat")).alias("_diagonal"))
    rows = rows.withColumn("_s", F.sum(F.when(F.col("at") - F.lag("at").over(beside) <= span, 0).otherwise(1)).over(beside))
    runs = rows.groupBy("doc", "pdoc", "_diagonal", "_s").agg(F.min("at").alias("low"), (F.max("at") - F.min("at") + F.lit(span)).alias("size"))
    # Long stretches are compared piece by piece, at the same places of both texts.
    runs = runs.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(PIECE))))
    runs = cut(runs.select("doc", (F.col("low") + F.col("_o")).alias("low"), F.least(F.lit(PIECE), F.col("size") - F.col("_o")).alias("size"), "pdoc", (F.col("low") + F.col("_o") - F.col("_diagonal")).alias("plow")))
    wanted = runs.unionByName(runs.select(F.col("pdoc").alias("doc"), F.col("plow").alias("low"), "size", "pdoc", "plow")).distinct()
    lists = cut(wanted.groupBy("doc").agg(F.collect_list(F.struct("low", "size", "pdoc", "plow")).alias("wanted")))
    schema = pa.schema([("pdoc", pa.int64()), ("plow", pa.int32()), ("size", pa.int32()), ("piece", pa.binary())])
    held = prefilter(docs, lists).join(lists, "doc").select("doc", "text", "wanted")
    pieces = held.mapInArrow(_pieces(schema), "pdoc long, plow int, size int, piece binary")
    same = pieces.groupBy("pdoc", "plow", "size").agg(F.min("piece").alias("a"), F.max("piece").alias("b"))
    differs = not same.where("a <> b").isEmpty()
    discard(runs, lists)
    return differs


def islands(rows: DataFrame, reach: int) -> DataFrame:
    """(doc, low, high): stretches of window starts of which successive ones are at most ``reach`` apart."""
    by_doc = Window.partitionBy("doc").orderBy("at")
    rows = rows.withColumn("_s", F.sum(F.when(F.col("at") - F.lag("at").over(by_doc) <= reach, 0).otherwise(1)).over(by_doc))
    return rows.groupBy("doc", "_s").agg(F.min("at").alias("low"), F.max("at").alias("high")).drop("_s")


def unsettled(spans: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """Ranges of window starts inside the spans whose characters the windows found so far leave open."""
    looked = spans.where(F.col("high") - F.col("low") > span - KMER + 1).select("doc", (F.col("low") + 1).alias("low"), (F.col("high") + KMER - span - 1).alias("high"))
    covered = islands(found, span).select("doc", F.col("low").alias("c_low"), F.col("high").alias("c_high"))
    per = covered.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("c_low", "c_high"))).alias("c"))
    rows = looked.where("low <= high").join(per, "doc", "left")
    rows = rows.withColumn("c", F.filter(F.coalesce("c", F.array().cast("array<struct<c_low:int,c_high:int>>")), lambda x: (x["c_high"] >= F.col("low")) & (x["c_low"] <= F.col("high"))))
    # Complement of the covered ranges within [low, high].
    begins = F.concat(F.array(F.col("low")), F.transform("c", lambda x: x["c_high"] + 1))
    ends = F.concat(F.transform("c", lambda x: x["c_low"] - 1), F.array(F.col("high")))
    rows = rows.select("doc", F.explode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("x"), "low", "high")
    rows = rows.select("doc", F.greatest("x.b", "low").alias("low"), F.least("x.e", "high").alias("high"))
    return rows.where("low <= high").distinct()


def shared_stretches(documents: DataFrame, row_id: str, text: str, span: int = SPAN, seed: int = 0, bits: int = 64) -> DataFrame:
    """(doc, first, last): disjoint stretches of characters (0-based, closed) that lie in a window of ``span`` characters shared with another document.

    A document is a row id; rows of one id with different texts count as one document, and rows with a null id
    or text do not count. Texts shorter than ``span`` share nothing. Exact
    copies share all they have. ``seed`` and ``bits`` of the hashes change which texts are compared, never the result.
    """
    if span < SPAN:
        raise ValueError(f"spans below {SPAN} characters need smaller k-mers")
    docs = documents.select(F.col(row_id).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))
    found = _found(docs, span, Hashing(seed, bits))
    if unequal(docs, found, span):
        found = _found(docs, span, Hashing(seed, bits, by_text=True))
    return islands(found, span).select("doc", F.col("low").alias("first"), (F.col("high") + span - 1).alias("last"))


def _found(docs: DataFrame, span: int, how: Hashing) -> DataFrame:
    """(doc, at, pdoc, pat) of windows in two documents, as far as ``how`` tells them apart; their union is all that is shared."""
    all_kmers = cut(kmers(docs, how))
    shared = shared_keys(all_kmers, "h")
    edges = cut(split_join(prefilter(all_kmers, shared, "h"), shared, "h").select("doc", "ordinal", "at", "h", "ways"))
    discard(all_kmers)
    spans = cut(candidate_spans(edges))
    ways = edges.groupBy("h").agg(F.max("ways").alias("ways"))
    ends = spans.select(F.explode(F.array("h_low", "h_high")).alias("h")).distinct().join(ways, "h")
    found = shared_windows(docs, split_join(edges, ends, "h"), spans, span, how)
    rest = cut(unsettled(spans, found, span))
    if not rest.isEmpty():
        per = rest.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("x"))
        within = F.exists("x", lambda r: (F.col("at") >= r["low"]) & (F.col("at") <= r["high"] + F.lit(span - KMER)))
        marked = edges.join(per, "doc").where(within).groupBy("h").agg(F.max("ways").alias("ways"))
        more = shared_windows(docs, split_join(edges, marked, "h"), None, span, how)
        found = cut(_once(found.unionByName(more)))
    discard(edges, spans, rest)
    return found


def shared_characters(documents: DataFrame, row_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(row_id, ``shared_chars``) of every document that shares any; see :func:`shared_stretches`."""
    rows = shared_stretches(documents, row_id, text, span)
    return rows.groupBy(F.col("doc").alias(row_id)).agg(F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("shared_chars"))

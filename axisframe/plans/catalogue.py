"""Registered queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.functions import predicates as P
from axisframe.functions import text as X
from axisframe.functions.filters import keep_features
from axisframe.operators import annotate, counts, density, extract, headers
from axisframe.operators import intervals as I
from axisframe.operators.categorise import categorise
from axisframe.plans import views as V
from axisframe.plans.fingerprint import distinct_sources, fingerprint
from axisframe.schema import HEADER
from axisframe.session import cut, scratch, table
from axisframe.sources import alignments, bam, gff, sam, sinks
from axisframe.sources.files import place

BY, BY3 = list(HEADER), list(HEADER[:3])
M, E, B, D = V.MIN_POINTS, V.EPSILON, V.BUFFER, V.DISTANCE
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- density clusters -------------------------------------------------------------------------------------------

_H = "reference, strand, category, source"


def _flat(source: str, by: str, m: int = M, e: str = str(E), p: str = "") -> str:
    """CTEs of flat clusters of ``source``(by, tip): {p}flat(by, k, start, stop, n)."""
    return f"""
  {p}p as (select {by}, tip, row_number() over w as i, lead(tip, {m - 1}) over w as hi from {source} window w as (partition by {by} order by tip)),
  {p}s as (select * from {p}p where hi - tip <= {e}),
  {p}b as (select *, case when i - lag(i) over (partition by {by} order by i) < {m} then 0 else 1 end as brk from {p}s),
  {p}c as (select *, sum(brk) over (partition by {by} order by i rows unbounded preceding) as k from {p}b),
  {p}flat as (select {by}, k, min(tip) as start, max(hi) as stop, max(i) - min(i) + {m} as n, min(i) as i0, max(i) + {m - 1} as i1 from {p}c group by {by}, k)"""


@query(f"with {V.TIPS}, {_flat('tips', _H)} select {_H}, tip as start, hi as stop from s")
def sub_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return density.sub_clusters(V.tips(spark, sf), BY, "tip", M, E)


@query(f"with {V.TIPS}, {_flat('tips', _H)} select {_H}, start, stop, n from flat")
def dbican(spark: SparkSession, sf: str) -> DataFrame:
    t = cut(V.tips(spark, sf))
    return density.with_size(t, density.dbican(t, BY, "tip", M, E), BY)


@query(f"""with {V.TIPS}, {_flat('tips', _H)},
  spots as (select distinct {_H}, tip from tips)
  select t.reference, t.strand, t.category, t.source, t.tip, coalesce(f.k - 1, -1)::bigint as label
  from spots t left join flat f on t.reference = f.reference and t.strand = f.strand and t.category = f.category and t.source = f.source
    and t.tip between f.start and f.stop""")
def dbican_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = cut(V.tips(spark, sf))
    found = density.labels(t, density.dbican(t, BY, "tip", M, E), BY)
    return found.withColumn("label", F.col("label").cast("long"))


_BY3 = "reference, strand, category"
_CORE = f"""
  r as (select *, row_number() over w as i, lead(tip, {M - 1}) over w - tip as r, lead(tip) over w is not null as more, count(*) over (partition by {_BY3}) as n
        from tips window w as (partition by {_BY3} order by tip)),
  core as (select *, min(r) over (partition by {_BY3} order by i rows between {M - 1} preceding and current row) as core_dist from r)"""


@query(f"with {V.TIPS}, {_CORE} select {_BY3}, tip, core_dist from core where n >= {M}")
def core_distance(spark: SparkSession, sf: str) -> DataFrame:
    return density.core_distances(V.tips(spark, sf), BY3, "tip", M)


@query(f"""with {V.TIPS}, {_CORE},
  g as (select *, case when more and n > {M} then min(r) over (partition by {_BY3} order by i rows between {M - 2} preceding and current row) end as g from r),
  d as (select *, lag(g) over (partition by {_BY3} order by i) as pg from g where g is not null),
  e as (select *, lag(g) over w as before, lead(g) over w as after from d where pg is null or g <> pg window w as (partition by {_BY3} order by i)),
  f as (select {_BY3}, max(g) as f from e where g > before and g > after group by {_BY3})
  select k.reference, k.strand, k.category, f.f as fork_epsilon from (select distinct {_BY3} from tips) k
  left join f on f.reference = k.reference and f.strand = k.strand and f.category = k.category""")
def fork_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    return density.fork_epsilons(V.tips(spark, sf), BY3, "tip", M)


def _split(m: int, e: str, levels: int = 7, aggressive: bool = False, least: int = 0, source: str = "tips", by: str = _BY3) -> str:
    """CTEs of splitting clusters, level by level: split_all(by, start, stop). A cluster still open at the end is an error.

    ``e`` is a number, or a column of ``source`` that is one of ``by``.
    """
    key = f"{by}, id"
    parts = by.split(", ")
    on = lambda a, b, names=("id",): " and ".join(f"{a}.{c} = {b}.{c}" for c in (*parts, *names))
    of = lambda a: ", ".join(f"{a}.{c}" for c in parts)
    eps = f"q.{e}" if e in parts else e
    top = f"p.{e}" if e in parts else e
    out = [_flat(source, by, m, e, "l0"), f"""
  pts0 as (select {of('p')}, f.k::varchar as id, p.tip, {top}::bigint as top from l0flat f join l0p p on {on('p', 'f', ())} where p.i between f.i0 and f.i1)"""]
    done = []
    for n in range(levels):
        out.append(f"""
  r{n} as (select *, row_number() over w as i, lead(tip, {m - 1}) over w - tip as r, lead(tip) over w is not null as more, count(*) over (partition by {key}) as n
           from pts{n} window w as (partition by {key} order by tip)),
  q{n} as (select *, greatest({least}, min(r) over (partition by {key} order by i rows between {m - 1} preceding and current row)) as core,
           case when more and n > {m} then min(r) over (partition by {key} order by i rows between {m - 2} preceding and current row) end as g from r{n}),
  d{n} as (select *, lag(g) over (partition by {key} order by i) as pg from q{n} where g is not null),
  e{n} as (select *, lag(g) over w as before, lead(g) over w as after from d{n} where pg is null or g <> pg window w as (partition by {key} order by i)),
  f{n} as (select {key}, max(g) as f from e{n} where g > before and g > after group by {key}),
  v{n} as (select {of('q')}, q.id, min(q.tip) as start, max(q.tip) as stop, min(f.f) as f,
           coalesce(sum({'q.top' if aggressive else eps} - greatest(f.f, q.core)) < sum(greatest(0, f.f - q.core)), false) as open
           from q{n} q left join f{n} f on {on('q', 'f')} group by {of('q')}, q.id),
  o{n} as (select {of('q')}, q.id, q.tip, v.f from q{n} q join v{n} v on {on('q', 'v')} where v.open),
  {_flat(f'o{n}', f'{key}, f', m, 'f - 1', f'l{n + 1}').strip()},
  pts{n + 1} as (select {of('p')}, p.id || '.' || x.k as id, p.tip, p.f as top from l{n + 1}flat x join l{n + 1}p p
           on {on('p', 'x')} where p.i between x.i0 and x.i1)""")
        done.append(f"select {by}, start, stop from v{n} where not open")
    done.append(f"select {by}, error('clusters left open') as start, 0 as stop from pts{levels}")
    return ",".join(out) + ",\n  split_all as (" + " union all ".join(done) + ")"


_SPLIT_ROWS = f"select {_BY3}, start::bigint as start, stop::bigint as stop from split_all"


@query(f"with {V.TIPS}, {_split(M, str(E))} {_SPLIT_ROWS}")
def sdbican(spark: SparkSession, sf: str) -> DataFrame:
    return density.sdbican(V.tips(spark, sf), BY3, "tip", M, E)


@query(f"with {V.TIPS}, {_split(M, str(E), least=60)} {_SPLIT_ROWS}")
def sdbican_min_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    """With a floor under the core distances."""
    return density.clusters(V.tips(spark, sf), BY3, "tip", M, E, 60)


@query(f"with {V.TIPS}, {_split(M, str(E), aggressive=True)} {_SPLIT_ROWS}")
def sdbican_aggressive(spark: SparkSession, sf: str) -> DataFrame:
    return density.clusters(V.tips(spark, sf), BY3, "tip", M, E, method="SDBICAN-aggressive")


_FORKS = f"""
  {_CORE.strip()},
  g as (select *, case when more and n > {M} then min(r) over (partition by {_BY3} order by i rows between {M - 2} preceding and current row) end as g from r),
  d as (select *, lag(g) over (partition by {_BY3} order by i) as pg from g where g is not null),
  e as (select *, lag(g) over w as before, lead(g) over w as after from d where pg is null or g <> pg window w as (partition by {_BY3} order by i)),
  f as (select {_BY3}, max(g) as f from e where g > before and g > after group by {_BY3})"""


@query(f"""with {V.TIPS}, {_FORKS},
  own as (select t.*, f.f - 1 as eps from tips t join f on f.reference = t.reference and f.strand = t.strand and f.category = t.category),
  {_split(M, "eps", 14, source="own", by=_BY3 + ", eps").strip()} {_SPLIT_ROWS}""")
def sdbican_auto_eps(spark: SparkSession, sf: str) -> DataFrame:
    return density.sdbican(V.tips(spark, sf), BY3, "tip", M, None)


# --- interval algebra -------------------------------------------------------------------------------------------


def _merged(source: str, by: str, p: str = "u") -> str:
    return f"""
  {p}0 as (select {by}, start, max(stop) as stop from {source} group by {by}, start),
  {p}1 as (select *, max(stop) over (partition by {by} order by start rows between unbounded preceding and 1 preceding) as pm from {p}0),
  {p}2 as (select *, sum(case when pm is null or start > pm then 1 else 0 end) over (partition by {by} order by start rows unbounded preceding) as k from {p}1),
  {p} as (select {by}, min(start) as start, max(stop) as stop from {p}2 group by {by}, k)"""


def _buffered(source: str, by: str, b: int, p: str = "w") -> str:
    return f"""
  {p}0 as (select *, lag(stop) over w as ps, lead(start) over w as ns from {source} window w as (partition by {by} order by start)),
  {p} as (select {by}, start - coalesce(cast(floor(least((start - ps - 1) / 2.0, {b})) as bigint), {b}) as start,
                 stop + coalesce(cast(ceil(least((ns - stop - 1) / 2.0, {b})) as bigint), {b}) as stop from {p}0)"""


@query(f"with {V.LOCI}, {_merged('places', _H)} select * from u")
def union(spark: SparkSession, sf: str) -> DataFrame:
    return I.union(V.loci(spark, sf), BY)


@query(f"with {V.LOCI}, {_merged('places', _H)}, {_buffered('u', _H, B)} select * from w")
def union_buffered(spark: SparkSession, sf: str) -> DataFrame:
    return I.union_buffered(V.loci(spark, sf), BY, B)


@query(f"with {V.LOCI}, {_merged('places', _BY3)} select * from u")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    return I.union(headers.mutate_header(V.loci(spark, sf), source=None), BY3)


@query(f"""with {V.LOCI} select locus_id, stop - start + 1 as length, 1000 <= start and stop <= 50000 as contains, start <= 1000 and 1500 <= stop as within,
  1000 between start and stop as lower, 1500 between start and stop as upper,
  (1000 <= stop and stop <= 1500) or (1000 <= start and start <= 1500) as intersects, start <= 1500 and 1000 <= stop as overlaps from places""")
def interval_predicates(spark: SparkSession, sf: str) -> DataFrame:
    s, e, lo, hi, far = F.col("start"), F.col("stop"), F.lit(1000), F.lit(1500), F.lit(50000)
    return V.loci(spark, sf).select(
        "locus_id", P.length().alias("length"), P.contains(lo, far, s, e).alias("contains"), P.within(lo, hi, s, e).alias("within"),
        P.intersects_lower(s, e, lo, hi).alias("lower"), P.intersects_upper(s, e, lo, hi).alias("upper"), P.intersects(s, e, lo, hi).alias("intersects"), P.overlaps(s, e, lo, hi).alias("overlaps"),
    )


@query(f"""with {V.LOCI}, {V.KNOWN}, a as (select locus_id, reference, start - 2000 as start, stop + 2000 as stop from places)
  select a.locus_id, a.reference, a.start, a.stop, coalesce(sum(k.stop - k.start + 1), 0)::bigint as contained
  from a left join known k on k.reference = a.reference and a.start <= k.start and k.stop <= a.stop group by all""")
def contained_length(spark: SparkSession, sf: str) -> DataFrame:
    a = V.loci(spark, sf).select("locus_id", "reference", (F.col("start") - 2000).alias("start"), (F.col("stop") + 2000).alias("stop"))
    return I.contained_length(a, V.known(spark, sf), ["reference"])


# --- counts -----------------------------------------------------------------------------------------------------

_IN = " and ".join(f"t.{c} = u.{c}" for c in ("reference", "strand", "category")) + " and t.tip between u.start and u.stop"
def _counted_in(found: str, name: str) -> str:
    """CTEs that buffer, join and count the clusters ``name`` of the CTEs ``found``."""
    return f"""{V.TIPS}, {found}, {_buffered(name, _H, B)}, {_merged('w', _BY3)},
  held as (select u.reference, u.strand, u.category, u.start as s, u.stop as e, t.source, t.tip, t.element from u join tips t on {_IN}),
  whole as (select {_BY3}, s, e, min(tip) as start, max(tip) as stop, cast(trunc(median(tip)) as bigint) as median, count(*) as total from held group by {_BY3}, s, e),
  names as (select distinct source as name from tips),
  each as (select w.*, n.name, coalesce(c.n, 0) as count from whole w cross join names n left join
           (select {_BY3}, s, e, source, count(*) as n from held group by all) c
           on c.reference = w.reference and c.strand = w.strand and c.category = w.category and c.s = w.s and c.e = w.e and c.source = n.name)"""


_COUNTED = _counted_in(_flat("tips", _H), "flat")


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = cut(V.tips(spark, sf))
    found = I.union_buffered(density.dbican(t, BY, "tip", M, E), BY, B)
    return t, cut(I.union(found.select(*BY3, "start", "stop"), BY3))


def _counted(spark: SparkSession, sf: str, n: int = 0) -> DataFrame:
    t, c = _clusters(spark, sf)
    return cut(counts.count_reads(t, c, BY3, n))


@query(f"with {_COUNTED} select {_BY3}, start, stop, name, count from each")
def count_reads(spark: SparkSession, sf: str) -> DataFrame:
    rows = _counted(spark, sf)
    return rows.select(*BY3, "start", "stop", F.explode("samples").alias("x")).select(*BY3, "start", "stop", "x.name", "x.count")


@query(f"with {_COUNTED} select {_BY3}, start, stop, median from whole")
def median_trim(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(spark, sf).select(*BY3, "start", "stop", "median")


_WIDE = ", ".join(f"(list(name order by name))[{i + 1}] as sample_{i}_name, (list(count order by name))[{i + 1}] as sample_{i}_count" for i in range(8))


@query(f"with {_COUNTED} select {_BY3}, start, stop, median, {_WIDE} from each group by {_BY3}, start, stop, median, s, e")
def count_reads_wide(spark: SparkSession, sf: str) -> DataFrame:
    return counts.flatten_samples(_counted(spark, sf), V.n_sources(spark, sf))


@query(f"""with {_COUNTED},
  ec as (select {_BY3}, s, e, source, element, count(*) as count, min(tip) as first from held group by all),
  k as (select *, row_number() over (partition by {_BY3}, s, e, source order by count desc, first, element) as rank from ec)
  select w.reference, w.strand, w.category, w.start, w.stop, k.source as name, k.rank::integer as rank, k.element, k.count from k join whole w
  on k.reference = w.reference and k.strand = w.strand and k.category = w.category and k.s = w.s and k.e = w.e where k.rank <= 2""")
def top_elements(spark: SparkSession, sf: str) -> DataFrame:
    rows = _counted(spark, sf, 2).select(*BY3, "start", "stop", F.explode("samples").alias("x"))
    each = rows.select(*BY3, "start", "stop", "x.name", F.posexplode("x.element").alias("rank", "y"))
    return each.select(*BY3, "start", "stop", "name", (F.col("rank") + 1).alias("rank"), F.col("y.name").alias("element"), F.col("y.count").alias("count")).where("count > 0")


_COLOUR = "case cast(floor(p * 10) as integer) " + " ".join(f"when {n} then '{c}'" for n, c in X.PROPORTION_COLOURS.items()) + " end"
_SHARES = f"shares as (select {_BY3}, start, stop, median, s, e, max(count) / sum(count) as p from each group by {_BY3}, start, stop, median, s, e)"


@query(f"with {_COUNTED}, {_SHARES} select {_BY3}, start, stop, p as max_count_proportion, {_COLOUR} as color from shares")
def max_count_proportion(spark: SparkSession, sf: str) -> DataFrame:
    return counts.proportions(_counted(spark, sf)).select(*BY3, "start", "stop", "max_count_proportion", "color")


@query("""with r as (select distinct reference from refs), k as (select * from r cross join (values ('+'), ('-')) s(strand) cross join (select distinct source from read_tips where source is not null) x),
  n as (select reference, strand, source, count(distinct read_id) as n from read_tips group by all)
  select k.reference, k.strand, k.source, coalesce(n.n, 0) as n from k left join n on n.reference = k.reference and n.strand = k.strand and n.source = k.source""")
def dense_keys(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "read_tips")
    keys = counts.dense_keys(table(spark, sf, "refs").select("reference"), spark.createDataFrame([("+",), ("-",)], "strand string"), reads.select("source").dropna().distinct())
    n = reads.groupBy("reference", "strand", "source").agg(F.countDistinct("read_id").alias("n"))
    return keys.join(n, ["reference", "strand", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("select source, row_number() over (order by source) - 1 as index from (select distinct source from read_tips where source is not null)")
def source_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = distinct_sources(table(spark, sf, "read_tips").where("source is not null"))
    return rows.withColumn("index", F.col("index").cast("long"))


# --- annotation and pairs ---------------------------------------------------------------------------------------

_IDS = "category || '_' || reference || '_' || strand || '_' || case when strand = '+' then stop else start end"
_MATCHED = f"""{_COUNTED}, {V.KNOWN},
  matched as (
    select w.*, coalesce((select case when w.strand = '+' then min_by(k.element, k.ord) else max_by(k.element, k.ord) end from known k
      where k.reference = w.reference and k.category = w.category and
        case when w.strand = '+' then k.start between w.median and w.stop + {D} else k.stop between w.start - {D} and w.median end), '.') as known_element
    from whole w),
  named as (select *, {_IDS} as ID from matched)"""


def _paired(test: str) -> str:
    return f"""
  n1 as (select *, lag(strand) over w as bs, lag(stop) over w as bstop, lag(start) over w as bstart, lag(known_element) over w as bk, lag(ID) over w as bid,
                lead(strand) over w as ns, lead(start) over w as nstart, lead(stop) over w as nstop, lead(known_element) over w as nk, lead(ID) over w as nid
         from named window w as (partition by reference, category order by median, strand)),
  pairs as (select *, case when strand = '-' and bs = '+' and ({test.format(fs='bstop', rs='start', fk='bk', rk='known_element')}) then bid
                           when strand = '+' and ns = '-' and ({test.format(fs='stop', rs='nstart', fk='known_element', rk='nk')}) then nid else '.' end as pair from n1)"""


_NEAR = f"{{fs}} + {D} >= {{rs}} - {D}"


@query(f"with {_MATCHED} select {_BY3}, start, stop, known_element from matched")
def match_known(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.match_known(_counted(spark, sf), V.known(spark, sf), D).select(*BY3, "start", "stop", "known_element")


@query(f"with {_COUNTED} select {_BY3}, start, stop, {_IDS} as ID from whole")
def contig_ids(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.contig_ids(_counted(spark, sf)).select(*BY3, "start", "stop", "ID")


def _pairs(spark: SparkSession, sf: str, **how) -> DataFrame:
    rows = annotate.match_known(_counted(spark, sf), V.known(spark, sf), D)
    return annotate.pair(annotate.contig_ids(rows), D, **how).select("ID", "pair")


@query(f"with {_MATCHED}, {_paired(_NEAR)} select ID, pair from pairs")
def pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@query(f"with {_MATCHED}, {_paired(_NEAR + ' or {fk} = {rk}')} select ID, pair from pairs")
def pair_known_reference(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, use_known=True)


@query(f"with {_MATCHED}, {_paired(_NEAR + " or ({fk} = {rk} and {fk} <> '.')")} select ID, pair from pairs")
def pair_known_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, use_known=True, known_match="strict")


@query(f"""with {_MATCHED}, {_SHARES}, {_paired(_NEAR + ' or {fk} = {rk}')},
  wide as (select {_BY3}, s, e, {_WIDE} from each group by {_BY3}, s, e)
  select p.reference, p.strand, p.category, p.start, p.stop, p.median, {", ".join(f"w.sample_{i}_name, w.sample_{i}_count" for i in range(8))},
         x.p as max_count_proportion, {_COLOUR} as color, p.known_element, p.ID, p.pair
  from pairs p join wide w on p.reference = w.reference and p.strand = w.strand and p.category = w.category and p.s = w.s and p.e = w.e
  join shares x on p.reference = x.reference and p.strand = x.strand and p.category = x.category and p.s = x.s and p.e = x.e""")
def fingerprint_job(spark: SparkSession, sf: str) -> DataFrame:
    n = V.n_sources(spark, sf)
    rows = fingerprint(V.tips(spark, sf), M, E, method="DBICAN", buffer=B, known=V.known(spark, sf), distance=D, n_sources=n)
    return headers.output_order(counts.flatten_samples(rows, n))


_TOP = ", ".join(
    f"max(x.name) filter (i = {i}) as sample_{i}_name, max(x.count) filter (i = {i}) as sample_{i}_count, "
    + ", ".join(f"coalesce(max(k.element) filter (i = {i} and rank = {j + 1}), '.') as sample_{i}_element_{j}_name, coalesce(max(k.n) filter (i = {i} and rank = {j + 1}), 0) as sample_{i}_element_{j}_count" for j in range(2))
    for i in range(8)
)


@query(f"""with {_counted_in(_split(M, str(E), by=_H), "split_all")},
  ec as (select {_BY3}, s, e, source, element, count(*) as n, min(tip) as first from held group by all),
  k as (select *, row_number() over (partition by {_BY3}, s, e, source order by n desc, first, element) as rank from ec),
  numbered as (select name, row_number() over (order by name) - 1 as i from names),
  topped as (select x.reference, x.strand, x.category, x.s, x.e, {_TOP}
    from each x join numbered n on n.name = x.name
    left join k on k.reference = x.reference and k.strand = x.strand and k.category = x.category and k.s = x.s and k.e = x.e and k.source = x.name
    group by x.reference, x.strand, x.category, x.s, x.e),
  shares as (select {_BY3}, start, stop, median, s, e, max(count) / sum(count) as p from each group by {_BY3}, start, stop, median, s, e),
  named as (select *, '' as known_element, category || '_' || reference || '_' || strand || '_' || case when strand = '+' then stop else start end as ID from shares),
  n1 as (select *, lag(strand) over w as bs, lag(stop) over w as bstop, lag(ID) over w as bid, lead(strand) over w as ns, lead(start) over w as nstart, lead(ID) over w as nid
         from named window w as (partition by reference, category order by median, strand))
  select n1.reference, n1.strand, n1.category, n1.start, n1.stop, n1.median, t.* exclude (reference, strand, category, s, e), n1.p as max_count_proportion,
         {{colour}} as color, n1.ID,
         case when n1.strand = '-' and bs = '+' and bstop >= n1.start then bid when n1.strand = '+' and ns = '-' and n1.stop >= nstart then nid else '.' end as pair
  from n1 join topped t on n1.reference = t.reference and n1.strand = t.strand and n1.category = t.category and n1.s = t.s and n1.e = t.e""".replace("{colour}", _COLOUR))
def fingerprint_split(spark: SparkSession, sf: str) -> DataFrame:
    """The default method with common elements, over the whole table."""
    n = V.n_sources(spark, sf)
    return counts.flatten_samples(fingerprint(V.tips(spark, sf), M, E, buffer=B, n_elements=2, n_sources=n), n, 2)


# --- key and field algebra --------------------------------------------------------------------------------------


@query(f"select read_id, {V._LONGEST.format('me')} as category from (select distinct read_id, me from read_tips) where me is not null and {V._LONGEST.format('me')} is not null")
def categorise_names(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "read_tips").select("read_id", "me").distinct()
    return categorise(reads, "me", V.CATEGORIES).select("read_id", "category")


@query(f"select read_id, {V._LONGEST.format('me')} as category from (select distinct read_id, me from read_tips) where me is not null and {V._LONGEST.format('me')} is not null")
def categorise_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the categories in a table."""
    reads = table(spark, sf, "read_tips").select("read_id", "me").distinct()
    return categorise(reads, "me", spark.createDataFrame([(c,) for c in V.CATEGORIES], "category string")).select("read_id", "category")


@query(f"with {V.LOCI} select locus_id, 'all' as reference, strand, category, start, stop from places")
def mutate_header(spark: SparkSession, sf: str) -> DataFrame:
    return headers.mutate_header(V.loci(spark, sf), reference="all", source=None)


@query(f"with {V.LOCI} select * from places where category = 'Copia' union all select * from places where category <> 'Copia'")
def append_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.loci(spark, sf)
    return headers.append(headers.loci_of(rows, category="Copia"), rows.where("category <> 'Copia'"), strict=True)


@query(f"with {V.LOCI} select distinct {_H} from places")
def header_set(spark: SparkSession, sf: str) -> DataFrame:
    return headers.headers(V.loci(spark, sf))


@query(f"with {V.LOCI} select {_H}, locus_id, start, 0::bigint as score, '' as note from places")
def fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = headers.add_field(headers.drop_field(V.loci(spark, sf), "stop"), score="long", note="string")
    return rows.select(*BY, "locus_id", "start", "score", "note")


@query(f"with {V.LOCI} select locus_id, start as span_start, stop as span_stop, strand as span_at_strand from places")
def flatten(spark: SparkSession, sf: str) -> DataFrame:
    return headers.flatten(V.loci(spark, sf).select("locus_id", F.struct("start", "stop", F.struct("strand").alias("at")).alias("span")))


@query(f"""with {V.LOCI} select {_H}, max(stop) - min(start) as extent, count(*)::bigint as n from places group by {_H}""")
def map_groups(spark: SparkSession, sf: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    def extent(t: pa.Table) -> pa.Table:
        row = {c: [t.column(c)[0].as_py()] for c in BY}
        return pa.table(row | {"extent": [pc.max(t.column("stop")).as_py() - pc.min(t.column("start")).as_py()], "n": [t.num_rows]})

    return headers.map_groups(V.loci(spark, sf), extent, "reference string, strand string, category string, source string, extent long, n long")


# --- reads ------------------------------------------------------------------------------------------------------

_RC = "reverse(translate(upper({0}), 'ACGT', 'TGCA'))"
_BASE = "flag & 256 = 0 and flag & 2048 = 0"
_HEAD = "substr({0}, 1, head + 1)"
_TAIL = "right({0}, tail)"
_TIPS_SQL = f"""tipped as (select qname as name, rname as element, case when rev then {_HEAD.format('seq')} else {_RC.format(_TAIL.format('seq'))} end as sequence,
  case when rev then {_HEAD.format('qual')} else reverse({_TAIL.format('qual')}) end as quality from parts
  where {_BASE} and not un and mateun and ((rev and head >= 38) or (not rev and tail >= 38)))"""
_DANGLERS_SQL = f"""dangling as (select qname as name, case when rnext = '=' then rname else rnext end as element,
  case when rev then {_RC.format('seq')} else seq end as sequence, case when rev then reverse(qual) else qual end as quality from parts
  where {_BASE} and not mateun and un)"""
_TAILS_SQL = f"""tailed as (select qname as name, rname as element, case when rev then {_RC.format(_TAIL.format('seq'))} else {_HEAD.format('seq')} end as sequence,
  case when rev then reverse({_TAIL.format('qual')}) else {_HEAD.format('qual')} end as quality from parts
  where {_BASE} and not mateun and not un and proper and ((rev and tail >= 38) or (not rev and head >= 38)))"""


@query(f"with {V.SAM}, {_TIPS_SQL} select * from tipped")
def extract_tips(spark: SparkSession, sf: str) -> DataFrame:
    return extract.clip_tips(V.sam(spark, sf))


@query(f"with {V.SAM}, {_DANGLERS_SQL} select * from dangling")
def extract_danglers(spark: SparkSession, sf: str) -> DataFrame:
    return extract.danglers(V.sam(spark, sf))


@query(f"with {V.SAM}, {_TAILS_SQL} select * from tailed")
def extract_tails(spark: SparkSession, sf: str) -> DataFrame:
    return extract.clip_tails(V.sam(spark, sf))


@query(f"""with {V.SAM}, {_TIPS_SQL}, {_DANGLERS_SQL}, {_TAILS_SQL}, other as (select * from dangling union all select * from tailed)
  select * from tipped union all select * from other where name not in (select name from tipped)""")
def extract_all(spark: SparkSession, sf: str) -> DataFrame:
    return extract.informative_reads(V.sam(spark, sf), tips=True)


@query(f"""with {V.SAM}, {_TIPS_SQL}, {_DANGLERS_SQL}, both_ as (select name, element, 1 as p from tipped union all select name, element, 0 from dangling)
  select name, max_by(element, (p, element)) as element from both_ group by name""")
def name_element_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.sam(spark, sf)
    return extract.name_elements(extract.clip_tips(rows), extract.danglers(rows))


@query(f"""with {V.SAM}, {_DANGLERS_SQL}, n as (select name, max(element) as element from dangling group by name)
  select s.qname, s.pos, 'ME:Z:' || n.element as tag from sam s join n on n.name = s.qname""")
def tag_reads(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.sam(spark, sf)
    elements = extract.name_elements(extract.danglers(rows))
    tagged = extract.tag_reads(rows.join(elements.select(F.col("name").alias("qname")), "qname", "left_semi"), elements)
    return tagged.select("qname", "pos", F.element_at("tags", -1).alias("tag"))


@query(f"with {V.SAM} select qname, case when rev then '-' else '+' end as strand, pos as start, pos + span - 1 as stop from parts where not un and mapq >= 30")
def cigar_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.sam(spark, sf).where(~P.has_flag(P.UNMAPPED) & P.mapped_well(30))
    return rows.select("qname", F.when(P.has_flag(P.REVERSE), "-").otherwise("+").alias("strand"), F.col("pos").alias("start"), (F.col("pos") + X.cigar_span("cigar") - 1).alias("stop"))


@query(f"with {V.SAM} select qname, {_RC.format('seq')} as rc, reverse(qual) as rq from sam")
def reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    return V.sam(spark, sf).select("qname", X.reverse_complement("seq").alias("rc"), F.reverse("qual").alias("rq"))


@query(f"""with {V.SAM},
  anchors as (select rname as reference, source, pos + span - 1 as start, pnext as stop from parts
    where flag & 1 <> 0 and flag & 64 <> 0 and not un and not mateun and not rev and flag & 32 <> 0 and (rnext = '=' or rnext = rname) and mapq >= 10 and pnext - 1 > pos + span - 1),
  feats as (select 'm' || (gff_id % 7) as reference, start % 2000 as start, start % 2000 + (end_pos - start) % 300 as stop
    from (select distinct gff_id, start, end_pos from gff where start is not null and end_pos is not null) where end_pos >= start),
  kept as (select distinct * from anchors a where a.stop - a.start + 1 - coalesce((select sum(f.stop - f.start + 1) from feats f where f.reference = a.reference and a.start <= f.start and f.stop <= a.stop), 0) <= 300),
  {_merged('kept', 'reference, source')} select * from u""")
def anchor_intervals(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gff").select("gff_id", "start", "end_pos").dropna("any").distinct().where("end_pos >= start")
    known = g.selectExpr("concat('m', gff_id % 7) as reference", "start % 2000 as start", "start % 2000 + (end_pos - start) % 300 as stop")
    return extract.anchor_intervals(V.sam(spark, sf), known, quality=10, insert_size=300)


@query("""select distinct read_id, reference, strand, coalesce(category, '.') as category, source, tip from read_tips
  where mapq >= 30 and flag & 4 = 0 and reference = 'chr4' and tip between 5000 and 60000 and me is not null""")
def region_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One region of one reference with a least quality; all of it reaches the Parquet scan."""
    rows = table(spark, sf, "read_tips").where(P.mapped_well(30) & ~P.has_flag(P.UNMAPPED) & sam.in_region("chr4:5000-60000", "reference", "tip", "tip") & F.col("me").isNotNull())
    return rows.select("read_id", "reference", "strand", F.coalesce("category", F.lit(".")).alias("category"), "source", "tip").distinct()


_COLUMN = "replace(replace(replace({0}, '%25', '%'), '%09', chr(9)), '%0D', chr(13))"


@query(f"""with c as (select line_id as ord, string_split(line, chr(9)) as c from gff_lines where line not like '#%' and trim(line) <> ''),
  t as (select ord, {_COLUMN.format('c[1]')} as reference, {_COLUMN.format('c[3]')} as element, try_cast(c[4] as bigint) as start, try_cast(c[5] as bigint) as stop,
    c[4] as a, c[5] as b from c)
  select reference, case when starts_with(element, 'repeat_r') then 'repeat_r' when starts_with(element, 'repeat') then 'repeat' when starts_with(element, 'mobile') then 'mobile' end as category,
         '.' as source, start, stop, element, ord from t where (starts_with(element, 'repeat') or starts_with(element, 'mobile'))
         and regexp_full_match(a, '[0-9]+') and regexp_full_match(b, '[0-9]+') and start is not null and stop is not null""")
def annotation_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Features whose ends are written in digits; numbers beyond 64 bits are none."""
    digits = lambda i: F.coalesce(F.get(F.split("value", "\t"), F.lit(i)).rlike("^[0-9]+$"), F.lit(False))
    lines = table(spark, sf, "gff_lines").select(F.col("line").alias("value"), F.col("line_id").alias("ord")).where(digits(3) & digits(4))
    return gff.annotation_intervals(lines, ["mobile", "repeat", "repeat_r"]).where("start is not null and stop is not null")


@query(f"""with {V.SAM} select qname, flag::integer as flag, rname, pos, mapq::integer as mapq, cigar, rnext, pnext, 0::bigint as tlen, seq, qual from sam""")
def sam_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as text files by all tasks and read again."""
    path = f"{scratch(spark)}/{uuid.uuid4().hex}.sam"
    sinks.write_text(sam.to_lines(V.sam(spark, sf)), path)
    return sam.read_sam(spark, path).drop("tags", "source")


@query(f"""with {V.TIPS}, {_flat('tips', _H)}, spots as (select distinct {_H}, tip from tips),
  labelled as (select t.tip, coalesce(f.k - 1, -1)::bigint as label
    from spots t left join flat f on t.reference = f.reference and t.strand = f.strand and t.category = f.category and t.source = f.source and t.tip between f.start and f.stop)
  select label, tip, count(*) as n from labelled group by label, tip""")
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return density.label_histogram(dbican_labels(spark, sf))


# --- text -------------------------------------------------------------------------------------------------------

# Written out, so that a change of the operator's table shows: percent first, then tab, carriage return, ; = & and comma.
_ENC = "replace(replace(replace(replace(replace(replace(replace({0}, '%', '%25'), chr(9), '%09'), chr(13), '%0D'), ';', '%3B'), '=', '%3D'), '&', '%26'), ',', '%2C')"
_DEC = "replace(replace(replace(replace(replace(replace(replace({0}, '%25', '%'), '%09', chr(9)), '%0D', chr(13)), '%3B', ';'), '%3D', '='), '%26', '&'), '%2C', ',')"


@query(f"select doc_id, md5({_ENC.format('text')}) as encoded from documents")
def gff_encode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.encode_attribute("text")).alias("encoded"))


_ESCAPED = "attributes || '%0A' || chr(10) || '%2509%3B'"


@query(f"select distinct gff_id, {_DEC.format('(' + _ESCAPED + ')')} as decoded from gff")
def gff_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Every field followed by an escaped and a plain line feed (both stay) and a percent sign that hides a tab (which comes out)."""
    text = F.concat("attributes", F.lit("%0A\n%2509%3B"))
    return table(spark, sf, "gff").select("gff_id", X.decode_attribute(text).alias("decoded")).distinct()


@query("select doc_id, md5(text) as same from documents")
def gff_escape_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The strict escapes of a text, undone: every text comes back, and none has a line feed in between."""
    coded = X.encode_attribute("text", strict=True)
    checked = F.when(F.contains(coded, F.lit("\n")), F.raise_error(F.lit("a line feed is left"))).otherwise(X.decode_attribute(coded, strict=True))
    return table(spark, sf, "documents").select("doc_id", F.md5(checked).alias("same"))


@query(f"""with {V.TIPS}, {_flat('tips', _H)} select reference || chr(9) || 'axisframe' || chr(9) || '.' || chr(9) || start || chr(9) || stop || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9)
  || 'category=' || category || ';source=' || source || ';n=' || n as value from flat""")
def gff_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.feature_lines(dbican(spark, sf).select(*BY, "start", "stop", "n"), "axisframe")


@query(f"""with {V.LOCI} select locus_id || ',"' || reference || '","' || strand || '","' || category || '","' || source || '",' || start || ',' || stop as value from places""")
def tabular_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.tabular_lines(V.loci(spark, sf), ",", quote=True)


@query(f"with {V.SAM}, {_TAILS_SQL} select '@' || name || chr(10) || sequence || chr(10) || '+' || chr(10) || quality as value from tailed")
def fastq_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.fastq_lines(extract.clip_tails(V.sam(spark, sf)))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return gff.parse_features(gff_lines(spark, sf)).select("value", "fields")


_KEPT = f"with {V.TIPS}, {_flat('tips', _H)} select reference as seqid, start, stop, n from flat where "


def _kept(spark: SparkSession, sf: str, **filters) -> DataFrame:
    f = lambda n: F.element_at("fields", F.lit(n))
    kept = keep_features(_features(spark, sf), **filters)
    return kept.select(f("seqid").alias("seqid"), f("start").cast("long").alias("start"), f("end").cast("long").alias("stop"), f("n").cast("long").alias("n"))


@query(_KEPT + "stop > 20000 and strand = '-' and category <> 'Copia'")
def filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, all_of=["end>20000", "strand==-", "category != Copia"])


@query(_KEPT + "start < 20000 or n >= 20")
def filter_any(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, any_of=["start<20000", "n>=20"])


@query(_KEPT + "n > 5 and start > 100 and stop > 100 and (source = 'sample_a.bam' or category = 'Copia')")
def filter_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    """Wildcards in field names: ``?`` and ``[]`` one character, ``*`` any; under all every field must pass, and a name that no field has is false."""
    rows = sinks.feature_lines(dbican(spark, sf).select(*BY, "start", "stop", "n").withColumnRenamed("source", "sample"), "axisframe")
    f = lambda n: F.element_at("fields", F.lit(n))
    kept = keep_features(gff.parse_features(rows), all_of=["[n]>5", "[se][tn][ad]*>100"], any_of=["s?mple=sample_a.bam", "nothing*>1", "cat*=Copia"])
    return kept.select(f("seqid").alias("seqid"), f("start").cast("long").alias("start"), f("end").cast("long").alias("stop"), f("n").cast("long").alias("n"))


# --- files ------------------------------------------------------------------------------------------------------

_TAGGED = """tagged as (select *, ['Copia_1', 'Copia_Co07', 'Gypsy-2', 'LINE1'][pos % 4 + 1] as element from parts)"""


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    element = F.element_at(F.array(*map(F.lit, ("Copia_1", "Copia_Co07", "Gypsy-2", "LINE1"))), (F.col("pos") % 4 + 1).cast("int"))
    return V.sam(spark, sf).withColumn("tags", F.array(F.lit("NM:i:3"), F.concat(F.lit("ME:Z:"), element)))


@query(f"""with {V.SAM}, {_TAGGED}
  select rname as reference, case when rev then '-' else '+' end as strand, case when starts_with(element, 'Copia_Co') then 'Copia_Co' when starts_with(element, 'Copia') then 'Copia' else 'Gypsy' end as category,
         source, case when rev then pos else pos + span - 1 end as tip, element
  from tagged where not un and mapq >= 30 and not starts_with(element, 'LINE') and (rname = 'm4' or (rname = 'm3' and pos <= 900 and pos + span - 1 >= 100))""")
def read_tips(spark: SparkSession, sf: str) -> DataFrame:
    """Tips of two regions, one of them a stretch of a reference."""
    return sam.read_tips(_tagged(spark, sf), ["Copia", "Copia_Co", "Gypsy"], 30, ["m3:100-900", "m4"])


@query(f"""with {V.SAM}, {_TAGGED} select qname, flag::integer as flag, rname, pos, mapq::integer as mapq, cigar, case when rnext = rname then '=' else rnext end as rnext, pnext, seq, qual, 'ME:Z:' || element as tag from tagged""")
def bam_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as BAM files by all tasks and read again in splits far smaller than the files."""
    bam.register(spark)
    path = f"{scratch(spark)}/{uuid.uuid4().hex}.bam"
    bam.write_bam(_tagged(spark, sf), path, [(f"m{i}", 10**9) for i in range(7)])
    rows = spark.read.format("bam").option("splitbytes", 1 << 18).load(path)
    return rows.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "seq", "qual", F.element_at("tags", -1).alias("tag"))


@query("select row_number() over (order by reference) - 1 as ord, reference, ref_length from refs")
def reference_list(spark: SparkSession, sf: str) -> DataFrame:
    """The reference list of a BAM file and of a SAM file, which must agree; a header is a list the driver holds by definition."""
    listed = [(r.reference, r.ref_length) for r in table(spark, sf, "refs").select("reference", "ref_length").orderBy("reference").collect()]
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    place(folder)[0].create_dir(place(folder)[1])
    bam.write_file(f"{folder}/a.bam", bam.sq_lines(listed), listed, [])
    with place(folder)[0].open_output_stream(place(folder)[1] + "/b.sam") as f:
        f.write(bam.sq_lines(listed).encode())
    alignments.common_references(spark, f"{folder}/a.bam", f"{folder}/b.sam")
    return alignments.references(spark, f"{folder}/a.bam").select(F.col("ord").cast("long").alias("ord"), "reference", "ref_length")


@query(f"""with {V.TIPS}, {_flat('tips', _H)} select reference || chr(9) || 'axisframe' || chr(9) || '.' || chr(9) || start || chr(9) || stop || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9)
  || 'category=' || category || ';n=' || n || ';sample=' || source as value from flat""")
def format_features(spark: SparkSession, sf: str) -> DataFrame:
    """Lines parsed to fields and written again, the attributes in order of name."""
    rows = sinks.feature_lines(dbican(spark, sf).select("n", *BY, "start", "stop").withColumnRenamed("source", "sample"), "axisframe")
    return gff.format_features(gff.parse_features(rows)).select("value")


@query("select 'copies' as pair, true as same union all select 'one row less', false")
def same_loci(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.loci(spark, sf)
    first = rows.agg(F.min("locus_id")).scalar()
    return spark.createDataFrame([("copies", headers.same_loci(rows, rows.select(*reversed(rows.columns)))), ("one row less", headers.same_loci(rows, rows.where(F.col("locus_id") != first)))], "pair string, same boolean")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

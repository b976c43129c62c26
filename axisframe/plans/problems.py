"""Registered queries of the general data-processing operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.operators.coverage import periods_and_gaps
from axisframe.operators.packed import packed_values
from axisframe.operators.skew import count_and_median
from axisframe.operators.validation import clean_rows, rule_errors
from axisframe.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = periods_and_gaps(table(spark, sf, "loci"), ["reference", "strand"])
    return rows.select("kind", "reference", "strand", "first_pos", "last_pos")


def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Positions covered and free per axis."""
    rows = periods_and_gaps(table(spark, sf, "loci"), ["reference", "strand"])
    length = F.col("last_pos") - F.col("first_pos") + 1
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, length)), F.lit(0))
    return rows.groupBy("reference", "strand").agg(of("period").alias("covered"), of("gap").alias("free"), F.count(F.when(F.col("kind") == "period", 1)).alias("n_periods"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "read_tips").select("read_id", "reference", F.coalesce("me", F.lit(".")).alias("me"), "tip").where("reference is not null")
    return count_and_median(reads, ["reference", "me"], "tip", "read_id", "n_reads", "median_tip")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_values(table(spark, sf, "gff"), "gff_id", "attributes")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rule_errors(table(spark, sf, "gff_lines"), "line_id", "line", table(spark, sf, "refs").select("reference"))


def p4_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_rows(table(spark, sf, "gff_lines"), "line_id", "line", table(spark, sf, "refs").select("reference"))


P1_PERIODS = """
  valid as (
    select distinct reference, strand, start, stop from loci
    where reference is not null and strand is not null and start <= stop),
  reach as (
    select *, max(stop) over (partition by reference, strand order by start, stop
                              rows between unbounded preceding and 1 preceding) as pm from valid),
  islands as (
    select *, sum(case when pm is null or start > pm then 1 else 0 end)
              over (partition by reference, strand order by start, stop rows unbounded preceding) as k from reach),
  periods as (
    select reference, strand, min(start) as first_pos, max(stop) as last_pos from islands group by reference, strand, k),
  ahead as (
    select *, lead(first_pos) over (partition by reference, strand order by first_pos) as nxt from periods),
  found as (
    select 'period' as kind, reference, strand, first_pos, last_pos from periods
    union all
    select 'gap', reference, strand, last_pos + 1, nxt - 1 from ahead where nxt - last_pos > 1)
"""

#: A reader of the notation that takes one entry's head or one value off the front of each field at a time.
P3_FOUND = r"""
  with recursive walk as (
    select gff_id, a as rest, '' as key, false as named, false as inside, 0 as pos, null::varchar as value
    from (select distinct gff_id, attributes as a from gff where attributes is not null and trim(attributes, ' ') not in ('', '.'))
    union all
    select gff_id,
           case when not inside then after_key when regexp_matches(after_value, '^[;&|\t\n\r,]') then substr(after_value, 2) else after_value end,
           case when inside then key else head end,
           case when inside then named else equal end,
           case when inside then not regexp_matches(after_value, '^[;&|\t\n\r]') else equal or (after_key <> '' and not regexp_matches(after_key, '^[;&|\t\n\r]')) end,
           case when inside and key <> '' then pos + 1 else pos end,
           case when inside and key <> '' then url_decode(replace(replace(body, chr(92) || mark, mark), mark || mark, mark) || rtrim(bare, ' ')) end
    from walk,
    lateral (select regexp_replace(rest, '^[;&|\t\n\r ]+', '') as t),
    lateral (select regexp_extract(t, '^([^;&|\t\n\r=]*)=', 1) as before),
    lateral (select regexp_matches(t, '^[^;&|\t\n\r=]*=') and not regexp_matches(before, '[ ,][\x22\x27]') as equal),
    lateral (select case when equal then trim(before, ' ') else regexp_extract(t, '^[^;&|\t\n\r ,]*') end as head),
    lateral (select case when equal then substr(t, length(before) + 2) else ltrim(substr(t, length(head) + 1), ' ') end as after_key),
    lateral (select ltrim(rest, ' ') as x),
    lateral (select case when left(x, 1) in (chr(34), chr(39)) then left(x, 1) else chr(0) end as mark),
    lateral (select case mark when chr(34) then regexp_extract(x, '^\x22(?:\\\x22|\x22\x22|[^\x22])*(?:\x22|$)') when chr(39) then regexp_extract(x, '^\x27(?:\\\x27|\x27\x27|[^\x27])*(?:\x27|$)') else '' end as q),
    lateral (select case mark when chr(34) then regexp_extract(x, '^\x22((?:\\\x22|\x22\x22|[^\x22])*)(?:\x22|$)', 1) when chr(39) then regexp_extract(x, '^\x27((?:\\\x27|\x27\x27|[^\x27])*)(?:\x27|$)', 1) else '' end as body),
    lateral (select regexp_extract(substr(x, length(q) + 1), case when named then '^[^;&|\t\n\r,]*' else '^[^;&|\t\n\r ,]*' end) as bare),
    lateral (select ltrim(substr(x, length(q) + length(bare) + 1), ' ') as after_value)
    where rest <> '')
  select gff_id, pos::integer as pos, key as attr_key, value as attr_value from walk where value <> ''
"""

P4_FOUND = """
  cells as (select line_id, line, string_split(line, chr(9)) as c from gff_lines
            where line is not null and trim(line, chr(9) || chr(10) || chr(13) || ' ') <> '' and line not like '#%'),
  judged as (
    select line_id, line, case
      when len(c) <> 9 then 'columns'
      when c[1] not in (select reference from refs) then 'seqid'
      when not regexp_full_match(c[4], '[0-9]+') or try_cast(c[4] as hugeint) < 1
           or coalesce(regexp_full_match(c[5], '[0-9]+') and try_cast(c[4] as hugeint) > try_cast(c[5] as hugeint), false) then 'start'
      when (length(c[9]) - length(replace(c[9], '"', ''))) % 2 = 1 then 'quoting' end as reason, c
    from cells)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p3_found, p4_found, p4_clean)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {P1_PERIODS} select * from found",
        "p1_coverage": f"""with {P1_PERIODS}
            select reference, strand,
                   cast(coalesce(sum(last_pos - first_pos + 1) filter (kind = 'period'), 0) as bigint) as covered,
                   cast(coalesce(sum(last_pos - first_pos + 1) filter (kind = 'gap'), 0) as bigint) as free,
                   count(*) filter (kind = 'period') as n_periods
            from found group by reference, strand""",
        "p2_found": """
            with once as (select distinct read_id, reference, coalesce(me, '.') as me, tip from read_tips
                          where reference is not null and tip is not null)
            select reference, me, count(*) as n_reads, cast(trunc(median(tip)) as bigint) as median_tip
            from once group by reference, me""",
        "p3_found": P3_FOUND,
        "p4_found": f"with {P4_FOUND} select line_id, reason from judged where reason is not null",
        "p4_clean": f"""with {P4_FOUND}
            select line_id, c[1] as seqid, c[2] as source, c[3] as type, cast(c[4] as bigint) as start, try_cast(c[5] as bigint) as end_pos,
                   c[6] as score, c[7] as strand, c[8] as phase, regexp_replace(c[9], '\\r+$', '') as attributes
            from judged where reason is null""",
    }

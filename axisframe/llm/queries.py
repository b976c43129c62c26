"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from axisframe.llm.communities import similarity_clusters
from axisframe.llm.mixing import mixture, mixture_in_characters
from axisframe.llm.spans import shared_characters
from axisframe.llm.tokenizer import encode_corpus
from axisframe.session import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = similarity_clusters(table(spark, sf, "read_tips"), ["reference", "strand"], "tip", "read_id", radius=60, members=5)
    return found.selectExpr("reference", "strand", "first as first_tip", "last as last_tip", "n as n_reads", "typical as typical_tip")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p7_characters(spark: SparkSession, sf: str) -> DataFrame:
    return mixture_in_characters(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_character_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixture_in_characters(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]
    return rows.select("source", "target_share", "available", "tokens", "n_documents", "most_repeats", "actual_share")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_characters(table(spark, sf, "documents"))


MIXED = """
            with sized as (
              select doc_id, source, n_chars as n,
                     greatest(coalesce(list_avg(list_filter(list_transform(boxes, lambda b: b.conf::double), lambda c: c is not null and not isnan(c))), 0.5), 0.01) as w
              from documents where source in (select source from mix_targets) and n_chars > 0),
            keyed as (select *, -ln((('0x' || substr(md5('7:' || doc_id), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / w as key from sized),
            held as (select t.source, t.target_share, t.max_repeats, coalesce(sum(s.n), 0)::bigint as available from mix_targets t left join sized s on s.source = t.source group by all),
            planned as (select *, (sum(available) over ())::double * target_share as budget from held),
            epochs as (select *, case when available > 0 then least(floor(budget / available)::bigint, max_repeats) else 0 end as epochs from planned),
            rest as (select *, case when epochs < max_repeats then budget - epochs * available else 0.0 end as rest from epochs),
            summed as (select *, sum(n) over (partition by source order by key, doc_id rows unbounded preceding) as upto from keyed),
            drawn as (
              select s.doc_id, s.source, s.n as n_tokens, (r.epochs + case when s.upto - s.n / 2 < r.rest then 1 else 0 end)::integer as n_times
              from summed s join rest r on r.source = s.source)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p5_found, p6_ids, p7_mixture, p7_shares, p7_characters, p7_character_shares, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_characters": f"{MIXED} select * from drawn where n_times > 0",
        "p7_character_shares": f"""{MIXED},
            reached as (select source, sum(n_tokens * n_times)::bigint as tokens, count(*) as n_documents, max(n_times) as most_repeats from drawn where n_times > 0 group by source)
            select r.source, r.target_share, r.available, coalesce(x.tokens, 0)::bigint as tokens, coalesce(x.n_documents, 0) as n_documents, coalesce(x.most_repeats, 0)::integer as most_repeats,
                   coalesce(x.tokens, 0) / sum(coalesce(x.tokens, 0)) over () as actual_share
            from rest r left join reached x on x.source = r.source""",
        "p5_found": """
            with once as (
              select distinct read_id, reference, strand, tip from read_tips
              where reference is not null and strand is not null and tip is not null),
            placed as (
              select *, row_number() over w as i, lead(tip, 4) over w as hi from once
              window w as (partition by reference, strand order by tip, read_id)),
            fives as (select * from placed where hi - tip <= 60),
            broken as (
              select *, case when i - lag(i) over (partition by reference, strand order by i) < 5 then 0 else 1 end as brk from fives),
            chained as (select *, sum(brk) over (partition by reference, strand order by i rows unbounded preceding) as k from broken),
            found as (
              select reference, strand, min(tip) as first_tip, max(hi) as last_tip, max(i) - min(i) + 5 as n_reads,
                     (min(i) + max(i) + 4) // 2 as middle
              from chained group by reference, strand, k)
            select f.reference, f.strand, f.first_tip, f.last_tip, f.n_reads, m.tip as typical_tip
            from found f join placed m on m.reference = f.reference and m.strand = f.strand and m.i = f.middle""",
    }

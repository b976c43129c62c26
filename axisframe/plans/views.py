"""The test tables as inputs of the operators, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.functions.predicates import category_of
from axisframe.session import table

#: The element families of the test tables; one is a prefix of another, so the longest must win.
CATEGORIES = ["CACTA", "Copia", "Copia_Co0", "Gypsy", "Gypsy_Gy1", "hAT", "Helitron", "LINE", "MULE", "PIF", "SINE"]
MIN_POINTS, EPSILON, BUFFER, DISTANCE = 5, 400, 50, 100


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "read_tips").select("read_id", "reference", "strand", "category", "source", "tip", F.col("me").alias("element"))
    return reads.dropna("any").where("strand <> '.'")


def tips(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with no null part, each delivery once."""
    return _reads(spark, sf).distinct().drop("read_id")


def n_sources(spark: SparkSession, sf: str) -> int:
    return _reads(spark, sf).select("source").distinct().count()


TIPS = """tips as (
  select distinct read_id, reference, strand, category, source, tip, me as element from read_tips
  where reference is not null and strand <> '.' and category is not null and source is not null and tip is not null and me is not null)"""


def loci(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "loci").dropna("any").where("start <= stop")
    return rows.select("locus_id", "reference", "strand", "category", "source", "start", "stop").distinct()


LOCI = """places as (
  select distinct locus_id, reference, strand, category, source, start, stop from loci
  where reference is not null and strand is not null and category is not null and source is not null and start <= stop)"""


def known(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated features whose type names an element, in order of their id."""
    rows = table(spark, sf, "gff").select("gff_id", "seqid", "type", "start", "end_pos").dropna("any").dropDuplicates(["gff_id"])
    rows = rows.withColumn("category", category_of("type", CATEGORIES)).where("category is not null")
    return rows.select(F.col("seqid").alias("reference"), F.when(F.col("category") == "Copia_Co0", "Copia").when(F.col("category") == "Gypsy_Gy1", "Gypsy").otherwise(F.col("category")).alias("category"), F.lit(".").alias("source"), "start", F.col("end_pos").alias("stop"), F.col("type").alias("element"), F.col("gff_id").alias("ord"))


_LONGEST = "case " + " ".join(f"when starts_with({{0}}, '{c}') then '{c}'" for c in sorted(CATEGORIES, key=lambda c: (-len(c), c))) + " end"
KNOWN = f"""known as (
  select distinct seqid as reference, case c when 'Copia_Co0' then 'Copia' when 'Gypsy_Gy1' then 'Gypsy' else c end as category,
         start, end_pos as stop, type as element, gff_id as ord
  from (select *, {_LONGEST.format("type")} as c from gff) where c is not null and seqid is not null and start is not null and end_pos is not null)"""

#: Fixed values of the synthetic alignments: flags and CIGAR strings as in paired reads against a repeat library.
FLAGS = [133, 69, 117, 181, 99, 147, 73, 137, 83, 163, 2169, 77, 97, 99, 65]
CIGARS = ["40S60M", "100M", "10S90M", "55M45S", "5S54M41S", "44M1I55M", "38S62M"]


def sam(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments made from lineitem: every row is one read, sequences come from digests."""
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    key = F.concat_ws(":", F.col("l_orderkey"), F.col("l_linenumber"))
    text = F.concat(*(F.md5(F.concat(key, F.lit(str(i)))) for i in range(4))).substr(1, 100)
    number = F.col("l_orderkey") + F.col("l_linenumber")
    cigar = F.when(at(FLAGS, number).bitwiseAND(F.lit(4)) != 0, "*").otherwise(at(CIGARS, F.col("l_partkey")))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), key).alias("qname"), at(FLAGS, number).alias("flag"), F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("rname"),
        F.col("l_partkey").alias("pos"), (F.col("l_suppkey") % 60).cast("int").alias("mapq"), cigar.alias("cigar"),
        F.when(F.col("l_linenumber") % 2 == 0, "=").otherwise(F.concat(F.lit("m"), F.col("l_orderkey") % 7)).alias("rnext"),
        (F.col("l_partkey") + 90 + F.col("l_orderkey") % 900).alias("pnext"), F.lit(0).cast("long").alias("tlen"),
        F.translate(text, "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"), text.alias("qual"),
        F.array().cast("array<string>").alias("tags"), F.concat(F.lit("s"), F.col("l_orderkey") % 3).alias("source"),
    )


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_TEXT = "substr(" + " || ".join(f"md5(l_orderkey || ':' || l_linenumber || '{i}')" for i in range(4)) + ", 1, 100)"
SAM = f"""raw as (
  select 'r' || l_orderkey || ':' || l_linenumber as qname,
         {_list(FLAGS)}[(l_orderkey + l_linenumber) % {len(FLAGS)} + 1] as flag, 'm' || (l_suppkey % 7) as rname, l_partkey as pos,
         l_suppkey % 60 as mapq, {_list(CIGARS)}[l_partkey % {len(CIGARS)} + 1] as c,
         case when l_linenumber % 2 = 0 then '=' else 'm' || (l_orderkey % 7) end as rnext,
         l_partkey + 90 + l_orderkey % 900 as pnext, {_TEXT} as qual, 's' || (l_orderkey % 3) as source
  from lineitem),
sam as (
  select *, case when flag & 4 <> 0 then '*' else c end as cigar, translate(qual, '0123456789abcdef', 'ACGTACGTACGTACGN') as seq from raw),
parts as (
  select *, case when cigar = '*' then 0 else list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: cast(x as int)))::bigint end as span,
         coalesce(try_cast(regexp_extract(cigar, '^([0-9]+)S', 1) as int), 0) as head,
         coalesce(try_cast(regexp_extract(cigar, '([0-9]+)S$', 1) as int), 0) as tail,
         flag & 16 <> 0 as rev, flag & 4 <> 0 as un, flag & 8 <> 0 as mateun, flag & 2 <> 0 as proper
  from sam)"""

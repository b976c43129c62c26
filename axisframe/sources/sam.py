"""SAM text as DataFrames: header, records, read tips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.functions import predicates as P
from axisframe.functions.text import basename, before_colon, cigar_span
from axisframe.operators.categorise import categorise
from axisframe.schema import SAM_COLUMNS


def sam_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, source) of all lines; ``.gz`` and ``.bz2`` are unpacked by name."""
    return spark.read.text(list(paths)).select("value", basename(F.col("_metadata.file_path")).alias("source"))


def references(lines: DataFrame) -> DataFrame:
    """(source, reference) of the header."""
    rows = lines.where(F.col("value").startswith("@SQ\t"))
    return rows.select("source", F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("reference"))


def parse_records(lines: DataFrame) -> DataFrame:
    """Records with typed columns, ``tags`` and ``source``."""
    cells = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("c"), "source")
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    columns = [F.get("c", F.lit(i)).try_cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(SAM_COLUMNS)]
    return cells.select(*columns, F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0))).alias("tags"), "source")


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_records(sam_lines(spark, *paths))


def tag_value(tag: str, strict: bool = False) -> Column:
    """Value of a text tag; a record without it is an error if ``strict``, else null."""
    found = F.get(F.filter("tags", lambda t: t.startswith(f"{tag}:")), F.lit(0))
    value = F.regexp_replace(found, "^[^:]*:[^:]*:", "")
    if strict:
        return F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"no tag {tag} in read "), F.col("qname")))).otherwise(value)
    return value


def aligned_reads(sam: DataFrame, quality: int = 0, regions: list[str] | None = None, tag: str = "ME") -> DataFrame:
    """reference, strand, start, stop, source, element of mapped reads; ``regions`` are names or name:start-stop."""
    rows = sam.where(~P.has_flag(P.UNMAPPED) & (F.col("rname") != "*") & P.mapped_well(quality))
    rows = rows.withColumns({"start": F.col("pos"), "stop": F.col("pos") + cigar_span("cigar") - 1})
    if regions is not None:
        rows = rows.where(P.disjunction([in_region(r) for r in regions]))
    strand = F.when(P.has_flag(P.REVERSE), "-").otherwise("+")
    return rows.select(F.col("rname").alias("reference"), strand.alias("strand"), "start", "stop", "source", tag_value(tag).alias("element"))


def in_region(region: str, name: str = "rname", start: str = "start", stop: str = "stop") -> Column:
    """Reads of a reference, or those that overlap reference:start-stop."""
    wanted, _, span = region.partition(":")
    if not span:
        return F.col(name) == wanted
    low, _, high = span.replace(",", "").partition("-")
    inside = (F.col(name) == wanted) & (F.col(stop) >= int(low))
    return inside & (F.col(start) <= int(high)) if high else inside


def region_name(region: str | Column) -> Column:
    return before_colon(F.lit(region) if isinstance(region, str) else region)


def read_tips(sam: DataFrame, categories: list[str] | DataFrame, quality: int = 0, regions: list[str] | None = None, tag: str = "ME") -> DataFrame:
    """reference, strand, category, source, tip, element of reads whose element starts with a category."""
    rows = categorise(aligned_reads(sam, quality, regions, tag), "element", categories)
    return rows.select("reference", "strand", "category", "source", P.tip().alias("tip"), "element")


def line_of() -> Column:
    """SAM text of a record."""
    return F.concat_ws("\t", *(F.col(c).cast("string") for c in SAM_COLUMNS), F.when(F.size("tags") > 0, F.array_join("tags", "\t")))


def to_lines(records: DataFrame) -> DataFrame:
    return records.select(line_of().alias("value"))

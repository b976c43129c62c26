"""GFF3 text as DataFrames: features with named fields, and annotation intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.functions.text import decode_column
from axisframe.operators.categorise import categorise
from axisframe.schema import GFF_COLUMNS


def gff_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, ord): lines with a number that rises within each file."""
    return spark.read.text(list(paths)).withColumn("ord", F.monotonically_increasing_id())


def is_feature(line: str = "value"):
    return ~F.col(line).startswith("#") & (F.trim(line) != "")


def parse_features(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``fields``: a map of the eight columns and the attributes; columns win over attributes of their name.

    Lines are cut at any white space and attributes at ``;`` and ``=``, as the tool reads its own output; the last
    of repeated attributes wins. Comment and blank lines are left out.
    """
    cells = F.split(F.trim(F.regexp_replace(F.col(value), "[\r\n]+$", "")), "\\s+")
    rows = lines.where(is_feature(value)).withColumn("_c", cells)
    attributes = F.filter(F.split(F.coalesce(F.get("_c", F.lit(8)), F.lit("")), ";"), lambda a: (a != "") & ~F.substring_index(a, "=", 1).isin(*GFF_COLUMNS[:8]))
    pairs = F.transform(attributes, lambda a: F.struct(F.substring_index(a, "=", 1).alias("k"), F.get(F.split(a, "="), F.lit(1)).alias("v")))
    columns = F.array(*(F.struct(F.lit(n).alias("k"), F.get("_c", F.lit(i)).alias("v")) for i, n in enumerate(GFF_COLUMNS[:8])))
    rows = rows.withColumn("_a", pairs)
    names = F.transform("_a", lambda e: e["k"])
    # Only a line that repeats an attribute needs the search for the last one of each name.
    later = lambda i: F.slice("_a", i + 2, F.size("_a"))
    last = F.filter("_a", lambda e, i: F.forall(later(i), lambda x: x["k"] != e["k"]))
    kept = F.when(F.size(F.array_distinct(names)) == F.size("_a"), F.col("_a")).otherwise(last)
    return rows.withColumn("fields", F.map_from_entries(F.concat(kept, columns))).drop("_c", "_a")


def annotation_intervals(lines: DataFrame, categories: list[str] | DataFrame, references: list[str] | None = None, value: str = "value") -> DataFrame:
    """reference, category, source '.', start, stop, element, ord of features whose type starts with a category."""
    cells = lines.where(is_feature(value)).select("ord", F.split(value, "\t").alias("c"))
    rows = cells.select(decode_column(F.get("c", F.lit(0))).alias("reference"), decode_column(F.get("c", F.lit(2))).alias("element"), F.get("c", F.lit(3)).try_cast("long").alias("start"), F.get("c", F.lit(4)).try_cast("long").alias("stop"), "ord")
    if references is not None:
        rows = rows.where(F.col("reference").isin([r.partition(":")[0] for r in references]))
    rows = categorise(rows, "element", categories)
    return rows.select("reference", "category", F.lit(".").alias("source"), "start", "stop", "element", "ord")


def format_features(features: DataFrame, fields: str = "fields") -> DataFrame:
    """Lines of features: the eight columns, then the other fields in order of name."""
    m = F.col(fields)
    columns = [F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(".")) for n in GFF_COLUMNS[:8]]
    rest = F.map_filter(m, lambda k, _: ~k.isin(*GFF_COLUMNS[:8]))
    pairs = F.transform(F.array_sort(F.map_keys(rest)), lambda k: F.concat(k, F.lit("="), F.element_at(rest, k)))
    return features.withColumn("value", F.concat_ws("\t", *columns, F.array_join(pairs, ";")))

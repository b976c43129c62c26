"""Assignment of names to categories by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.functions.predicates import category_of

#: Up to so many categories are one expression; more become a join on prefixes.
INLINE = 200


def categorise(df: DataFrame, name: str, categories: list[str] | DataFrame, out: str = "category") -> DataFrame:
    """Adds the longest category that ``name`` starts with; rows without one are dropped.

    A table of categories (one column) is joined on the prefix itself: each name gives one row per length that
    occurs among the categories, so this is an equi-join, never a comparison of all names with all categories.
    """
    if not isinstance(categories, DataFrame):
        if len(set(categories)) <= INLINE:
            return df.withColumn(out, category_of(name, categories)).where(F.col(out).isNotNull())
        categories = df.sparkSession.createDataFrame([(c,) for c in sorted(set(categories))], "category string")
    table = categories.select(F.col(categories.columns[0]).alias("_c")).where("_c is not null").distinct()
    sizes = table.agg(F.sort_array(F.collect_set(F.length("_c"))).alias("_sizes")).scalar()  # the lengths in use
    names = df.select(F.col(name).alias(name)).where(F.col(name).isNotNull()).distinct()
    parts = names.withColumn("_sizes", sizes)
    parts = parts.select(name, F.explode(F.transform(F.filter("_sizes", lambda n: n <= F.length(name)), lambda n: F.col(name).substr(F.lit(1), n))).alias("_c"))
    best = parts.join(table, "_c").groupBy(name).agg(F.max_by("_c", F.length("_c")).alias(out))
    return df.join(best, name).select(*df.columns, out)

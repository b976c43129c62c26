"""Counts, medians and most common elements of the points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.functions.text import SINGLE_COLOUR, proportion_colour
from axisframe.operators.coverage import BLOCK
from axisframe.operators.intervals import sweep
from axisframe.schema import MISSING


def dense_keys(*dimensions: DataFrame) -> DataFrame:
    """Every combination of small dimension tables, so that absent ones can be counted as zero."""
    keys = dimensions[0]
    for d in dimensions[1:]:
        keys = keys.crossJoin(d)
    return keys


def top_elements(tips: DataFrame, by: list[str], n: int, element: str = "element", at: str = "tip", weight: str | None = None) -> DataFrame:
    """by, ``elements``: the n most common elements, ties by the smallest (point, element); filled up with ('.', 0)."""
    c = tips.groupBy(*by, element).agg(F.sum(weight or F.lit(1)).cast("long").alias("_c"), F.min(at).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.col("_c").desc(), "_first", element)
    best = c.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    lists = best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_rank", F.col(element).alias("name"), F.col("_c").alias("count")))).alias("x"))
    return lists.select(*by, padded(F.transform("x", lambda e: F.struct(e["name"].alias("name"), e["count"].alias("count"))), n).alias("elements"))


def padded(elements: Column, n: int) -> Column:
    blank = F.struct(F.lit(MISSING).alias("name"), F.lit(0).cast("long").alias("count"))
    return F.slice(F.concat(elements, F.array_repeat(blank, n)), 1, n)


def points_in(tips: DataFrame, clusters: DataFrame, by: list[str], at: str = "tip", block: int = BLOCK) -> DataFrame:
    """Points with the disjoint interval they lie in."""
    return sweep(tips, clusters, by, at, block)


def count_reads(tips: DataFrame, clusters: DataFrame, by: list[str], n_elements: int = 0, trim: bool = True, block: int = BLOCK) -> DataFrame:
    """Per cluster: ``median`` (fraction dropped), ``samples`` (name, count[, element]) of every source, and trimmed ends.

    A source without points in a cluster counts zero; clusters without any point are left out. Points are
    counted per (position, source) before they meet the clusters, so copies of a position travel once.
    """
    sources = tips.select(F.col("source").alias("name")).where("name is not null").distinct()
    # A scalar: the list of sources is as long as the list of input files.
    names = sources.agg(F.sort_array(F.collect_list("name")).alias("_names"))
    parts = ["source", "tip"] + (["element"] if n_elements else [])
    weights = tips.groupBy(*by, *parts).agg(F.count(F.lit(1)).alias("_w"))
    cluster = [*by, "start", "stop"]
    # One exchange that all the aggregates below share.
    held = sweep(weights, clusters, by, "tip", block).repartition(*cluster)
    whole = held.groupBy(*cluster).agg(
        F.expr("percentile(tip, 0.5, _w)").cast("long").alias("median"), F.min("tip").alias("_first"), F.max("tip").alias("_last"),
    )
    counts = held.groupBy(*cluster, "source").agg(F.sum("_w").alias("count"))
    per = counts.groupBy(*cluster).agg(F.map_from_entries(F.collect_list(F.struct("source", "count"))).alias("_counts"))
    rows = whole.join(per, cluster)
    zero = F.lit(0).cast("long")
    count = lambda s: F.coalesce(F.try_element_at("_counts", s), zero)
    if n_elements:
        top = top_elements(held, [*cluster, "source"], n_elements, weight="_w")
        tops = top.groupBy(*cluster).agg(F.map_from_entries(F.collect_list(F.struct("source", "elements"))).alias("_tops"))
        rows = rows.join(tops, cluster, "left")
        none = padded(F.array().cast("array<struct<name:string,count:bigint>>"), n_elements)
        entry = lambda s: F.struct(s.alias("name"), count(s).alias("count"), F.coalesce(F.try_element_at("_tops", s), none).alias("element"))
    else:
        entry = lambda s: F.struct(s.alias("name"), count(s).alias("count"))
    rows = rows.withColumn("_names", names.scalar()).withColumn("samples", F.transform("_names", entry))
    start, stop = ("_first", "_last") if trim else ("start", "stop")
    return rows.select(*by, F.col(start).alias("start"), F.col(stop).alias("stop"), "median", "samples")


def proportions(counted: DataFrame) -> DataFrame:
    """Adds ``max_count_proportion`` and ``color``; one sample alone has proportion 1 and a colour of its own."""
    n = F.transform("samples", lambda s: s["count"])
    total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    alone = F.size("samples") <= 1
    share = F.when(alone, F.lit(1.0)).otherwise(F.array_max(n) / total)
    return counted.withColumn("max_count_proportion", share).withColumn("color", F.when(alone, F.lit(SINGLE_COLOUR)).otherwise(proportion_colour(F.col("max_count_proportion"))))


def flatten_samples(counted: DataFrame, n_sources: int, n_elements: int = 0) -> DataFrame:
    """Wide form: ``sample_i_name``, ``sample_i_count`` and ``sample_i_element_j_name`` / ``_count`` in place of ``samples``; more samples than ``n_sources`` are an error."""
    wide = []
    fits = F.when(F.size("samples") > n_sources, F.raise_error(F.lit(f"more than {n_sources} samples"))).otherwise(F.col("samples"))
    counted = counted.withColumn("samples", fits)
    for i in range(n_sources):
        s = F.get("samples", F.lit(i))
        wide += [s["name"].alias(f"sample_{i}_name"), s["count"].alias(f"sample_{i}_count")]
        for j in range(n_elements):
            e = F.get(s["element"], F.lit(j))
            wide += [e["name"].alias(f"sample_{i}_element_{j}_name"), e["count"].alias(f"sample_{i}_element_{j}_count")]
    out = []
    for c in counted.columns:
        out += wide if c == "samples" else [F.col(c)]
    return counted.select(*out)

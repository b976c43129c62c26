"""Known features, identifiers and pairs of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.operators.intervals import block_of
from axisframe.schema import MISSING


def contig_ids(df: DataFrame) -> DataFrame:
    """Adds ``ID``: category_reference_strand_position, the position being the end that points at the insertion."""
    return df.withColumn("ID", F.concat_ws("_", "category", "reference", "strand", F.when(F.col("strand") == "+", F.col("stop")).otherwise(F.col("start"))))


def match_known(clusters: DataFrame, known: DataFrame, distance: int = 0, block: int = 1 << 14) -> DataFrame:
    """Adds ``known_element``: on ``+`` the first known feature that starts in [median, stop + distance], on ``-`` the last that stops in [start - distance, median]; ``.`` if none.

    First and last go by ``ord``, the order of the annotation file. Equality on (reference, category) and on
    blocks of the axis keeps the range join from comparing all features of a reference. Clusters are known by their
    keys and ends.
    """
    own = ["reference", "strand", "category", "start", "stop", "median"]
    c = clusters
    plus = F.col("strand") == "+"
    lo = F.when(plus, F.col("median")).otherwise(F.col("start") - distance)
    hi = F.when(plus, F.col("stop") + distance).otherwise(F.col("median"))
    spans = c.select(*own, plus.alias("_plus"), lo.alias("_lo"), hi.alias("_hi")).where("_lo <= _hi")
    spans = spans.withColumn("_b", F.explode(F.sequence(block_of(F.col("_lo"), block), block_of(F.col("_hi"), block))))
    ends = known.select("reference", "category", "element", "ord", F.explode(F.array(F.struct(F.lit(True).alias("_plus"), F.col("start").alias("_at")), F.struct(F.lit(False).alias("_plus"), F.col("stop").alias("_at")))).alias("x"))
    ends = ends.select("reference", "category", "element", "ord", "x._plus", "x._at").withColumn("_b", block_of(F.col("_at"), block))
    hits = spans.join(ends, ["reference", "category", "_plus", "_b"]).where("_at between _lo and _hi").dropDuplicates([*own, "element", "ord"])
    best = hits.groupBy(*own).agg(F.when(F.first("_plus"), F.min_by("element", "ord")).otherwise(F.max_by("element", "ord")).alias("_known"))
    return c.join(best, own, "left").withColumn("known_element", F.coalesce("_known", F.lit(MISSING))).select(*clusters.columns, "known_element")


def pair(clusters: DataFrame, distance: int = 0, use_known: bool = False, known_match: str = "reference", block: int = 1 << 20) -> DataFrame:
    """Adds ``pair``: the ID of the cluster on the other strand that this one faces, or ``.``.

    Along (reference, category) in order of median, a ``-`` cluster pairs with the row right before it if that is
    ``+`` and they lie within twice the distance or share their known element. With ``known_match='reference'`` two
    clusters without a known element count as sharing ``.``; ``'strict'`` wants a real one.

    Neighbours are found within blocks of the axis; the row before a block's first comes from one row per block.
    """
    if known_match not in ("reference", "strict"):
        raise ValueError("known_match must be 'reference' or 'strict'")
    by = ["reference", "category"]
    fields = ["ID", "strand", "start", "stop"] + (["known_element"] if use_known else [])
    rows = clusters.withColumn("_b", block_of(F.col("median"), block)).withColumn("_me", F.struct(F.col("median").alias("_m"), *fields))
    inside = Window.partitionBy(*by, "_b").orderBy("median", "strand")
    rows = rows.withColumns({"_before": F.lag("_me").over(inside), "_after": F.lead("_me").over(inside)})
    order = F.struct("median", "strand")
    edges = rows.groupBy(*by, "_b").agg(F.min_by("_me", order).alias("_f"), F.max_by("_me", order).alias("_l"))
    axis = Window.partitionBy(*by).orderBy("_b")
    edges = edges.select(*by, "_b", F.lag("_l").over(axis).alias("_pl"), F.lead("_f").over(axis).alias("_nf"))
    rows = rows.join(edges, [*by, "_b"]).withColumns({"_before": F.coalesce("_before", "_pl"), "_after": F.coalesce("_after", "_nf")})

    def faces(f: str, r: str):
        near = F.col(f"{f}.stop") + distance >= F.col(f"{r}.start") - distance
        if use_known:
            a, b = F.col(f"{f}.known_element"), F.col(f"{r}.known_element")
            same = (a == b) & (a != "")
            near = near | (same & (a != MISSING) if known_match == "strict" else same)
        return (F.col(f"{f}.strand") == "+") & (F.col(f"{r}.strand") == "-") & near

    found = F.when(faces("_before", "_me"), F.col("_before.ID")).when(faces("_me", "_after"), F.col("_after.ID"))
    return rows.withColumn("pair", F.coalesce(found, F.lit(MISSING))).select(*clusters.columns, "pair")

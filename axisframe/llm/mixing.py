"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the key -ln(u) / w, with u fixed by its id and the seed and w its quality weight
(Efraimidis and Spirakis); the first documents in key order are a weighted sample. A source whose budget exceeds
its size is taken whole as often as it fits (complete epochs, at most its cap), and the rest of the budget is
filled in key order up to a prefix sum of sizes.

The prefix sum never runs over a whole source in one task: keys fall into ranges by their logarithm, range totals are
summed first, and only the range in which the budget ends is summed row by row. The logarithm of an exponential
variable has a density of at most 1/e whatever its weight, so no range of 1/256 of an octave is expected to hold more
than a thousandth of a source, however its weights are spread, and no statistics of the keys are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.llm.tokenizer import VOCABULARY, token_counts
from axisframe.session import cut

#: Ranges for each doubling of the key in the two-level prefix sum.
RANGES = 256
#: Most rows of a list of sources that is broadcast.
SOURCES = 100_000
#: Weight of a page none of whose lines has a confidence, and the least weight of any page.
UNKNOWN_WEIGHT, LEAST_WEIGHT = 0.5, 0.01


def confidence_weight(boxes: Column) -> Column:
    """Mean confidence of a page's lines: its quality weight."""
    known = F.filter(F.transform(boxes, lambda b: b["conf"].cast("double")), lambda c: c.isNotNull() & ~F.isnan(c))
    mean = F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)
    return F.greatest(F.coalesce(F.when(F.size(known) > 0, mean), F.lit(UNKNOWN_WEIGHT)), F.lit(LEAST_WEIGHT))


def sampling_key(row_id: str, weight: Column, seed: int) -> Column:
    """-ln(u) / weight; u from the first 52 bits of a digest of seed and id, so that any engine can draw the same."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def listed(df: DataFrame) -> DataFrame:
    """A table with a row for each source, to be broadcast if it is as short as such lists are."""
    return F.broadcast(df) if df.limit(SOURCES + 1).count() <= SOURCES else df


def budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: tokens there are, budget, complete epochs and tokens to fill by sampling.

    ``targets`` is one row per source, so the window over all of it is as short as the list of sources.
    """
    available = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = targets.select("source", "target_share", "max_repeats").join(available, "source", "left")
    rows = rows.withColumn("available", F.coalesce("available", F.lit(0)))
    rows = rows.withColumn("total", F.sum("available").over(Window.partitionBy()))
    rows = rows.withColumn("budget", F.col("total") * F.col("target_share"))
    fits = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)
    rows = rows.withColumn("epochs", F.least(fits, F.col("max_repeats")).cast("int"))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0)
    return rows.withColumn("rest", rest)


def draw(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, n_times) of every document that enters the mixture."""
    keyed = sized.join(listed(plan.select("source", "epochs", "rest")), "source").withColumn("key", sampling_key("doc_id", F.col("weight"), seed))
    keyed = keyed.withColumn("range", F.coalesce(F.floor(F.log2("key") * RANGES), F.lit(-(1 << 30))).cast("int"))
    totals = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"), F.first("rest").alias("rest"))
    axis = Window.partitionBy("source").orderBy("range")
    totals = totals.withColumn("before", F.sum("range_tokens").over(axis) - F.col("range_tokens"))
    # A range is taken whole, or not, or is the one in which the budget of its source ends: one row for each source says where.
    ends = totals.where("before < rest and before + range_tokens > rest").select("source", F.col("range").alias("edge"), "before")
    full = totals.where("before + range_tokens <= rest").groupBy("source").agg(F.max("range").alias("upto"))
    marks = full.join(ends, "source", "full")
    keyed = keyed.join(listed(cut(marks)), "source", "left")
    on_edge = F.coalesce(F.col("range") == F.col("edge"), F.lit(False))
    # Only that range is sorted; a document enters if more than half of it fits.
    inner = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = keyed.where(on_edge).withColumn("upto_here", F.col("before") + F.sum("n_tokens").over(inner))
    edge = edge.withColumn("extra", (F.col("upto_here") - F.col("n_tokens") / 2 < F.col("rest")).cast("int")).drop("upto_here")
    flat = keyed.where(~on_edge).withColumn("extra", F.coalesce(F.col("range") <= F.col("upto"), F.lit(False)).cast("int"))
    times = flat.unionByName(edge).withColumn("n_times", F.col("epochs") + F.col("extra"))
    return times.where("n_times > 0").select("doc_id", "source", "n_tokens", "n_times")


def weighted_documents(documents: DataFrame, targets: DataFrame, size: str) -> DataFrame:
    """(doc_id, source, size, weight) of the documents of listed sources."""
    rows = documents.select("doc_id", "source", size, confidence_weight(F.col("boxes")).alias("weight"))
    return rows.join(listed(targets.select("source")), "source", "left_semi")


def sized_documents(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, weight) of the documents of listed sources that have tokens."""
    packed = weighted_documents(documents, targets, "text").select(F.struct("doc_id", "source", "weight").alias("row"), "text")
    return cut(token_counts(packed, "row", "text", path).where("n_tokens > 0").select("row.*", "n_tokens"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture of ``sized`` = (doc_id, source, n_tokens, weight), a written table, and the shares its sources reach.

    The mixture is as large as all listed sources together. A source that
    cannot fill its budget within ``max_repeats`` stays below its share, which the report shows; its shortfall
    is not moved to other sources. Listed sources without documents appear in the report with no tokens. ``doc_id``
    should be unique: a repeated one counts as a document of its own with the same key.
    """
    plan = cut(budgets(sized, targets))
    drawn = draw(sized, plan, seed)
    reached = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_times")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("n_times").alias("most_repeats"))
    report = plan.join(reached, "source", "left").select(
        "source", "target_share", "available", F.round("budget").cast("long").alias("budget"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "n_documents", "most_repeats")),
    )
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())
    return drawn, report.withColumn("actual_share", F.coalesce(share, F.lit(0.0)))


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """:func:`mix` in tokens of the tokenizer at ``path``.

    Documents without tokens, without a source or of unlisted sources do not enter.
    """
    return mix(sized_documents(documents, targets, path), targets, seed)


def mixture_in_characters(documents: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """:func:`mix` with the characters of each document as its size."""
    rows = weighted_documents(documents, targets, "n_chars").where("n_chars > 0")
    return mix(cut(rows.select("doc_id", "source", "weight", F.col("n_chars").cast("long").alias("n_tokens"))), targets, seed)

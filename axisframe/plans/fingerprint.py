"""The whole job: read tips to described, annotated and paired clusters, and the extraction job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.operators.annotate import contig_ids, match_known, pair
from axisframe.operators.counts import count_reads, proportions
from axisframe.operators.density import clusters
from axisframe.operators.extract import clip_tips, informative_reads, name_elements
from axisframe.operators.intervals import union, union_buffered
from axisframe.schema import HEADER, require
from axisframe.session import cut

#: Fixed value: the program name in column 2 of feature lines.
PROGRAM = "axisframe"


def fingerprint(
    tips: DataFrame,
    min_points: int = 10,
    epsilon: int = 250,
    min_epsilon: int = 0,
    method: str = "SDBICAN",
    n_elements: int = 0,
    buffer: int = 0,
    known: DataFrame | None = None,
    distance: int = 0,
    colour: bool = True,
    known_match: str = "reference",
    n_sources: int | None = None,
) -> DataFrame:
    """Clusters per source, joined over sources, with counts, colours, known elements, IDs and pairs.

    ``tips`` has the columns of schema.TIPS. A reference is a key like any other: nothing runs per reference.
    ``n_sources`` (2 or more colours the clusters) is counted if not given.
    """
    require(tips, *HEADER, "tip", "element")
    by_source, by = list(HEADER), list(HEADER[:3])
    # Tips are read several times from here on, however they were made (parsed from text, deduplicated).
    tips = cut(tips.select(*by_source, "tip", "element"))
    found = clusters(tips, by_source, "tip", min_points, epsilon, min_epsilon, method)
    joined = union(union_buffered(found, by_source, buffer).select(*by, "start", "stop"), by)
    # Clusters are few beside the tips and used several times from here on.
    rows = cut(count_reads(tips, cut(joined), by, n_elements))
    if colour:
        n_sources = tips.select("source").distinct().count() if n_sources is None else n_sources
        if n_sources > 1:
            rows = proportions(rows)
    if known is not None:
        rows = match_known(rows, known, distance)
    return pair(contig_ids(rows), distance, use_known=known is not None, known_match=known_match)


def extraction(sam: DataFrame, tips: bool = False, tails: bool = True, full_length: bool = True, min_clip: int = 38) -> tuple[DataFrame, DataFrame]:
    """Informative reads to be aligned again, and the element of each name (tips win)."""
    reads = informative_reads(sam, tips, tails, full_length, min_clip)
    if not tips:
        return reads, name_elements(reads)
    found = clip_tips(sam, min_clip)
    return reads, name_elements(found, reads.join(found.select("name").distinct(), "name", "left_anti"))


def distinct_sources(tips: DataFrame) -> DataFrame:
    """(source, index): the sources in order of name."""
    from pyspark.sql import Window

    # One row per input file.
    return tips.select("source").distinct().withColumn("index", F.row_number().over(Window.orderBy("source")) - 1)

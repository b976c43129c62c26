"""Reads that point at insertions: clipped tips, danglers and clipped tails, and anchor pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.functions import predicates as P
from axisframe.functions.text import cigar_span, clip_at, clip_head, clip_tail, reverse_complement
from axisframe.operators.intervals import contained_length, union

MIN_CLIP = 38


def _reads(sam: DataFrame) -> DataFrame:
    """Neither secondary nor supplementary, with the parts that all rules need."""
    rows = sam.where(~P.has_flag(P.SECONDARY) & ~P.has_flag(P.SUPPLEMENTARY))
    return rows.withColumns({"_first": clip_at("cigar", False), "_last": clip_at("cigar", True), "_reverse": P.has_flag(P.REVERSE)})


def _informative(rows: DataFrame, element: Column, as_is: Column, sequence: tuple[Column, Column], quality: tuple[Column, Column]) -> DataFrame:
    """``as_is`` reads keep the first of each pair, the others take the second."""
    return rows.select(F.col("qname").alias("name"), element.alias("element"), F.when(as_is, sequence[0]).otherwise(sequence[1]).alias("sequence"), F.when(as_is, quality[0]).otherwise(quality[1]).alias("quality"))


def clip_tips(sam: DataFrame, min_clip: int = MIN_CLIP, strict: bool = False) -> DataFrame:
    """Clipped ends of mapped reads that point outwards from their element."""
    rows = _reads(sam).where(~P.has_flag(P.UNMAPPED) & P.has_flag(P.MATE_UNMAPPED))
    rows = rows.where((F.col("_reverse") & (F.col("_first") >= min_clip)) | (~F.col("_reverse") & (F.col("_last") >= min_clip)))
    head = clip_head("seq", F.col("_first"), strict), clip_head("qual", F.col("_first"), strict)
    tail = reverse_complement(clip_tail("seq", F.col("_last"))), F.reverse(clip_tail("qual", F.col("_last")))
    return _informative(rows, F.col("rname"), F.col("_reverse"), (head[0], tail[0]), (head[1], tail[1]))


def danglers(sam: DataFrame) -> DataFrame:
    """Unmapped reads whose mate lies in an element."""
    rows = _reads(sam).where(~P.has_flag(P.MATE_UNMAPPED) & P.has_flag(P.UNMAPPED))
    element = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    return _informative(rows, element, ~F.col("_reverse"), (F.col("seq"), reverse_complement("seq")), (F.col("qual"), F.reverse("qual")))


def clip_tails(sam: DataFrame, min_clip: int = MIN_CLIP, strict: bool = False, with_danglers: bool = True) -> DataFrame:
    """Clipped ends of properly paired reads that point back out of their element.

    ``with_danglers`` says that unmapped reads are taken as danglers already; without, one that is flagged as
    proper is looked at here.
    """
    rows = _reads(sam).where(~P.has_flag(P.MATE_UNMAPPED) & P.has_flag(P.PROPER))
    if with_danglers:
        rows = rows.where(~P.has_flag(P.UNMAPPED))
    rows = rows.where((F.col("_reverse") & (F.col("_last") >= min_clip)) | (~F.col("_reverse") & (F.col("_first") >= min_clip)))
    head = clip_head("seq", F.col("_first"), strict), clip_head("qual", F.col("_first"), strict)
    tail = reverse_complement(clip_tail("seq", F.col("_last"))), F.reverse(clip_tail("qual", F.col("_last")))
    return _informative(rows, F.col("rname"), ~F.col("_reverse"), (head[0], tail[0]), (head[1], tail[1]))


def informative_reads(sam: DataFrame, tips: bool = False, tails: bool = True, full_length: bool = True, min_clip: int = MIN_CLIP) -> DataFrame:
    """All informative reads; reads whose name gave a tip are not taken again."""
    reads = danglers(sam) if full_length else None
    if tails:
        more = clip_tails(sam, min_clip, with_danglers=full_length)
        reads = more if reads is None else reads.unionByName(more)
    if not tips:
        return reads if reads is not None else danglers(sam).limit(0)
    found = clip_tips(sam, min_clip)
    return found if reads is None else found.unionByName(reads.join(found.select("name").distinct(), "name", "left_anti"))


def name_elements(*sets: DataFrame) -> DataFrame:
    """(name, element), one row per name; earlier sets win, within a set the greatest element."""
    parts = [s.select("name", "element", F.lit(-i).alias("_p")) for i, s in enumerate(sets)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("name").agg(F.max_by("element", F.struct("_p", "element")).alias("element"))


def tag_reads(aligned: DataFrame, elements: DataFrame, tag: str = "ME", strict: bool = True) -> DataFrame:
    """Aligned reads with ``tags`` ending in the element of their name; a read without one is an error if ``strict``."""
    joined = aligned.join(elements.select(F.col("name").alias("qname"), F.col("element").alias("_e")), "qname", "left")
    text = F.concat(F.lit(f"{tag}:Z:"), F.col("_e"))
    if strict:
        text = F.when(F.col("_e").isNull(), F.raise_error(F.concat(F.lit("no element for "), F.col("qname")))).otherwise(text)
    return joined.withColumn("tags", F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(text))).drop("_e").select(*aligned.columns)


def anchor_intervals(sam: DataFrame, known: DataFrame, quality: int = 0, insert_size: int = 1000) -> DataFrame:
    """Stretches between the two reads of a pair that face each other, not longer than ``insert_size`` without known features: reference, source, ``start``, ``stop``, merged."""
    stop = F.col("pos") + cigar_span("cigar") - 1
    same = (F.col("rnext") == "=") | (F.col("rnext") == F.col("rname"))
    facing = [P.has_flag(P.PAIRED), P.has_flag(P.READ1), ~P.has_flag(P.UNMAPPED), ~P.has_flag(P.MATE_UNMAPPED), ~P.has_flag(P.REVERSE), P.has_flag(P.MATE_REVERSE), same, P.mapped_well(quality)]
    rows = sam.where(P.conjunction(facing)).withColumn("_stop", stop.cast("long")).where("pnext - 1 > _stop")
    anchors = rows.select(F.col("rname").alias("reference"), "source", F.col("_stop").alias("start"), F.col("pnext").cast("long").alias("stop"))
    # Equal anchors are one: they have the same known features inside, and the union does not count.
    # One longer than the insert and all known features of its reference together cannot pass: it is not laid out in blocks.
    all_known = known.groupBy(F.col("reference").alias("_r")).agg(F.sum(F.greatest(P.length(), F.lit(0))).alias("_all"))
    near = anchors.distinct().join(all_known, F.col("reference") == F.col("_r"), "left").where(P.length() - F.coalesce("_all", F.lit(0)) <= insert_size)
    anchors = contained_length(near.select("reference", "source", "start", "stop"), known, ["reference"])
    return union(anchors.where(P.length() - F.col("contained") <= insert_size), ["reference", "source"])

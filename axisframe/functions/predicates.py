"""Predicates on reads, intervals and categories as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a SAM flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, SECONDARY, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x100, 0x800


def has_flag(bit: int, flag: str | Column = "flag") -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(F.lit(bit)) != 0


def mapped_well(quality: int) -> Column:
    return F.col("mapq") >= quality


def contains(lo: Column, hi: Column, start: Column, stop: Column) -> Column:
    """[start, stop] lies inside [lo, hi]."""
    return (lo <= start) & (stop <= hi)


def within(lo: Column, hi: Column, start: Column, stop: Column) -> Column:
    """[lo, hi] lies inside [start, stop]."""
    return (start <= lo) & (hi <= stop)


def intersects_lower(lo: Column, hi: Column, start: Column, stop: Column) -> Column:
    return (lo <= start) & (start <= hi)


def intersects_upper(lo: Column, hi: Column, start: Column, stop: Column) -> Column:
    return (lo <= stop) & (stop <= hi)


def intersects(lo: Column, hi: Column, start: Column, stop: Column) -> Column:
    """An end of [lo, hi] lies in [start, stop]; false where [start, stop] lies strictly inside, see :func:`overlaps`."""
    return ((start <= hi) & (hi <= stop)) | ((start <= lo) & (lo <= stop))


def overlaps(lo: Column, hi: Column, start: Column, stop: Column) -> Column:
    return (lo <= stop) & (start <= hi)


def length(start: str | Column = "start", stop: str | Column = "stop") -> Column:
    start, stop = (F.col(c) if isinstance(c, str) else c for c in (start, stop))
    return stop - start + 1


def tip(strand: str | Column = "strand", start: str | Column = "start", stop: str | Column = "stop") -> Column:
    """The end of a read that points at its insertion."""
    strand, start, stop = (F.col(c) if isinstance(c, str) else c for c in (strand, start, stop))
    return F.when(strand == "-", start).otherwise(stop)


def category_of(name: str | Column, categories: list[str]) -> Column:
    """The longest category that the name starts with, or null."""
    name = F.col(name) if isinstance(name, str) else name
    best = sorted(set(categories), key=lambda c: (-len(c), c))
    if not best:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.when(name.startswith(c), F.lit(c)) for c in best))


def conjunction(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def disjunction(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))

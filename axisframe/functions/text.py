"""Sequence, CIGAR, escaping and colour functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes of a GFF3 column, and those of an attribute besides; the percent sign comes first.
COLUMN_ESCAPES = [("%", "%25"), ("\t", "%09"), ("\r", "%0D")]
ATTRIBUTE_ESCAPES = [*COLUMN_ESCAPES, (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C")]

#: The strict form also escapes line feeds, so that no value breaks its line.
LINE_ESCAPES = [("\n", "%0A")]

#: Colour of a feature by the tenths of its largest sample's share, and that of a single sample.
PROPORTION_COLOURS = {
    0: "#C6DBEF",
    1: "#C6DBEF",
    2: "#C6DBEF",
    3: "#C6DBEF",
    4: "#C6DBEF",
    5: "#C6DBEF",
    6: "#9ECAE1",
    7: "#6BAED6",
    8: "#2171B5",
    9: "#08306B",
    10: "#08306B",
}
SINGLE_COLOUR = "#0112b6"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(sequence: str | Column) -> Column:
    return F.reverse(F.translate(F.upper(_col(sequence)), "ACGT", "TGCA"))


def clip_head(sequence: str | Column, clip: Column, strict: bool = False) -> Column:
    """The clipped beginning; like the tool it replaces one base more than the clip, unless ``strict``."""
    return _col(sequence).substr(F.lit(1), clip if strict else clip + 1)


def clip_tail(sequence: str | Column, clip: Column) -> Column:
    return F.right(_col(sequence), clip)


def cigar_ops(cigar: str | Column) -> Column:
    """Operations of a CIGAR string: array of struct(n, op)."""
    c = _col(cigar)
    counts = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)[MIDNSHP=X]"), 1), lambda x: x.cast("int"))
    kinds = F.regexp_extract_all(c, F.lit("[0-9]+([MIDNSHP=X])"), 1)
    return F.zip_with(counts, kinds, lambda n, o: F.struct(n.alias("n"), o.alias("op")))


def cigar_span(cigar: str | Column) -> Column:
    """Reference positions the alignment covers; soft clips do not count."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda a, x: a + x["n"])


def clip_at(cigar: str | Column, last: bool) -> Column:
    """Length of the soft clip at one end, 0 if there is none."""
    op = F.try_element_at(cigar_ops(cigar), F.lit(-1 if last else 1))
    return F.coalesce(F.when(op["op"] == "S", op["n"]), F.lit(0))


def _encode(value: str | Column, escapes: list[tuple[str, str]], back: bool) -> Column:
    value = _col(value)
    for plain, code in escapes:
        value = F.replace(value, F.lit(code if back else plain), F.lit(plain if back else code))
    return value


def encode_column(value: str | Column, strict: bool = False) -> Column:
    """Escapes of a column; line feeds stay as they are unless ``strict``."""
    return _encode(value, COLUMN_ESCAPES + (LINE_ESCAPES if strict else []), False)


def encode_attribute(value: str | Column, strict: bool = False) -> Column:
    return _encode(value, ATTRIBUTE_ESCAPES + (LINE_ESCAPES if strict else []), False)


def decode_column(value: str | Column, strict: bool = False) -> Column:
    """Escapes back in the order of the table, percent sign first (``%2509`` becomes a tab).

    ``strict`` undoes the strict encoding exactly: the percent sign last, so that every text comes back as it was.
    """
    return _encode(value, [*COLUMN_ESCAPES[1:], *LINE_ESCAPES, COLUMN_ESCAPES[0]] if strict else COLUMN_ESCAPES, True)


def decode_attribute(value: str | Column, strict: bool = False) -> Column:
    return _encode(value, [*ATTRIBUTE_ESCAPES[1:], *LINE_ESCAPES, ATTRIBUTE_ESCAPES[0]] if strict else ATTRIBUTE_ESCAPES, True)


def quoted(value: str | Column) -> Column:
    return F.concat(F.lit('"'), _col(value), F.lit('"'))


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def before_colon(value: str | Column) -> Column:
    return F.substring_index(_col(value), ":", 1)


def proportion_colour(proportion: Column) -> Column:
    tenths = F.floor(proportion * 10).cast("int")
    colour = F.lit(None).cast("string")
    for n, c in PROPORTION_COLOURS.items():
        colour = F.when(tenths == n, F.lit(c)).otherwise(colour)
    return colour

"""Column names, record schemas and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The key parts of a set of loci, in output order; a part is dropped by dropping its column.
HEADER = ("reference", "strand", "category", "source")
STRANDS = ("+", "-", ".")
MISSING = "."

_long, _string = T.LongType(), T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TIPS = _struct(*((h, _string) for h in HEADER), ("tip", _long), ("element", _string))
INTERVALS = _struct(*((h, _string) for h in HEADER[:3]), ("start", _long), ("stop", _long))
KNOWN = _struct(("reference", _string), ("category", _string), ("source", _string), ("start", _long), ("stop", _long), ("element", _string), ("ord", _long))
INFORMATIVE = _struct(("name", _string), ("element", _string), ("sequence", _string), ("quality", _string))
SAM_COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
GFF_COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")


def header_of(df: DataFrame) -> list[str]:
    """The key columns present, in output order."""
    return [h for h in HEADER if h in df.columns]


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

"""Text sinks: delimited rows, GFF3 features, FASTQ reads, block-gzip files."""

from __future__ import annotations

import bz2
import contextlib
import io
import itertools
import struct
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.functions.text import encode_attribute, encode_column, quoted
from axisframe.schema import MISSING


def _text(df: DataFrame, name: str) -> Column:
    """Numbers print like the tool's: doubles without exponent noise as Spark casts them."""
    return F.col(f"`{name}`").cast("string")


def tabular_lines(df: DataFrame, sep: str = "\t", quote: bool = False) -> DataFrame:
    """``value``: one line per row; with ``quote`` text cells are wrapped, nothing is escaped."""
    cells = []
    for f in df.schema.fields:
        cell = F.coalesce(_text(df, f.name), F.lit(""))
        cells.append(quoted(cell) if quote and isinstance(f.dataType, T.StringType) else cell)
    return df.select(F.concat_ws(sep, *cells).alias("value"))


def header_line(df: DataFrame, sep: str = "\t", quote: bool = False) -> str:
    return sep.join(f'"{c}"' if quote else c for c in df.columns)


def feature_lines(df: DataFrame, program: str, reference: str = "reference", start: str = "start", stop: str = "stop", strand: str = "strand", kind: str | None = None) -> DataFrame:
    """``value``: a GFF3 line per row; columns that have no place of their own become attributes in their order."""
    fixed = [c for c in (reference, start, stop, strand, kind) if c]
    column = lambda c: encode_column(_text(df, c))
    attributes = [F.concat(F.lit(encode_name(f.name)), F.lit("="), encode_attribute(F.coalesce(_text(df, f.name), F.lit(MISSING)))) for f in df.schema.fields if f.name not in fixed]
    dot = F.lit(MISSING)
    cells = [column(reference), F.lit(program), column(kind) if kind else dot, column(start), column(stop), dot, column(strand), dot, F.concat_ws(";", *attributes)]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def encode_name(name: str) -> str:
    from axisframe.functions.text import ATTRIBUTE_ESCAPES

    for plain, code in ATTRIBUTE_ESCAPES:
        name = name.replace(plain, code)
    return name


def fastq_lines(reads: DataFrame) -> DataFrame:
    """``value``: four lines per read in one string."""
    return reads.select(F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality")).alias("value"))


def write_text(lines: DataFrame, path: str, compression: str | None = None, single: bool = False) -> None:
    """Lines to a folder of part files, or one part if ``single`` (for results that a person reads)."""
    lines = lines.coalesce(1) if single else lines
    writer = lines.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


#: Fixed value: the empty block that ends a block-gzip file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class BlockGzip:
    """A stream that packs what is written into gzip members of at most ``size`` bytes that tell their length, so the file can be indexed."""

    def __init__(self, out, size: int = 65280):
        self.out, self.size, self.held = out, size, bytearray()

    def __enter__(self) -> BlockGzip:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._flush(1)
            self.out.write(BGZF_END)

    def _flush(self, least: int) -> None:
        while len(self.held) >= least:
            part = bytes(self.held[: self.size])
            del self.held[: self.size]
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = packer.compress(part) + packer.flush()
            head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
            self.out.write(head + body + struct.pack("<II", zlib.crc32(part), len(part)))

    def write(self, data: bytes) -> None:
        self.held += data
        self._flush(self.size)


def bgzf(data: bytes, size: int = 65280) -> bytes:
    """``data`` as block-gzip."""
    out = io.BytesIO()
    with BlockGzip(out, size) as packed:
        packed.write(data)
    return out.getvalue()


def write_file(lines: Iterable[str], header: str | None, path: str) -> None:
    """One file (``.gz``: block-gzip, ``.bz2``) from an iterator of lines, packed as they come; for the command line."""
    with open(path, "wb") as raw, contextlib.ExitStack() as stack:
        out = raw
        if path.endswith(".gz"):
            out = stack.enter_context(BlockGzip(raw))
        elif path.endswith(".bz2"):
            out = stack.enter_context(bz2.BZ2File(raw, "wb"))
        for line in itertools.chain([header] if header is not None else [], lines):
            out.write(line.encode() + b"\n")

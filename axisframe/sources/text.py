"""Lines of files whose compression shows in their first bytes, whatever they are called."""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import posixpath
import shutil
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from axisframe.session import ship
from axisframe.sources.files import expand, place

#: The first bytes of gzip (also block-gzip) and bzip2 files.
GZIP, BZIP2 = b"\x1f\x8b", b"BZh"
#: Lines per batch.
LINES = 10_000


def _opened(path: str) -> Iterator[str]:
    """Lines of a file, unpacked as its first bytes say, read piece by piece."""
    system, plain = place(path)
    with system.open_input_file(plain) as raw:
        head = raw.read(3)
        raw.seek(0)
        stream = gzip.GzipFile(fileobj=raw) if head[:2] == GZIP else bz2.BZ2File(raw) if head == BZIP2 else raw
        yield from io.TextIOWrapper(io.BufferedReader(stream) if stream is not raw else stream, newline="\n")


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            lines = _opened(path)
            while held := [x.rstrip("\r\n") for x in itertools.islice(lines, LINES)]:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([posixpath.basename(path)] * len(held), pa.string())], ["value", "source"])


def sniffed_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, source) of all lines. A file is one task's work, read piece by piece; prefer names that Spark knows (.gz, .bz2) or plain text."""
    ship(spark)
    found = [f for p in paths for f, _ in expand(p)]
    files = spark.createDataFrame([(f,) for f in found], "path string").repartition(len(found))
    return files.mapInArrow(_unpack, "value string, source string")


def require_programs(*names: str) -> bool:
    """True if all programs are on the path, else an error that names the missing ones."""
    missing = [n for n in names if shutil.which(n) is None]
    if missing:
        raise OSError(f"not installed: {', '.join(missing)}")
    return True

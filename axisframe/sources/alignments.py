"""Alignments in SAM or BAM files: records, reference lists, and whether files agree on their references."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.session import ship
from axisframe.sources import bam, sam
from axisframe.sources.files import expand, open_stream


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of files by their extension (.bam, or SAM text)."""
    bams = [p for p in paths if p.rstrip("/").endswith(".bam")]
    rest = [p for p in paths if p not in bams]
    frames = [sam.read_sam(spark, *rest)] if rest else []
    if bams:
        bam.register(spark)
        frames += [spark.read.format("bam").load(p) for p in bams]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reference lines of SAM files, read no further than their header."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            names, sizes = [], []
            with open_stream(path) as raw:
                rest = b""
                while True:
                    block = raw.read(1 << 16)
                    *lines, rest = (rest + block).split(b"\n")
                    lines = lines if block else [*lines, rest]
                    for line in lines:
                        if line.startswith(b"@SQ\t"):
                            parts = dict(x.split(":", 1) for x in line.decode().rstrip("\r").split("\t")[1:] if ":" in x)
                            names.append(parts.get("SN"))
                            sizes.append(int(parts.get("LN", 0)))
                    if not block or any(line and not line.startswith(b"@") for line in lines):
                        break
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "ord", "reference", "ref_length"])


def references(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, ord, reference, ref_length) of the files' headers; only headers are read."""
    bams = [p for p in paths if p.rstrip("/").endswith(".bam")]
    rest = [f for p in paths if p not in bams for f, _ in expand(p)]
    frames = []
    if rest:
        ship(spark)
        files = spark.createDataFrame([(f,) for f in rest], "path string").repartition(min(len(rest), 64))
        frames.append(files.mapInArrow(_heads, bam.REFERENCES))
    if bams:
        bam.register(spark)
        frames += [spark.read.format("bam").option("content", "references").load(p) for p in bams]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def common_references(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """(name, length) of the references in file order; every file must list the same names in the same order.

    The driver sees one list, as long as a file's header.
    """
    rows = references(spark, *paths)
    lists = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "reference", "ref_length"))).alias("x"))
    names = lists.withColumn("names", F.transform("x", lambda r: r["reference"]))
    found = names.agg(F.countDistinct(F.sha2(F.array_join("names", "\n"), 256)).alias("n"), F.min_by("x", "path").alias("x"), F.count(F.lit(1)).alias("files")).first()
    n_files = sum(len(expand(p, ".bam")) for p in paths)
    if found["n"] > 1 or (found["n"] == 1 and found["files"] < n_files):
        raise ValueError("files differ in their references")
    return [(r["reference"], r["ref_length"]) for r in found["x"] or []]

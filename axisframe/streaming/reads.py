"""Alignments that arrive as files: tips as a stream, and running counts per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.functions.text import basename
from axisframe.schema import HEADER
from axisframe.sources import sam


def stream_tips(spark: SparkSession, folder: str, categories: list[str], quality: int = 0, tag: str = "ME", per_trigger: int = 100) -> DataFrame:
    """Read tips of SAM files as they appear in ``folder``; nothing is kept between files."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", per_trigger).text(folder)
    lines = lines.select("value", basename(F.col("_metadata.file_path")).alias("source"))
    return sam.read_tips(sam.parse_records(lines), categories, quality, tag=tag)


def running_counts(tips: DataFrame) -> DataFrame:
    """Reads per key so far; the state is one counter per key (reference, strand, category, source)."""
    return tips.groupBy(*HEADER).agg(F.count(F.lit(1)).alias("n"), F.min("tip").alias("first_tip"), F.max("tip").alias("last_tip"))

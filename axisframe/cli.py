"""Command line: ``python -m axisframe.cli fingerprint|extract|filter``."""

from __future__ import annotations

import argparse
import itertools
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

from axisframe.functions.filters import keep_features
from axisframe.operators import density
from axisframe.operators.counts import flatten_samples
from axisframe.operators.extract import MIN_CLIP, tag_reads
from axisframe.operators.headers import output_order
from axisframe.plans.fingerprint import PROGRAM, extraction, fingerprint
from axisframe.session import clear, scratch
from axisframe.sources import alignments, bam, gff, sam, sinks
from axisframe.sources.files import place


def session(threads: int | None) -> SparkSession:
    """The session of spark-submit or of the configuration; ``threads`` asks for this machine alone."""
    builder = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(f"local[{threads}]") if threads else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def emit(lines: DataFrame, path: str, header: str | None = None, parallel: bool = False) -> None:
    """Text to a file or ``-``, row by row as partitions come in; or to a folder of part files, written by all tasks."""
    if parallel and path != "-":
        sinks.write_text(lines, path, "gzip" if path.endswith(".gz") else "bzip2" if path.endswith(".bz2") else None)
        return
    values = (r.value for r in lines.toLocalIterator())
    if path == "-":
        for x in itertools.chain([header] if header is not None else [], values):
            print(x)
    else:
        sinks.write_file(values, header, path)


def spooled(spark: SparkSession, stream) -> str:
    """Standard input as a file in the shared folder, copied piece by piece."""
    target = f"{scratch(spark)}/{uuid.uuid4().hex}.txt"
    system, path = place(target)
    system.create_dir(os.path.dirname(path))
    with system.open_output_stream(path) as f:
        while piece := stream.read(1 << 20):
            f.write(piece.encode())
    return target


def run_fingerprint(a: argparse.Namespace) -> None:
    spark = session(a.threads)
    regions = None if a.references in (None, ["all"]) else a.references
    alignments.common_references(spark, *a.inputs)  # an error if they differ
    tips = sam.read_tips(alignments.load(spark, *a.inputs), a.families, a.mapping_quality, regions, a.tag)
    known = gff.annotation_intervals(gff.gff_lines(spark, a.annotation), a.families, regions) if a.annotation else None
    rows = fingerprint(tips, a.minimum_reads, a.epsilon, a.minimum_epsilon, a.splitting_method, a.common_elements, a.buffer, known, a.join_distance, not a.no_max_count_proportion, n_sources=len(a.inputs))
    flat = output_order(flatten_samples(rows, len(a.inputs), a.common_elements))
    if a.gff:
        emit(sinks.feature_lines(flat, PROGRAM), a.gff, parallel=a.parallel)
    for path, sep in ((a.tsv, "\t"), (a.csv, ",")):
        if path:
            emit(sinks.tabular_lines(flat, sep, quote=True), path, sinks.header_line(flat, sep, quote=True), a.parallel)


def run_extract(a: argparse.Namespace) -> None:
    spark = session(a.threads)
    reads, elements = extraction(alignments.load(spark, a.input), a.include_tips, not a.exclude_tails, not a.exclude_full_length, a.minimum_clip)
    if not a.aligned:
        emit(sinks.fastq_lines(reads), a.output, parallel=a.parallel)
        return
    tagged = tag_reads(alignments.load(spark, a.aligned), elements, a.tag)
    if a.output.endswith(".bam"):
        bam.write_bam(tagged, a.output, alignments.common_references(spark, a.aligned))
    else:
        emit(sam.to_lines(tagged), a.output, parallel=a.parallel)


def run_filter(a: argparse.Namespace) -> None:
    spark = session(a.threads)
    lines = gff.gff_lines(spark, spooled(spark, sys.stdin) if a.input == "-" else a.input)
    kept = keep_features(gff.parse_features(lines), all_of=a.all, any_of=a.any, strict=a.strict)
    emit(kept.orderBy("ord").selectExpr("trim(value) as value"), a.output, parallel=a.parallel)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("axisframe")
    jobs = top.add_subparsers(dest="job", required=True)
    f = jobs.add_parser("fingerprint", help="alignments to described clusters")
    f.add_argument("inputs", nargs="+")
    f.add_argument("-r", "--references", nargs="*")
    f.add_argument("-q", "--mapping-quality", type=int, default=30)
    f.add_argument("-f", "--families", nargs="*", default=[""])
    f.add_argument("-a", "--annotation")
    f.add_argument("-m", "--minimum-reads", type=int, default=10)
    f.add_argument("-e", "--epsilon", type=int, default=250)
    f.add_argument("--minimum-epsilon", type=int, default=0)
    f.add_argument("-s", "--splitting-method", choices=density.METHODS, default="SDBICAN")
    f.add_argument("-n", "--common-elements", type=int, default=3)
    f.add_argument("-b", "--buffer", type=int, default=25)
    f.add_argument("-j", "--join-distance", type=int, default=25)
    f.add_argument("--no-max-count-proportion", action="store_true")
    f.add_argument("--tag", default="ME")
    for kind in ("gff", "tsv", "csv"):
        f.add_argument(f"--{kind}")
    f.set_defaults(run=run_fingerprint)
    e = jobs.add_parser("extract", help="informative reads as FASTQ, or tags on reads aligned again (--aligned; an output ending in .bam is a folder of BAM files)")
    e.add_argument("input")
    e.add_argument("-o", "--output", default="-")
    e.add_argument("--aligned")
    e.add_argument("--include-tips", action="store_true")
    e.add_argument("--exclude-tails", action="store_true")
    e.add_argument("--exclude-full-length", action="store_true")
    e.add_argument("--minimum-clip", type=int, default=MIN_CLIP)
    e.add_argument("--tag", default="ME")
    e.set_defaults(run=run_extract)
    g = jobs.add_parser("filter", help="features that pass filters")
    g.add_argument("input", nargs="?", default="-")
    g.add_argument("-o", "--output", default="-")
    g.add_argument("--all", nargs="*", default=[])
    g.add_argument("--any", nargs="*", default=[])
    g.add_argument("--strict", action="store_true", help="fail where a field to be compared by order is no number")
    g.set_defaults(run=run_filter)
    for job in (f, e, g):
        job.add_argument("-t", "--threads", type=int, help="run on this machine with so many threads, whatever else is configured")
        job.add_argument("--parallel", action="store_true", help="write folders of part files by all tasks instead of single files")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)
    clear(SparkSession.active())


if __name__ == "__main__":
    main()

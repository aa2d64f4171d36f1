"""Command line: a report over FASTQ or BAM files."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from seqlume import report
from seqlume.plans.ship import ship
from seqlume.sources import defaults, small
from seqlume.sources.bam import read_bam
from seqlume.sources.fastq import read_fastq


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqlume", description="Quality report over sequencing reads.")
    p.add_argument("input", help="FASTQ or BAM file, plain or compressed; or a report's JSON with --rerender")
    p.add_argument("input_reverse", nargs="?", help="FASTQ file of the second mates")
    p.add_argument("--json", help="name of the JSON report (default: input name and .json)")
    p.add_argument("--html", help="name of the HTML report (default: input name and .html)")
    p.add_argument("--outdir", "--dir", "--out-dir", default=".", help="folder of the reports")
    p.add_argument("--images-zip", nargs="?", const="", help="also write the pictures as an archive")
    p.add_argument("--adapter-file", help="tab-separated list: name, technology, sequence, start or end (default: common adapters)")
    p.add_argument("--library", action="append", default=[], help="FASTA file of known sequences (may be repeated; default: published adapters and primers)")
    p.add_argument("--overrepresentation-threshold-fraction", type=float, default=0.001)
    p.add_argument("--overrepresentation-min-threshold", type=int, default=100)
    p.add_argument("--overrepresentation-max-threshold", type=int, default=(1 << 63) - 1)
    p.add_argument("--overrepresentation-max-unique-fragments", type=int, default=5_000_000)
    p.add_argument("--overrepresentation-fragment-length", type=int, default=21)
    p.add_argument("--overrepresentation-sample-every", type=int, default=8)
    p.add_argument("--overrepresentation-bases-from-start", type=int, default=100)
    p.add_argument("--overrepresentation-bases-from-end", type=int, default=100)
    p.add_argument("--duplication-max-stored-fingerprints", type=int, default=1_000_000)
    p.add_argument("--fingerprint-front-length", type=int, default=8)
    p.add_argument("--fingerprint-back-length", type=int, default=8)
    p.add_argument("--fingerprint-front-offset", type=int)
    p.add_argument("--fingerprint-back-offset", type=int)
    p.add_argument("-t", "--threads", type=int, default=2, help="cores of a local session")
    p.add_argument("--rerender", action="store_true", help="make HTML from a report's JSON")
    p.add_argument("--no-report", action="store_true", help=argparse.SUPPRESS)
    p.add_argument("--version", action="version", version=report.VERSION)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    stem = os.path.join(args.outdir, os.path.basename(args.input))
    page = os.path.join(args.outdir, args.html) if args.html else stem + ".html"
    if args.rerender:
        with open(args.input) as found:
            report.write_html(json.load(found), page)
        return 0
    kind = small.technology(args.input)
    bam = small.is_bam(args.input)
    if args.input_reverse:
        if bam or small.is_bam(args.input_reverse):
            print("Pairs must be FASTQ files", file=sys.stderr)
            return 1
        if small.technology(args.input_reverse) != kind:
            print("Mates are of different technologies", file=sys.stderr)
            return 1
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{args.threads}]").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    first = read_bam(spark, args.input) if bam else read_fastq(spark, args.input)
    second = read_fastq(spark, args.input_reverse) if args.input_reverse else None
    adapters = [(n, s.upper(), p) for n, _, s, p in (small.adapters(args.adapter_file, kind) if args.adapter_file else defaults.adapters(kind))]
    library = small.library(spark, args.library) if args.library else small.known_library(spark)
    options = report.Options(
        args.overrepresentation_threshold_fraction, args.overrepresentation_min_threshold, args.overrepresentation_max_threshold, args.overrepresentation_max_unique_fragments,
        args.overrepresentation_fragment_length, args.overrepresentation_sample_every, args.overrepresentation_bases_from_start, args.overrepresentation_bases_from_end,
        args.duplication_max_stored_fingerprints, args.fingerprint_front_length, args.fingerprint_back_length, args.fingerprint_front_offset, args.fingerprint_back_offset,
    )
    paths = (args.input, args.input_reverse) if args.input_reverse else (args.input,)
    made = report.build(first, second, adapters, library, options, paths)
    if args.no_report:
        return 0
    os.makedirs(args.outdir, exist_ok=True)
    report.write_json(made, os.path.join(args.outdir, args.json) if args.json else stem + ".json")
    report.write_html(made, page)
    if args.images_zip is not None:
        report.write_images(made, os.path.join(args.outdir, args.images_zip) if args.images_zip else stem + ".zip")
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: ``python -m keyloom.plans.cli APP [options] FILE...``."""

from __future__ import annotations

import argparse
import sys
import warnings

from pyspark.sql import SparkSession

from keyloom.apps import APPS
from keyloom.plans.job import Job, run


def parse(argv: list[str], job: Job) -> tuple[Job, list[str]]:
    """Merge the flags into the job, then validate; unknown flags only warn."""
    p = argparse.ArgumentParser(prog="keyloom")
    p.add_argument("-i", "--readers", type=int)
    p.add_argument("-m", "--mappers", type=int)
    p.add_argument("-r", "--reducers", type=int)
    p.add_argument("-o", "--output-dir")
    p.add_argument("-p", "--metrics-file")
    p.add_argument("-v", "--verbose", action="store_const", const=True)
    p.add_argument("paths", nargs="*")
    known, rest = p.parse_known_args(argv)
    for flag in rest:
        warnings.warn(f"ignoring unknown option {flag}", stacklevel=2)
    options = vars(known)
    paths = options.pop("paths")
    if not paths:
        p.error("no input files")
    return (job.with_options(**options) if job.allow_cli else job).validate(), paths


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in APPS:
        print(f"usage: keyloom {{{','.join(APPS)}}} [options] FILE...", file=sys.stderr)
        return 1
    job, paths = parse(argv[1:], APPS[argv[0]])
    spark = SparkSession.builder.appName("keyloom").getOrCreate()
    run(spark, job.with_options(verbose=True), paths)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m lexlode [PATH] [--no-recursive] [--base DIR]: ingest a file tree and print the counters."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from lexlode.config import Settings
from lexlode.operators.ingest import ingest
from lexlode.sources.files import load_files, scan


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexlode")
    p.add_argument("path", nargs="?", default=Settings.from_env().data_dir)
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--base", default="store")
    a = p.parse_args(argv)
    if not os.path.exists(a.path):
        print(f"no such path: {a.path}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lexlode").getOrCreate()
    docs, errors = load_files(scan(spark, a.path, not a.no_recursive))
    stats = ingest(docs, a.base, Settings.from_env(), errors=errors)
    for name, value in vars(stats).items():
        print(f"{name}: {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

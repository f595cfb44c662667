"""``python -m tracemill QUERY IN OUT``: run a registered query over a folder of tables and write its rows.

The suffix of OUT (parquet, jsonl, json) chooses the format."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.queries import QUERIES
from .sources.files import write_any


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    p.add_argument("query", choices=sorted(QUERIES), metavar="QUERY")
    p.add_argument("source", metavar="IN", help="folder with a Parquet file or folder for each table")
    p.add_argument("target", metavar="OUT")
    p.add_argument("--mode", default="overwrite", choices=["overwrite", "append", "error"])
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"tracemill {a.query}").getOrCreate()
    write_any(QUERIES[a.query](spark, a.source.rstrip("/")), a.target, a.mode)


if __name__ == "__main__":
    main()

"""`python -m tidemark list` names the queries; `python -m tidemark run QUERY TABLES OUT` writes one as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .queries import QUERIES


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    run = verbs.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("tables", help="folder of the Parquet tables")
    run.add_argument("out")
    run.add_argument("--mode", default="errorifexists", choices=("errorifexists", "overwrite", "append"))
    got = parser.parse_args(args)
    if got.verb == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName(f"tidemark {got.query}").getOrCreate()  # master and sizes come from spark-submit
    QUERIES[got.query](spark, got.tables).write.mode(got.mode).parquet(got.out)


if __name__ == "__main__":
    main()

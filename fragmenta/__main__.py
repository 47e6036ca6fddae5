"""python -m fragmenta INPUTS ROOT [--from STAGE] [--to STAGE] [--stream]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fragmenta.plans.run import STAGES, Pipeline


def main() -> None:
    parser = argparse.ArgumentParser(prog="fragmenta", description="Builds the tables and answers the queries.")
    parser.add_argument("inputs", help="folder with videos, train_qa and queries as Parquet")
    parser.add_argument("root", help="folder for the tables and the result")
    parser.add_argument("--from", dest="first", choices=STAGES, default=STAGES[0])
    parser.add_argument("--to", dest="last", choices=STAGES, default=STAGES[-1])
    parser.add_argument("--stream", action="store_true", help="caption scenes as their parts arrive")
    given = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    for stage, seconds in Pipeline(spark, given.inputs, given.root).run(given.first, given.stream, given.last).items():
        print(f"{stage}: {seconds:.1f} s")


if __name__ == "__main__":
    main()

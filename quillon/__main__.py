"""``python -m quillon FOLDER "SELECT ..." [--format csv]``: statements over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from quillon.sources.sinks import FORMATS, lines
from quillon.sql.engine import Engine


def main() -> None:
    parser = argparse.ArgumentParser(prog="quillon")
    parser.add_argument("folder", help="local folder with NAME.parquet files or folders")
    parser.add_argument("statement", nargs="+", help="run in order; each result is printed")
    parser.add_argument("--format", choices=FORMATS, default="table")
    args = parser.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    db = Engine(spark)
    for name in sorted(os.listdir(args.folder)):
        if name.endswith(".parquet"):
            db.register(name[:-8], spark.read.parquet(os.path.join(args.folder, name)))
    for statement in args.statement:
        for line in lines(db.sql(statement), args.format):
            print(line)
    spark.stop()


if __name__ == "__main__":
    main()

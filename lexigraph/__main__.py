"""Command line: spark-submit -m lexigraph QUERY SF_DIR shows a registered query; --list names them."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .queries import queries


def main(args: list[str]) -> int:
    if args == ["--list"]:
        print("\n".join(queries()))
        return 0
    if len(args) != 2 or args[0] not in queries():
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("lexigraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    queries()[args[0]](spark, args[1]).show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

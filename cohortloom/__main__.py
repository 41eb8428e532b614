"""python -m cohortloom environment | queries | run NAME TABLES OUTPUT | fit FOLDER MODEL COLUMNS [--binary COLUMNS]"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortloom", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("environment", help="print the versions that results depend on")
    sub.add_parser("queries", help="print the names of all queries")
    run = sub.add_parser("run", help="write a query's result to a fresh folder")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("output")
    fit = sub.add_parser("fit", help="fit one model on a prepared folder")
    fit.add_argument("folder")
    fit.add_argument("model")
    fit.add_argument("columns", help="comma-separated")
    fit.add_argument("--binary", default="")
    fit.add_argument("--unpenalized", default="")
    args = parser.parse_args(argv)
    if args.what == "environment":
        import numpy
        import pandas
        import pyarrow
        import pyspark

        print(json.dumps({"python": sys.version.split()[0], **{m.__name__: m.__version__ for m in (numpy, pandas, pyarrow, pyspark)}}, sort_keys=True))
        return 0
    from cohortloom.plans.catalogue import QUERIES

    if args.what == "queries":
        print("\n".join(QUERIES))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if args.what == "run":
        QUERIES[args.name](spark, args.tables).write.mode("errorifexists").parquet(args.output)
        return 0
    from cohortloom.plans.prediction import Settings
    from cohortloom.plans.protocol import fit_model

    names = lambda s: [c for c in s.split(",") if c]
    out = fit_model(spark, args.folder, args.model, names(args.columns), set(names(args.binary)), Settings(), set(names(args.unpenalized)))
    return int(out.where("status <> 'PASS'").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())

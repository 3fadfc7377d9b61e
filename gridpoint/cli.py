"""Command line: `python -m gridpoint.cli serialize PATH`, `extract PATH`, `generate -n N`; PATH may be - for what comes in."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.operators import grid as G
from gridpoint.operators import reader as R
from gridpoint.sources import markup
from gridpoint.synth import assemble as A
from gridpoint.synth.shapes import build_mixed


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="gridpoint", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("serialize", "tables of markup as text"), ("extract", "points of tables as JSON lines")):
        one = commands.add_parser(name, help=what)
        one.add_argument("path", help="a file, a folder of files, or -")
        one.add_argument("--caption", default="")
        one.add_argument("--footer", default="")
    made = commands.add_parser("generate", help="made tables")
    made.add_argument("-n", type=int, default=1)
    made.add_argument("--seed", type=int, default=0)
    made.add_argument("--jsonl", help="a folder to write JSON lines to")
    return parser.parse_args(given)


def tables(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """One table a file, as raw, with the given caption and footer."""
    read = spark.createDataFrame([(sys.stdin.read(),)], "value string") if args.path == "-" else spark.read.text(args.path, wholetext=True)
    return markup.serialize(read.select(F.col("value").alias("raw"), F.lit(args.caption).alias("caption"), F.lit(args.footer).alias("footer")))


def extracted(read: DataFrame) -> DataFrame:
    """What was read of each table as one JSON text."""
    point = lambda p: F.struct(*(p[c].alias(c) for c in ("x", "y", "z", "statistic_type", "statistic_value", "extent", "label")))
    out = R.extract(read, G.parse(F.col("table_serialised")))
    return out.select(F.to_json(F.struct("located_by", "space", "measure", "axes", "packed", "sections", "sign_disagreements", F.transform("points", point).alias("points")), {"ignoreNullFields": "false"}).alias("value"))


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    spark = SparkSession.builder.appName("gridpoint").getOrCreate()
    if args.command == "generate":
        out = build_mixed(spark.range(args.seed, args.seed + args.n).select(F.col("id").alias("seed")))
        rows = out.select(F.lit("generated").alias("origin"), "caption", "footer", "table_serialised", A.target_json(F.col("target")).alias("target_json"))
        if args.jsonl:
            print(markup.write_jsonl(rows, args.jsonl))
            return
        for r in rows.toLocalIterator():
            print(r.caption, r.table_serialised, r.footer, json.dumps(json.loads(r.target_json), indent=1, ensure_ascii=False), sep="\n", end="\n\n")
        return
    read = tables(spark, args)
    for r in (read.select(F.col("table_serialised").alias("value")) if args.command == "serialize" else extracted(read)).toLocalIterator():
        print(r.value)


if __name__ == "__main__":
    main()

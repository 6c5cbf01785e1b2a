"""Command line over Parquet snapshots of jobs and dead letters: list, stats, requeue, purge.

    python -m tallyspan.cli list SNAPSHOTS LANE [--limit 50] [--format json|table]

SNAPSHOTS is a folder with the snapshots ``jobs`` and ``dead``. Changes are written beside it as ``jobs-next`` and ``dead-next``.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan import schema
from tallyspan.operators import inspect, resolve
from tallyspan.sources import stores


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyspan")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "stats", "purge", "requeue"):
        c = sub.add_parser(name)
        c.add_argument("snapshots")
        c.add_argument("id" if name == "requeue" else "lane")
        if name == "list":
            c.add_argument("--limit", type=int, default=50)
            c.add_argument("--format", choices=("json", "table"), default="json")
        if name in ("purge", "requeue"):
            c.add_argument("--yes", action="store_true", help="needed to change anything")
    return p


def run(spark: SparkSession, argv: Sequence[str]) -> tuple[int, list[str]]:
    """(exit code, lines to print)."""
    a = parser().parse_args(argv)
    jobs, dead = (stores.read_snapshot(spark, f"{a.snapshots}/{n}", s) for n, s in (("jobs", schema.JOBS), ("dead", schema.DEAD)))
    if a.command == "list":
        rows = inspect.dead_snapshot(dead.where(F.col("lane") == a.lane)).orderBy("seq").limit(a.limit)
        return 0, _lines(rows.drop("seq"), a.format)
    if a.command == "stats":
        lane = spark.createDataFrame([(a.lane,)], "lane string")
        n = [inspect.counts(x, lane, "n").first().n for x in (dead, jobs)]
        return 0, [f"Lane:               {a.lane}", f"Dead-letter count:  {n[0]}", f"Pending job count:  {n[1]}"]
    if not a.yes:
        return 1, ["nothing changed: confirm with --yes"]
    if a.command == "purge":
        left, counts = resolve.purge(dead, spark.createDataFrame([(a.lane,)], "lane string"))
        stores.save_snapshot(left, f"{a.snapshots}/dead-next", schema.DEAD)
        return 0, [f"removed {counts.first().removed}"]
    asked = spark.createDataFrame([(1, a.id)], "ord long, id string")
    live, left, outcomes = resolve.requeue(dead, jobs, asked, F.lit(time.time_ns()))
    what = outcomes.first().outcome
    if what == "ok":
        stores.save_snapshot(live, f"{a.snapshots}/jobs-next", schema.JOBS)
        stores.save_snapshot(left, f"{a.snapshots}/dead-next", schema.DEAD)
    return (0 if what == "ok" else 1), [what]


def _lines(rows: DataFrame, form: str) -> list[str]:
    got = stores.json_lines(rows) if form == "json" else stores.table_lines(rows)
    return [r.line for r in got.toLocalIterator()]


def main() -> int:
    spark = SparkSession.builder.appName("tallyspan").getOrCreate()
    code, lines = run(spark, sys.argv[1:])
    print(*lines, sep="\n")
    return code


if __name__ == "__main__":
    sys.exit(main())

"""python -m corpusspark.cli [--config FILE] sync --subject NAME|all [--every SECONDS] [-v] | drain | serve"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusspark import config
from corpusspark.functions.scalars import stats_line
from corpusspark.operators.store import retried


def main(argv: list[str] | None = None, spark: SparkSession | None = None, sleep=time.sleep) -> int:
    """0 when the command is done, whether there was work or not; failures raise."""
    parser = argparse.ArgumentParser(prog="corpusspark", description=__doc__)
    parser.add_argument("--config", default="config.yaml")
    sub = parser.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sync", help="bring the store in step with the folders")
    s.add_argument("--subject", required=True)
    s.add_argument("--every", type=float, help="again after so many seconds, until interrupted")
    s.add_argument("-v", "--verbose", action="store_true")
    sub.add_parser("serve", help="answer searches over HTTP")
    sub.add_parser("drain", help="commit what a run that died has decoded")
    args = parser.parse_args(argv)
    cfg = config.load(args.config)
    spark = spark or SparkSession.builder.appName("corpusspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "serve":
        from corpusspark.http import serve

        serve(spark, cfg)
        return 0
    from corpusspark.plans.pipeline import drained, synced

    if args.command == "drain":
        print(f"drained={retried(lambda: drained(spark, cfg), attempts=12, first=5, most=120)}")
        return 0
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    line = stats_line(*[F.col(c) for c in ("subject", "new", "changed", "deleted", "unchanged", "chunks_embedded")])
    while True:
        stats = synced(spark, cfg, [x.name for x in cfg.resolve(args.subject)])
        for r in stats.orderBy("subject").select(line.alias("line")).collect():
            print(r["line"], flush=True)
        if args.every is None:
            return 0
        sleep(args.every)


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: extract a site from a table of pages (or live) and export it."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from pagequarry.functions import rules, validation
from pagequarry.logs import logger
from pagequarry.operators import live
from pagequarry.operators.control import Pipeline, Settings
from pagequarry.sources import pages


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagequarry", description=__doc__)
    p.add_argument("url", help="start of the crawl")
    p.add_argument("--pages", help="Parquet table of pages (page_id, url, html); without it pages are fetched as the crawl meets them")
    p.add_argument("--mode", choices=rules.MODES, default="auto")
    p.add_argument("--out", default=os.environ.get("PAGEQUARRY_OUTPUT_DIR", "output"))
    p.add_argument("--format", choices=rules.EXPORT_FORMATS, default="both")
    p.add_argument("--max-depth", type=int, default=5)
    p.add_argument("--max-pages", type=int, default=500)
    p.add_argument("--concurrency", type=int, default=3)
    p.add_argument("--parallel", action="store_true")
    p.add_argument("--content-cache", help="folder of the cache of contents")
    p.add_argument("--link-cache", help="folder of the cache of verdicts on links")
    p.add_argument("--events", help="folder of the events of operations")
    p.add_argument("--use-ai", action="store_true", help="keep relevant links only")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    log = logger("pagequarry")
    try:
        request = validation.ExtractRequest(args.url, args.mode, args.parallel, args.max_depth, args.concurrency, args.use_ai, export_format=args.format)
    except validation.InvalidRequest as error:
        log.error(str(error), context={"url": args.url})
        return 2
    spark = SparkSession.builder.appName("pagequarry").getOrCreate()
    if args.pages:
        table = pages.read_pages(spark, args.pages)
    else:
        table = None
    stage = None if args.pages else live.fetching(pace=live.Pace(delay=0.2 if request.parallel else 0.5, lanes=request.concurrency))
    settings = Settings(max_pages=args.max_pages, fetch=stage, content_cache=args.content_cache, link_cache=args.link_cache, events=args.events)
    done = Pipeline(spark, table, settings).run(request.url, request.mode, args.out, request.max_depth, request.use_ai, request.export_format)
    log.info("finished", context=done)
    print(json.dumps(done, indent=2))
    return 0 if done["status"] == "completed" else 1


if __name__ == "__main__":
    sys.exit(main())

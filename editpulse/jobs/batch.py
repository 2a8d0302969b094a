"""Batch layer: event history to six tables.

    spark-submit --py-files editpulse.zip submit.py batch --input DIR --output DIR [--top-n 50] [--format json|parquet] [--incremental]

With ``--incremental`` a run reads only the files that came since the last one and
also stores the baseline for streams to probe (``OUTPUT/probe``).
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from ..config import DEFAULTS
from ..plans.batch_layer import run_batch_layer
from ..plans.incremental import update_batch_layer
from ..session import build_session
from ..sources import read_event_json, read_events, store_baseline


def main(argv: list[str] | None = None) -> dict[str, str]:
    p = argparse.ArgumentParser(prog="editpulse-batch")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--top-n", type=int, default=DEFAULTS.batch_top_n)
    p.add_argument("--format", choices=["json", "parquet"], default="json")
    p.add_argument("--incremental", action="store_true")
    args = p.parse_args(argv)

    spark = build_session("editpulse-batch")
    columnar = args.format == "parquet"
    settings = replace(DEFAULTS, batch_top_n=args.top_n)
    if args.incremental:
        json_lines = None if columnar else lambda paths: read_event_json(spark, paths)
        paths = update_batch_layer(spark, args.input, args.output, json_lines, settings, "*.parquet" if columnar else "*")
        if paths:
            store_baseline(spark.read.parquet(paths["article_baseline"]), f"{args.output.rstrip('/')}/probe")
        return paths
    events = read_events(spark, args.input) if columnar else read_event_json(spark, args.input)
    return run_batch_layer(spark, events, args.output, settings, columnar_input=columnar)


if __name__ == "__main__":
    main()

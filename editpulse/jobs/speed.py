"""Speed layer: a stream of bus records to trending snapshots.

    spark-submit --py-files editpulse.zip submit.py speed --input DIR --output DIR [--baseline DIR | --probe DIR] [--policy rate]

Publishes the current window at every trigger and each finished window once. The
length of the window may be changed while the job runs, by a new number in the
file that ``--window-file`` names.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import parse_timestamp
from ..operators.trend import POLICIES
from ..schemas import WIRE_EVENT
from ..session import build_session
from ..sources import StoredBaseline, read_baseline, read_stream, with_arrival_time
from ..streaming import live_stream, with_clock

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="editpulse-speed")
    p.add_argument("--input", required=True, help="folder of JSON-lines events")
    p.add_argument("--output", required=True)
    p.add_argument("--baseline", default=None, help="article_baseline table of the batch layer")
    p.add_argument("--probe", default=None, help="stored baseline of the batch layer, read by candidate instead of whole")
    p.add_argument("--window-file", default=None, help="text file with the length of the window in seconds, read at every trigger")
    p.add_argument("--longest", type=int, default=None, help="longest window that the file may ask for")
    p.add_argument("--window-seconds", type=int, default=DEFAULTS.window_seconds)
    p.add_argument("--slide-seconds", type=int, default=DEFAULTS.slide_seconds)
    p.add_argument("--batch-seconds", type=float, default=DEFAULTS.trigger_seconds)
    p.add_argument("--top-n", type=int, default=DEFAULTS.trending_top_n)
    p.add_argument("--policy", choices=sorted(POLICIES), default="rate")
    p.add_argument("--time", choices=["event", "arrival"], default="event")
    p.add_argument("--per-trigger", type=int, default=None, help="files per micro-batch")
    p.add_argument("--until-done", action="store_true", help="process what is there and stop")
    args = p.parse_args(argv)

    spark = build_session("editpulse-speed", **{"spark.sql.streaming.stateStore.providerClass": STATE_STORE})
    settings = replace(
        DEFAULTS,
        window_seconds=args.window_seconds,
        slide_seconds=args.slide_seconds,
        trending_top_n=args.top_n,
    )
    records = read_stream(spark, args.input, WIRE_EVENT, source="json", per_trigger=args.per_trigger)
    if args.time == "arrival":
        settings = replace(settings, watermark_delay="0 seconds")
        events = with_arrival_time(records)
        events = events if args.until_done else with_clock(events)
    else:
        events = records.withColumn("timestamp", parse_timestamp(F.col("timestamp")))
    baseline = StoredBaseline(spark, args.probe) if args.probe else lambda titles: read_baseline(spark, args.baseline)
    length = (lambda: int(spark.read.text(args.window_file).first()[0])) if args.window_file else None
    query = live_stream(
        events,
        args.output,
        f"{args.output.rstrip('/')}/_checkpoint",
        baseline,
        settings,
        POLICIES[args.policy],
        None if args.until_done else args.batch_seconds,
        length,
        args.longest,
    )
    query.awaitTermination()


if __name__ == "__main__":
    main()

"""Ingestion: raw change JSON to events, bus rows, rejects and counters.

    spark-submit --py-files editpulse.zip submit.py ingest --input DIR --output DIR [--rates] [--land] [--recent]

Beside them: ``--rates`` the ingestion rate by interval, ``--recent`` the newest
events, ``--land`` the raw records by hour of arrival (a stream of its own).
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from ..config import DEFAULTS
from ..session import build_session
from ..sources import read_stream, with_arrival_time
from ..streaming import ingest_stream, land_stream, rate_samples, recent_buffer


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="editpulse-ingest")
    p.add_argument("--input", required=True, help="folder of text files, one JSON value per line")
    p.add_argument("--output", required=True)
    p.add_argument("--wiki", default=DEFAULTS.wiki, help="empty for all")
    p.add_argument("--namespace", type=int, default=DEFAULTS.namespace)
    p.add_argument("--event-type", default=DEFAULTS.event_type)
    p.add_argument("--keep-bots", action="store_true")
    p.add_argument("--batch-seconds", type=float, default=DEFAULTS.trigger_seconds)
    p.add_argument("--per-trigger", type=int, default=None)
    p.add_argument("--until-done", action="store_true")
    p.add_argument("--rates", action="store_true")
    p.add_argument("--land", action="store_true")
    p.add_argument("--recent", action="store_true")
    args = p.parse_args(argv)

    spark = build_session("editpulse-ingest")
    settings = replace(
        DEFAULTS,
        wiki=args.wiki,
        namespace=args.namespace,
        event_type=args.event_type,
        exclude_bots=not args.keep_bots,
    )
    raw = read_stream(spark, args.input, source="text", per_trigger=args.per_trigger)
    root, seconds = args.output.rstrip("/"), None if args.until_done else args.batch_seconds
    consumers = [rate_samples(f"{root}/rates", settings)] if args.rates else []
    consumers += [recent_buffer(f"{root}/recent", settings.recent_events)] if args.recent else []
    queries = [ingest_stream(raw, root, f"{root}/_checkpoint", settings, seconds, consumers=consumers)]
    if args.land:
        flush = None if args.until_done else settings.store_flush_seconds
        queries.append(land_stream(with_arrival_time(raw, "arrived_at"), f"{root}/landed", f"{root}/_checkpoint_landed", flush))
    for query in queries:
        query.awaitTermination()


if __name__ == "__main__":
    main()

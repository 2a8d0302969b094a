"""Merge the small files of closed dates of an event store.

    spark-submit --py-files editpulse.zip submit.py compact --store DIR --before 2024-03-02
"""

from __future__ import annotations

import argparse

from ..session import build_session
from ..sinks import compact_store


def main(argv: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="editpulse-compact")
    p.add_argument("--store", required=True, help="event store, by event_date")
    p.add_argument("--before", required=True, help="dates before this one are closed (yyyy-MM-dd)")
    args = p.parse_args(argv)
    return compact_store(build_session("editpulse-compact"), args.store, args.before)


if __name__ == "__main__":
    main()

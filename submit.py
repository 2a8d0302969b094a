"""Start a job by name: ``spark-submit --py-files editpulse.zip submit.py batch --input … --output …``."""

from __future__ import annotations

import importlib
import sys

JOBS = ("batch", "compact", "ingest", "repair", "speed")


def main(argv: list[str]) -> None:
    if not argv or argv[0] not in JOBS:
        raise SystemExit(f"usage: submit.py {{{','.join(JOBS)}}} [options]")
    importlib.import_module(f"editpulse.jobs.{argv[0]}").main(argv[1:])


if __name__ == "__main__":
    main(sys.argv[1:])

"""Rewrite landing objects with back-to-back JSON values as JSON lines, in a new folder.

    spark-submit --py-files editpulse.zip submit.py repair --input DIR --output DIR
"""

from __future__ import annotations

import argparse

from ..session import build_session, run_folder
from ..sinks import rewrite_landing, write_rejects
from ..sources import read_landing, split_landing


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="editpulse-repair")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True, help="gets the folders lines and rejects")
    args = p.parse_args(argv)

    spark = build_session("editpulse-repair")
    work = run_folder(spark, "repair")
    split_landing(read_landing(spark, args.input)).write.parquet(work)
    split = spark.read.parquet(work)
    root = args.output.rstrip("/")
    rewrite_landing(split, f"{root}/lines")
    write_rejects(split.where("error is not null"), f"{root}/rejects")


if __name__ == "__main__":
    main()

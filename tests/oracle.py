"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def differences(spark_df, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    names, types = list(relation.columns), [str(t) for t in relation.types]
    found = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    expected_types = dict(zip(names, types))
    for field in spark_df.schema.fields:
        mine = TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if mine != expected_types[field.name]:
            found.append(f"type of {field.name}: {mine} against {expected_types[field.name]}")
    order = sorted(names)
    mine = Counter(tuple(_cell(r[c]) for c in order) for r in spark_df.collect())
    where = [names.index(c) for c in order]
    theirs = Counter(tuple(_cell(r[i]) for i in where) for r in relation.fetchall())
    if mine != theirs:
        found.append(f"{sum(mine.values())} rows against {sum(theirs.values())}")
        found.append(f"only Spark: {list((mine - theirs).items())[:3]}")
        found.append(f"only DuckDB: {list((theirs - mine).items())[:3]}")
    return found

"""Exact comparison of a Spark result with its SQL counterpart in DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Types that both engines name differently.
SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(con: duckdb.DuckDBPyConnection, sql: str, df: DataFrame) -> str | None:
    """A description of the first difference, or ``None`` if both agree exactly."""
    cursor = con.execute(sql)
    their_types = {d[0]: str(d[1]) for d in cursor.description}
    our_types = {f.name: SPARK_TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    if our_types != their_types:
        return f"schema: {set(our_types.items()) ^ set(their_types.items())}"
    names = sorted(our_types)
    positions = [list(their_types).index(n) for n in names]
    theirs = Counter(tuple(row[p] for p in positions) for row in cursor.fetchall())
    ours = Counter(tuple(row[n] for n in names) for row in df.collect())
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    text = f"{sum(only_ours.values())} rows only here, {sum(only_theirs.values())} only there"
    for side in (only_ours, only_theirs):
        if side:
            first = sorted(side, key=repr)[0]
            text += f"\n  {dict(zip(names, first))}"
    return text

"""Compare a query with its oracle: column names and types, row count and values in any order."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> str | None:
    """None where both agree, otherwise a short description of how they differ."""
    df = query(spark, sf_dir)
    expected = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(expected.columns):
        return f"columns {names} != {sorted(expected.columns)}"
    types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    other = dict(zip(expected.columns, map(str, expected.types)))
    if types != other:
        return f"types {types} != {other}"
    ours = Counter(map(tuple, df.select(*names).collect()))
    theirs = Counter(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    if ours != theirs:
        return f"rows {sum(ours.values())} vs {sum(theirs.values())}; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    from . import oracles, queries

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, query in queries.QUERIES.items():
        if only and name not in only:
            continue
        started = time.time()
        sql = oracles.ORACLES.get(name)
        try:
            result = "no oracle" if sql is None else difference(spark, con, query, sql, sf_dir)
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result is not None
        print(f"{name}: {result or 'equal'} ({time.time() - started:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

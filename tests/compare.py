"""Row-by-row comparison of a Spark result with the rows DuckDB gives."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(spark_df, con, sql: str) -> str | None:
    """None when both sides give the same columns, types and bag of rows."""
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = {c: (t, types[c]) for c, t in spark_df.dtypes if c in types and TYPES.get(t) != types[c]}
    if odd:
        return f"types differ: {odd}"
    cur = con.execute(sql)
    sql_columns = [c[0] for c in cur.description]
    right = rows_of(sql_columns, cur.fetchall())
    if sorted(spark_df.columns) != sorted(sql_columns):
        return f"columns differ: {sorted(spark_df.columns)} / {sorted(sql_columns)}"
    left = rows_of(spark_df.columns, spark_df.collect())
    if left == right:
        return None
    only_left, only_right = left - right, right - left
    return (
        f"{sum(left.values())} / {sum(right.values())} rows; only Spark ({sum(only_left.values())}): {list(only_left)[:2]}; "
        f"only SQL ({sum(only_right.values())}): {list(only_right)[:2]}"
    )


def main(argv: list[str]) -> int:
    """``python tests/compare.py SF_DIR [name …]``: compare queries and print one line each."""
    import os
    import tempfile

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from graphloom import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = argv[0], argv[1:]
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                result = differences(df, con, sqls[name])
                note = "ok" if result is None else f"DIFF {result}"
            else:
                result, note = None, f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001
            result = note = f"ERROR {str(error)[:1500]}"
        bad += result is not None
        print(f"{name:40s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} not equal")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

"""Compare registered queries with their SQL: python tests/check_queries.py FOLDER [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wireloom.plans import catalog, oracles
from wireloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def difference(frame, con, sql: str) -> str | None:
    """What differs between a DataFrame and a SQL result, or None."""
    names = sorted(frame.columns)
    found = con.sql(sql)
    if sorted(found.columns) != names:
        return f"columns {names} / {sorted(found.columns)}"
    kinds = {n: TYPES[t] for n, t in frame.dtypes}
    found_kinds = {n: str(t) for n, t in zip(found.columns, found.types)}
    if kinds != found_kinds:
        return f"types {[(n, kinds[n], found_kinds[n]) for n in names if kinds[n] != found_kinds[n]]}"
    picked = ", ".join(f'"{n}"' for n in names)
    left = Counter(tuple(r) for r in frame.select(names).collect())
    right = Counter(con.sql(f"SELECT {picked} FROM ({sql})").fetchall())
    if left != right:
        return f"{sum(left.values())} / {sum(right.values())} rows, e.g. {list((left - right))[:2]} / {list((right - left))[:2]}"
    return None


if __name__ == "__main__":
    folder, only = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check",
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), oracles.oracle_sql()
    for name, run in catalog.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            if name in sqls:
                verdict = difference(frame, con, sqls[name]) or "ok"
            else:
                verdict = f"rows {frame.count()}"
        except Exception as error:
            verdict = f"ERROR {str(error)[:400]}"
        print(f"{name:24s} {time.time() - start:6.1f}s  {verdict}", flush=True)

"""Runs bundled queries next to their SQL on DuckDB: python tests/oracle_check.py [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


from quillspark.session import scratch  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if isinstance(v, float):
                cells.append("null" if pd.isna(v) else repr(round(v, 6) + 0.0))
            elif v is None or v is pd.NaT or v is pd.NA:
                cells.append("null")
            elif hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
                cells.append(repr(v.tolist()))
            elif isinstance(v, bool) or str(type(v).__name__) == "bool_":
                cells.append(str(bool(v)))
            else:
                text = str(v)
                try:
                    cells.append(repr(round(float(text), 6) + 0.0))
                except ValueError:
                    cells.append(text)
        rows.append(tuple(cells))
    return sorted(rows)


def compare(spark, con, name, fn, sql, folder) -> tuple[bool, str]:
    with scratch(spark):
        got = fn(spark, folder).toPandas()
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        only_a = [r for r in a if r not in b][:3]
        only_b = [r for r in b if r not in a][:3]
        return False, f"{len(a)} vs {len(b)} rows\n   spark {str(only_a)[:900]}\n   duck  {str(only_b)[:900]}"
    return True, f"{len(a)} rows"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from quillspark.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "oracle-check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), oracle_sql(), 0
    chosen = sys.argv[1:]
    for name, fn in queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)
    spark.stop()

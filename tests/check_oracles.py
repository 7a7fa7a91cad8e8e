"""Run the registered queries against their DuckDB twins: python tests/check_oracles.py [sf_dir] [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from watchframe.session import get_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def differences(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str:
    """Empty when both hold the same rows, else what differs."""
    a, b = canonical(spark_df), canonical(duck_df)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    kinds = [(c, a[c].dtype, b[c].dtype) for c in a.columns if a[c].dtype.kind != b[c].dtype.kind]
    if kinds:
        return f"types {kinds}"
    bad = [c for c in a.columns if not ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all()]
    if bad:
        c = bad[0]
        where = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        return f"values {bad} {where.sum()} rows\n{a[where].head(3).to_string()}\n{b[where].head(3).to_string()}"
    return ""


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    failed = []
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            verdict = differences(got, con.execute(sql[name]).df()) if name in sql else "(rows only)"
        except Exception as e:  # noqa: BLE001
            took, verdict = time.time() - start, f"ERROR {str(e)[:1500]}"
        if verdict not in ("", "(rows only)"):
            failed.append(name)
        print(f"{name:28s} {took:6.2f}s {len(got) if 'got' in dir() else 0:6d} {verdict or 'ok'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()

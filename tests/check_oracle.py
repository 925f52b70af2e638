"""Compare every registered query with its SQL: `python tests/check_oracle.py [sf] [name ...]`."""

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    rows = df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0") else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE", "8")).config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name, query in contract.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
        except Exception as e:
            print(f"{name:26} FAIL {str(e)[:600]}")
            if os.environ.get("FULL"):
                print(str(e))
            bad += 1
            continue
        took = time.time() - start
        sql = contract.oracle_sql().get(name)
        if sql is None or os.environ.get("TIMES"):
            print(f"{name:26} rows {len(got):8}  {took:6.2f}s")
            continue
        want = con.execute(sql).df()
        ok = sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)
        print(f"{name:26} {'ok  ' if ok else 'DIFF'} {len(got):8} {len(want):8}  {took:6.2f}s", flush=True)
        if not ok:
            bad += 1
            a, b = normal(got), normal(want)
            print("   ", got.dtypes.to_dict(), want.dtypes.to_dict())
            print("   ", [x for x in zip(a, b) if x[0] != x[1]][:1].__repr__()[:800])
    return bad


if __name__ == "__main__":
    sys.exit(main())

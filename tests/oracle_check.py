"""Compare every registered query with its SQL counterpart: ``python tests/oracle_check.py DIR [names]``."""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return df.map(repr).sort_values(list(df.columns)).reset_index(drop=True)


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    kinds = [(c, ours[c].dtype.kind, theirs[c].dtype.kind) for c in ours.columns]
    odd = [k for k in kinds if k[1] != k[2]]
    if odd:
        return f"types {odd}"
    left, right = canonical(ours), canonical(theirs)
    off = (left != right).any(axis=1)
    if off.any():
        return f"{off.sum()} rows, first\n{left[off].head(2).to_dict('records')}\n{right[off].head(2).to_dict('records')}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ours = query(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sql:
                verdict = "rows only"
            else:
                verdict = compare(ours, con.execute(sql[name]).fetch_df()) or "equal"
            print(f"{name:30s} {len(ours):7d} rows {took:6.1f} s {time.time() - start - took:6.1f} s  {verdict}", flush=True)
        except Exception as problem:
            print(f"{name:30s} FAILED {type(problem).__name__} {str(problem)[:700]}", flush=True)


if __name__ == "__main__":
    main()

"""Runs queries beside their SQL in DuckDB: ``python -m tests.oracle [SF_DIR] [NAME...]``."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(found, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in found), key=str)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both agree."""
    df = query(spark, sf_dir)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if got != want:
        return f"{len(got)} and {len(want)} rows; first that differ: {next(((a, b) for a, b in zip(got, want) if a != b), None)}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    con, bad, all_queries = connect(sf), 0, entry.queries()
    for name, sql in entry.oracle_sql().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            said = compare(session, con, sf, all_queries[name], sql)
        except Exception as e:  # noqa: BLE001  every query gets its line
            said = f"{type(e).__name__}: {str(e)[:300]}"
        bad += bool(said)
        print(name, said or "ok", flush=True)
    sys.exit(bad > 0)

"""Compares catalog queries with their SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return ("f", "nan") if math.isnan(value) else ("f", repr(round(value, 8) + 0.0))
    return (type(value).__name__, repr(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = query(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if mine != theirs:
        extra, missing = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
        return f"{sorted(columns)}\n rows {len(mine)} != {len(theirs)};\n only here {extra[:2]}\n only SQL {missing[:2]}"
    return None if mine else "no rows"


def main(sf_dir, names):
    sys.path.insert(0, "/root/repo")
    from meterlake.demo.catalog import QUERIES
    from meterlake.demo.oracles import ORACLES
    from meterlake.session import get_session

    spark = get_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names or QUERIES:
        began = time.time()
        try:
            problem = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir) if name in ORACLES else "no SQL"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

"""Runs registered queries in Spark and DuckDB and compares the rows. ``python tests/compare.py 0.01 V5 L``"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

took: list[float] = []

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, folder):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took.append(time.time())
    if sql is None:
        return sum(got.values()), None, []
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    diff = [("spark", r) for r in list((got - want))[:3]] + [("sql", r) for r in list((want - got))[:3]]
    return sum(got.values()), sum(want.values()), diff


def main() -> None:
    sf, only = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    from tallyrun.session import build

    import __spark_entry__ as e

    spark = build("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                            "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    con, sqls, bad = duck(folder), e.oracle_sql(), []
    for name, q in e.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            n, m, diff = compare(spark, con, q, sqls.get(name), folder)
            mark = "ok" if not diff and (m is None or n == m) else "DIFF"
        except Exception as err:  # noqa: BLE001
            n = m = None
            mark, diff = "ERR", [str(err)[:900]]
        spark_s = took[-1] - start if took and took[-1] > start else 0
        print(f"{mark:5}{name:34}{spark_s:6.1f}s {time.time() - start - spark_s:6.1f}s  {n} {m if m is not None else '-'}", flush=True)
        if mark != "ok":
            bad.append(name)
            for d in diff:
                print("     ", d)
    print("bad:", bad)


if __name__ == "__main__":
    main()

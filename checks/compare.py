"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare [folder with the tables] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(root: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr), [names[i] for i in order]


def compare(spark, con, root, name, fn, sql) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, root)
    got, cols = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"{took:6.2f}s rows={len(got)} (no SQL)"
    res = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in res.description}
    want, wcols = rows_of([d[0] for d in res.description], res.fetchall())
    text = f"{took:6.2f}s rows={len(got)}"
    if cols != wcols:
        return False, f"{text} columns {cols} != {wcols}"
    spark_kinds = dict(df.dtypes)
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    off = [f"{c}:{spark_kinds[c]}/{kinds[c]}" for c in cols if pairs.get(spark_kinds[c]) != kinds[c]]
    if off:
        text += f" TYPES {off}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]
        return False, f"{text} want={len(want)} first differences {diff}"
    return not off and len(got) > 0, text


def main(argv):
    from checks import ORACLES, QUERIES
    from cohortflow import get_spark

    root = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = get_spark("compare", master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(root), []
    for name in names:
        try:
            ok, text = compare(spark, con, root, name, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", f"{name:28s}", text, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} agree; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Runs queries beside their SQL: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        at = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{at}'")
    return con


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {df.columns} and {columns}", ours, theirs
    return ("" if ours == theirs else f"{len(ours)} and {len(theirs)} rows; only ours {[x for x in ours if x not in set(theirs)][:2]}, only SQL's {[x for x in theirs if x not in set(ours)][:2]}"), ours, theirs


def main() -> None:
    import __spark_entry__ as e
    from acervo.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), e.oracle_sql(), 0
    for name, query in e.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            if name in sqls:
                why, ours, _ = compare(spark, con, sf_dir, query, sqls[name])
                n = len(ours)
            else:
                why, n = "", query(spark, sf_dir).count()
        except Exception as error:  # noqa: BLE001
            why, n = "ERROR " + str(error)[:900], 0
        bad += bool(why)
        print(f"{'BAD ' if why else 'ok  '} {name} rows={n} {time.time() - began:.1f}s {'' if name in sqls else '(no SQL) '}{why[:1200]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

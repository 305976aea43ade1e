"""Run queries and their SQL side by side."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(spark_df, con, sql):
    names = spark_df.columns
    got = rows_of(names, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want_names = [c[0] for c in result.description]
    want = rows_of(want_names, result.fetchall())
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}", len(got)
    if got != want:
        extra = sorted(set(got) - set(want))[:2]
        missing = sorted(set(want) - set(got))[:2]
        return f"{len(got)} rows against {len(want)}; extra {extra} missing {missing}", len(got)
    return None, len(got)


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    from tests.session import local_session
    import __spark_entry__ as entry

    spark, con, bad = local_session(), duck(sf_dir), 0
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                error, n = differences(df, con, sql[name])
            else:
                error, n = None, len(df.collect())
        except Exception as e:  # report and go on
            error, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += error is not None
        kind = "sql" if name in sql else "rows only"
        print(f"{name:28} {n:7} {time.time() - start:6.2f}s {kind} {error or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

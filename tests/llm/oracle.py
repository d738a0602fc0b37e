"""Compare a registered query with its SQL on one table folder."""

import duckdb

from fleetscope.llm.queries import ORACLE_SQL, QUERIES


def plain(rows, order):
    return sorted(repr([r[c] for c in order]) for r in rows)


def same_as_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = plain([dict(zip(names, r)) for r in cur.fetchall()], sorted(names))
    assert plain([r.asDict() for r in df.collect()], sorted(names)) == want and want

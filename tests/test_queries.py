"""Registered queries against their SQL where it once told other rows."""

import duckdb

import __spark_entry__ as entry


def told(name, folder):
    con = duckdb.connect()
    for t in ("nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = con.execute(entry.oracle_sql()[name])
    return [c[0] for c in got.description], got.fetchall()


def test_candidates_of_projects(spark):
    columns, rows = told("projects", entry.SMOKE_DIR)
    got = entry.queries()["projects"](spark, entry.SMOKE_DIR)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry_points
from lodework.plans import core

NAMES = sorted(core.oracle_sql())


def test_entry_and_names(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", ["bm25_top10", "rrf_fused", "traverse_2hop", "column_profiles", "query_plans", "communities_ranked", "stage_report", "table_chunks"])
def test_against_sql(spark, sf, name):
    duckdb = importlib.import_module("duckdb")
    con = duckdb.connect()
    for t in ("lexical_docs", "queries", "edges", "entities", "subjects", "records", "events", "blocks", "mentions", "indexed_chunks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = core.queries()[name](spark, sf)
    cols = sorted(df.columns)
    told = con.execute(core.oracle_sql()[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == cols
    tidy = lambda v: round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v
    want = sorted((repr([tidy(r[names.index(c)]) for c in cols]) for r in told.fetchall()))
    got = sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect())
    assert got == want

"""Queries against their DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from alphaloom.queries import ORACLE_SQL, QUERIES

#: One of each kind; the driver checks all of them.
CHOSEN = ["s01_bars", "s03_fundamentals", "s07_document_coverage", "w_rsi_5d", "w_amihud_20d", "j04_asof_fundamentals", "w10_cross_sectional_z", "w11_sector_neutral_z", "w12_bounded_fill", "r01_rank_ic", "r25_regime_multiplier", "w17_quantile_buckets", "b02_long_short", "b02_full_long_short", "a14_two_layer", "w15_streaks", "r07_kruskal", "r08_mann_whitney", "s16_chunks", "x02_windowed_flow"]


def sorted_rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    for c in pdf.columns:
        pdf[c] = pdf[c].astype(float).round(5) if pdf[c].dtype.kind == "f" else pdf[c].astype(str)
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, tiny, name):
    con = duckdb.connect()
    for p in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = sorted_rows(QUERIES[name](spark, tiny).toPandas()), sorted_rows(con.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert {"date", "ret", "equity"} <= set(out.columns)
    assert set(e.oracle_sql()) <= set(e.queries())

"""Some queries against their SQL on the smallest tables; the driver holds all of them."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
@pytest.mark.parametrize("name", ["paragraphs", "section_pairs", "select_rules", "widen_regions", "speech_runs", "normalize", "quiet_runs", "left_out", "clip_totals"])
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    assert sorted(map(str, map(key, map(tuple, got.select(*columns).collect())))) == sorted(map(str, map(key, want)))

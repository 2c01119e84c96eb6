"""The document queries that have SQL, against DuckDB on whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cartolith.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf_dir, name):
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].sort_values(columns, na_position="last").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)

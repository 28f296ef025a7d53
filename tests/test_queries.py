"""Every imagery query against its SQL in DuckDB, and the entry point's contract."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from verdanta import catalogue

DATA = "/root/testdata/sf0.001"


def keyed(df):
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    columns = sorted(df.columns)
    return columns, sorted((tuple(cell(v) for v in row) for row in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert keyed(catalogue.QUERIES[name](spark, DATA).toPandas()) == keyed(duck.execute(catalogue.ORACLES[name]).df())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 16
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cva_nd_covers_all_elements(spark):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet").set_index("vec_id")["embedding"].map(lambda v: np.array(v, float)).to_dict()
    want = {i // 2: np.sqrt(((e[i + 1] - e[i]) ** 2).sum()) if i + 1 in e else 0.0 for i in sorted(e) if i % 2 == 0}
    limit = np.mean(list(want.values())) + 1.5 * np.std(list(want.values()))
    got = {r["pair"]: r for r in catalogue.QUERIES["cva_nd"](spark, DATA).collect()}
    assert {len(v) for v in e.values()} == {64} and set(got) == set(want)
    assert all(abs(got[p]["magnitude"] - m) < 1e-5 and got[p]["changed"] == (m > limit) and got[p]["change_type"] == 0 for p, m in want.items())

import duckdb
import pytest

import __spark_entry__ as E
from quernstone.plans import catalogue


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "customer documents embeddings eval_items events graph_nodes indexed_chunks orders parsed_chunks parsed_documents parsed_entities scraped_pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, small).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() >= 0

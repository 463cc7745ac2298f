"""Registered queries against their DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "region", "supplier", "customer", "part", "documents", "benchmark", "pages", "labels"]
NAMES = ["pdf_tagged", "pdf_outline", "pdf_images", "pdf_fonts", "pdf_columns", "pdf_metadata", "pdf_failures", "pdf_extract", "filters_checked", "safe_names", "html_pages", "library_ingest", "search_ladder", "search_corrected", "search_stemmed", "search_many_whole", "snippets", "postings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_like_the_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    said = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(said.fetchall())

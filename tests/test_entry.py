import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["catalog_list", "token_freq", "concept_cosine", "density_counts", "chapters", "section_spans", "density_sections", "concept_merged", "edges_comparison", "cooccurrence_clusters", "formula_variables"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF).select(*want.columns).collect()
    plain = lambda rows: sorted(str(tuple(float(x) if isinstance(x, int) else x for x in r)) for r in rows)
    assert plain(want.fetchall()) == plain(got)

"""Every registered query with SQL, against that SQL in DuckDB."""

import os

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in cols])
    kinds = dict(df.dtypes)
    assert [KINDS[kinds[c]] for c in cols] == [str(t) for t in rel.types]
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, rel.fetchall()))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("plain", [True, False])
def test_redirects_to_a_path_that_several_pages_share(spark, tmp_path, plain):
    """A row for each page at the path; pages of equal paths in another archive (the first two of 98) are none of them, and without plain pages there is no target."""
    urls = [f"http://a.example.org/en/{i:03d}" for i in (0, 1, 1, 1, 2, *range(4, 94), 98, 98, 98, 99, 99)] if plain else []
    urls += [f"http://a.example.org/en/{i:03d}#top" for i in (1, 1, 2, 98, 99)]
    c = duckdb.connect()
    c.execute("CREATE TABLE pages AS SELECT CAST(i AS BIGINT) AS page_id, $1[i + 1] AS url, '<title>t</title>' AS html FROM range(len($1)) t(i)", [urls])
    c.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    want = c.sql(entry.oracle_sql()["archive_redirects"]).fetchall()
    got = entry.queries()["archive_redirects"](spark, str(tmp_path)).select("archive", "entry_id", "final_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len(want) > 5 if plain else {w[2] for w in want} == {None}

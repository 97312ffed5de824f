"""Every registered query with SQL, on both engines over the same small tables."""

import datetime

import duckdb
import pytest

from chatloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    talks = [(c, t, "system" if t == 0 and c % 5 == 0 else ("user", "assistant")[(t + (c % 5 == 0)) % 2], f"Line one {c}.\n\n\n  And  two {t}:  {'word ' * (c * t % 11)}") for c in range(14) for t in range(2 + c % 6)]
    docs = [(i, f"Text {i}\n\n\n  more   words  x " * (1 + i % 4), "en", "s", 40 * (1 + i % 4) * 700) for i in range(24)]
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(hours=i), i % 7, "view", float(i), f'{{"k": {i % 3}, "v": "x"}}') for i in range(60)]
    pages = [(1, "http://a.example.com/en/1?x=2", "<p>a<p><b>x</b><a href='/one'> First <i>link</i></a><a>none</a><a href='https://b/2'></a>"), (2, "https://b.example.org/longidentifier/#top", None)]
    for name, rows, schema in (
        ("conversations", talks, "conv_id long, turn long, role string, text string"),
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("events", events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        ("pages", pages, "page_id long, url string, html string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("conversations", "documents", "events", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * {'REPLACE (CAST(ts AS TIMESTAMP) AS ts)' if name == 'events' else ''} FROM '{tables}/{name}.parquet/*.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_spark_equals_sql(spark, tables, duck, name):
    got = QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) x").fetchall()
    assert plain(got.select(*columns).collect()) == plain(expected)
    assert expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_run(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_page_links_as_they_stand(spark, tables):
    assert [tuple(r) for r in QUERIES["page_links"](spark, tables).orderBy("page_id", "ord").collect()] == [(1, 0, "/one", "First link"), (1, 1, "https://b/2", "")]


def test_entry_point_without_the_optional_packages(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_present", lambda module: False)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fernweave.plans import queries
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["indegree_topk", "account_listing", "relationships_page", "bfs_nodes", "bfs_edges", "post_sample_metrics", "candidate_admission", "affinity", "approach_plan", "layer_state", "expansion_outcomes", "timeline_outcomes", "pagination_outcomes", "response_classify", "parse_users", "parse_posts", "seed_list_parse", "stream_apply"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "account_id"


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SMALL, t)}.parquet'")
    expected = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    place = [expected.columns.index(c) for c in columns]
    told = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert told([tuple(r[c] for c in columns) for r in df.collect()]) == told([tuple(r[i] for i in place) for r in expected.fetchall()])


@pytest.mark.parametrize("name", ["parse_users", "parse_posts", "parse_cursors", "stream_apply"])
def test_pages_are_bounded(spark, name, monkeypatch):
    monkeypatch.setattr(queries, "SPAN", 40, raising=False)
    parts = {"parse_posts": queries._pages_of_events, "parse_cursors": queries._pages_of_events}.get(name, queries._pages_of_customers)(spark, SMALL)
    sizes = parts.selectExpr("regexp_count(payload, '__typename') AS n").agg({"n": "max"}).head()[0]
    assert sizes <= 40
    test_query_equals_its_sql(spark, name)

"""Every query against its SQL on the smallest tables."""

import pytest
from compare import TESTDATA, connect, difference

import __spark_entry__ as entry

SF = "sf0.001"
LLM = {"pipeline", *entry.LLM_QUERIES}  # these are checked by tests of their own
QUERIES = {k: v for k, v in entry.queries().items() if k not in LLM}
SQL = {k: v for k, v in entry.oracle_sql().items() if k not in LLM}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"track_assign_boxes"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    table = QUERIES[name](spark, str(TESTDATA / SF)).toArrow()
    assert table.num_rows > 0
    if name in SQL:
        assert difference(table, con.execute(SQL[name]).to_arrow_table()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["stream_rep_count", "state_ttl"])
def test_stream_over_many_landings(spark, con, name, monkeypatch):
    from checks import queries

    monkeypatch.setattr(queries, "LANDING_ROWS", 350)
    table = QUERIES[name](spark, str(TESTDATA / SF)).toArrow()
    assert difference(table, con.execute(SQL[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", ["frame_loop_tracked", "frame_overlay"])
@pytest.mark.parametrize("parts", [[(3_404_800, 3_406_400)], [(0, 600), (1_000_003, 1_000_500)]])
def test_tracks_that_break_off(spark, tmp_path, name, parts):
    """A box beyond where its track is looked for, and a pause longer than the tracker remembers that ends inside a frame."""
    import duckdb

    ids = " UNION ALL ".join(f"SELECT unnest(range({a}, {b})) AS event_id" for a, b in parts)
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE events AS SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts, event_id % 7 AS user_id, "
        f"CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'view' END AS event_type FROM ({ids})"
    )
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    table = QUERIES[name](spark, str(tmp_path)).toArrow()
    assert difference(table, con.execute(SQL[name]).to_arrow_table()) is None

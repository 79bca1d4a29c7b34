"""Every query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from quillforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [tuple(r) for r in want.fetchall()]
    assert _sorted(tuple(r) for r in df.select(*columns).collect()) == _sorted(rows)


def test_every_query_has_a_distinct_name_and_runs_without_sql(spark, sf_dir):
    without = set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)
    assert without == {"stream_rate_limit", "closest_names", "words_in_documents"}


def test_rate_limit_against_a_plain_loop(spark, sf_dir):
    got = {r["event_id"]: r["accepted"] for r in catalogue.QUERIES["stream_rate_limit"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect()
    taken, want = {}, {}
    for r in rows:
        mine = [t for t in taken.get(r["user_id"], []) if (r["ts"] - t).total_seconds() < 12 * 3600]
        want[r["event_id"]] = len(mine) < 3
        taken[r["user_id"]] = mine + [r["ts"]] * want[r["event_id"]]
    assert got == want and not all(want.values())


def test_streams_of_many_files_that_are_not_in_order(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_entity_states", "stream_rate_limit"):
        want, got = (sorted(map(tuple, catalogue.QUERIES[name](spark, str(d)).collect())) for d in (sf_dir, tmp_path))
        assert got == want
    last = {r["user_id"]: r["event_id"] for r in events.orderBy("ts", "event_id").collect()}
    assert {r["user_id"]: r["last_seq"] for r in catalogue.QUERIES["stream_entity_states"](spark, str(tmp_path)).collect()} == last


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_have_no_cartesian_products_and_push_filters_down(spark, sf_dir):
    lines = catalogue.QUERIES["price_or_range"](spark, sf_dir)
    plan = lines._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Generate" not in plan
    physical = plan.split("Physical Plan")[1]
    assert "l_extendedprice" not in physical

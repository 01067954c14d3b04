"""Registered queries against their DuckDB SQL on the smallest tables, and the plans that they should have."""

from collections import Counter

import duckdb
import pytest

from ledgerloom import plans
from ledgerloom.operators import workload
from ledgerloom.operators.clause import Clause, LogFilter, page
from ledgerloom.plans import oracles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, duck, name, monkeypatch):
    monkeypatch.setattr(workload, "TRACES", 300)  # the driver's check draws all of them
    df = plans.queries()[name](spark, SF)
    want = duck.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(rounded(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(map(rounded, r)) for r in want.fetchall())


def test_pushdown(spark, tmp_path):
    plans.queries()["chain_logs"](spark, SF).write.parquet(f"{tmp_path}/logs")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the plan's text is cut
    where = LogFilter(address=Clause.any_of(plans.ADDRS), topic0=Clause.one("NO"))
    plan = page(spark.read.parquet(f"{tmp_path}/logs"), where, "log_id", 10, 1, 5).select("log_id", "address")._jdf.queryExecution().toString()
    assert "In(address" in plan and "EqualTo(topic0,NO)" in plan and "TakeOrderedAndProject" in plan
    assert "topic3" not in plan.split("ReadSchema:")[1]

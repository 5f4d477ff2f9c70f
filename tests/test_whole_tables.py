"""Registered queries that must read whole tables, on small ones."""

import random
from datetime import datetime

from chainframe.operators import aggs
from chainframe.plans import more, results  # noqa: F401  register their queries
from chainframe.plans.queries import QUERIES


def events(spark, folder, data):
    """data: (event_id, user, second, kind, k)."""
    rows = [(i, datetime.fromtimestamp(1_700_000_000 + s), user, kind, 1.0, f'{{"k": {k}}}') for i, user, s, kind, k in data]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_order_is_checked_for_every_signer(spark, tmp_path):
    d = events(spark, tmp_path, [(1, 3, 0, "view", 9), (2, 7, 0, "view", 5), (3, 7, 1, "view", 4), (4, 3, 1, "view", 8), (5, 8, 0, "view", 1)])
    assert sorted(r[0] for r in QUERIES["e07_check_order"](spark, d).collect()) == [3, 4]


def test_every_order_is_audited(spark, tmp_path):
    d = events(spark, tmp_path, [(1, 1, 0, "signup", 50), (2, 1, 1, "purchase", 50), (3, 2, 0, "purchase", 50), (4, 2, 0, "signup", 1)])
    assert sorted(tuple(r) for r in QUERIES["t16_order_lifecycle"](spark, d).collect()) == [("2/1", "ENDS"), ("2/50", "DECISIONS")]


def test_every_order_key_is_reconciled(spark, tmp_path):
    spark.createDataFrame([(7, 1.0), (8, 2.0), (14, 3.0)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 1.0), (8, 1.0), (21, 1.0)], "l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["c21_reconcile"](spark, str(tmp_path)).select("k", "status").collect()
    assert {tuple(r) for r in got} == {(7, "MATCH"), (8, "MISMATCH"), (14, "ONLY_LEFT"), (21, "ONLY_RIGHT")}


def test_stream_results_are_files_and_not_the_drivers(spark, tmp_path):
    d = events(spark, tmp_path, [(1, 3, 0, "view", 9), (2, 3, 1, "purchase", 5), (3, 7, 0, "view", 4)])
    seen, balances = QUERIES["k01_stream_dedup"](spark, d), QUERIES["k04_stream_balances"](spark, d)
    assert seen.inputFiles() and balances.inputFiles()
    assert sorted(r.signer for r in seen.collect()) == [3, 7] and sorted(tuple(r) for r in balances.collect()) == [(3, 0), (7, 100)]
    empty, names = tmp_path / "empty", ("k01_stream_dedup", "k02_stream_activity", "k03_stream_cooldown", "k04_stream_balances")
    assert [QUERIES[q](spark, events(spark, empty / q, [])).count() for q in names] == [0, 0, 0, 0]


def test_cooldown_holds_no_key_as_a_whole(spark):
    r = random.Random(5)
    data = [(i, r.choice(["big", "big", "b", None]), r.choice([None, *range(90)]), r.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, k string, t long, x int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    out = aggs.cooldown(df, ["k"], "t", ["id"], 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {(x.id, x.k, x.t, x.x): x.accepted for x in out.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for row in sorted(data, key=lambda d: (d[2] is None, d[2] or 0, d[0])):
        k, t = row[1], row[2]
        want[row] = k not in last or t is not None and t - last[k] >= 10
        last[k] = t if want[row] else last[k]
    assert got == want and "InPandas" not in plan

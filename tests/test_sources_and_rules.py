"""Scans and writes on real files, and rules of single operators against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chainframe.functions import scalar as sc
from chainframe.operators import aggs, joins, pit, trips
from chainframe.sources import tables


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_remote_tables_are_read_in_bounded_parts(spark):
    url, driver = "jdbc:derby:memory:scan;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V")).write.format("jdbc").options(url=url, dbtable="T", **driver).save()
    df = tables.scan_jdbc(spark, url, "T", "K", 10, 30, 4, **driver)
    assert got(df, "K", "V") == sorted(((i, 2 * i) for i in range(10, 30)), key=repr) and df.rdd.getNumPartitions() == 4


def test_json_lines_that_do_not_fit_fail(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join(json.dumps({"slot": i, "mint": "m"}) for i in range(3)))
    assert got(tables.read_jsonl(spark, str(good), "slot long, mint string"), "slot") == [(0,), (1,), (2,)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"slot": 1, "mint": "m"}\n{"slot": "x"')
    with pytest.raises(Exception, match="alformed|FAILFAST"):
        tables.read_jsonl(spark, str(bad), "slot long, mint string").collect()


def test_cache_opens_only_its_partitions(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("slot"), F.floor(F.col("id") / 100).cast("int").alias("bucket"))
    df.write.partitionBy("bucket").parquet(f"{tmp_path}/c")
    out = tables.read_cache(spark, f"{tmp_path}/c", "bucket", "slot", 250, 410, 100)
    assert got(out, "slot") == sorted(((i,) for i in range(250, 410)), key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and len({r[0] for r in out.select(F.input_file_name()).collect()}) <= 3 * 4


def test_date_partitions_are_pruned(spark, tmp_path):
    spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-20')) as dt").withColumn("v", F.lit(1)).write.partitionBy("dt").parquet(f"{tmp_path}/d")
    out = tables.prune_by_date(spark.read.parquet(f"{tmp_path}/d"), "dt", "2024-01-03", "2024-01-05")
    assert out.count() == 3 and "PartitionFilters: [isnotnull(dt" in out._jdf.queryExecution().executedPlan().toString()


def test_results_are_written_once(spark, tmp_path):
    tables.write_results({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/a")).count() == 3 and spark.read.parquet(str(tmp_path / "r/b")).count() == 2
    with pytest.raises(Exception, match="exists"):
        tables.write_results({"a": spark.range(3)}, str(tmp_path / "r"))


def test_snapshots_of_other_columns_join_by_name(spark, tmp_path):
    tables.write_snapshot(spark.range(2), str(tmp_path / "x"), ["id"])
    tables.write_snapshot(spark.range(2, 4).withColumn("more", F.lit("m")), str(tmp_path / "y"), ["id"])
    assert got(tables.read_snapshot(spark, [str(tmp_path / "x"), str(tmp_path / "y")]), "id", "more") == [(0, None), (1, None), (2, "m"), (3, "m")]


def test_canonical_order(spark):
    rows = [(2, 0, 1, "a"), (1, 5, None, "z"), (1, 5, 0, "b"), (1, 5, 0, "a"), (1, 4, 9, "c")]
    df = spark.createDataFrame(rows, "boundary long, grp long, ix long, cause string")
    want = sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3]))
    assert [tuple(r) for r in aggs.merge_streams(df.where("ix is null"), df.where("ix is not null"), order=("boundary", "grp", "ix", "cause")).collect()] == want


def test_base58_sizes(spark):
    r = random.Random(3)
    raw = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 20, 31, 32, 32, 33)] + [b"\0" * 32, b"\0" + b"\xff" * 31, b""]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, x binary").withColumn("t", sc.to_base58("x"))
    assert got(df.select("i", sc.base58_bytes("t").alias("n")), "i", "n") == sorted(((i, len(x)) for i, x in enumerate(raw)), key=repr)
    other = spark.createDataFrame([("0OIl",), (None,), ("é",)], "t string")
    assert [x[0] for x in other.select(sc.base58_bytes("t")).collect()] == [None, None, None]


def test_percentiles_of_any_key(spark):
    r = random.Random(8)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(12)])) for _ in range(400)] + [("one", 5)]
    df = spark.createDataFrame(data, "k string, v long").repartition(7)
    for p in (0, 1, 50, 95, 100):
        want = set()
        for k in {k for k, _ in data}:
            v = sorted(v for kk, v in data if kk == k and v is not None)
            want.add((k, v[((len(v) - 1) * p + 99) // 100]))
        assert set(got(aggs.rank_percentile(df, ["k"], "v", p, "x"), "k", "x")) == want


def test_clocks_over_many_spans(spark):
    r, span = random.Random(2), joins.SPAN
    at = sorted(r.sample(range(0, 9 * span), 300)) + [40 * span, 40 * span + 1]
    blocks = [(b, r.randrange(3), 10 * b) for b in at]
    clock = joins.clock_prefix(spark.createDataFrame(blocks, "block long, tx_count long, time long"))
    want, total = [], 0
    for b, n, _ in blocks:
        want.append((b, total))
        total += n
    assert got(clock, "block", "prefix") == sorted(want, key=repr)
    asked = spark.createDataFrame([(v,) for v in (-5, 0, at[0], at[0] + 1, at[150] + 1, 20 * span, at[-1], at[-1] + 1)], "v long")
    out = {x.v: x.p for x in joins.first_not_below(asked, "v", clock.select("block"), "block", "p").collect()}
    assert out == {v: min((b for b in at if b >= v), default=None) for v in out}


@pytest.mark.parametrize("limit", [1000, 3])
def test_schedules_short_and_long(spark, limit, monkeypatch):
    monkeypatch.setattr(joins, "SCHEDULE_ROWS", limit)
    plan = [(10 + 50 * i, 10 + 50 * i + (50 if i % 3 else 40), f"m{i}") for i in range(12)]
    rows = spark.createDataFrame([(i,) for i in (-3, 9, 10, 49, 50, 59, 60, 300, 555, 609, 610, 9999, None)], "at long")
    schedule = spark.createDataFrame(plan, "valid_from long, valid_until long, model_id string")
    want = set()
    for (at,) in [tuple(x) for x in rows.collect()]:
        m = next((m for lo, hi, m in plan if at is not None and lo <= at < hi), None)
        want.add((at, m, "SCORED" if m else "UNCOVERED" if at is not None and at < 10 else "GAP"))
    assert set(got(joins.model_at(rows, schedule, "at"), "at", "model_id", "status")) == want
    assert {r.status for r in joins.model_at(rows, schedule.limit(0), "at").collect()} == {"UNCOVERED"}


def test_states_that_an_order_could_have_seen(spark):
    orders = spark.createDataFrame([(1, "v", 5, 2, 3), (2, "v", 5, 2, 0), (3, "v", 5, 3, 0), (4, "w", 1, 1, 1)], "id long, k string, b long, t long, i long")
    states = spark.createDataFrame([("v", 5, 2, 1, "AFTER_INSTRUCTION", 10), ("v", 5, 2, 2, "AFTER_TRANSACTION", 20), ("v", 5, 2, 3, "AFTER_INSTRUCTION", 30), ("v", 5, 1, 9, "AFTER_TRANSACTION", 5)], "k string, b long, t long, i long, timing string, v long")
    assert got(joins.asof_causal(orders, states, ["k"], ("b", "t", "i"), "timing", ["v"]), "id", "v") == [(1, 10), (2, 5), (3, 20), (4, None)]


def test_transactions_take_the_rows_of_highest_priority(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 1, "a"), (2, 1, "b"), (3, 1, None), (3, 1, None), (4, 1, None), (4, 1, "z")], "tx long, prio int, f string")
    assert got(aggs.transactions(df, ["tx"], ["f"], "prio"), "tx", "f", "n_instructions", "conflict") == [(1, "x", 2, False), (2, "b", 2, True), (3, None, 2, False), (4, "z", 2, True)]


def test_coverage_must_equal_the_plan(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, mint string")
    one = aggs.coverage(df, "mint")
    assert aggs.differs_from_plan(one, aggs.coverage(df.repartition(3), "mint")).count() == 0
    assert {r.field for r in aggs.differs_from_plan(one, aggs.coverage(df.where("id < 3"), "mint")).collect()} == {"signals", "keys", "digest"}


def test_feature_sets_of_other_rows_fail(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "row_id long, x long"), spark.createDataFrame([(1, 7), (2, 8)], "row_id long, y long")
    assert got(joins.align_features(a, b), "row_id", "x", "y") == [(1, 5, 7), (2, 6, 8)]
    for other in (b.where("row_id = 1"), b.union(b.where("row_id = 1")), b.union(spark.createDataFrame([(3, 1)], "row_id long, y long"))):
        with pytest.raises(Exception, match="different rows"):
            joins.align_features(a, other).collect()


def test_scores_fail_or_stay_empty_without_a_feature(spark):
    model = spark.createDataFrame([("m", 0, 10, -1, 5, 2, [3])], "model_id string, valid_from long, valid_until long, model_available long, bias long, divisor long, weights array<long>")
    rows = spark.createDataFrame([(1, 3, 3), (None, 4, 4), (2, 50, 50)], "x long, at long, available long")
    assert got(pit.score(rows, model, "at", ["x"]).withColumn("p", F.col("prediction").cast("int")), "at", "p", "status") == [(3, 4, "SCORED"), (4, None, "SCORED"), (50, None, "GAP")]
    with pytest.raises(ValueError, match="missing"):
        pit.score(rows, model, "at", ["x"], "FAIL")
    assert pit.score(rows.where("x is not null"), model, "at", ["x"], "FAIL").count() == 2


def test_histories_and_lifecycles(spark):
    rows = [("v", 1, "launch", "p", "ACTIVE"), ("v", 2, "state", "p", "ACTIVE"), ("v", 3, "state", "q", "ACTIVE"), ("v", 4, "state", "p", None), ("v", 5, "launch", "p", "ACTIVE"), ("w", 1, "state", "p", "ACTIVE")]
    df = spark.createDataFrame(rows, "k string, at long, kind string, pair string, life string")
    out = trips.check_state_history(df, ["k"], ["at"], "kind", "launch", "pair", "life", {"state": ["ACTIVE"]})
    assert got(out, "k", "at", "rule") == [("v", 3, "OTHER_PAIR"), ("v", 4, "LIFECYCLE"), ("v", 5, "SECOND_LAUNCH"), ("w", 1, "NO_LAUNCH")]
    ends = spark.createDataFrame([(1, "done", 5), (1, "done", 5), (2, "done", 4), (3, "done", None), (4, "done", 5), (5, "other", 0)], "tx long, kind string, v long")
    assert got(trips.check_lifecycle(ends, ["tx"], "kind", ["done"], {"done": F.col("v") == 5}), "tx", "n", "off") == [(1, 2, 0), (2, 1, 1), (3, 1, 1)]


def test_logistic_fit_separates(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(x := r.uniform(-3, 3), r.uniform(-1, 1), float(x > 0.5)) for _ in range(300)], "a double, b double, y double")
    out = pit.fit_logistic(df, ["a", "b"], "y").transform(df)
    assert out.where("prediction = y").count() >= 290


def test_trailing_hours_without_rows_count_as_zero(spark):
    df = spark.createDataFrame([("k", 0, 2, 10, 1), ("k", 4, 1, 6, 1), ("k", 12, 1, 1, 0)], "k string, h long, n long, total long, hits long")
    out = {r.h: r for r in aggs.trailing_features(aggs.hourly_spine(df, ["k"], "h", ["n", "total", "hits"]), ["k"], "h", "n", "total", "hits").collect()}
    assert sorted(out) == list(range(13))
    assert (out[5].trailing_n, out[5].trailing_mean, out[5].trailing_share) == (3, 16 / 3, 2 / 3)
    assert (out[12].trailing_n, out[12].trailing_mean, out[11].trailing_share) == (0, None, None)

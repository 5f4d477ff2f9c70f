"""Operators on literal rows, against plain Python."""

import random
from datetime import date, datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chainframe.functions import scalar as sc
from chainframe.operators import aggs, filters, graph, joins, pit, quality, trips
from chainframe.sources import tables
from chainframe.streaming import streams


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_floor_and_ceil_are_exact(spark):
    big = 10**18 + 7
    df = spark.createDataFrame([(big, 3), (-7, 2), (0, 5), (10**17, 10**17 - 1)], "a long, b long")
    got = df.select("a", "b", sc.floordiv(F.col("a"), F.col("b")).alias("f"), sc.ceildiv(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(int(r.f) == r.a // r.b and int(r.c) == -(-r.a // r.b) for r in got)


def test_boundary_round_trip(spark):
    df = spark.createDataFrame([(0, -1), (5, 0), (2**30, 77)], "b long, t long").withColumn("x", sc.boundary(F.col("b"), F.col("t")))
    assert rows(df.select("b", "t", sc.boundary_block(F.col("x")).alias("b2"), sc.boundary_tx(F.col("x")).alias("t2")), "b", "t", "b2", "t2") == [(0, -1, 0, -1), (5, 0, 5, 0), (2**30, 77, 2**30, 77)]


def test_price_exit_takes_the_loss_first_and_includes_the_edge(spark):
    df = spark.createDataFrame([(90, 1), (120, 1), (100, 1)], "p long, d long")
    assert [r[0] for r in df.select(sc.price_exit(F.col("p"), F.col("d"), F.lit(100), F.lit(1), 1000, 2000)).collect()] == ["STOP_LOSS", "TAKE_PROFIT", None]


def test_base58_keeps_leading_zeros(spark):
    df = spark.createDataFrame([(bytearray(b"\0\0\x01"),), (bytearray(b""),), (None,)], "x binary")
    assert [r[0] for r in df.select(sc.to_base58("x")).collect()] == ["112", "", None]


def test_co_occurrence_includes_the_edge_and_ties(spark):
    df = spark.createDataFrame([("m", 1, 0, 1), ("m", 2, 60, 2), ("m", 3, 121, 3), ("n", 1, 5, 4), ("n", 2, 5, 4)], "mint string, signer long, t long, event_id long")
    assert rows(joins.co_occurrence(df, 60), "key", "a", "b", "direction") == [("m", 1, 2, -1), ("n", 1, 2, 0)]


@pytest.mark.parametrize("strict,forward", [(False, False), (True, False), (False, True), (True, True)])
def test_asof_against_a_loop(spark, strict, forward):
    rnd = random.Random(3)
    left = [(i, rnd.randrange(3), rnd.randrange(30)) for i in range(60)]
    right = sorted({(rnd.randrange(3), rnd.randrange(30)) for _ in range(40)})
    got = joins.asof(spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame([(*r, None if r[1] % 5 == 0 else r[1] * 10) for r in right], "k long, s long, v long"), ["k"], "t", "s", ["s", "v"], strict, forward)

    def want(k, t):
        fits = [s for kk, s in right if kk == k and ((s > t or s == t and not strict) if forward else (s < t or s == t and not strict))]
        return (min(fits) if forward else max(fits)) if fits else None

    assert {r.id: (r.s, r.v) for r in got.collect()} == {i: (s, None if s is None or s % 5 == 0 else s * 10) for i, k, t in left for s in [want(k, t)]}


def test_positions_on_a_clock_with_empty_blocks(spark):
    blocks = [(10, 2, 100), (11, 0, 100), (12, 3, 105), (13, 0, 106), (15, 1, 110)]
    clock = joins.clock_prefix(spark.createDataFrame(blocks, "block long, tx_count long, time long"))
    flat = [(b, i) for b, n, _ in blocks for i in range(n)]
    asked = [(10, 0), (10, 1), (12, 2), (15, 0)]
    pos = spark.createDataFrame(asked, "block long, tx long")
    for n in (1, 2, 4):
        got = {(r.block, r.tx): (r.to_block, r.to_tx) for r in joins.nth_after(pos, clock, n).collect()}
        assert got == {p: (flat[i] if (i := flat.index(p) + n) < len(flat) else (None, None)) for p in asked}
    aim = pos.withColumn("target", F.lit(101))
    full = [(b, t) for b, n, t in blocks if n]
    assert {r.block: r.to_block for r in joins.first_at_or_after(aim, clock, "target").collect()} == {p[0]: min((b for b, t in full if b > p[0] and t >= 101), default=None) for p in asked}
    due = joins.delay_delivery(pos, clock, 2)
    assert {r.block: r.released for r in due.collect()} == {10: 12, 12: 15, 15: None}


def test_roles_come_from_the_nearest_ancestor_of_the_same_decoder(spark):
    df = spark.createDataFrame([(1, [1], "d", "top"), (1, [1, 2], "d", None), (1, [1, 2, 3], "d", None), (1, [1, 2, 4], "e", None)], "tx long, path array<int>, decoder string, role string")
    assert rows(joins.inherit_roles(df, ["tx"]), F.concat_ws(".", F.col("path").cast("array<string>")), "inherited_role") == [("1", "top"), ("1.2", "top"), ("1.2.3", "top"), ("1.2.4", None)]


def test_variants_count_nulls(spark):
    df = spark.createDataFrame([(1, None, 2), (1, "x", 2), (1, None, 2)], "k long, a string, b long")
    assert rows(aggs.collapse_occurrences(df, ["k"], ["a", "b"]), "k", "source_row_count", "payload_variant_count") == [(1, 3, 2)]


def test_paths_compare_by_step(spark):
    df = spark.createDataFrame([(1, [4, 10], "late"), (1, [4, 6], "early")], "k long, path array<int>, v string")
    assert rows(aggs.last_state(df, ["k"], ["v"], ["path"]), "k", "v") == [(1, "late")]


def test_unknown_is_not_zero(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, 5)], "status string, x long, y long")
    r = aggs.run_totals(df, "status", ["A"], ["x"], ["y"]).first()
    assert (r.positions, r.a, r.x, r.y) == (2, 2, 3, None)


def test_frontier_stops_at_the_first_gap(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 8), ("a", 9, 20), ("a", 21, 30), ("b", 3, 9)], "k string, lo long, hi long")
    assert rows(aggs.frontier(df, ["k"], "lo", "hi", 0), "k", "frontier") == [("a", 20), ("b", 0)]


def test_cooldown_counts_from_the_last_accepted_row(spark):
    df = spark.createDataFrame([("d", t, t) for t in (0, 300, 600, 900, 1199, 1200)], "k string, t long, id long")
    assert rows(aggs.cooldown(df, ["k"], "t", ["id"], 600), "t", "accepted") == [(0, True), (300, False), (600, True), (900, False), (1199, False), (1200, True)]


def test_priority_conflicts_are_told(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 2, "y"), (2, 1, "z"), (2, 3, "w")], "k long, prio int, p string")
    assert rows(aggs.dedup_by_priority(df, ["k"], "prio", ["p"]), "k", "p", "conflict") == [(1, "x", True), (2, "w", False)]


def test_rank_percentile_is_a_value_of_the_data(spark):
    data = [7, 1, 5, 3, 9, 11, 2]
    df = spark.createDataFrame([("k", v) for v in data], "k string, v long")
    for p in (50, 95):
        assert aggs.rank_percentile(df, ["k"], "v", p, "x").first().x == sorted(data)[((len(data) - 1) * p + 99) // 100]


def test_ordinals_and_fingerprint_ignore_the_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v == r.n for r in aggs.with_ordinal(df, ["v"], "n").collect())
    assert aggs.fingerprint(df).first() == aggs.fingerprint(df.repartition(7).orderBy(F.desc("v"))).first()


def test_ledger_checks(spark):
    p = spark.createDataFrame([("t1", "A", 5), ("t1", "A", -5), ("t2", "A", 5), ("t3", "A", 0), ("t3", "A", 0)], "tx string, asset string, amount long")
    assert rows(aggs.unbalanced(p, "tx", "asset", "amount"), "tx") == [("t2",), ("t3",)]
    assert rows(joins.reconcile(p.where("tx <> 't3'"), p.where("tx <> 't1'"), ["tx"], "amount"), "tx", "status") == [("t1", "ONLY_LEFT"), ("t2", "MATCH"), ("t3", "ONLY_RIGHT")]


def test_ridge_is_exact(spark):
    df = spark.createDataFrame([(x, z, 3 * x - 2 * z + 7) for x in range(5) for z in range(4)], "x long, z long, y long")
    assert pit.fit_ridge(df, ["x", "z"], "y", 0) == [Fraction(7), Fraction(3), Fraction(-2)]


def test_late_features_fail(spark):
    f = spark.createDataFrame([(1, 10, 5)], "row_id long, available long, v long")
    u = spark.createDataFrame([(1, 9, 12, 9)], "row_id long, eligible_from long, eligible_until long, input_available long")
    with pytest.raises(ValueError):
        pit.training_rows(spark.createDataFrame([(1, 1)], "row_id long, label long"), u, f, ["v"])


def test_communities_find_two_cliques(spark):
    e = [(a, b, 1) for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(0, 10, 1)]
    got = dict(rows(graph.communities(spark.createDataFrame(e, "a long, b long, weight long")), "node", "grp"))
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[1] != got[11]


def test_lineage_ends_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "child long, parent long")
    assert rows(graph.lineage(e, spark.createDataFrame([(1,)], "node long")), "node", "steps") == [(1, 0), (2, 1), (3, 2)]


def test_snapshots_are_not_overwritten(spark, tmp_path):
    df = spark.range(10).withColumn("dt", F.lit(date(2024, 1, 1)))
    tables.write_snapshot(df, str(tmp_path / "s"), ["id"])
    with pytest.raises(Exception, match="exists"):
        tables.write_snapshot(df, str(tmp_path / "s"), ["id"])
    assert tables.read_snapshot(spark, [str(tmp_path / "s")]).count() == 10
    with pytest.raises(ValueError):
        tables.assert_max_rows(df, 9)
    with pytest.raises(ValueError):
        tables.assert_schema(df, {"id": ["string"]})


def test_verdicts_know_empty_input(spark):
    df = spark.range(3)
    got = quality.verdicts({"a": (df, df.where("id = 1")), "b": (df, df.where("id > 5")), "c": (df.where("id > 5"), df)})
    assert dict(rows(got, "rule", "state")) == {"a": "REFUTED", "b": "PROVEN", "c": "UNKNOWN"}


def test_uint_bounds(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("18446744073709551616",), ("-1",), ("1.5",), (None,)], "x string")
    good, bad = filters.decode_uint(df, ["x"])
    assert [int(r.x) for r in good.collect()] == [2**64 - 1] and bad.count() == 4


def drained(df, mode, folder):
    """What a stream has given in the end."""
    sink = df.writeStream.format("parquet").option("path", f"{folder}/out") if mode == "append" else df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{folder}/out"))
    assert sink.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_live_cooldown_agrees_with_the_batch_over_many_micro_batches(spark, tmp_path):
    rnd, at = random.Random(7), datetime(2024, 1, 1)
    data = [(i, rnd.choice(["a", "b", None]), i // 3 * 50) for i in range(200)]
    for n in range(5):  # a file is a micro-batch; times go on from one to the next
        part = [(i, k, at + timedelta(seconds=t)) for i, k, t in data[n * 40 : n * 40 + 40]] + ([(1000, "a", None)] if n == 2 else [])
        spark.createDataFrame(part, "id long, k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("id long, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.id: r.accepted for r in drained(streams.stream_cooldown(live, "k", "ts", "id", 600, "1 day"), "append", tmp_path).collect()}
    want = aggs.cooldown(spark.createDataFrame(data, "id long, k string, t long"), ["k"], "t", ["id"], 600)
    assert got == {r.id: r.accepted for r in want.collect()} and 30 > sum(got.values()) > 10


def test_cooldown_state_goes_when_the_watermark_has_passed(spark, tmp_path):
    at = datetime(2024, 1, 1)
    for n, rows_of in enumerate([[(1, "a", 0)], [(2, "b", 90_000)], [(3, "b", 180_000)], [(4, "a", 180_100), (5, "a", 180_200)]]):
        spark.createDataFrame([(i, k, at + timedelta(seconds=t)) for i, k, t in rows_of], "id long, k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("id long, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.id: r.accepted for r in drained(streams.stream_cooldown(live, "k", "ts", "id", 600, "1 hour"), "append", tmp_path).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_live_activity_counts_each_window(spark, tmp_path):
    events = spark.createDataFrame([(datetime(2024, 1, 1, 0, i), "w", "BUY", i) for i in range(4)], "ts timestamp, w string, side string, n long")
    events.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = drained(streams.stream_activity(live, "ts", "1 minute", "1 hour", "w", "side", "n"), "complete", tmp_path)
    assert rows(got, "w", "n", "amount", "sides") == [("w", 4, 6, 1)]

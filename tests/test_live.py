"""Live operators over shuffled micro-batches, restarts and replays."""

import random
from datetime import datetime, timedelta

from chainframe.operators import aggs
from chainframe.streaming import streams

AT = datetime(2024, 1, 1)


def micro_batch(spark, rows, path):
    spark.createDataFrame([(i, k, None if t is None else AT + timedelta(seconds=t)) for i, k, t in rows], "id long, k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def test_settled_cooldown_agrees_with_the_batch_in_any_order(spark, tmp_path):
    r = random.Random(1)
    data = [(i, r.choice(["a", "a", "b", None]), i // 2 * 40) for i in range(160)]
    late = [(900, "a", 10), (901, "b", 20)]
    # rows come up to 2,000 seconds out of order; the watermark allows 3,000
    arriving = sorted(data, key=lambda x: x[2] + r.randrange(2000))
    listener = streams.LateRows()
    spark.streams.addListener(listener)

    def run(files):
        for part in files:
            micro_batch(spark, part, f"{tmp_path}/in")
        live = spark.readStream.schema("id long, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = streams.stream_cooldown_settled(live, "k", "ts", "id", 600, "3000 seconds", 60)
        query = out.writeStream.queryName("settled").format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(180)

    try:
        run([arriving[:60], [*arriving[60:110], (800, "a", None)]])
        # from the checkpoint; a batch is held against the watermark that the one before it began with, and the last row lets the watermark pass all others
        run([arriving[110:], [(950, "y", 5000)], late, [(1000, "z", 100_000)]])
    finally:
        spark.streams.removeListener(listener)
    got = {x.id: x.accepted for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {x.id: x.accepted for x in aggs.cooldown(spark.createDataFrame([*data, (950, "y", 5000)], "id long, k string, t long"), ["k"], "t", ["id"], 600).collect()}
    assert got == want and 5 < sum(got.values()) < 100
    assert listener.late["settled"] == 2 and listener.read["settled"] == 165


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    schema = "k string, balance long"
    sink = streams.BalanceSink(str(tmp_path / "sink"), ["k"])
    batches = [[("a", 5), ("b", -1)], [("b", 4), (None, -2)], [], [("a", -7)]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    state = lambda: (sorted((tuple(x) for x in sink.latest(spark, schema).collect()), key=repr), sorted((tuple(x) for x in sink.alerts(spark, schema).collect()), key=repr))
    assert state() == ([], [])
    for n, df in enumerate(frames):
        sink(df, n)
    first = state()
    assert first[0] == sorted([("a", -7, 3), ("b", 4, 1), (None, -2, 1)], key=repr) and first[1] == sorted([("b", -1, 0), (None, -2, 1), ("a", -7, 3)], key=repr)
    sink(frames[3], 3)
    assert state() == first
    for _ in range(2):
        sink.fold(spark, schema, 1)
        assert [x[:2] for x in state()[0]] == [x[:2] for x in first[0]] and state()[1] == first[1]
    sink.fold(spark, schema, 3)
    assert [x[:2] for x in state()[0]] == [x[:2] for x in first[0]]
    sink(spark.createDataFrame([("b", -9)], schema), 4)
    assert ("b", -9, 4) in state()[0] and ("b", -9, 4) in state()[1]


def test_live_balances_reach_the_sink(spark, tmp_path):
    for part in ([("a", 5), ("b", 3)], [("a", -9)], [("b", 1), ("a", 10)]):
        spark.createDataFrame(part, "k string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("k string, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = streams.BalanceSink(str(tmp_path / "sink"), ["k"])
    query = streams.stream_balances(live, ["k"], "n").writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((x.k, x.balance) for x in sink.latest(spark, "k string, balance long").collect()) == [("a", 6), ("b", 4)]
    assert {x.k for x in sink.alerts(spark, "k string, balance long").collect()} <= {"a"}

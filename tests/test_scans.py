"""Scans, cooldowns and exits where one key holds most rows, against loops."""

import random

from pyspark.sql import functions as F

from chainframe.operators import aggs, joins, scans, trips


def hot_rows(r, n, most=0.5):
    """(id, key, time, amount): half of all rows in one key, some keys and amounts null."""
    return [(i, "hot" if r.random() < most else r.choice(["a", "b", "c", None, "d"]), r.randrange(3 * n), r.choice([None, r.randrange(-50, 50)])) for i in range(n)]


def spread(rows, by, order):
    """Rows of the fullest range and of all."""
    counts = [x["n"] for x in scans.ranged(rows, [*by, *order]).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(counts), len(counts), sum(counts)


def test_a_hot_key_is_spread_over_all_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(hot_rows(random.Random(1), 4000, 0.7), "id long, k string, t long, v long")
        most, ranges, total = spread(df, ["k"], ["t"])
        assert ranges == 4 and most < 1.3 * total / ranges
        plan = joins.asof(df, df.select("k", F.col("t").alias("s"), "v").dropDuplicates(["k", "s"]), ["k"], "t", "s", ["v"])._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.splitlines() if " Window [" in x or "+- Window [" in x]
        # no window holds a key: each is of a range and a key, or of the table of one row a range
        assert windows and all("[_part#" in x or "_last#" in x or "[_part#" in x.split("], [")[-1] for x in windows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_and_last_values_of_a_hot_key(spark):
    data = hot_rows(random.Random(2), 1500)
    df = spark.createDataFrame(data, "id long, k string, t long, v long").repartition(3)
    for how, before, descending in (("sum", False, False), ("sum", True, False), ("last", False, False), ("last", True, True)):
        got = {x.id: x.out for x in scans.keyed_scan(df, ["k"], ["t", "id"], F.col("v"), "out", how, descending, before).collect()}
        by_key = {}
        for row in sorted(data, key=lambda x: (x[2], x[0]), reverse=descending):
            seen = by_key.setdefault(row[1], [])
            if not before:
                seen.append(row[3])
            known = [v for v in seen if v is not None]
            assert got[row[0]] == ((sum(known) if how == "sum" else known[-1]) if known else None)
            if before:
                seen.append(row[3])
    assert scans.keyed_scan(df.limit(0), ["k"], ["t"], F.col("v"), "out").count() == 0
    money = scans.keyed_scan(df.withColumn("v", F.col("v").cast("decimal(18,0)")), ["k"], ["t", "id"], F.col("v"), "out", "sum")
    assert dict(money.dtypes)["out"] == "decimal(28,0)"


def test_asof_of_a_hot_key(spark):
    r = random.Random(3)
    left, right = hot_rows(r, 900), {(x[1], x[2]): x for x in hot_rows(r, 700)}.values()
    one, two = spark.createDataFrame(left, "id long, k string, t long, v long"), spark.createDataFrame([(x[1], x[2], x[3]) for x in right], "k string, s long, w long")
    for strict in (False, True):
        for forward in (False, True):
            got = {x.id: (x.s, x.w) for x in joins.asof(one, two, ["k"], "t", "s", ["s", "w"], strict, forward).collect()}
            for i, k, t, _ in left:
                fits = [(x[2], x[3]) for x in right if x[1] == k and ((x[2] > t if strict else x[2] >= t) if forward else (x[2] < t if strict else x[2] <= t))]
                assert got[i] == ((min if forward else max)(fits, key=lambda x: x[0]) if fits else (None, None))


def accepted(data, seconds):
    out, keys = {}, {}
    for i, k, t, _ in data:
        keys.setdefault(k, []).append((t is None, t or 0, i))
    for rows in keys.values():
        last = started = None
        for missing, t, i in sorted(rows):
            ok = not started or (not missing and last is not None and t - last >= seconds)
            if ok:
                started, last = True, None if missing else t
            out[i] = ok
    return out


def test_cooldown_of_a_hot_key(spark):
    r = random.Random(4)
    data = [(i, k, None if r.random() < 0.02 else t // 3, v) for i, k, t, v in hot_rows(r, 2500)] + [(9000, "late", None, 0), (9001, "late", None, 0), (9002, "late", 7, 0), (9003, "none", None, 0), (9004, "none", None, 0)]
    df = spark.createDataFrame(data, "id long, k string, t long, accepted_before long").repartition(5)
    for seconds in (1, 7, 400, 0):
        got = {x.id: x.accepted for x in aggs.cooldown(df, ["k"], "t", ["id"], seconds).collect()}
        assert got == accepted(data, seconds)
    assert aggs.cooldown(df.limit(0), ["k"], "t", ["id"], 5).count() == 0
    rows = spark.range(3000).select("id", F.lit("x").alias("k"), (F.col("id") * 2).alias("t"))
    assert aggs.cooldown(rows, ["k"], "t", ["id"], 3).where("accepted").count() == 1500
    assert not [x for x in aggs.cooldown(rows, ["k"], "t", ["id"], 3)._jdf.queryExecution().executedPlan().toString().splitlines() if "Python" in x or "InArrow" in x]


def test_exits_open_three_spans_at_most(spark):
    r = random.Random(5)
    states = [("k", t, r.randrange(96, 105)) for t in range(0, 5000, 3)] + [("k", 2500, 50), ("k", 4400, 170), ("q", 10, 1), (None, 5, 1), ("k", 77, None)]
    pos = [(i, r.choice(["k", "q", "none", None]), e := r.randrange(4000), e + r.randrange(0, 4000), 100) for i in range(120)] + [(500, "k", 2500, 2500, 100), (501, "k", 9, 3, 100), (502, "k", 100, 4900, None)]
    p, s = spark.createDataFrame(pos, "id long, k string, entry long, deadline long, price0 long"), spark.createDataFrame(states, "k string, t long, price long")
    out = trips.first_exit(p, s, ["k"], "entry", "deadline", "t", "price", "price0", 3000, 4000, "id", 100)
    got = {x.id: (x.exit_at, x.exit_reason, x.at_fill) for x in out.collect()}
    for i, k, entry, deadline, price0 in pos:
        hits = [] if price0 is None or k is None else [(t, "STOP_LOSS" if x * 10 <= price0 * 7 else "TAKE_PROFIT") for q, t, x in states if q == k and x is not None and entry <= t <= deadline and (x * 10 <= price0 * 7 or x * 10 >= price0 * 14)]
        want = min(hits) if hits else (deadline, "DEADLINE")
        assert got[i] == (*want, bool(hits) and want[0] == entry), i
    assert trips.first_exit(p.limit(0), s, ["k"], "entry", "deadline", "t", "price", "price0", 3000, 4000, "id", 100).count() == 0

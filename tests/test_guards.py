"""Pruning, shards, guards, verdicts, training sets and clocks against plain Python."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chainframe.operators import aggs, clocks, joins, pit, quality, trips
from chainframe.sources import tables


def test_pruning_loses_no_row_under_a_wrong_date(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 100:02d}") for i in range(1000)] + [(150, "2024-01-09"), (None, "2024-01-02"), (170, None)]
    spark.createDataFrame(rows, "pos long, dt string").write.partitionBy("dt").parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    zones = tables.zone_map(df, "dt", "pos")
    out = tables.prune_proven(df, zones, "dt", "pos", 140, 260)
    assert sorted(x.pos for x in out.collect()) == sorted([*range(140, 260), 150, 170])
    opened = {f.split("dt=")[1].split("/")[0] for f in out.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert opened == {"2024-01-02", "2024-01-03", "2024-01-09", "__HIVE_DEFAULT_PARTITION__"}
    scan = next(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    assert "2024-01-05" in scan.split("PartitionFilters")[1]
    later = [(200, "2024-02-01")]  # a partition that the map doesn't name
    spark.createDataFrame(later, "pos long, dt string").write.mode("append").partitionBy("dt").parquet(f"{tmp_path}/t")
    assert tables.prune_proven(spark.read.parquet(f"{tmp_path}/t"), zones, "dt", "pos", 200, 201).count() == 2


def test_only_shards_that_differ_are_written(spark, tmp_path):
    root = f"{tmp_path}/shards"
    source = lambda change: spark.createDataFrame([(i, f"v{i}" if i != change else "other", i % 4 if i % 4 != 3 else None) for i in range(40)], "id long, v string, shard long")
    status = lambda df: {x.shard: x.status for x in df.collect()}
    files = lambda: {f: f.stat().st_mtime_ns for f in tmp_path.glob("shards/shard=*/part-*")}
    assert status(tables.refresh_shards(source(None), root, ["shard"])) == {0: "MISSING", 1: "MISSING", 2: "MISSING", None: "MISSING"}
    before = files()
    assert set(status(tables.refresh_shards(source(None), root, ["shard"])).values()) == {"REUSE"} and files() == before
    assert status(tables.refresh_shards(source(5), root, ["shard"])) == {0: "REUSE", 1: "CHANGED", 2: "REUSE", None: "REUSE"}
    kept = {f for f in before if files().get(f) == before[f]}
    assert {f.parent.name for f in before} - {f.parent.name for f in kept} == {"shard=1"}
    assert sorted(map(tuple, spark.read.schema("id long, v string, shard long").parquet(root).collect()), key=repr) == sorted(map(tuple, source(5).collect()), key=repr)
    assert status(tables.refresh_shards(source(5).where("shard <> 2"), root, ["shard"]))[2] == "EXTRA"


def test_a_guarded_write_counts_on_the_way(spark, tmp_path):
    df = spark.range(50).withColumn("v", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")))
    assert tables.write_guarded(df, f"{tmp_path}/a", 50, {"large": F.col("v") > 60}) == {"rows": 50, "large": 0}
    assert spark.read.parquet(f"{tmp_path}/a").count() == 50
    for most, limit in ((49, 60), (50, 40)):
        with pytest.raises(ValueError, match="rows of at most"):
            tables.write_guarded(df, f"{tmp_path}/b", most, {"large": F.col("v") > limit})
    with pytest.raises(ValueError, match="exists"):
        tables.write_guarded(df, f"{tmp_path}/a", 50)
    assert [p.name for p in tmp_path.iterdir()] == ["a"]
    plan = tables.assert_max_rows(df, 50)
    assert plan is df
    with pytest.raises(ValueError, match="more than 49"):
        tables.assert_max_rows(df, 49)


def test_verdicts_have_three_states(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, -1, "a"), (3, None, "b"), (3, 4, "b")], "id long, v long, k string")
    out = quality.verdicts_in_one_pass(df, {"NEGATIVE": F.col("v") < 0, "HUGE": F.col("v") > 9, "C": F.when(F.col("k") == "c", True)})
    groups = quality.verdicts_of_groups(df, {"REPEATED": (["id"], [F.count(F.lit(1)).alias("n")], F.col("n") > 1), "CROWDED": (["k"], [F.count(F.lit(1)).alias("n")], F.col("n") > 2)})
    assert {x.rule: (x.state, x.checked, x.broken) for x in out.union(groups).collect()} == {"NEGATIVE": ("REFUTED", 3, 1), "HUGE": ("PROVEN", 3, 0), "C": ("UNKNOWN", 0, 0), "REPEATED": ("REFUTED", 3, 1), "CROWDED": ("PROVEN", 2, 0)}
    assert {x.state for x in quality.verdicts_in_one_pass(df.limit(0), {"NEGATIVE": F.col("v") < 0}).collect()} == {"UNKNOWN"}


def test_training_sets_take_what_was_known(spark):
    labels = spark.createDataFrame([(1, "a", 100, 7, 110), (2, "a", 200, None, 210), (3, None, 150, 9, 160), (4, "a", 900, 1, 910), (5, "a", 120, 5, 130)], "row_id long, entity string, at long, label long, future_used long")
    universe = spark.createDataFrame([(1, 90, 101), (1, 0, 50), (2, 0, 999), (3, 150, 151), (4, 0, 999), (5, 0, 120)], "row_id long, eligible_from long, eligible_until long")
    told = [("x", "a", 10, 1), ("x", "a", 100, 2), ("x", "a", 101, 3), ("y", "a", 50, 4), ("x", None, 1, 5), ("y", None, 150, 6), ("y", None, 150, 5), ("z", "a", 1, 0)]
    features = spark.createDataFrame(told, "name string, entity string, available long, value long")
    get = lambda f=features, cutoff=500, until=500: sorted(map(tuple, pit.training_set(labels, universe, f, ["x", "y"], 0, until, cutoff).collect()))
    assert get() == [(1, 100, 7, 2, 4), (3, 150, 9, 5, 6)]
    with pytest.raises(ValueError, match="after the cutoff"):
        get(cutoff=159)
    with pytest.raises(ValueError, match="not yet available"):
        get(features.where("not (name = 'y' and entity = 'a')"))
    with pytest.raises(ValueError, match="not yet available"):
        get(features.withColumn("available", F.when(F.col("name") == "y", F.col("available") + 60).otherwise(F.col("available"))))
    with pytest.raises(ValueError, match="no rows"):
        get(until=50)


def test_ridge_error_is_exact(spark):
    r = random.Random(1)
    data = [(r.randrange(-50, 50), r.randrange(9), r.randrange(-999, 999)) for _ in range(40)]
    fitted, error = pit.fit_ridge_and_error(spark.createDataFrame(data, "a long, b long, y long"), ["a", "b"], "y", 3)
    assert error == sum((Fraction(y) - fitted[0] - fitted[1] * a - fitted[2] * b) ** 2 for a, b, y in data) and fitted == pit.fit_ridge(spark.createDataFrame(data, "a long, b long, y long"), ["a", "b"], "y", 3)


def test_small_rules(spark):
    rows = spark.createDataFrame([(i, i * 10, None if i == 8 else 1, i * 10 + (5 if i < 6 else 25) if i != 2 else None) for i in range(10)], "id long, t long, label long, known long")
    got = {x.id: x.split for x in pit.split_by_rank(rows, ["t", "id"], "t", "label", "known").collect()}
    assert got == {0: "TRAIN", 1: "TRAIN", 2: "PURGED_TRAIN", 3: "TRAIN", 4: "TRAIN", 5: "TRAIN", 6: "PURGED_TRAIN", 7: "TEST", 8: "UNKNOWN_TEST", 9: "TEST"}
    schedule = spark.createDataFrame([(20, 40, "m"), (60, 80, "n")], "valid_from long, valid_until long, model_id string")
    scored = joins.model_at(rows, schedule, "t")
    with pytest.raises(ValueError, match="without a model"):
        joins.require_covered(scored)
    assert joins.require_covered(joins.model_at(rows.where("t < 40"), schedule, "t")).count() == 4
    with pytest.raises(ValueError, match="without a model"):
        joins.require_covered(joins.model_at(rows.where("t < 40"), schedule, "t"), prefix=False)
    assert {x.id: (x.model_id, x.status) for x in joins.model_at(rows, schedule, "t", fallback="f").collect() if x.id in (0, 3, 5)} == {0: ("f", "FALLBACK"), 3: ("m", "SCORED"), 5: ("f", "FALLBACK")}
    page = lambda after, n: [(x.id, x.more) for x in aggs.keyset_page_and_more(rows.select("id"), ["id"], after, n).orderBy("id").collect()]
    assert page(None, 9)[-1] == (8, True) and page([4], 5) == [(i, False) for i in range(5, 10)] and page([9], 5) == []
    blocks = spark.createDataFrame([(1, "h", 0), (1, "h", 0), (2, "", 0), (2, "", 0), (3, "", 0), (3, "h", 0), (None, "", None)], "slot long, hash string, n long")
    got = {x.slot: (x.hash, x.source_row_count, x.payload_variant_count, x.sentinel) for x in aggs.block_clock(blocks, "slot", ["hash", "n"], {"hash": "", "n": 0}).collect()}
    assert got == {1: ("h", 2, 1, False), 2: ("", 2, 1, True), 3: ("", 2, 2, False), None: ("", 1, 1, False)}


# --- the clock


def made_clock(r, n):
    block, time, prefix, out = 5, 1000, 0, []
    for _ in range(n):
        count = r.choice([0, 0, 1, 3, 7])
        out.append((block, count, time, prefix))
        block, time, prefix = block + r.choice([1, 1, 1, 9]), time + r.choice([0, 1, 1, 30]), prefix + count
    return out


def step(clock, place, hop):
    if place is None or (at := next((i for i, c in enumerate(clock) if c[0] == place[0]), None)) is None:
        return None
    kind, n = hop
    if kind == "transactions":
        g = clock[at][3] + place[1] + n
        return next(((b, g - p) for b, k, _, p in clock if p <= g < p + k), None)
    return next(((b, 0) for b, k, t, _ in clock[at + 1 :] if k and t >= clock[at][2] + n), None)


@pytest.mark.parametrize("leaf,places", [(1 << 12, 1 << 17), (4, 3)])
def test_paths_along_the_clock(spark, monkeypatch, leaf, places):
    monkeypatch.setattr(clocks, "LEAF", leaf)
    monkeypatch.setattr(clocks, "PLACES", places)
    r = random.Random(leaf)
    clock = made_clock(r, 150)
    pos = [(i, b := r.choice(clock)[0] + r.choice([0, 0, 0, 1]), r.randrange(3)) for i in range(80)] + [(900, None, 1), (901, 1, 0), (902, clock[0][0], 0), (903, clock[-1][0], 0)]
    hops = [("transactions", 1), ("seconds", 3), ("transactions", 9), ("seconds", 40), ("transactions", 2)]
    c, p = spark.createDataFrame(clock, "block long, tx_count long, time long, prefix long"), spark.createDataFrame(pos, "id long, block long, tx long")
    got = {x.id: [None if y is None else tuple(y) for y in x.places] for x in clocks.walk(p, c, hops, "id").collect()}
    for i, b, t in pos:
        place, want = (None if b is None else (b, t)), []
        for hop in hops:
            place = step(clock, place, hop)
            want.append(place)
        assert got[i] == want, i
    assert any(None not in x for x in got.values())
    if leaf == 4:
        assert all(x.places == [None] * 5 for x in clocks.walk(p, c.limit(0), hops, "id").collect()) and clocks.walk(p.limit(0), c, hops, "id").count() == 0


def test_sales_by_the_clock(spark):
    r = random.Random(9)
    clock = made_clock(r, 120)
    states = sorted({(k, (b << 32) + r.randrange(4)): r.choice([80, 97, 99, 100]) for k in ("a", "b") for b, *_ in r.sample(clock[20:], 60)}.items())
    pos = [(i, r.choice(["a", "b", "none"]), *r.choice([(b, 0) for b, n, *_ in clock if n])) for i in range(50)]
    c, p = spark.createDataFrame(clock, "block long, tx_count long, time long, prefix long"), spark.createDataFrame(pos, "id long, k string, block long, tx long")
    s = spark.createDataFrame([(k, at, x) for (k, at), x in states], "k string, at long, price long")
    out = trips.sell_ladder(p, c, s, ["k"], "id", "at", "price", 4, 20, 100)
    got = {x.id: (x.status, x.attempts, x.fill_price, x.fill_block, x.fill_tx) for x in out.collect()}
    last = lambda k, place: next((x for (q, at), x in reversed(states) if q == k and at <= (place[0] << 32) + place[1] + 1), None)
    for i, k, b, t in pos:
        place, want = (b, t), None
        for n in range(1, 5):
            landed = step(clock, place, ("transactions", 4)) if place else None
            if landed is None:
                want = (None, n - 1, None, None, None)
                break
            quote, price = last(k, place), last(k, landed)
            if quote is not None and price >= quote * 9900 // 10_000:
                want = ("CLOSED", n, price, *landed)
                break
            place = step(clock, place if quote is None else landed, ("seconds", 20))
        assert got[i] == (want or ("EXHAUSTED", 4, None, None, None)), i
    assert {x[0] for x in got.values()} == {"CLOSED", "EXHAUSTED", None}
    settled = {x.id: x.settled for x in trips.settlement(p, c, "id", 2, 30, 4).collect()}
    for i, _, b, t in pos:
        place = (b, t)
        for hop in [("transactions", 2), ("seconds", 30), ("transactions", 4), *[("seconds", 2), ("transactions", 4)] * 3]:
            place = step(clock, place, hop)
        assert (None if settled[i] is None else tuple(settled[i])) == place


def test_null_keys_take_part(spark):
    tree = [(None, "p", [1], "root"), (None, "p", [1, 2], None), (None, "q", [1, 2, 3], None), (7, None, [4], "x"), (7, None, [4, 1], None), (7, None, None, None), (7, None, [], None), (7, "p", [4, 1], None)]
    df = spark.createDataFrame(tree, "tx long, decoder string, path array<int>, role string")
    got = sorted(((x.tx, x.decoder, x.path, x.inherited_role) for x in joins.inherit_roles(df, ["tx"]).collect()), key=repr)
    want = [(None, "p", [1], "root"), (None, "p", [1, 2], "root"), (None, "q", [1, 2, 3], None), (7, None, [4], "x"), (7, None, [4, 1], "x"), (7, None, None, None), (7, None, [], None), (7, "p", [4, 1], None)]
    assert got == sorted(want, key=repr)
    rows = spark.createDataFrame([(None, [1, 1], 1), (None, [1, 2], 2), (3, [1, 1], None), (3, [1, 2], None), (4, [1, 1], None), (4, [1, 3], 5), (4, [2], 1), (4, [2], 1)], "tx long, path array<int>, v long")
    got = sorted(((x.tx, x.path, x.v) for x in joins.drop_superseded(rows, ["tx"], "path", "v").collect()), key=repr)
    assert got == sorted([(None, [1, 2], 2), (3, [1, 1], None), (3, [1, 2], None), (4, [1, 3], 5), (4, [2], 1), (4, [2], 1)], key=repr)
    one, two = (spark.createDataFrame(x, "k long, n long") for x in ([(None, 5), (1, 2), (1, None), (2, 3), (4, None)], [(None, 5), (1, 3), (3, 1), (4, None)]))
    got = {x.k: (x.left_amount, x.right_amount, x.status) for x in joins.reconcile(one, two, ["k"], "n").collect()}
    assert got == {None: (5, 5, "MATCH"), 1: (2, 3, "MISMATCH"), 2: (3, None, "ONLY_LEFT"), 3: (None, 1, "ONLY_RIGHT"), 4: (None, None, "MATCH")}

"""What larger tables hold and small ones lack, against the queries' own SQL."""

import datetime
import itertools
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chainframe.operators import adjacency, blocks, graph, joins
from chainframe.plans import queries as plans
from chainframe.plans import guards, more, results, trades  # noqa: F401  register their queries
from chainframe.streaming import streams


def events(folder, made):
    """An events table of (user, second, mint, value, type) rows."""
    start = datetime.datetime(2024, 1, 1)
    rows = pd.DataFrame(made, columns=["user_id", "second", "k", "value", "event_type"])
    pq.write_table(pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array([start + datetime.timedelta(seconds=int(s)) for s in rows["second"]], pa.timestamp("us")), "user_id": pa.array(rows["user_id"], pa.int64()),
        "event_type": pa.array(rows["event_type"], pa.string()), "value": pa.array(rows["value"], pa.float64()), "props": pa.array([f'{{"k": {k}}}' for k in rows["k"]], pa.string()),
    }), f"{folder}/events.parquet")
    return str(folder)


def same_rows(spark, folder, name):
    """The rows of a query, which are those of its SQL."""
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    db.sql(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    want = db.sql(plans.SQL[name])
    df = plans.QUERIES[name](spark, folder)
    got = sorted(map(tuple, df.select(*want.columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    return got


def test_a_posting_is_never_zero(spark, tmp_path):
    folder = events(tmp_path, [(1, 5, 3, 0.0, "view"), (2, 6, 3, 0.05, "view"), (3, 7, 3, 0.14, "view"), (4, 8, 3, None, "view")])
    assert same_rows(spark, folder, "t18_to_postings") == [(1, "CASH", "Q", -5), (1, "FEES", "Q", 5), (2, "CASH", "Q", -14), (2, "VENUE", "Q", 14)]


PAIR_QUERIES = ["c01_co_occurrence", "d02_pairs", "c08_pair_evidence", "e04_running_offset", "n01_node_strength", "n03_quotient", "n04_ego", "f06_rank_groups"]


@pytest.mark.parametrize("name", PAIR_QUERIES)
def test_pairs_across_blocks_are_those_of_the_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(blocks, "FEW", 60)
    monkeypatch.setattr(blocks, "MATCHES", 300)
    draw = random.Random(5)
    folder = events(tmp_path, [(draw.randint(-3, 30), draw.choice([0, 86_400, draw.randint(0, 400_000)]), draw.randint(0, 25), draw.randint(0, 900) / 100, "view") for _ in range(900)])
    assert same_rows(spark, folder, name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_shuffled(spark, tmp_path):
    folder = events(tmp_path, [(1, 5, 3, 1.0, "view"), (2, 6, 3, 1.0, "view")])
    for name in ("c01_co_occurrence", "d02_pairs", "c08_pair_evidence", "e04_running_offset", "n04_ego"):
        above = plan(plans.QUERIES[name](spark, folder)).split("MapInArrow")[0]  # what happens to pairs
        assert "Exchange hash" not in above and "Exchange range" not in above, name


def test_evidence_counts_matches_once_and_gives_every_source_row(spark):
    first = spark.createDataFrame([(1, "x", 10, 100), (2, "x", 12, 101), (1, "y", 20, 102), (2, "y", 20, 103), (3, "x", 11, 104), (4, None, 11, 105), (None, "x", 11, 106), (3, "y", 20, None)], "signer int, mint string, t long, event_id long")
    source = spark.createDataFrame([(100, "p"), (101, "q"), (101, "r"), (103, "s"), (104, "t")], "event_id long, note string")
    old = joins.pair_evidence(joins.co_occurrence(first, 5), joins.pairs(joins.co_occurrence(first, 5), 2), source, "event_id", ["note"])
    new = blocks.pair_matches(first, 5, 2, source, "event_id", ["note"])
    names = ["key", "a", "b", "a_row", "b_row", "direction", "a_note", "b_note"]
    assert sorted(map(tuple, new.select(names).collect()), key=str) == sorted(map(tuple, old.select(names).collect()), key=str) and new.count() == 5
    assert dict(new.dtypes)["a"] == "int"
    every = ["key", "a", "b", "a_row", "b_row", "direction"]
    assert sorted(map(tuple, blocks.pair_matches(first, 5).select(every).collect()), key=str) == sorted(map(tuple, joins.co_occurrence(first, 5).select(every).collect()), key=str)


class Calls:
    """A key's state, and how many calls it takes."""

    def __init__(self):
        self.n, self.values, self.lists, self.maps, self.timers = 0, {}, {}, {}, set()

    def __getattr__(self, name):
        if name in ("getValueState", "getListState", "getMapState"):
            return lambda state, schema: _State(self, state)
        raise AttributeError(name)

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)


class _State:
    def __init__(self, calls, name):
        self.calls, self.name, self.held = calls, name, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.n += 1
            held = self.held
            if name == "get":
                return held
            if name in ("update", "put"):
                self.held = args[0]
            elif name == "appendList":
                self.held = [*(held or []), *args[0]]
            elif name == "clear":
                self.held = None
            elif name == "updateValue":
                self.held = {**(held or {}), args[0]: args[1]}
            elif name == "containsKey":
                return args[0] in (held or {})
            elif name == "getValue":
                return held[args[0]]
            return None

        return call


def test_a_cooldowns_state_is_called_by_micro_batch_and_not_by_bucket():
    rule, calls = streams._Cooldown("o", 7200, 3600), Calls()
    rule.init(calls)
    hours = pd.DataFrame({"k": 1, "t": pd.to_datetime([h * 3_600_000_000 + 5 for h in range(500)], unit="us"), "o": range(500)})
    list(rule.handleInputRows((1,), iter([hours]), None))
    assert calls.n <= 5 and calls.timers == {3_600_000}


def test_a_cooldown_is_decided_bucket_by_bucket_as_the_watermark_moves():
    rule, calls = streams._Cooldown("o", 7200, 3600), Calls()
    rule.init(calls)
    draw, told, at = random.Random(3), [], 0
    times = [draw.randint(1, 400_000) * 1_000_000 for _ in range(300)]
    waiting = sorted(enumerate(times), key=lambda x: x[1] + draw.randint(0, 9_000) * 1_000_000)
    while waiting or calls.timers:
        some, waiting = waiting[:20], waiting[20:]
        if some:
            list(rule.handleInputRows((1,), iter([pd.DataFrame({"k": 1, "t": pd.to_datetime([t for _, t in some], unit="us"), "o": [o for o, _ in some]})]), None))
        at = max(at, max((t for _, t in some), default=1 << 50) // 1000 - 9_000_000)
        watermark = type("T", (), {"getCurrentWatermarkInMs": lambda self: at})()  # noqa: B023
        due = sorted(x for x in calls.timers if x <= at)
        calls.timers -= set(due)
        for _ in due:
            told += [row for out in rule.handleExpiredTimer((1,), watermark, None) for row in out.itertuples(index=False, name=None)]
    want, last = [], None
    for o, t in sorted(enumerate(times), key=lambda x: (x[1], x[0])):
        good = last is None or t >= last + 7_200_000_000
        last = t if good else last
        want.append((o, good))
    assert told == want


def test_a_row_is_written_once_however_many_blocks_there_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 40)
    draw = random.Random(7)
    folder = events(tmp_path, [(draw.randint(0, 60), draw.randint(0, 400_000), draw.randint(0, 9), 1.0, "view") for _ in range(800)])
    written, checkpoint = [], blocks.checkpoint
    monkeypatch.setattr(blocks, "checkpoint", lambda df: written.append(checkpoint(df)) or written[-1])
    found = plans.QUERIES["c01_co_occurrence"](spark, folder)
    packed = written[0].collect()
    assert len(packed) > 8 and sum(blocks._unpacked(pa.py_buffer(x.rows)).num_rows for x in packed) == plans.first_rows(spark, folder).count()
    # a task's matches come key by key, not entity by entity
    runs = found.select("key").rdd.mapPartitions(lambda rows: [sum(1 for _ in itertools.groupby(x.key for x in rows))]).collect()
    assert found.count() > 2000 and max(runs) <= 10


@pytest.mark.parametrize("position", [("t", "event_id"), ("event_id",), ("slot", "t", "event_id")])
@pytest.mark.parametrize("entities", [12, 4000])
def test_pairs_are_counted_alike_in_tables_and_lists(spark, monkeypatch, entities, position):
    monkeypatch.setattr(blocks, "FEW", 300)
    monkeypatch.setattr(blocks, "CELLS", 20)
    draw = random.Random(entities)
    made = [(draw.randint(0, entities) - 5, draw.choice("xyz"), draw.randint(0, 9), None if draw.random() < 0.1 else draw.randint(0, 5), draw.choice([None, 1, 2])) for _ in range(700)]
    first = spark.createDataFrame(made, "signer int, mint string, t long, event_id long, slot int")
    near = joins.co_occurrence(first.fillna(-1, ["event_id", "slot"]), 1, position=position)  # a null comes first, as -1 does
    got, want = (sorted(map(tuple, df.collect())) for df in (blocks.pair_counts(first, 1, 2, position=position), joins.pairs(near, 2)))
    assert got == want and got
    got, want = (sorted(map(tuple, df.collect())) for df in (blocks.pair_matches(first, 1, 1, position=position).select("key", "a", "b", "direction"), near.select("key", "a", "b", "direction")))
    assert got == want
    assert blocks.pair_counts(first.limit(0), 1, 2, position=position).collect() == []


def test_bounds_of_blocks_are_taken_without_a_join_to_the_source_rows(spark, tmp_path, monkeypatch):
    folder = events(tmp_path, [(u, 10 * u, 3, 1.0, "view") for u in range(20)])
    counted = []
    first, rows = plans.first_rows(spark, folder), plans.obs(spark, folder)
    monkeypatch.setattr(type(first), "agg", lambda df, *c, **k: counted.append(plan(df)) or df.groupBy().agg(*c, **k))
    assert blocks.pair_matches(first, 86_400, 1, rows, "event_id", ["amount"]).count() == 190
    assert counted and "Join" not in counted[0]


def graph_events(tmp_path, draw, users, n, keys=25):
    return events(tmp_path, [(draw.randint(0, users), draw.randint(0, 400_000), draw.randint(0, keys), 1.0, "view") for _ in range(n)])


@pytest.mark.parametrize("users", [30, 5000])
def test_graphs_of_pairs_are_those_of_their_edges(spark, tmp_path, monkeypatch, users):
    monkeypatch.setattr(blocks, "FEW", 200)
    monkeypatch.setattr(blocks, "CELLS", 40)
    monkeypatch.setattr(blocks, "LINKS", 100)
    folder = graph_events(tmp_path, random.Random(users), users, 900)
    pairs = blocks.Pairs(plans.first_rows(spark, folder), 86_400, 1 if users > 100 else 2)
    edges = pairs.edges().persist()
    same = lambda one, two: sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.select(one.columns).collect()), key=str)
    assert edges.count() > 50 and same(graph.node_strength(edges), graph.node_strength(pairs)) and same(graph.nodes(edges), graph.nodes(pairs))
    every = pairs.entities()
    for groups in (
        every.select("node", F.when(F.col("node") % 5 > 0, F.concat(F.lit("g"), F.col("node") % 5)).alias("grp")),  # also a null group
        every.where("node % 3 > 0").withColumn("grp", F.col("node")),  # nodes without a group
        every.withColumn("grp", F.lit(1)).union(every.withColumn("grp", F.lit(2))),  # two a node
    ):
        assert same(graph.quotient(edges, groups), graph.quotient(pairs, groups))
    node = edges.first().b
    assert same(graph.ego(edges, node), graph.ego(pairs, node)) and graph.ego(pairs, -1).collect() == []
    assert same(adjacency.links(adjacency.pack(edges), "bigint", "bigint"), adjacency.links(adjacency.merge(pairs.links()), "bigint", "bigint"))


def test_graph_queries_make_no_row_for_each_edge(spark, tmp_path, monkeypatch):
    folder = graph_events(tmp_path, random.Random(3), 40, 3000)
    monkeypatch.setattr(blocks, "pair_weights", None)
    assert plans.QUERIES["n03_quotient"](spark, folder).count() == 28 and plans.QUERIES["n01_node_strength"](spark, folder).count() == 41


def test_an_ego_counts_only_the_pairs_of_its_neighbours(spark, tmp_path, monkeypatch):
    folder = events(tmp_path, [(u, d * 200_000 + u, k, 1.0, "view") for u in range(40) for k in range(3) for d in [u % 4]])
    counted, packed = [], blocks._packed
    monkeypatch.setattr(blocks, "_packed", lambda first, *a: counted.append(first.count()) or packed(first, *a))
    assert len(same_rows(spark, folder, "n04_ego")) == 45 and counted == [30]  # 10 of 40 users

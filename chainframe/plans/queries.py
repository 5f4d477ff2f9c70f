"""Registered queries: every operator on the given tables, with the SQL that must give the same rows.

Stand-ins: an event is an observation (signer = user, mint = the number in props, side = event type,
amount = value in cents, slot = hour); a day is a block and its orders are its transactions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframe.functions import scalar as sc
from chainframe.operators import aggs, blocks, filters, graph, joins, pit, quality, trips
from chainframe.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OBS = """obs AS (
    SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id AS signer, CAST(json_extract_string(props, '$.k') AS BIGINT) AS mint,
           event_type AS side, CAST(round(value * 100) AS BIGINT) AS amount, CAST(floor(floor(epoch(ts)) / 3600) AS BIGINT) AS slot
    FROM events)"""
FIRST = OBS + """, firsts AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signer, mint ORDER BY t, event_id) AS rn FROM obs) WHERE rn = 1)"""
MATCHES = FIRST + """, matches AS (
    SELECT a.mint AS key, a.signer AS a, b.signer AS b, a.event_id AS a_row, b.event_id AS b_row,
           CASE WHEN (a.t, a.event_id) < (b.t, b.event_id) THEN -1 WHEN (b.t, b.event_id) < (a.t, a.event_id) THEN 1 ELSE 0 END AS direction
    FROM firsts a JOIN firsts b ON a.mint = b.mint AND a.signer < b.signer AND abs(a.t - b.t) <= 86400)"""
PAIRS = MATCHES + """, pairs AS (
    SELECT a, b, count(*) AS shared, count(*) FILTER (direction = -1) AS a_first, count(*) FILTER (direction = 0) AS together, count(*) FILTER (direction = 1) AS b_first
    FROM matches GROUP BY a, b HAVING count(*) >= 2)"""
EDGES = PAIRS + ", edges AS (SELECT a, b, shared AS weight FROM pairs)"
DAYS = """days AS (
    SELECT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS block, count(*) AS tx_count, min(CAST(floor(epoch(o_orderdate)) AS BIGINT)) AS time FROM orders GROUP BY 1),
clock AS (SELECT *, CAST(coalesce(sum(tx_count) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM days)"""
POSTINGS = """postings AS (
    SELECT o_orderkey AS tx, 'ORDER' AS account, o_custkey AS asset, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, 0 AS line FROM orders
    UNION ALL SELECT l_orderkey, 'LINE', o_custkey, -CAST(round(l_extendedprice * 100) AS BIGINT), l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
HOURLY = OBS + """, hourly AS (
    SELECT side, slot, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total, count(*) FILTER (amount > 1000) AS hits FROM obs GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    t = sc.epoch_seconds("ts")
    return table(spark, d, "events").select(
        "event_id", t.alias("t"), F.col("user_id").alias("signer"), sc.json_field(F.col("props"), "$.k").cast("long").alias("mint"),
        F.col("event_type").alias("side"), F.round(F.col("value") * 100).cast("long").alias("amount"), F.floor(t / 3600).alias("slot"),
    )


def first_rows(spark, d):
    return joins.first_per(obs(spark, d), ["signer", "mint"], ["t", "event_id"])


def matches(spark, d):
    return blocks.pair_matches(first_rows(spark, d), 86_400)


def found_pairs(spark, d):
    return blocks.pair_counts(first_rows(spark, d), 86_400, 2)


def met(spark, d):
    return blocks.Pairs(first_rows(spark, d), 86_400, 2)


def clock(spark, d):
    day = F.floor(sc.epoch_seconds("o_orderdate") / 86400)
    days = table(spark, d, "orders").groupBy(day.alias("block")).agg(F.count(F.lit(1)).alias("tx_count"), F.min(sc.epoch_seconds("o_orderdate")).alias("time"))
    return joins.clock_prefix(days).withColumn("prefix", F.col("prefix").cast("long"))


def postings(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    one = o.select(F.col("o_orderkey").alias("tx"), F.lit("ORDER").alias("account"), F.col("o_custkey").alias("asset"), cents("o_totalprice").alias("amount"), F.lit(0).alias("line"))
    two = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("tx"), F.lit("LINE").alias("account"), F.col("o_custkey").alias("asset"), (-cents("l_extendedprice")).alias("amount"), F.col("l_linenumber").alias("line"))
    return one.union(two)


def hourly(spark, d):
    return obs(spark, d).groupBy("side", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.count_if(F.col("amount") > 1000).alias("hits"))


def side(name: str):
    return F.col("side") == name


# --- scans and filters


@query("a01_scan_range", f"WITH {OBS} SELECT event_id, slot, amount FROM obs WHERE event_id >= 1000 AND event_id < 3000")
def _(spark, d):
    return tables.scan_range(obs(spark, d), ["event_id", "slot", "amount"], "event_id", 1000, 3000)


@query("a03_prune_by_date", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def _(spark, d):
    df = table(spark, d, "orders").withColumn("dt", F.to_date("o_orderdate"))
    return tables.prune_by_date(df, "dt", "1997-01-01", "1997-03-31").select("o_orderkey", "o_custkey")


@query("a06_scan_key", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def _(spark, d):
    return tables.scan_key(table(spark, d, "events"), "event_type", "click").select("event_id", "user_id")


@query("a08_scan_keys", f"WITH {OBS} SELECT event_id, slot, mint FROM obs WHERE (slot, mint) IN (SELECT slot, mint FROM obs WHERE side = 'purchase')")
def _(spark, d):
    o = obs(spark, d)
    return tables.scan_keys(o, o.where(side("purchase")), ["slot", "mint"]).select("event_id", "slot", "mint")


@query("a09_assert_schema", "SELECT count(*) AS n FROM events")
def _(spark, d):
    df = tables.assert_schema(table(spark, d, "events"), {"event_id": ["bigint"], "user_id": ["bigint"], "event_type": ["string"], "ts": ["timestamp_ntz", "timestamp"]})
    return df.agg(F.count(F.lit(1)).alias("n"))


@query("a12_missing_shards", f"WITH {OBS} SELECT DISTINCT slot FROM obs WHERE slot NOT IN (SELECT slot FROM obs WHERE side = 'error')")
def _(spark, d):
    o = obs(spark, d)
    return tables.missing_shards(o.select("slot").distinct(), o.where(side("error")).select("slot").distinct(), ["slot"])


@query("a13_assert_max_rows", "SELECT event_id FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return tables.assert_max_rows(e, 1 << 30).select("event_id")


@query("b01_successful_swaps", f"WITH {OBS} SELECT event_id FROM obs WHERE side <> 'error' AND mint = 7 AND event_id >= 0 AND event_id < 5000")
def _(spark, d):
    return filters.successful_swaps(obs(spark, d), ~side("error"), "mint", 7, "event_id", 0, 5000).select("event_id")


@query("b02_side_filter", "SELECT event_id FROM events WHERE upper(event_type) = 'PURCHASE'")
def _(spark, d):
    return filters.side_filter(table(spark, d, "events"), "event_type", "Purchase").select("event_id")


@query("b03_select_entities", "SELECT event_id FROM events WHERE user_id IN (1, 2, 3, 5, 8, 13)")
def _(spark, d):
    return filters.select_entities(table(spark, d, "events"), "user_id", [1, 2, 3, 5, 8, 13]).select("event_id")


@query("b04_project", "SELECT event_id AS row_id, user_id AS signing_wallet, event_type AS action FROM events")
def _(spark, d):
    return filters.project(table(spark, d, "events"), {"row_id": "event_id", "signing_wallet": "user_id", "action": "event_type"})


def _classes(spark, d):
    return obs(spark, d).groupBy("mint").agg(F.when(F.min("amount") < 20, "CHEAP").otherwise("DEAR").alias("label"), F.when(F.count_if(side("error")) > 30, "MANY_ERRORS").otherwise("").alias("issue"))


CLASSES = OBS + """, classes AS (
    SELECT mint, CASE WHEN min(amount) < 20 THEN 'CHEAP' ELSE 'DEAR' END AS label, CASE WHEN count(*) FILTER (side = 'error') > 30 THEN 'MANY_ERRORS' ELSE '' END AS issue FROM obs GROUP BY mint)"""


@query("b05_filter_by_class", f"WITH {CLASSES} SELECT event_id, label FROM obs JOIN classes USING (mint) WHERE issue = '' AND label = 'CHEAP'")
def _(spark, d):
    return filters.filter_by_class(obs(spark, d), _classes(spark, d), "mint", "label", ["CHEAP"]).select("event_id", "label")


@query("b06_decode_uint", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <= 63")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", sc.json_field(F.col("props"), "$.k").alias("k"))
    return filters.decode_uint(rows, ["k"], 6)[0].select("event_id", F.col("k").cast("long").alias("k"))


def _routed(spark, d):
    return filters.route(obs(spark, d), {"FAILED": side("error"), "ROUTER": F.col("mint") < 5, "TOO_SMALL": F.col("amount") < 100})


ROUTED = OBS + ", routed AS (SELECT *, CASE WHEN side = 'error' THEN 'FAILED' WHEN mint < 5 THEN 'ROUTER' WHEN amount < 100 THEN 'TOO_SMALL' ELSE 'ACCEPTED' END AS reason FROM obs)"


@query("b07_route", f"WITH {ROUTED} SELECT event_id, reason FROM routed")
def _(spark, d):
    return _routed(spark, d).select("event_id", "reason")


@query("b08_normalize_trades", f"""WITH {OBS}, x AS (
    SELECT event_id, side, CASE side WHEN 'purchase' THEN mint WHEN 'view' THEN amount END AS base, CASE side WHEN 'purchase' THEN amount WHEN 'view' THEN mint END AS quote,
           CASE side WHEN 'purchase' THEN amount % 10 WHEN 'view' THEN 0 END AS fee_amount FROM obs)
    SELECT event_id, fee_amount, CASE WHEN side = 'purchase' THEN quote ELSE base END AS sold_amount, CASE WHEN side = 'purchase' THEN base ELSE quote END AS bought_amount FROM x WHERE base IS NOT NULL""")
def _(spark, d):
    a, m = F.col("amount"), F.col("mint")
    shapes = {"purchase": {"base_amount": m, "quote_amount": a, "fee_amount": a % 10}, "view": {"base_amount": a, "quote_amount": m, "fee_amount": F.lit(0).cast("long")}}
    return filters.normalize_trades(obs(spark, d), shapes, "side", side("purchase")).select("event_id", "fee_amount", "sold_amount", "bought_amount")


@query("b09_fee_components", f"WITH {OBS} SELECT event_id, CASE WHEN amount % 3 > 0 AND amount % 2 > 0 THEN 'protocol,creator' WHEN amount % 3 > 0 THEN 'protocol' WHEN amount % 2 > 0 THEN 'creator' ELSE '' END AS parts, CAST(amount % 3 + amount % 2 AS BIGINT) AS total FROM obs")
def _(spark, d):
    fees = filters.fee_components({"protocol": F.col("amount") % 3, "creator": F.col("amount") % 2})
    out = obs(spark, d).withColumn("fees", fees)
    return out.select("event_id", F.concat_ws(",", "fees.component").alias("parts"), F.aggregate("fees", F.lit(0).cast("long"), lambda s, x: s + x["amount"]).alias("total"))


@query("b10_flag_sentinels", f"WITH {OBS} SELECT event_id, CASE WHEN side = 'error' AND mint = 0 THEN 'SENTINEL' WHEN mint = 0 THEN 'BROKEN' ELSE 'NONE' END AS sentinel FROM obs")
def _(spark, d):
    return filters.flag_sentinels(obs(spark, d), {"side": "error", "mint": 0}, "mint").select("event_id", "sentinel")


@query("b12_classify_keys", f"""WITH {OBS}, meta AS (SELECT mint, CASE WHEN mint % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS mode FROM obs WHERE side = 'signup' AND amount > 5000)
    SELECT o.mint, coalesce(min(m.mode), 'UNKNOWN') AS mode, count(m.mint) AS source_rows, count(DISTINCT m.mode) > 1 AS conflict FROM (SELECT DISTINCT mint FROM obs) o LEFT JOIN meta m USING (mint) GROUP BY o.mint""")
def _(spark, d):
    o = obs(spark, d)
    meta = o.where(side("signup") & (F.col("amount") > 5000)).select("mint", F.when(F.col("mint") % 2 == 0, "EVEN").otherwise("ODD").alias("mode"))
    return filters.classify_keys(o, meta, "mint", "mode")


@query("b13_appears_before", f"WITH {OBS}, meta AS (SELECT mint, min(t) AS created FROM obs WHERE side = 'signup' GROUP BY mint) SELECT mint, created, first_seen FROM meta JOIN (SELECT mint, min(t) AS first_seen FROM obs GROUP BY mint) USING (mint) WHERE created > first_seen")
def _(spark, d):
    o = obs(spark, d)
    return filters.appears_before(o.where(side("signup")).groupBy("mint").agg(F.min("t").alias("created")), o, "mint", "created", "t").select("mint", "created", "first_seen")


@query("b14_program_mode", f"WITH {OBS} SELECT event_id, CASE WHEN amount % 2 = 0 AND side = 'view' THEN 'CASHBACK' WHEN side = 'view' THEN 'TOKEN_2022' WHEN amount % 2 <> 0 THEN 'NORMAL' END AS mode FROM obs")
def _(spark, d):
    return obs(spark, d).select("event_id", sc.program_mode(F.col("side"), F.col("amount") % 2 == 0, "view").alias("mode"))


@query("b15_annotate", f"WITH {OBS} SELECT event_id, CASE WHEN mint < 50 THEN 'V1' ELSE 'V2' END AS route, concat_ws(',', CASE WHEN amount <= 500 THEN 'reserves' END, CASE WHEN side = 'error' THEN 'fees' END) AS missing FROM obs")
def _(spark, d):
    out = filters.annotate(obs(spark, d), {"reserves": F.col("amount") > 500, "fees": ~side("error")}, F.when(F.col("mint") < 50, "V1").otherwise("V2"))
    return out.select("event_id", "route", F.concat_ws(",", "missing").alias("missing"))


# --- joins


@query("c01_co_occurrence", f"WITH {MATCHES} SELECT * FROM matches")
def _(spark, d):
    return matches(spark, d)


@query("c02_enrich", f"WITH {CLASSES} SELECT event_id, mint, label FROM obs JOIN classes USING (mint)")
def _(spark, d):
    return joins.enrich(obs(spark, d), _classes(spark, d).select("mint", "label"), ["mint"]).select("event_id", "mint", "label")


@query("c03_attach_terminal", f"WITH {OBS}, term AS (SELECT signer, mint, max(amount) AS top FROM obs WHERE side = 'purchase' GROUP BY 1, 2) SELECT event_id, top FROM obs LEFT JOIN term USING (signer, mint) WHERE side = 'signup'")
def _(spark, d):
    o = obs(spark, d)
    term = o.where(side("purchase")).groupBy("signer", "mint").agg(F.max("amount").alias("top"))
    return joins.enrich(o.where(side("signup")), term, ["signer", "mint"], "left").select("event_id", "top")


@query("c04_candidate_history", f"WITH {OBS} SELECT event_id, mint FROM obs WHERE mint IN (SELECT mint FROM obs WHERE signer < 3 AND side = 'purchase')")
def _(spark, d):
    o = obs(spark, d)
    return joins.candidate_history(o, o.where((F.col("signer") < 3) & side("purchase")), ["mint"]).select("event_id", "mint")


@query("c08_pair_evidence", f"WITH {PAIRS} SELECT m.a, m.b, m.key, m.direction, a_row, b_row, x.amount AS a_amount, y.amount AS b_amount FROM matches m JOIN pairs USING (a, b) JOIN obs x ON a_row = x.event_id JOIN obs y ON b_row = y.event_id")
def _(spark, d):
    return blocks.pair_matches(first_rows(spark, d), 86_400, 2, obs(spark, d), "event_id", ["amount"]).select("a", "b", "key", "direction", "a_row", "b_row", "a_amount", "b_amount")


def _views(spark, d):
    return aggs.last_state(obs(spark, d).where(side("view")), ["signer", "t"], ["amount"], ["event_id"]).select("signer", F.col("t").alias("view_t"), F.col("amount").alias("view_amount"))


VIEWS = OBS + ", views AS (SELECT signer, t AS view_t, arg_max(amount, event_id) AS view_amount FROM obs WHERE side = 'view' GROUP BY 1, 2)"


@query("c09_asof_backward", f"WITH {VIEWS} SELECT event_id, view_t, view_amount FROM (SELECT * FROM obs WHERE side = 'click') c ASOF LEFT JOIN views v ON c.signer = v.signer AND c.t >= v.view_t")
def _(spark, d):
    clicks = obs(spark, d).where(side("click"))
    return joins.asof(clicks, _views(spark, d), ["signer"], "t", "view_t", ["view_t", "view_amount"]).select("event_id", "view_t", "view_amount")


@query("c10_mark_series", f"WITH {VIEWS} SELECT event_id, view_amount AS price FROM (SELECT * FROM obs WHERE side = 'purchase') c ASOF JOIN views v ON c.signer = v.signer AND c.t >= v.view_t")
def _(spark, d):
    marks = obs(spark, d).where(side("purchase"))
    return joins.asof(marks, _views(spark, d), ["signer"], "t", "view_t", ["view_amount"]).where("view_amount is not null").select("event_id", F.col("view_amount").alias("price"))


@query("c11_asof_strict", f"WITH {VIEWS} SELECT event_id, view_t FROM (SELECT * FROM obs WHERE side IN ('click', 'view')) c ASOF LEFT JOIN views v ON c.signer = v.signer AND c.t > v.view_t")
def _(spark, d):
    rows = obs(spark, d).where(F.col("side").isin("click", "view"))
    return joins.asof(rows, _views(spark, d), ["signer"], "t", "view_t", ["view_t"], strict=True).select("event_id", "view_t")


@query("c11_asof_timing", f"""WITH {OBS}, p AS (SELECT *, (slot * 6 + t // 600 % 6) * 1000000000 AS tx FROM obs), st AS (SELECT signer, tx + CASE WHEN event_id % 2 = 0 THEN event_id ELSE 999999999 END AS k, max(event_id) AS state_id FROM p WHERE side = 'view' GROUP BY 1, 2)
    SELECT event_id, state_id FROM (SELECT *, tx + event_id AS k FROM p WHERE side = 'click') o ASOF LEFT JOIN st ON o.signer = st.signer AND o.k > st.k""")
def _(spark, d):
    rows = obs(spark, d).select("event_id", "signer", "side", F.col("slot").alias("block"), F.floor(F.col("t") / 600 % 6).alias("tx"), F.col("event_id").alias("ix"), F.when(F.col("event_id") % 2 == 0, "AFTER_INSTRUCTION").otherwise("AFTER_TRANSACTION").alias("timing"))
    states = rows.where(side("view")).withColumn("state_id", F.col("event_id"))
    return joins.asof_causal(rows.where(side("click")), states, ["signer"], ("block", "tx", "ix"), "timing", ["state_id"]).select("event_id", "state_id")


@query("c12_in_interval", f"""WITH {OBS}, ivals AS (SELECT DISTINCT signer, t AS lo, t + 7200 AS hi, t + 60 AS ready FROM obs WHERE side = 'signup')
    SELECT event_id, lo FROM (SELECT * FROM obs WHERE side = 'purchase') p ASOF JOIN ivals i ON p.signer = i.signer AND p.t >= i.lo WHERE p.t < hi AND p.t >= ready""")
def _(spark, d):
    o = obs(spark, d)
    ivals = o.where(side("signup")).select("signer", F.col("t").alias("lo"), (F.col("t") + 7200).alias("hi"), (F.col("t") + 60).alias("ready")).distinct()
    return joins.in_interval(o.where(side("purchase")), ivals, ["signer"], "t", "lo", "hi", "ready").select("event_id", "lo")


def _schedule(spark, d):
    starts = obs(spark, d).agg(F.min("slot").alias("s"))
    return starts.select(F.explode(F.array(*[F.struct((F.col("s") + a).alias("valid_from"), (F.col("s") + b).alias("valid_until"), F.lit(m).alias("model_id"), (F.col("s") + a - 2).alias("model_available"), F.lit(x).alias("bias")) for a, b, m, x in ((24, 120, "m1", -700), (120, 300, "m2", 50), (320, 9999, "m3", 9))])).alias("x")).select("x.*")


SCHEDULE = OBS + """, st AS (SELECT min(slot) AS s FROM obs), schedule AS (
    SELECT s + x.lo AS valid_from, s + x.hi AS valid_until, x.m AS model_id, s + x.lo - 2 AS model_available, x.bias FROM st, (VALUES (24, 120, 'm1', -700), (120, 300, 'm2', 50), (320, 9999, 'm3', 9)) x(lo, hi, m, bias))"""


@query("c13_model_at", f"WITH {SCHEDULE} SELECT event_id, model_id, CASE WHEN model_id IS NOT NULL THEN 'SCORED' WHEN slot < (SELECT min(valid_from) FROM schedule) THEN 'UNCOVERED' ELSE 'GAP' END AS status FROM obs LEFT JOIN schedule ON slot >= valid_from AND slot < valid_until")
def _(spark, d):
    return joins.model_at(obs(spark, d), _schedule(spark, d), "slot").select("event_id", "model_id", "status")


POSITIONS = DAYS + ", pos AS (SELECT c_custkey AS id, (SELECT min(block) FROM days) + c_custkey % 2000 AS block, c_custkey % 3 AS tx FROM customer)"


def _positions(spark, d):
    least = clock(spark, d).agg(F.min("block").alias("_least"))
    rows = table(spark, d, "customer").join(F.broadcast(least))
    return rows.select(F.col("c_custkey").alias("id"), (F.col("_least") + F.col("c_custkey") % 2000).alias("block"), (F.col("c_custkey") % 3).alias("tx"))


@query("c14_nth_after", f"WITH {POSITIONS}, g AS (SELECT id, prefix + tx + 25 AS g FROM pos LEFT JOIN clock USING (block)) SELECT id, c.block AS to_block, g - c.prefix AS to_tx FROM g LEFT JOIN clock c ON g >= c.prefix AND g < c.prefix + c.tx_count")
def _(spark, d):
    return joins.nth_after(_positions(spark, d), clock(spark, d), 25).select("id", "to_block", "to_tx")


@query("c15_first_at_or_after", f"WITH {POSITIONS} SELECT id, min(c.block) AS to_block FROM pos p LEFT JOIN clock c ON c.block > p.block AND c.time >= p.block * 86400 + 300000 GROUP BY id")
def _(spark, d):
    asked = _positions(spark, d).withColumn("target", F.col("block") * 86400 + 300000)
    return joins.first_at_or_after(asked, clock(spark, d), "target").select("id", "to_block")


@query("c16_delay_delivery", f"WITH {POSITIONS} SELECT id, min(c.block) AS released FROM pos p LEFT JOIN clock c ON c.block >= p.block + 3 GROUP BY id")
def _(spark, d):
    return joins.delay_delivery(_positions(spark, d), clock(spark, d), 3).select("id", "released")


STATES = OBS + ", states AS (SELECT mint, slot, max(t) AS state_t, arg_max(amount, (t, event_id)) AS price FROM obs GROUP BY 1, 2)"


def _states(spark, d):
    return aggs.last_state(obs(spark, d), ["mint", "slot"], ["t", "amount"], ["t", "event_id"]).select("mint", "slot", F.col("t").alias("state_t"), F.col("amount").alias("price"))


@query("c17_attach_slot_state", f"WITH {STATES} SELECT event_id, CASE WHEN state_t IS NULL THEN 'MISSING' WHEN state_t < t THEN 'EARLY' ELSE 'OK' END AS state_status FROM (SELECT event_id, t, mint, slot + 1 AS slot FROM obs WHERE side = 'click') c LEFT JOIN states USING (mint, slot)")
def _(spark, d):
    signals = obs(spark, d).where(side("click")).withColumn("slot", F.col("slot") + 1)
    return joins.attach_slot_state(signals, _states(spark, d), ["mint", "slot"], "t", "state_t").select("event_id", "state_status")


def _tree(spark, d):
    """Instructions of a tree: a line item's path is [part, supplier, line] within its order."""
    path = F.slice(F.array(F.col("l_linenumber") % 2, F.col("l_linenumber") % 3, F.col("l_linenumber").cast("int")), F.lit(1), F.least(F.lit(3), F.col("l_linenumber").cast("int")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx"), F.lit("d").alias("decoder"), path.alias("path"), F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("r"), F.col("l_linenumber").cast("string"))).alias("role"))
    return rows.groupBy("tx", "decoder", "path").agg(F.min("role").alias("role"))


TREE = """tree AS (SELECT l_orderkey AS tx, array_slice([l_linenumber % 2, l_linenumber % 3, l_linenumber], 1, least(3, l_linenumber)) AS path,
    min(CASE WHEN l_linenumber <= 2 THEN 'r' || l_linenumber END) AS role FROM lineitem GROUP BY 1, 2)"""


@query("c18_inherit_roles", f"""WITH {TREE}, up AS (SELECT tx, path, unnest(range(1, len(path) + 1)) AS depth FROM tree),
    near AS (SELECT up.tx, up.path, arg_max(t.role, depth) AS inherited_role FROM up JOIN tree t ON t.tx = up.tx AND t.path = array_slice(up.path, 1, depth) AND t.role IS NOT NULL GROUP BY 1, 2)
    SELECT tree.tx, array_to_string(tree.path, '.') AS path, inherited_role FROM tree LEFT JOIN near ON near.tx = tree.tx AND near.path = tree.path""")
def _(spark, d):
    return joins.inherit_roles(_tree(spark, d), ["tx"]).select("tx", F.concat_ws(".", F.col("path").cast("array<string>")).alias("path"), "inherited_role")


@query("c19_drop_superseded", f"WITH {TREE}, v AS (SELECT tx, path, array_slice(path, 1, greatest(len(path) - 1, 0)) AS up, path[-1] AS version FROM tree) SELECT tx, array_to_string(path, '.') AS path FROM (SELECT *, max(version) OVER (PARTITION BY tx, up) AS top FROM v) WHERE version = top")
def _(spark, d):
    rows = _tree(spark, d).withColumn("version", F.element_at("path", -1))
    return joins.drop_superseded(rows, ["tx"], "path", "version").select("tx", F.concat_ws(".", F.col("path").cast("array<string>")).alias("path"))


@query("c20_align_features", f"WITH {OBS} SELECT event_id AS row_id, amount, slot % 24 AS hour FROM obs")
def _(spark, d):
    o = obs(spark, d)
    return joins.align_features(o.select(F.col("event_id").alias("row_id"), "amount"), o.select(F.col("event_id").alias("row_id"), (F.col("slot") % 24).alias("hour")))


@query("c21_reconcile", """WITH l AS (SELECT o_orderkey AS k, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS left_amount FROM orders GROUP BY 1),
    r AS (SELECT l_orderkey AS k, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS right_amount FROM lineitem GROUP BY 1)
    SELECT k, left_amount, right_amount, CASE WHEN right_amount IS NULL THEN 'ONLY_LEFT' WHEN left_amount IS NULL THEN 'ONLY_RIGHT' WHEN left_amount = right_amount THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM l FULL JOIN r USING (k)""")
def _(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias("x")
    one = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), cents("o_totalprice"))
    return joins.reconcile(one, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), cents("l_extendedprice")), ["k"], "x")


@query("c22_profile_at", f"WITH {SCHEDULE} SELECT event_id, bias AS fee FROM obs JOIN schedule ON slot >= valid_from AND slot < valid_until")
def _(spark, d):
    out = joins.model_at(obs(spark, d), _schedule(spark, d), "slot").where("status = 'SCORED'")
    return out.select("event_id", F.col("bias").alias("fee"))


@query("c23_price_accounts", f"""WITH {OBS}, costs AS (SELECT side AS kind, min(amount) AS cost, side < 'm' AS refundable FROM obs GROUP BY side), req AS (SELECT signer AS owner, side AS kind, count(*) AS n FROM obs GROUP BY 1, 2)
    SELECT owner, CAST(sum(n * cost) AS BIGINT) AS total, CAST(sum(CASE WHEN refundable THEN n * cost ELSE 0 END) AS BIGINT) AS refundable FROM req JOIN costs USING (kind) GROUP BY owner""")
def _(spark, d):
    o = obs(spark, d)
    costs = o.groupBy(F.col("side").alias("kind")).agg(F.min("amount").alias("cost")).withColumn("refundable", F.col("kind") < "m")
    return joins.price_accounts(o.groupBy(F.col("signer").alias("owner"), F.col("side").alias("kind")).agg(F.count(F.lit(1)).alias("n")), costs)

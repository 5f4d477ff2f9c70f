"""Registered queries, third part: history checks, paths, pages, small expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainframe.functions import scalar as sc
from chainframe.operators import aggs, joins, trips
from chainframe.plans.queries import DAYS, OBS, POSITIONS, TREE, _positions, _tree, clock, obs, query, side, table


@query("t09_landing", f"WITH {POSITIONS}, g AS (SELECT id, prefix + tx + 4 AS g FROM pos LEFT JOIN clock USING (block)) SELECT id, c.block AS land_block, g - c.prefix AS land_tx FROM g LEFT JOIN clock c ON g >= c.prefix AND g < c.prefix + c.tx_count")
def _(spark, d):
    return joins.nth_after(_positions(spark, d), clock(spark, d), 4).select("id", F.col("to_block").alias("land_block"), F.col("to_tx").alias("land_tx"))


@query("t12_tail_ok", f"WITH {POSITIONS} SELECT id, CASE WHEN block + 900 <= (SELECT max(block) FROM days) THEN 'ENOUGH' ELSE 'SHORT' END AS tail FROM pos")
def _(spark, d):
    return trips.tail_ok(_positions(spark, d), clock(spark, d), 900).select("id", "tail")


def _hop(source, target, hop, fields="id, key"):
    """SQL of one step along the clock, from block and tx of ``source``; the failed ones keep nulls."""
    kind, n = hop
    if kind == "transactions":
        return f"""{target} AS (SELECT s.*, s.g - c.prefix AS tx, c.block FROM (SELECT {fields}, prefix + s.tx + {n} AS g FROM {source} s LEFT JOIN clock c ON c.block = s.block) s LEFT JOIN clock c ON s.g >= c.prefix AND s.g < c.prefix + c.tx_count)"""
    return f"""{target} AS (SELECT {fields}, block, CASE WHEN block IS NOT NULL THEN 0 END AS tx FROM (SELECT {fields}, (SELECT min(n.block) FROM clock n WHERE n.block > s.block AND n.time >= c.time + {n} AND n.tx_count > 0) AS block FROM {source} s LEFT JOIN clock c ON c.block = s.block))"""


HOPS = [("transactions", 2), ("transactions", 40), ("seconds", 86400 * 3), *[("transactions", 60), ("seconds", 86400)] * 3, ("transactions", 60)]


@query("t12_settlement", f"WITH {POSITIONS}, h0 AS (SELECT id, 0 AS key, block, tx FROM pos), {', '.join(_hop(f'h{i}', f'h{i + 1}', h) for i, h in enumerate(HOPS))} SELECT id, block AS settled_block, tx AS settled_tx FROM h{len(HOPS)}")
def _(spark, d):
    out = trips.settlement(_positions(spark, d), clock(spark, d), "id", 40, 86_400 * 3, 60, observe=2, wait_s=86_400)
    return out.select("id", F.col("settled.block").alias("settled_block"), F.col("settled.tx").alias("settled_tx"))


def _ladder():
    """Four attempts, each with its decision d, landing l, quote and price."""
    out = POSITIONS + """, st AS (SELECT o_custkey % 40 AS key, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) * 4294967296 AS at, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS price FROM orders WHERE o_custkey % 40 <> 3 GROUP BY 1, 2),
    d1 AS (SELECT id, id % 40 AS key, block, tx FROM pos)"""
    for n in (1, 2, 3, 4):
        out += f", {_hop(f'd{n}', f'l{n}', ('transactions', 25))}"
        out += f""", q{n} AS (SELECT d.id, d.key, d.block AS d_block, d.tx AS d_tx, l.block AS l_block, l.tx AS l_tx, v.price AS quote FROM d{n} d JOIN l{n} l USING (id) ASOF LEFT JOIN st v ON v.key = d.key AND d.block * 4294967296 + d.tx + 1 >= v.at),
        p{n} AS (SELECT q.*, v.price, coalesce(v.price >= quote * 9900 // 10000, false) AS ok FROM q{n} q ASOF LEFT JOIN st v ON v.key = q.key AND q.l_block * 4294967296 + q.l_tx + 1 >= v.at)"""
        if n < 4:
            out += f""", f{n} AS (SELECT id, key, CASE WHEN quote IS NULL THEN d_block ELSE l_block END AS block, CASE WHEN quote IS NULL THEN d_tx ELSE l_tx END AS tx FROM p{n} WHERE l_block IS NOT NULL AND NOT ok), {_hop(f'f{n}', f'd{n + 1}', ('seconds', 86400))}"""
    ends = " UNION ALL ".join(f"""SELECT id, CASE WHEN l_block IS NULL THEN NULL WHEN ok THEN 'CLOSED' ELSE 'EXHAUSTED' END AS status, CASE WHEN l_block IS NULL THEN {n - 1} ELSE {n} END AS attempts, CASE WHEN ok AND l_block IS NOT NULL THEN price END AS fill_price,
        CASE WHEN ok THEN l_block END AS fill_block, CASE WHEN ok THEN l_tx END AS fill_tx FROM p{n} WHERE {n} = 4 OR ok OR l_block IS NULL""" for n in (1, 2, 3, 4))
    return f"WITH {out} {ends}"


@query("t11_sell_ladder", _ladder())
def _(spark, d):
    day = F.floor(sc.epoch_seconds("o_orderdate") / 86400)
    key = F.col("o_custkey") % 40
    states = table(spark, d, "orders").where(key != 3).groupBy(key.alias("key"), F.shiftleft(day, 32).alias("at")).agg(F.max(F.round(F.col("o_totalprice") * 100).cast("long")).alias("price"))
    pos = _positions(spark, d).withColumn("key", F.col("id") % 40)
    return trips.sell_ladder(pos, clock(spark, d), states, ["key"], "id", "at", "price", 25, 86_400, 100).select("id", "status", "attempts", "fill_price", "fill_block", "fill_tx")


@query("t22_state_history", f"""WITH {OBS}, h AS (SELECT *, coalesce(sum(CASE WHEN side = 'signup' THEN 1 ELSE 0 END) OVER w, 0) AS launched, first(amount % 2) OVER w AS pair0 FROM obs WINDOW w AS (PARTITION BY mint ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, rule FROM (SELECT event_id, CASE WHEN side = 'signup' AND launched > 0 THEN 'SECOND_LAUNCH' WHEN side <> 'signup' AND launched = 0 THEN 'NO_LAUNCH' WHEN amount % 2 <> pair0 THEN 'OTHER_PAIR' WHEN side = 'view' AND amount % 5 = 0 THEN 'LIFECYCLE' END AS rule FROM h) WHERE rule IS NOT NULL""")
def _(spark, d):
    rows = obs(spark, d).withColumn("pair", F.col("amount") % 2).withColumn("life", F.when(F.col("amount") % 5 == 0, "COMPLETED").otherwise("ACTIVE"))
    return trips.check_state_history(rows, ["mint"], ["t", "event_id"], "side", "signup", "pair", "life", {"view": ["ACTIVE"]}).select("event_id", "rule")


@query("t23_observations", f"""WITH {OBS}, h AS (SELECT *, lag(slot + mint % 3) OVER w AS before, lag(amount) OVER w AS content FROM obs WINDOW w AS (PARTITION BY signer ORDER BY t, event_id))
    SELECT event_id, CASE WHEN slot + mint % 3 < before THEN 'BACKWARD' ELSE 'CONFLICT' END AS rule FROM h WHERE slot + mint % 3 < before OR slot + mint % 3 = before AND amount <> content""")
def _(spark, d):
    rows = obs(spark, d).withColumn("pos", F.col("slot") + F.col("mint") % 3)
    return trips.check_observations(rows, ["signer"], ["t", "event_id"], "pos", ["amount"]).select("event_id", "rule")


@query("t24_lifecycle", f"WITH {OBS} SELECT mint, slot, side, count(*) AS n, count(*) FILTER (side = 'purchase' AND amount % 97 = 0) AS off FROM obs WHERE side IN ('purchase', 'signup') GROUP BY 1, 2, 3 HAVING count(*) > 1 OR count(*) FILTER (side = 'purchase' AND amount % 97 = 0) > 0")
def _(spark, d):
    return trips.check_lifecycle(obs(spark, d), ["mint", "slot"], "side", ["purchase", "signup"], {"purchase": F.col("amount") % 97 != 0})


@query("t25_first_match", f"WITH {OBS} SELECT mint, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY t, event_id) AS n FROM obs WHERE side = 'purchase' AND amount > 500) WHERE n = 1")
def _(spark, d):
    rows = obs(spark, d).where(side("purchase") & (F.col("amount") > 500))
    return joins.first_per(rows, ["mint"], ["t", "event_id"]).select("mint", "event_id")


@query("e07_check_order", f"WITH {OBS} SELECT event_id FROM (SELECT event_id, {{'t': mint, 'm': slot}} AS k, lag({{'t': mint, 'm': slot}}) OVER (PARTITION BY signer ORDER BY event_id) AS b FROM obs) WHERE k < b")
def _(spark, d):
    rows = obs(spark, d).withColumn("k", F.struct(F.col("mint").alias("t"), F.col("slot").alias("m")))
    return aggs.out_of_order(rows, ["signer"], ["event_id"], "k").select("event_id")


@query("e12_extend_to_end", f"WITH {OBS}, s AS (SELECT mint, slot, arg_max(amount, (t, event_id)) AS price FROM obs GROUP BY 1, 2) SELECT mint, slot, price FROM s UNION ALL SELECT mint, 480000, arg_max(price, slot) FROM s GROUP BY mint HAVING max(slot) < 480000")
def _(spark, d):
    s = aggs.last_state(obs(spark, d), ["mint", "slot"], ["amount"], ["t", "event_id"]).withColumnRenamed("amount", "price")
    return trips.extend_to_end(s, ["mint"], "slot", ["price"], 480_000)


@query("f02_path_sort", f"WITH {TREE} SELECT tx, array_to_string(path, '.') AS path, row_number() OVER (PARTITION BY tx ORDER BY path) AS place FROM tree")
def _(spark, d):
    out = _tree(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("tx").orderBy("path")).cast("long"))
    return out.select("tx", F.concat_ws(".", F.col("path").cast("array<string>")).alias("path"), "place")


@query("f04_latest_page", "SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)


@query("g02_merge_streams", f"WITH {OBS} SELECT event_id, amount AS a, NULL::BIGINT AS b FROM obs WHERE side = 'click' UNION ALL SELECT event_id, NULL, mint FROM obs WHERE side = 'view'")
def _(spark, d):
    o = obs(spark, d)
    return aggs.merge_streams(o.where(side("click")).select("event_id", F.col("amount").alias("a")), o.where(side("view")).select("event_id", F.col("mint").alias("b")))


@query("h02_direction", f"WITH {OBS} SELECT event_id, CASE WHEN (slot % 5, mint) < (amount % 5, signer) THEN -1 WHEN (amount % 5, signer) < (slot % 5, mint) THEN 1 ELSE 0 END AS way FROM obs")
def _(spark, d):
    rows = obs(spark, d).withColumns({"a": F.col("slot") % 5, "b": F.col("amount") % 5})
    return rows.select("event_id", sc.direction(["a", "mint"], ["b", "signer"]).alias("way"))


@query("h03_clean_text", "SELECT event_id, upper(event_type) AS side FROM events")
def _(spark, d):
    padded = F.concat(F.col("event_type"), F.lit("\0\0pad"))
    return table(spark, d, "events").select("event_id", sc.clean_text(padded).alias("side"))


@query("h08_fee_matches", f"WITH {OBS} SELECT event_id, (amount * 100 + 9999) // 10000 = mint % 8 AS fits FROM obs")
def _(spark, d):
    return obs(spark, d).select("event_id", sc.fee_matches(F.col("amount"), F.lit(100), F.col("mint") % 8).alias("fits"))


@query("h15_parent_path", f"WITH {TREE} SELECT tx, array_to_string(path, '.') AS path, CASE WHEN len(path) > 1 THEN array_to_string(array_slice(path, 1, len(path) - 1), '.') ELSE '' END AS parent FROM tree")
def _(spark, d):
    text = lambda c: F.concat_ws(".", c.cast("array<string>"))
    return _tree(spark, d).select("tx", text(F.col("path")).alias("path"), text(sc.parent_path(F.col("path"))).alias("parent"))


@query("h16_widen_range", f"WITH {DAYS} SELECT block, greatest(0, block - 9000) AS lo, block + 31 AS hi FROM days")
def _(spark, d):
    lo, hi = sc.widen_range(F.col("block"), F.col("block") + 1, [9000, 10], [5, 30])
    return clock(spark, d).select("block", lo.alias("lo"), hi.alias("hi"))


@query("f01_canonical_sort", f"WITH {OBS} SELECT event_id, row_number() OVER (ORDER BY slot, mint, CASE WHEN side = 'error' THEN NULL ELSE amount END NULLS FIRST, event_id) - 1 AS place FROM obs")
def _(spark, d):
    rows = obs(spark, d).select("event_id", "slot", "mint", F.when(~side("error"), F.col("amount")).alias("ix"))
    sorted_rows = aggs.merge_streams(rows.where("ix is null"), rows.where("ix is not null"), order=("slot", "mint", "ix", "event_id"))
    place = sorted_rows.withColumn("key", F.struct("slot", "mint", "ix", "event_id"))
    return aggs.with_ordinal(place, ["key"], "place").select("event_id", F.col("place").cast("long").alias("place"))

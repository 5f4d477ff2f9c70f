"""Registered queries, second part: aggregations, windows, paging, positions, graphs, models, streams."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from chainframe.functions import scalar as sc
from chainframe.operators import aggs, blocks, filters, graph, joins, pit, quality, trips
from chainframe.plans.queries import CLASSES, DAYS, EDGES, FIRST, HOURLY, OBS, PAIRS, POSTINGS, ROUTED, SCHEDULE, STATES, VIEWS, _classes, _routed, _schedule, _states, _views, clock, first_rows, found_pairs, hourly, matches, met, obs, postings, query, side, table
from chainframe.streaming import streams

# --- aggregations


@query("d01_wallet_activity", f"""WITH {OBS} SELECT signer, count(*) FILTER (side = 'purchase') AS buys, count(*) FILTER (side = 'view') AS sells, count(DISTINCT mint) AS keys, min(slot) AS first_block, max(slot) AS last_block,
    CAST(coalesce(sum(amount) FILTER (side = 'purchase'), 0) AS BIGINT) AS bought, CAST(coalesce(sum(amount) FILTER (side = 'view'), 0) AS BIGINT) AS sold FROM obs GROUP BY signer""")
def _(spark, d):
    return aggs.wallet_activity(obs(spark, d), "signer", "side", "purchase", "view", "mint", "slot", "amount")


@query("d02_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def _(spark, d):
    return found_pairs(spark, d)


@query("d03_fanout_budget", f"WITH {FIRST} SELECT max(n) AS largest, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM firsts GROUP BY mint)")
def _(spark, d):
    return joins.fanout_budget(first_rows(spark, d), "mint")


@query("d04_collapse_occurrences", f"WITH {OBS} SELECT signer, mint, min((side, amount)).side AS side, min((side, amount)).amount AS amount, count(*) AS source_row_count, count(DISTINCT (side, amount)) AS payload_variant_count FROM (SELECT signer, mint, {{'side': side, 'amount': amount}} AS p, side, amount FROM obs) GROUP BY 1, 2".replace("min((side, amount))", "min(p)").replace("(DISTINCT (side, amount))", "(DISTINCT p)"))
def _(spark, d):
    return aggs.collapse_occurrences(obs(spark, d), ["signer", "mint"], ["side", "amount"])


@query("d05_block_clock", f"WITH {DAYS} SELECT block, tx_count, time, prefix FROM clock")
def _(spark, d):
    return clock(spark, d)


@query("d06_terminal_by_tx", f"WITH {OBS} SELECT signer, slot, count(*) AS n, count(DISTINCT mint) AS variants, greatest(count(*), count(DISTINCT mint)) AS worst FROM obs GROUP BY 1, 2")
def _(spark, d):
    return aggs.terminal_by_tx(obs(spark, d), ["signer", "slot"], "mint")


@query("d07_last_state", f"WITH {STATES} SELECT mint, slot, state_t, price FROM states")
def _(spark, d):
    return _states(spark, d)


@query("d08_class_counts", f"WITH {CLASSES} SELECT label, count(o.mint) AS n, count(DISTINCT o.mint) AS keys FROM (VALUES ('CHEAP'), ('DEAR'), ('UNKNOWN')) v(label) LEFT JOIN (SELECT o.mint, coalesce(c.label, 'UNKNOWN') AS l FROM obs o LEFT JOIN classes c USING (mint)) o ON l = label GROUP BY label")
def _(spark, d):
    return aggs.class_counts(obs(spark, d), _classes(spark, d), "mint", "label", ["CHEAP", "DEAR", "UNKNOWN"])


@query("d09_data_issues", f"WITH {CLASSES}, c AS (SELECT obs.*, issue FROM obs LEFT JOIN classes USING (mint)) SELECT 'UNCLASSIFIED' AS issue, count(*) FILTER (issue IS NULL) AS n FROM c UNION ALL SELECT 'ISSUE', count(*) FILTER (issue <> '') FROM c UNION ALL SELECT 'NO_AMOUNT', count(*) FILTER (amount = 0) FROM c UNION ALL SELECT 'NEVER', 0 FROM (SELECT 1)")
def _(spark, d):
    rows = obs(spark, d).join(_classes(spark, d), "mint", "left")
    return aggs.data_issues(rows, {"UNCLASSIFIED": F.col("issue").isNull(), "ISSUE": F.col("issue") != "", "NO_AMOUNT": F.col("amount") == 0, "NEVER": F.col("event_id").isNull()})


@query("d10_distinct_wallets", "SELECT count(DISTINCT user_id) AS wallets FROM events")
def _(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("wallets"))


@query("d11_distinct_keys", f"WITH {OBS} SELECT DISTINCT mint FROM obs WHERE side = 'purchase'")
def _(spark, d):
    return obs(spark, d).where(side("purchase")).select("mint").distinct()


@query("d12_repeated_keys", f"WITH {OBS} SELECT signer, slot, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return aggs.repeated_keys(obs(spark, d), ["signer", "slot"])


@query("d13_first_position", f"WITH {OBS} SELECT mint, min(p).t AS t, min(p).event_id AS event_id FROM (SELECT mint, {{'t': t, 'event_id': event_id}} AS p FROM obs) GROUP BY mint")
def _(spark, d):
    return aggs.first_position(obs(spark, d), "mint", ["t", "event_id"])


@query("d14_distributions", f"""WITH {OBS}, x AS (SELECT 'side' AS category, side AS label FROM obs UNION ALL SELECT 'size', CASE WHEN amount < 1000 THEN 'small' WHEN amount < 5000 THEN 'middle' ELSE 'large' END FROM obs
    UNION ALL SELECT 'failure', CASE WHEN side = 'error' THEN CASE WHEN mint < 50 THEN 'low' ELSE 'high' END END FROM obs)
    SELECT category, label, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY category) AS BIGINT) AS population FROM x WHERE label IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    size = F.when(F.col("amount") < 1000, "small").when(F.col("amount") < 5000, "middle").otherwise("large")
    return aggs.distributions(obs(spark, d), {"side": F.col("side"), "size": size, "failure": F.when(side("error"), F.when(F.col("mint") < 50, "low").otherwise("high"))})


@query("d15_run_totals", f"WITH {OBS} SELECT count(*) AS positions, count(*) FILTER (side = 'click') AS click, count(*) FILTER (side = 'view') AS view, CAST(sum(amount) AS BIGINT) AS amount, CASE WHEN count(*) FILTER (side = 'error') = 0 THEN CAST(sum(mint) AS BIGINT) END AS known FROM obs")
def _(spark, d):
    rows = obs(spark, d).withColumn("known", F.when(~side("error"), F.col("mint")))
    return aggs.run_totals(rows, "side", ["click", "view"], ["amount"], ["known"])


@query("d16_launch_totals", f"""WITH {OBS} SELECT side, count(*) AS positions, CAST(sum(least(amount, 3000)) AS BIGINT) AS venue, CAST(sum(greatest(amount - 3000, 0)) AS BIGINT) AS shortfall,
    count(*) FILTER (amount > mint * 50) AS worse, count(*) FILTER (amount < mint * 50) AS better, count(*) FILTER (amount = mint * 50) AS same FROM obs GROUP BY side""")
def _(spark, d):
    return trips.launch_totals(obs(spark, d), ["side"], F.col("amount"), F.lit(3000), F.col("amount"), F.col("mint") * 50).select("side", "positions", *[F.col(c).cast("long").alias(c) for c in ("venue", "shortfall")], "worse", "better", "same")


@query("d17_violated_rules", f"WITH {OBS}, g AS (SELECT signer, count(*) AS n, count(*) FILTER (side = 'error') AS bad, count(*) FILTER (side = 'view') AS views FROM obs GROUP BY 1) SELECT signer, 'FEW_ERRORS' AS rule FROM g WHERE NOT bad * 4 <= n UNION ALL SELECT signer, 'HAS_VIEWS' FROM g WHERE NOT views > 5")
def _(spark, d):
    g = obs(spark, d).groupBy("signer").agg(F.count(F.lit(1)).alias("n"), F.count_if(side("error")).alias("bad"), F.count_if(side("view")).alias("views"))
    return aggs.violated_rules(g, {"FEW_ERRORS": F.col("bad") * 4 <= F.col("n"), "HAS_VIEWS": F.col("views") > 5}).select("signer", "rule")


@query("d18_ratio", f"WITH {OBS} SELECT signer, CAST(count(*) FILTER (side = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (side = 'view' AND mint < 20), 0) AS rate FROM obs GROUP BY signer")
def _(spark, d):
    g = obs(spark, d).groupBy("signer").agg(F.count_if(side("purchase")).alias("x"), F.count_if(side("view") & (F.col("mint") < 20)).alias("y"))
    return g.select("signer", aggs.ratio(F.col("x"), F.col("y")).alias("rate"))


@query("d19_balances", f"WITH {POSTINGS} SELECT asset, account, CAST(sum(amount) AS BIGINT) AS balance FROM postings GROUP BY 1, 2 HAVING sum(amount) <> 0")
def _(spark, d):
    return aggs.balances(postings(spark, d), ["asset", "account"], "amount")


@query("d20_unbalanced", f"WITH {POSTINGS} SELECT tx, asset, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, count(*) FILTER (amount = 0) AS empty FROM postings GROUP BY 1, 2 HAVING sum(amount) <> 0 OR count(*) < 2 OR count(*) FILTER (amount = 0) > 0")
def _(spark, d):
    return aggs.unbalanced(postings(spark, d), "tx", "asset", "amount")


@query("d21_disposition_counts", f"WITH {ROUTED} SELECT reason, count(*) AS n FROM routed GROUP BY 1")
def _(spark, d):
    return filters.disposition_counts(_routed(spark, d))


@query("d22_transactions", """WITH t AS (SELECT l_orderkey, max(l_linenumber % 3) AS top, count(*) AS n_instructions FROM lineitem GROUP BY 1)
    SELECT l_orderkey, max(l_returnflag) AS l_returnflag, any_value(n_instructions) AS n_instructions, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem JOIN t USING (l_orderkey) WHERE l_linenumber % 3 = top GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("source_priority", F.col("l_linenumber") % 3)
    return aggs.transactions(rows, ["l_orderkey"], ["l_returnflag"], "source_priority")


@query("d23_not_functional", f"WITH {OBS} SELECT signer, slot, count(DISTINCT mint) AS n_values FROM obs GROUP BY 1, 2 HAVING count(DISTINCT mint) > 1")
def _(spark, d):
    return aggs.not_functional(obs(spark, d), ["signer", "slot"], "mint")


@query("d25_gram", """SELECT CAST(count(*) AS BIGINT) AS x0_x0, CAST(sum(q) AS BIGINT) AS x0_x1, CAST(sum(x) AS BIGINT) AS x0_x2, CAST(sum(q * q) AS BIGINT) AS x1_x1, CAST(sum(q * x) AS BIGINT) AS x1_x2, CAST(sum(x * x) AS BIGINT) AS x2_x2,
    CAST(sum(p) AS BIGINT) AS x0_y, CAST(sum(q * p) AS BIGINT) AS x1_y, CAST(sum(x * p) AS BIGINT) AS x2_y, CAST(sum(CAST(p AS HUGEINT) * p) AS BIGINT) AS y_y, count(*) AS n
    FROM (SELECT CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS x, CAST(round(l_extendedprice) AS BIGINT) AS p FROM lineitem)""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("x"), F.round("l_extendedprice").cast("long").alias("p"))
    out = aggs.gram(rows, ["q", "x"], "p")
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("d26_rank_percentile", f"WITH {OBS}, r AS (SELECT side, amount, row_number() OVER (PARTITION BY side ORDER BY amount) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM obs) SELECT side, amount AS p95 FROM r WHERE i = ((n - 1) * 95 + 99) // 100")
def _(spark, d):
    return aggs.rank_percentile(obs(spark, d), ["side"], "amount", 95, "p95")


@query("d27_fingerprint", """WITH x AS (SELECT sha256('{"event_id":"' || event_id || '","user_id":"' || user_id || '"}') AS h FROM events) SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM x""")
def _(spark, d):
    out = aggs.fingerprint(table(spark, d, "events").select("event_id", "user_id"))
    return out.withColumn("digest", F.col("digest").cast("string"))


@query("d28_coverage", f"""WITH {OBS}, x AS (SELECT mint, sha256('{{"event_id":"' || event_id || '","mint":"' || mint || '"}}') AS h FROM obs WHERE side = 'purchase')
    SELECT count(*) AS signals, count(DISTINCT mint) AS keys, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM x""")
def _(spark, d):
    out = aggs.coverage(obs(spark, d).where(side("purchase")).select("event_id", "mint"), "mint")
    return out.withColumn("digest", F.col("digest").cast("string"))


@query("d29_compare_runs", f"WITH {OBS}, s AS (SELECT side AS run, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM obs GROUP BY 1) SELECT run, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT run, 'total', CAST(total AS DOUBLE) FROM s")
def _(spark, d):
    s = obs(spark, d).groupBy(F.col("side").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return aggs.compare_runs(s, "run", ["n", "total"])


@query("d30_boundaries", f"WITH {ROUTED} SELECT DISTINCT slot, event_id FROM routed WHERE reason = 'ACCEPTED' UNION SELECT DISTINCT slot, -1 FROM routed")
def _(spark, d):
    r = _routed(spark, d)
    return r.where("reason = 'ACCEPTED'").select("slot", "event_id").union(r.select("slot", F.lit(-1).cast("long"))).distinct()


# --- windows


@query("e01_first_per", f"WITH {FIRST} SELECT event_id, signer, mint FROM firsts")
def _(spark, d):
    return first_rows(spark, d).select("event_id", "signer", "mint")


@query("e02_dense_keys", "SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS key FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    return aggs.dense_keys(table(spark, d, "events"), "user_id", "key")


@query("e03_with_ordinal", f"WITH {OBS} SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS ordinal FROM obs")
def _(spark, d):
    return aggs.with_ordinal(obs(spark, d).select("event_id", "t"), ["t", "event_id"], "ordinal").select("event_id", "ordinal")


@query("e04_running_offset", f"WITH {PAIRS} SELECT a, b, CAST(coalesce(sum(shared) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM pairs")
def _(spark, d):
    return blocks.pair_offsets(first_rows(spark, d), 86_400, 2)


@query("e06_out_of_order", f"WITH {OBS} SELECT event_id, amount, before FROM (SELECT *, lag(amount) OVER (PARTITION BY signer ORDER BY t, event_id) AS before FROM obs) WHERE amount < before")
def _(spark, d):
    return aggs.out_of_order(obs(spark, d), ["signer"], ["t", "event_id"], "amount").select("event_id", "amount", "before")


def _shards(spark, d):
    return obs(spark, d).groupBy("side", F.floor(F.col("event_id") / 500).alias("s")).agg(F.min("event_id").alias("lo"), (F.max("event_id") + 3).alias("hi"))


SHARDS = OBS + ", shards AS (SELECT side, event_id // 500 AS s, min(event_id) AS lo, max(event_id) + 3 AS hi FROM obs GROUP BY 1, 2)"


@query("e08_shard_gaps", f"WITH {SHARDS} SELECT side, lo, hi, nxt - hi AS gap FROM (SELECT *, lead(lo) OVER (PARTITION BY side ORDER BY lo, hi) AS nxt FROM shards) WHERE nxt <> hi")
def _(spark, d):
    return aggs.shard_gaps(_shards(spark, d), ["side"], "lo", "hi").select("side", "lo", "hi", "gap")


@query("e09_frontier", f"""WITH RECURSIVE {SHARDS}, walk AS (SELECT side, CAST(100 AS BIGINT) AS pos FROM (SELECT DISTINCT side FROM shards) UNION SELECT w.side, s.hi FROM walk w JOIN shards s ON s.side = w.side AND s.lo <= w.pos AND s.hi > w.pos)
    SELECT side, max(pos) AS frontier FROM walk GROUP BY side""")
def _(spark, d):
    return aggs.frontier(_shards(spark, d), ["side"], "lo", "hi", 100).select("side", F.col("frontier").cast("long").alias("frontier"))


@query("e10_missing_steps", f"WITH {OBS} SELECT signer, slot, slot - before - 1 AS missing FROM (SELECT *, lag(slot) OVER (PARTITION BY signer ORDER BY slot) AS before FROM (SELECT DISTINCT signer, slot FROM obs)) WHERE slot - before <> 1")
def _(spark, d):
    return aggs.missing_steps(obs(spark, d).select("signer", "slot").distinct(), ["signer"], "slot").select("signer", "slot", "missing")


@query("e13_dedup_by_priority", f"WITH {OBS}, r AS (SELECT *, max(amount % 4) OVER (PARTITION BY signer, mint) AS top FROM obs) SELECT signer, mint, top AS prio, min(side) AS side, count(DISTINCT side) > 1 AS conflict FROM r WHERE amount % 4 = top GROUP BY 1, 2, 3")
def _(spark, d):
    return aggs.dedup_by_priority(obs(spark, d).withColumn("prio", F.col("amount") % 4), ["signer", "mint"], "prio", ["side"])


@query("e14_event_index", f"WITH {ROUTED} SELECT event_id, row_number() OVER (PARTITION BY signer, slot ORDER BY t, event_id) - 1 AS event_index FROM routed WHERE reason = 'ACCEPTED'")
def _(spark, d):
    rows = _routed(spark, d).where("reason = 'ACCEPTED'")
    return aggs.numbered_within(rows, ["signer", "slot"], ["t", "event_id"], "event_index").select("event_id", F.col("event_index").cast("long").alias("event_index"))


@query("e16_fee_once", f"WITH {OBS} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY signer, slot ORDER BY t, event_id) = 1 THEN amount ELSE 0 END AS fee FROM obs")
def _(spark, d):
    return aggs.once_per(obs(spark, d), ["signer", "slot"], ["t", "event_id"], "amount", "fee").select("event_id", F.col("fee").cast("long").alias("fee"))


@query("e17_running_balance", f"WITH {POSTINGS}, b AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY asset ORDER BY tx, account, line, amount ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM postings) SELECT asset, min(balance) AS lowest, count(*) FILTER (balance < 0) AS below FROM b GROUP BY asset")
def _(spark, d):
    rows = aggs.running_balance(postings(spark, d), ["asset"], ["tx", "account", "line", "amount"], "amount")
    return rows.groupBy("asset").agg(F.min("balance").alias("lowest"), F.count_if(F.col("balance") < 0).alias("below"))


@query("e18_trailing_features", f"""WITH {HOURLY}, ends AS (SELECT side, min(slot) AS lo, max(slot) AS hi FROM hourly GROUP BY 1), spine AS (SELECT side, unnest(range(lo, hi + 1)) AS slot FROM ends),
    h AS (SELECT side, slot, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(hits, 0) AS hits FROM spine LEFT JOIN hourly USING (side, slot)),
    t AS (SELECT side, slot, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS trailing_n, CAST(coalesce(sum(total) OVER w, 0) AS BIGINT) AS trailing_total, CAST(coalesce(sum(hits) OVER w, 0) AS BIGINT) AS trailing_hits, slot % 24 AS hour_of_day
        FROM h WINDOW w AS (PARTITION BY side ORDER BY slot RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING))
    SELECT *, CAST(trailing_total AS DOUBLE) / nullif(trailing_n, 0) AS trailing_mean, CAST(trailing_hits AS DOUBLE) / nullif(trailing_n, 0) AS trailing_share FROM t""")
def _(spark, d):
    rows = aggs.hourly_spine(hourly(spark, d), ["side"], "slot", ["n", "total", "hits"])
    return aggs.trailing_features(rows, ["side"], "slot", "n", "total", "hits").drop("n", "total", "hits")


COOLDOWN = f"""WITH RECURSIVE {OBS}, r AS (SELECT event_id, signer, t, row_number() OVER (PARTITION BY signer ORDER BY t, event_id) AS i FROM obs),
    w AS (SELECT signer, i, event_id, t AS last, true AS accepted FROM r WHERE i = 1 UNION ALL SELECT r.signer, r.i, r.event_id, CASE WHEN r.t - w.last >= 7200 THEN r.t ELSE w.last END, r.t - w.last >= 7200 FROM w JOIN r ON r.signer = w.signer AND r.i = w.i + 1)
    SELECT event_id, accepted FROM w"""


@query("e19_cooldown", COOLDOWN)
def _(spark, d):
    return aggs.cooldown(obs(spark, d), ["signer"], "t", ["event_id"], 7200).select("event_id", "accepted")


@query("e20_group_counts", f"WITH {OBS} SELECT event_id FROM (SELECT *, count(*) FILTER (side = 'purchase') OVER (PARTITION BY signer, mint) AS p, count(*) FILTER (side = 'view') OVER (PARTITION BY signer, mint) AS v FROM obs) WHERE p = 1 AND v = 1")
def _(spark, d):
    return trips.one_buy_one_sell(obs(spark, d), ["signer", "mint"], "side", "purchase", "view").select("event_id")


# --- paging, sets, scalars


@query("f03_keyset_page", f"WITH {OBS} SELECT t, event_id FROM obs WHERE (t, event_id) > (1704400000, 0) ORDER BY t, event_id LIMIT 200")
def _(spark, d):
    return aggs.keyset_page(obs(spark, d).select("t", "event_id"), ["t", "event_id"], [1704400000, 0], 200)


@query("f05_row_range", "SELECT event_id, user_id FROM events WHERE event_id BETWEEN 500 AND 900")
def _(spark, d):
    return table(spark, d, "events").where(F.col("event_id").between(500, 900)).select("event_id", "user_id")


@query("g01_lifecycle_candidates", f"WITH {OBS} SELECT event_id, 'COMPLETED' AS kind, amount, CAST(NULL AS BIGINT) AS target FROM obs WHERE side = 'purchase' UNION ALL SELECT event_id, 'MIGRATED', NULL, mint FROM obs WHERE side = 'signup'")
def _(spark, d):
    o = obs(spark, d)
    done = o.where(side("purchase")).select("event_id", F.lit("COMPLETED").alias("kind"), "amount")
    return aggs.merge_streams(done, o.where(side("signup")).select("event_id", F.lit("MIGRATED").alias("kind"), F.col("mint").alias("target")))


@query("g03_same_keys", f"WITH {OBS}, a AS (SELECT DISTINCT signer, mint FROM obs WHERE side = 'view'), b AS (SELECT DISTINCT signer, mint FROM obs WHERE side = 'click') SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _(spark, d):
    o = obs(spark, d)
    return aggs.same_keys(o.where(side("view")), o.where(side("click")), ["signer", "mint"])


@query("h01_boundary", f"WITH {OBS} SELECT event_id, slot * 4294967296 + mint + 1 AS boundary, slot AS block, mint AS tx FROM obs")
def _(spark, d):
    o = obs(spark, d).withColumn("boundary", sc.boundary(F.col("slot"), F.col("mint")))
    return o.select("event_id", "boundary", sc.boundary_block(F.col("boundary")).alias("block"), sc.boundary_tx(F.col("boundary")).alias("tx"))


@query("h07_exact_money", f"""WITH {OBS} SELECT event_id, (amount * 125 + 9999) // 10000 AS fee, amount * 9900 // 10000 AS least_out, CAST(amount AS HUGEINT) * 1000000000 * 1000000007 // (mint + 3) % 1000000007 AS cap, (amount * 1500 + 999999) // 1000000 + mint * 5000 AS network FROM obs""")
def _(spark, d):
    a, m = F.col("amount"), F.col("mint")
    cap = sc.market_cap(a * 1_000_000_000, F.lit(1_000_000_007), m + 3)
    return obs(spark, d).select("event_id", sc.ceil_fee(a, F.lit(125)).cast("long").alias("fee"), sc.min_output(a, F.lit(100)).cast("long").alias("least_out"), (cap % 1_000_000_007).cast("long").alias("cap"), sc.network_fee(a, F.lit(1500), m, 5000).cast("long").alias("network"))


@query("h10_price_exit", f"WITH {OBS} SELECT event_id, CASE WHEN amount * 7 * 10000 <= 3000 * (mint + 1) * 9000 THEN 'STOP_LOSS' WHEN amount * 7 * 10000 >= 3000 * (mint + 1) * 12000 THEN 'TAKE_PROFIT' END AS exit FROM obs")
def _(spark, d):
    return obs(spark, d).select("event_id", sc.price_exit(F.col("amount"), F.col("mint") + 1, F.lit(3000), F.lit(7), 1000, 2000).alias("exit"))


@query("h13_content_id", "SELECT event_id, sha256(length(CAST(user_id AS VARCHAR)) || ':' || user_id || length(event_type) || ':' || event_type) AS id FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", sc.content_id("user_id", "event_type").alias("id"))


@query("h14_split_range", "SELECT c_custkey, lo AS part_from, least(lo + 40, c_custkey + 100) AS part_to FROM (SELECT c_custkey, unnest(range(c_custkey, c_custkey + 100, 40)) AS lo FROM customer)")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("lo"), (F.col("c_custkey") + 100).alias("hi"))
    return sc.split_range(rows, "lo", "hi", 40).select("c_custkey", "part_from", "part_to")


@query("h17_real_reserves", f"WITH {OBS} SELECT event_id, CASE WHEN amount >= 50 AND mint >= 3 THEN amount - 50 END AS base, CASE WHEN amount >= 50 AND mint >= 3 THEN mint - 3 END AS quote, CASE WHEN amount >= 50 AND mint >= 3 THEN CASE WHEN amount = 50 THEN 'COMPLETED' ELSE 'ACTIVE' END END AS lifecycle, mint * 2 + 1 AS derived FROM obs")
def _(spark, d):
    o = obs(spark, d).withColumn("r", sc.real_reserves(F.col("amount"), F.col("mint"), 50, 3))
    return o.select("event_id", "r.base", "r.quote", "r.lifecycle", sc.event_index_of(F.col("mint"), 1).alias("derived"))


@query("h05_base58")
def _(spark, d):
    text = sc.to_base58(F.unhex(F.sha2(F.col("user_id").cast("string"), 256)))
    return table(spark, d, "events").select("user_id").distinct().select("user_id", text.alias("address")).withColumn("fits", sc.is_base58(F.col("address")) & (sc.base58_bytes("address") == 32))


# --- positions


@query("t08_copy_signals", f"WITH {OBS} SELECT event_id, mint FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY t, event_id) AS n FROM obs WHERE signer IN (1, 2, 3, 4, 5) AND side = 'purchase') WHERE n = 1")
def _(spark, d):
    return trips.copy_signals(obs(spark, d), [1, 2, 3, 4, 5], "signer", "side", "purchase", "slot", 0, 1 << 40, "mint", ["t", "event_id"]).select("event_id", "mint")


EXITS = FIRST + ", p AS (SELECT event_id AS id, mint, t AS entry_at, t + 43200 AS deadline, amount AS entry_price FROM firsts WHERE side = 'purchase')"


@query("t10_first_exit", f"""WITH {EXITS}, x AS (SELECT id, t, CASE WHEN amount * 10000 <= entry_price * 7000 THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS r FROM p JOIN obs o ON o.mint = p.mint AND o.t >= entry_at AND o.t <= deadline AND o.side = 'view' AND (amount * 10000 <= entry_price * 7000 OR amount * 10000 >= entry_price * 14000))
    SELECT p.id, coalesce(min(x.t), deadline) AS exit_at, coalesce(min({{'t': x.t, 'r': x.r}}).r, 'DEADLINE') AS exit_reason FROM p LEFT JOIN x USING (id) GROUP BY p.id, deadline""")
def _(spark, d):
    pos = first_rows(spark, d).where(side("purchase")).select(F.col("event_id").alias("id"), "mint", F.col("t").alias("entry_at"), (F.col("t") + 43_200).alias("deadline"), F.col("amount").alias("entry_price"))
    states = obs(spark, d).where(side("view")).select("mint", "t", F.col("amount").alias("price"))
    return trips.first_exit(pos, states, ["mint"], "entry_at", "deadline", "t", "price", "entry_price", 3000, 4000, "id").select("id", "exit_at", "exit_reason")


def _retries():
    """Quote, landing and outcome of four attempts, one after the other."""
    out = VIEWS + ", s0 AS (SELECT event_id AS id, signer, t AS at1 FROM obs WHERE side = 'click')"
    for n in (1, 2, 3, 4):
        out += f", q{n} AS (SELECT p.*, view_amount AS q{n}, at{n} + 600 AS land{n} FROM s{n - 1} p ASOF LEFT JOIN views v ON p.signer = v.signer AND p.at{n} >= v.view_t)"
        out += f", l{n} AS (SELECT p.*, view_amount AS p{n} FROM q{n} p ASOF LEFT JOIN views v ON p.signer = v.signer AND p.land{n} >= v.view_t)"
        out += f", s{n} AS (SELECT *, coalesce(p{n} >= q{n} * 9900 // 10000, false) AS f{n}, CASE WHEN q{n} IS NULL THEN at{n} ELSE land{n} END + 3600 AS at{n + 1} FROM l{n})"
    return out


@query("t11_retry_sells", f"WITH {_retries()} SELECT id, CASE WHEN f1 THEN 1 WHEN f2 THEN 2 WHEN f3 THEN 3 WHEN f4 THEN 4 END AS attempt, CASE WHEN f1 THEN p1 WHEN f2 THEN p2 WHEN f3 THEN p3 WHEN f4 THEN p4 END AS fill_price, CASE WHEN f1 THEN land1 WHEN f2 THEN land2 WHEN f3 THEN land3 WHEN f4 THEN land4 END AS filled_at FROM s4")
def _(spark, d):
    pos = obs(spark, d).where(side("click")).select(F.col("event_id").alias("id"), "signer", "t")
    return trips.retry_sells(pos, _views(spark, d), ["signer"], "t", "view_t", "view_amount", 600, 3600, 100).select("id", "attempt", "fill_price", "filled_at")


@query("t14_economics", f"WITH {OBS} SELECT event_id, CASE WHEN side <> 'error' THEN amount + mint + 3 END AS total, CASE WHEN side <> 'error' THEN 'VALUED' ELSE 'UNVALUED' END AS mark FROM obs")
def _(spark, d):
    e = trips.economics(F.col("amount"), F.when(~side("error"), F.col("mint")), F.lit(1), F.lit(2))
    return obs(spark, d).withColumn("e", e).select("event_id", "e.total", "e.mark")


@query("t15_attempts", f"WITH {OBS} SELECT event_id, leg_no, CASE WHEN leg_no = 0 AND amount > 500 OR leg_no = 1 AND mint > 50 THEN 'FILLED' WHEN leg_no = 0 AND mint < 5 THEN 'REJECTED' ELSE 'FAILED' END AS state FROM obs, (VALUES (0), (1)) v(leg_no)")
def _(spark, d):
    legs = F.array(F.struct((F.col("amount") > 500).alias("filled"), (F.col("mint") < 5).alias("rejected")), F.struct((F.col("mint") > 50).alias("filled"), F.lit(False).alias("rejected")))
    return trips.attempts(obs(spark, d).withColumn("legs", legs), "event_id", "legs").select("event_id", "leg_no", "state")


@query("t16_order_lifecycle", f"""WITH {OBS}, s AS (SELECT signer || '/' || mint AS order_id, count(*) FILTER (side = 'signup') AS decisions, count(*) FILTER (side IN ('purchase', 'error')) AS ends FROM obs GROUP BY 1)
    SELECT order_id, CASE WHEN decisions <> 1 THEN 'DECISIONS' ELSE 'ENDS' END AS rule FROM s WHERE decisions <> 1 OR ends <> 1""")
def _(spark, d):
    audit = obs(spark, d).withColumn("order_id", F.concat_ws("/", F.col("signer").cast("string"), F.col("mint").cast("string")))
    return trips.order_lifecycle(audit, "order_id", "side", "signup", ["purchase", "error"], "purchase", audit.where(side("purchase"))).select("order_id", "rule")


@query("t17_slippage", f"WITH {OBS} SELECT event_id, CASE WHEN amount > 1000 THEN 'WORSE' WHEN amount < 1000 THEN 'BETTER' ELSE 'SAME' END AS slip FROM obs")
def _(spark, d):
    return obs(spark, d).select("event_id", trips.slippage(F.col("amount"), F.lit(1000)).alias("slip"))


@query("t18_to_postings", f"WITH {OBS} SELECT event_id, 'CASH' AS account, 'Q' AS asset, -amount AS amount FROM obs WHERE amount <> 0 UNION ALL SELECT event_id, 'VENUE', 'Q', amount - amount % 7 FROM obs WHERE amount - amount % 7 <> 0 UNION ALL SELECT event_id, 'FEES', 'Q', amount % 7 FROM obs WHERE amount % 7 <> 0")
def _(spark, d):
    a = F.col("amount")
    return trips.to_postings(obs(spark, d), "event_id", {"cash": ("CASH", "Q", -a), "venue": ("VENUE", "Q", a - a % 7), "fee": ("FEES", "Q", a % 7)})


@query("t20_market_cap_series", f"WITH {OBS} SELECT mint, slot, arg_max(amount, (t, event_id)) * 1000000 // (mint + 1) AS market_cap FROM obs GROUP BY mint, slot")
def _(spark, d):
    rows = obs(spark, d).withColumn("supply", F.lit(1_000_000)).withColumn("base", F.col("mint") + 1)
    return aggs.market_cap_series(rows, ["mint"], "slot", "amount", "base", "supply", ["t", "event_id"]).select("mint", "slot", F.col("market_cap").cast("long").alias("market_cap"))


@query("t20_chart_series", f"""WITH {OBS}, s AS (SELECT mint, slot, arg_max(amount, (t, event_id)) * 1000000 // (mint + 1) AS market_cap FROM obs GROUP BY mint, slot), made AS (SELECT mint, min(slot) AS made FROM obs WHERE side = 'signup' AND mint % 9 <> 0 GROUP BY 1),
    sig AS (SELECT DISTINCT mint, slot FROM obs WHERE side = 'purchase' AND mint % 8 <> 0), c AS (SELECT slot, min(t) AS time FROM obs GROUP BY 1)
    SELECT s.mint, s.slot, market_cap, time, CASE WHEN sig.slot IS NOT NULL THEN 'SIGNAL' WHEN s.slot = made THEN 'CREATED' WHEN s.slot > made THEN 'ACTIVE' END AS lifecycle,
    CASE WHEN made IS NULL THEN 'NO_CREATION' WHEN s.slot < made THEN 'BEFORE_CREATION' WHEN s.mint NOT IN (SELECT mint FROM sig) THEN 'NO_SIGNAL' END AS issue FROM s LEFT JOIN made USING (mint) LEFT JOIN sig ON sig.mint = s.mint AND sig.slot = s.slot LEFT JOIN c ON c.slot = s.slot""")
def _(spark, d):
    o = obs(spark, d)
    series = aggs.market_cap_series(o.withColumn("supply", F.lit(1_000_000)).withColumn("base", F.col("mint") + 1), ["mint"], "slot", "amount", "base", "supply", ["t", "event_id"])
    out = aggs.chart_series(series, o.where(side("signup") & (F.col("mint") % 9 != 0)), o.where(side("purchase") & (F.col("mint") % 8 != 0)), o.groupBy("slot").agg(F.min("t").alias("time")), "mint", "slot")
    return out.select("mint", "slot", F.col("market_cap").cast("long").alias("market_cap"), "time", "lifecycle", "issue")


@query("t21_series_window", f"""WITH {OBS}, m AS (SELECT mint, min(t) - 3600 AS lo, max(t) + 3600 AS hi FROM obs WHERE side = 'purchase' GROUP BY 1), n AS (SELECT o.event_id, o.mint, o.t, lo, max(CASE WHEN t < lo THEN t END) OVER (PARTITION BY mint) AS e FROM obs o JOIN m USING (mint) WHERE t <= hi) SELECT event_id FROM n WHERE t >= lo OR t = e""")
def _(spark, d):
    o = obs(spark, d)
    return trips.series_window(o, o.where(side("purchase")).select("mint", F.col("t").alias("m")), ["mint"], "t", "m", 3600).select("event_id")


# --- graphs


@query("n01_node_strength", f"WITH {EDGES} SELECT node, CAST(sum(weight) AS BIGINT) AS strength, count(*) AS degree FROM (SELECT a AS node, weight FROM edges UNION ALL SELECT b, weight FROM edges) GROUP BY node")
def _(spark, d):
    return graph.node_strength(met(spark, d))


@query("n02_communities")
def _(spark, d):
    return graph.communities(met(spark, d), 20)


@query("n03_quotient", f"WITH {EDGES} SELECT least(a % 7, b % 7) AS g1, greatest(a % 7, b % 7) AS g2, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS n_edges FROM edges GROUP BY 1, 2")
def _(spark, d):
    pairs = met(spark, d)
    return graph.quotient(pairs, pairs.entities().withColumn("grp", F.col("node") % 7))


@query("n04_ego", f"WITH {EDGES}, near AS (SELECT b AS n FROM edges WHERE a = 3 UNION SELECT a FROM edges WHERE b = 3 UNION SELECT 3) SELECT a, b, weight FROM edges WHERE a IN (SELECT n FROM near) AND b IN (SELECT n FROM near)")
def _(spark, d):
    return graph.ego(met(spark, d), 3)


@query("n05_lineage", f"""WITH RECURSIVE {OBS}, e AS (SELECT DISTINCT signer AS child, mint % 150 AS parent FROM obs WHERE side = 'signup'), w AS (SELECT CAST(7 AS BIGINT) AS node, 0 AS steps UNION SELECT parent, steps + 1 FROM w JOIN e ON child = node WHERE steps < 12)
    SELECT node, min(steps) AS steps FROM w GROUP BY node""")
def _(spark, d):
    e = obs(spark, d).where(side("signup")).select(F.col("signer").alias("child"), (F.col("mint") % 150).alias("parent")).distinct()
    return graph.lineage(e, spark.range(7, 8).select(F.col("id").alias("node")))


@query("n06_find_nodes", "SELECT c_name, (SELECT count(DISTINCT c_name) FROM customer WHERE contains(c_name, '42')) AS total FROM (SELECT DISTINCT c_name FROM customer WHERE contains(c_name, '42')) ORDER BY c_name LIMIT 100")
def _(spark, d):
    return graph.find_nodes(table(spark, d, "customer"), "c_name", "42")


@query("f06_rank_groups", f"WITH {EDGES}, n AS (SELECT a AS node FROM edges UNION SELECT b FROM edges) SELECT node % 7 AS grp, count(*) AS size, min(node) AS least FROM n GROUP BY 1")
def _(spark, d):
    return graph.rank_groups(graph.nodes(met(spark, d)).withColumn("grp", F.col("node") % 7))


# --- point in time


@query("m01_feature_rows", f"WITH {OBS} SELECT event_id AS row_id, slot AS effective, slot + 6 AS available, amount FROM obs")
def _(spark, d):
    return pit.feature_rows(obs(spark, d).withColumn("row_id", F.col("event_id")), "slot", [1, 6, 3], ["amount"], "row_id")


@query("m02_universe_rows", f"WITH {OBS} SELECT event_id AS row_id, slot + 6 AS eligible_from, slot + 7 AS eligible_until, slot + 6 AS input_available FROM obs")
def _(spark, d):
    return pit.universe_rows(pit.feature_rows(obs(spark, d).withColumn("row_id", F.col("event_id")), "slot", [6], [], "row_id"))


@query("m03_label_rows", f"WITH {OBS} SELECT event_id, slot + 10 AS future_used, amount AS label FROM obs WHERE slot + 10 <= 473600")
def _(spark, d):
    return pit.label_rows(obs(spark, d), "slot", "amount", 10, 473_600).select("event_id", "future_used", "label")


@query("m04_lookahead", f"WITH {OBS} SELECT event_id, 'AVAILABLE_BEFORE_EFFECTIVE' AS rule FROM obs WHERE slot + mint - 2 < slot")
def _(spark, d):
    return pit.lookahead_violations(obs(spark, d).withColumn("ready", F.col("slot") + F.col("mint") - 2), "slot", "ready").select("event_id", "rule")


@query("m05_temporal_split", f"WITH {OBS} SELECT event_id, CASE WHEN slot < 473500 - 24 THEN 'TRAIN' WHEN slot >= 473520 THEN 'TEST' ELSE 'PURGED' END AS split FROM obs")
def _(spark, d):
    return pit.temporal_split(obs(spark, d), "slot", 473_500, 24, 473_520).select("event_id", "split")


@query("m06_training_rows", f"WITH {OBS} SELECT event_id AS row_id, mint AS label, amount FROM obs WHERE side = 'click'")
def _(spark, d):
    rows = obs(spark, d).withColumn("row_id", F.col("event_id"))
    f = pit.feature_rows(rows, "slot", [6], ["amount"], "row_id")
    labels = rows.select("row_id", F.when(side("click"), F.col("mint")).alias("label"))
    return pit.training_rows(labels, pit.universe_rows(f), f, ["amount"]).select("row_id", "label", "amount")


@query("m08_score", f"WITH {SCHEDULE} SELECT event_id, CAST(floor((bias + 3 * amount - 200 * mint) / 7.0) AS BIGINT) AS prediction, greatest(slot + 6, model_available) AS prediction_available FROM obs JOIN schedule ON slot >= valid_from AND slot < valid_until")
def _(spark, d):
    models = _schedule(spark, d).withColumn("divisor", F.lit(7)).withColumn("weights", F.array(F.lit(3), F.lit(-200)))
    out = pit.score(obs(spark, d).withColumn("available", F.col("slot") + 6), models, "slot", ["amount", "mint"]).where("status = 'SCORED'")
    return out.select("event_id", F.col("prediction").cast("long").alias("prediction"), "prediction_available")


@query("m10_check_schedule", f"""WITH {OBS}, s AS (SELECT event_id AS model_id, signer, slot AS valid_from, slot + mint % 4 AS valid_until, slot - 1 + mint % 3 AS model_available FROM obs), n AS (SELECT *, lead(valid_from) OVER (PARTITION BY signer ORDER BY valid_from, model_id) AS nxt FROM s),
    r AS (SELECT model_id, CASE WHEN valid_until <= valid_from THEN 'EMPTY' WHEN nxt < valid_until THEN 'OVERLAP' WHEN model_available > valid_from THEN 'LATE_MODEL' END AS rule FROM n) SELECT * FROM r WHERE rule IS NOT NULL""")
def _(spark, d):
    m = F.col("mint")
    schedules = obs(spark, d).select(F.col("event_id").alias("model_id"), "signer", F.col("slot").alias("valid_from"), (F.col("slot") + m % 4).alias("valid_until"), (F.col("slot") - 1 + m % 3).alias("model_available"))
    return pit.check_schedule(schedules, ["signer"]).select("model_id", "rule")


@query("m11_split_purged", f"WITH {OBS} SELECT event_id, CASE WHEN side = 'error' THEN 'UNKNOWN' WHEN slot >= 473500 THEN 'TEST' WHEN slot + 24 > 473500 THEN 'PURGED' ELSE 'TRAIN' END AS split FROM obs")
def _(spark, d):
    rows = obs(spark, d).withColumn("label", F.when(~side("error"), F.col("mint"))).withColumn("known", F.col("slot") + 24)
    return pit.split_purged(rows, "slot", "known", "label", F.lit(473_500)).select("event_id", "split")


@query("m07_fit_ridge")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("x"), F.round("l_extendedprice").cast("long").alias("p"))
    fitted = pit.fit_ridge(rows, ["q", "x"], "p", 10)
    return spark.createDataFrame([(i, str(v.numerator), str(v.denominator)) for i, v in enumerate(fitted)], "coefficient int, numerator string, denominator string")


@query("m12_fit_logistic")
def _(spark, d):
    rows = hourly(spark, d).withColumn("y", (F.col("hits") * 3 > F.col("n")).cast("double"))
    model = pit.fit_logistic(rows, ["n", "total"], "y")
    return model.transform(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m13_binary_metrics", f"WITH {OBS}, p AS (SELECT (mint + 1) / 102.0 AS p, CASE WHEN amount > 1000 THEN 1.0 ELSE 0.0 END AS y FROM obs) SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss FROM (SELECT CAST(p AS DOUBLE) AS p, CAST(y AS DOUBLE) AS y FROM p)")
def _(spark, d):
    rows = obs(spark, d).select(((F.col("mint") + 1) / F.lit(102.0)).alias("p"), (F.col("amount") > 1000).alias("y"))
    return pit.binary_metrics(rows.withColumn("y", F.col("y").cast("int")), "p", "y").select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "brier", "log_loss")])


# --- quality


@query("q01_check_in_block", f"WITH {DAYS}, e AS (SELECT l_orderkey, l_linenumber, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS block FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN tx_count IS NULL THEN 'NO_BLOCK' ELSE 'PAST_END' END AS rule FROM e LEFT JOIN clock USING (block) WHERE tx_count IS NULL OR l_linenumber >= tx_count")
def _(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(sc.epoch_seconds("l_shipdate") / 86400).alias("block"))
    return quality.check_in_block(e, clock(spark, d), "block", "l_linenumber").select("l_orderkey", "l_linenumber", "rule")


@query("q02_check_shard", f"WITH {OBS} SELECT event_id, CASE WHEN slot < 473400 OR slot >= 473700 THEN 'OUTSIDE' ELSE 'BOUNDARY' END AS rule FROM obs WHERE slot < 473400 OR slot >= 473700 OR mint = 5")
def _(spark, d):
    rows = obs(spark, d).withColumn("stored", sc.boundary(F.col("slot"), F.when(F.col("mint") == 5, F.lit(6)).otherwise(F.col("mint"))))
    return quality.check_shard(rows, 473_400, 473_700, "slot", "stored", sc.boundary(F.col("slot"), F.col("mint"))).select("event_id", "rule")


@query("q03_check_groups", f"WITH {OBS} SELECT slot, count(DISTINCT signer) AS groups, count(*) AS n, CASE WHEN count(DISTINCT signer) > 1 THEN 'MANY_GROUPS' ELSE 'TOO_LARGE' END AS rule FROM obs GROUP BY slot HAVING count(DISTINCT signer) > 1 OR count(*) > 30")
def _(spark, d):
    return quality.check_groups(obs(spark, d), "slot", "signer", 30)


@query("q04_check_reserves", f"WITH {OBS} SELECT event_id FROM obs WHERE amount - mint <> amount - mint % 90")
def _(spark, d):
    rows = obs(spark, d).withColumn("after", F.col("amount") - F.col("mint") % 90)
    return quality.check_reserves(rows, "amount", "after", "mint").select("event_id")


@query("q05_quality_report", f"WITH {OBS} SELECT 'REPEATED' AS rule, signer || '/' || slot AS key FROM obs GROUP BY signer, slot HAVING count(*) > 1 UNION ALL SELECT 'NOT_FUNCTIONAL', signer || '/' || slot FROM obs GROUP BY signer, slot HAVING count(DISTINCT mint) > 1")
def _(spark, d):
    o = obs(spark, d)
    return quality.quality_report({"REPEATED": (aggs.repeated_keys(o, ["signer", "slot"]), ["signer", "slot"]), "NOT_FUNCTIONAL": (aggs.not_functional(o, ["signer", "slot"], "mint"), ["signer", "slot"])}).select("rule", "key")


# --- streams: what is in the table arrives as micro-batches, and the result is what the sink holds at the end


def _stream(spark, d, columns):
    """A live table over the Parquet files of events: one file beside the other tables, or a folder of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    read = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema)
    live = read.parquet(f"{d}/events.parquet") if folder else read.option("pathGlobFilter", "events.parquet").parquet(d)
    return live.select(*columns)


def _drain(spark, df, mode):
    """What the stream gives in the end, written as Parquet beside its state and read again; none of it passes the driver."""
    root = _state_dir(spark)
    out = f"{root}/out"
    if mode == "append":
        sink = df.writeStream.format("parquet").option("path", out)
    else:
        spark.createDataFrame([], df.schema).write.parquet(out)
        sink = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    run = sink.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _state_dir(spark):
    """Below spark.checkpoint.dir; only where Spark is one process and none is set, a folder of this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root}/streams-{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="spark-stream-")


@query("k01_stream_dedup", f"WITH {OBS} SELECT DISTINCT signer, slot FROM obs")
def _(spark, d):
    rows = _stream(spark, d, [F.col("user_id").alias("signer"), F.floor(sc.epoch_seconds("ts") / 3600).alias("slot"), F.col("ts").cast("timestamp").alias("ts")])
    return _drain(spark, streams.stream_dedup(rows, ["signer", "slot"], "ts", "60 days"), "append").select("signer", "slot")


@query("k02_stream_activity", f"WITH {OBS} SELECT signer, t // 86400 AS day, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM obs GROUP BY 1, 2")
def _(spark, d):
    rows = _stream(spark, d, [F.col("user_id").alias("signer"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("ts").cast("timestamp").alias("ts")])
    out = _drain(spark, streams.stream_activity(rows, "ts", "60 days", "1 day", "signer", "event_type", "cents"), "complete")
    return out.select("signer", F.floor(F.unix_seconds("window.start") / 86_400).alias("day"), "n", "amount")


@query("k03_stream_cooldown", COOLDOWN)
def _(spark, d):
    rows = _stream(spark, d, [F.col("user_id").alias("signer"), F.col("ts").cast("timestamp").alias("ts"), "event_id"])
    rows = rows.withColumn("ts", F.date_trunc("second", "ts"))
    return _drain(spark, streams.stream_cooldown(rows, "signer", "ts", "event_id", 7200, "60 days"), "append")


@query("k04_stream_balances", f"WITH {OBS} SELECT signer, CAST(sum(CASE WHEN side = 'purchase' THEN -amount ELSE amount END) AS BIGINT) AS balance FROM obs GROUP BY signer")
def _(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    rows = _stream(spark, d, [F.col("user_id").alias("signer"), F.when(F.col("event_type") == "purchase", -cents).otherwise(cents).alias("amount")])
    return _drain(spark, streams.stream_balances(rows, ["signer"], "amount"), "complete")


@query("k03_cooldown_settled", COOLDOWN.replace("SELECT event_id, accepted FROM w", "SELECT event_id, accepted FROM w JOIN obs USING (event_id) WHERE (t + 3599) // 3600 * 3600 <= (SELECT max(t) FROM obs) - 2 * 86400"))
def _(spark, d):
    rows = _stream(spark, d, [F.col("user_id").alias("signer"), F.col("ts").cast("timestamp").alias("ts"), "event_id"])
    # times come in any order inside a file, so a watermark moves between files only
    rows = rows.withColumn("ts", F.date_trunc("second", "ts"))
    return _drain(spark, streams.stream_cooldown_settled(rows, "signer", "ts", "event_id", 7200, "2 days", 3600), "append")


@query("k04_live_balances", f"WITH {OBS} SELECT signer, CAST(sum(CASE WHEN side = 'purchase' THEN -amount ELSE amount END) AS BIGINT) AS balance, sum(CASE WHEN side = 'purchase' THEN -amount ELSE amount END) < 0 AS alerted FROM obs GROUP BY signer")
def _(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    rows = _stream(spark, d, [F.col("user_id").alias("signer"), F.when(F.col("event_type") == "purchase", -cents).otherwise(cents).alias("amount")])
    root = _state_dir(spark)
    sink = streams.BalanceSink(root, ["signer"])
    live = streams.stream_balances(rows, ["signer"], "amount")
    live.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    schema = f"signer {dict(live.dtypes)['signer']}, balance long"
    below = sink.alerts(spark, schema).select("signer", "batch", F.lit(True).alias("_below"))
    return sink.latest(spark, schema).join(below, ["signer", "batch"], "left").select("signer", "balance", F.coalesce("_below", F.lit(False)).alias("alerted"))

"""Registered queries, fourth part: proven pruning, shard manifests, verdicts, training sets, clocks with variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.operators import aggs, joins, pit, quality
from chainframe.plans.queries import OBS, SCHEDULE, _schedule, obs, query, side, table
from chainframe.sources import tables


@query("a03_prune_proven", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000")
def _(spark, d):
    df = table(spark, d, "orders").withColumn("dt", F.to_date("o_orderdate"))
    return tables.prune_proven(df, tables.zone_map(df, "dt", "o_orderkey"), "dt", "o_orderkey", 1000, 9000).select("o_orderkey", "o_custkey")


@query("a03_zone_map", "SELECT CAST(o_orderdate AS DATE) AS dt, min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(0 AS BIGINT) AS unplaced FROM orders GROUP BY 1")
def _(spark, d):
    return tables.zone_map(table(spark, d, "orders").withColumn("dt", F.to_date("o_orderdate")), "dt", "o_orderkey")


@query("a12_compare_shards", f"""WITH {OBS} SELECT slot, CASE WHEN slot % 5 = 0 THEN 'MISSING' WHEN slot % 11 = 0 THEN 'EXTRA' WHEN slot % 7 = 0 AND bool_or(mint % 9 = 3) THEN 'CHANGED' ELSE 'REUSE' END AS status FROM obs WHERE NOT (slot % 5 = 0 AND slot % 11 = 0) GROUP BY slot""")
def _(spark, d):
    o, slot = obs(spark, d), F.col("slot")
    done = o.where(slot % 5 != 0).withColumn("amount", F.when((slot % 7 == 0) & (F.col("mint") % 9 == 3), F.col("amount") + 1).otherwise(F.col("amount")))
    return tables.compare_shards(tables.shard_manifest(o.where(slot % 11 != 0), ["slot"]), tables.shard_manifest(done, ["slot"]), ["slot"])


@query("q06_verdicts", f"""WITH {OBS}, c AS (SELECT count(*) AS n, count(*) FILTER (side = 'purchase') AS buys, count(*) FILTER (amount < 0) AS negative, count(*) FILTER (side = 'purchase' AND amount > 5000) AS dear, count(*) FILTER (mint < 0 OR mint > 1000000) AS odd FROM obs),
    g AS (SELECT count(*) AS n, count(*) FILTER (k > 1) AS repeated FROM (SELECT count(*) AS k FROM obs GROUP BY signer, slot)), h AS (SELECT count(*) AS n, count(*) FILTER (k > 1) AS repeated FROM (SELECT count(*) AS k FROM obs GROUP BY event_id))
    SELECT rule, CASE WHEN checked = 0 THEN 'UNKNOWN' WHEN broken > 0 THEN 'REFUTED' ELSE 'PROVEN' END AS state, checked, broken FROM (
    SELECT 'NEGATIVE' AS rule, n AS checked, negative AS broken FROM c UNION ALL SELECT 'DEAR_PURCHASE', buys, dear FROM c UNION ALL SELECT 'ODD_MINT', n, odd FROM c UNION ALL SELECT 'NO_SUCH_SIDE', 0, 0 FROM c
    UNION ALL SELECT 'CROWDED', n, repeated FROM g UNION ALL SELECT 'REPEATED', n, repeated FROM h)""")
def _(spark, d):
    o, a = obs(spark, d), F.col("amount")
    rows = {"NEGATIVE": a < 0, "DEAR_PURCHASE": F.when(side("purchase"), a > 5000), "ODD_MINT": (F.col("mint") < 0) | (F.col("mint") > 1_000_000), "NO_SUCH_SIDE": F.when(side("none"), F.lit(True))}
    many = [F.count(F.lit(1)).alias("k")]
    groups = {"CROWDED": (["signer", "slot"], many, F.col("k") > 1), "REPEATED": (["event_id"], many, F.col("k") > 1)}
    return quality.verdicts_in_one_pass(o, rows).unionByName(quality.verdicts_of_groups(o, groups))


@query("m06_training_set", f"""WITH {OBS}, told AS (SELECT signer, t AS available, max(amount) AS value FROM obs WHERE side = 'view' GROUP BY 1, 2), more AS (SELECT signer, t + 60 AS available, max(mint) AS value FROM obs WHERE side = 'signup' GROUP BY 1, 2),
    asked AS (SELECT event_id AS row_id, signer, t AS moment, mint AS label FROM obs WHERE side = 'click' AND t >= 1704300000 AND t < 1705900000 AND mint % 4 <> 0)
    SELECT row_id, moment, label, v.value AS viewed, w.value AS signed FROM asked ASOF JOIN told v ON asked.signer = v.signer AND asked.moment >= v.available ASOF JOIN more w ON asked.signer = w.signer AND asked.moment >= w.available""")
def _(spark, d):
    o = obs(spark, d)
    feature = lambda rows, name, at, value: rows.select(F.lit(name).alias("name"), F.col("signer").alias("entity"), at.alias("available"), F.col(value).alias("value"))
    sets = feature(o.where(side("view")), "viewed", F.col("t"), "amount").unionByName(feature(o.where(side("signup")), "signed", F.col("t") + 60, "mint"))
    # the universe is what has both by then, so that no feature is missing
    since = sets.groupBy("name", "entity").agg(F.min("available").alias("since")).groupBy("entity").agg(F.max("since").alias("since"), F.count(F.lit(1)).alias("n")).where("n = 2")
    asked = o.where(side("click")).select(F.col("event_id").alias("row_id"), F.col("signer").alias("entity"), F.col("t").alias("at"), F.when(F.col("mint") % 4 != 0, F.col("mint")).alias("label"), F.col("t").alias("future_used"))
    universe = asked.join(since, "entity").select("row_id", F.col("since").alias("eligible_from"), F.lit(1 << 40).alias("eligible_until"))
    return pit.training_set(asked, universe, sets, ["viewed", "signed"], 1704300000, 1705900000, 1 << 40).withColumnRenamed("at", "moment")


@query("m08_score_with_bounds", f"WITH {SCHEDULE} SELECT event_id, greatest(slot + 6, model_available, valid_from + mint, slot + mint % 9) AS prediction_available FROM obs JOIN schedule ON slot >= valid_from AND slot < valid_until")
def _(spark, d):
    models = _schedule(spark, d).withColumn("divisor", F.lit(7)).withColumn("weights", F.array(F.lit(3), F.lit(-200)))
    rows = obs(spark, d).withColumns({"available": F.col("slot") + 6, "run_ended": F.col("slot") + F.col("mint") % 9})
    out = pit.score(rows, models.withColumn("fitted", F.col("valid_from")), "slot", ["amount", "mint"], also=["run_ended"])
    return out.where("status = 'SCORED'").select("event_id", F.greatest("prediction_available", F.col("fitted") + F.col("mint")).alias("prediction_available"))


@query("m11_split_by_rank", f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS i, count(*) OVER () * 7 // 10 AS cut FROM obs), s AS (SELECT *, (SELECT t FROM r WHERE i = cut) AS start FROM r)
    SELECT event_id, CASE WHEN side = 'error' AND i < cut THEN 'UNKNOWN_TRAIN' WHEN side = 'error' THEN 'UNKNOWN_TEST' WHEN i >= cut THEN 'TEST' WHEN t + 86400 >= start THEN 'PURGED_TRAIN' ELSE 'TRAIN' END AS split FROM s""")
def _(spark, d):
    rows = obs(spark, d).withColumns({"label": F.when(~side("error"), F.col("mint")), "known": F.col("t") + 86_400})
    return pit.split_by_rank(rows, ["t", "event_id"], "t", "label", "known").select("event_id", "split")


@query("c13_model_or_fallback", f"WITH {SCHEDULE} SELECT event_id, coalesce(model_id, 'm0') AS model_id, CASE WHEN model_id IS NOT NULL THEN 'SCORED' ELSE 'FALLBACK' END AS status FROM obs LEFT JOIN schedule ON slot >= valid_from AND slot < valid_until")
def _(spark, d):
    return joins.require_covered(joins.model_at(obs(spark, d), _schedule(spark, d), "slot", fallback="m0")).select("event_id", "model_id", "status")


@query("d05_block_variants", f"""WITH {OBS} SELECT slot, min(signer) AS signer, min(side) AS side, count(*) AS source_row_count, count(DISTINCT (signer, side)) AS payload_variant_count, count(DISTINCT (signer, side)) = 1 AND min(side) = 'view' AS sentinel FROM obs GROUP BY slot""")
def _(spark, d):
    return aggs.block_clock(obs(spark, d), "slot", ["signer", "side"], {"side": "view"})


@query("f03_keyset_page_and_more", f"WITH {OBS} SELECT t, event_id, true AS more FROM obs WHERE (t, event_id) > (1704400000, 0) ORDER BY t, event_id LIMIT 200")
def _(spark, d):
    return aggs.keyset_page_and_more(obs(spark, d).select("t", "event_id"), ["t", "event_id"], [1704400000, 0], 200)

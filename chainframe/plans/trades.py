"""Registered queries on trades as round trips: pairing, results, quotes, copies, launches.

Stand-ins: an event is a trade of its user in a mint, a purchase is a buy and any other event a sale; the amounts, rates and
flags come from the mint and the event, so that every rule is met. The SQL follows the rules and not the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.functions import scalar as sc
from chainframe.operators import aggs, filters, trips
from chainframe.plans.queries import DAYS, OBS, clock, obs, query, side

START, END = 473_300 * 3600, 473_750 * 3600

TRADES = OBS + """, tr AS (
    SELECT event_id, signer, mint, slot, t, side = 'purchase' AS is_buy, CASE WHEN mint % 4 = 0 THEN event_id % 3 ELSE 5 END AS tokens, amount AS sol,
           (amount * p_bps + 9999) // 10000 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS p_fee, (amount * 30 + 9999) // 10000 AS c_fee, p_bps, mint % 10 = 2 AS mayhem, CASE WHEN mint % 10 = 3 THEN 1 ELSE 0 END AS cashback,
           signer || '/' || slot AS signature, CASE WHEN mint % 7 = 0 THEN -1 ELSE signer END AS payer
    FROM (SELECT *, CASE WHEN mint % 10 = 1 THEN 90 ELSE 95 END AS p_bps FROM obs))"""
PAIRED = TRADES + f""", e AS (SELECT signer, mint, count(*) FILTER (is_buy AND t >= {START} AND t < {END}) AS entries, min(event_id) FILTER (is_buy AND t >= {START} AND t < {END}) AS buy_id FROM tr GROUP BY 1, 2),
f AS (SELECT e.signer, e.mint, count(*) FILTER (NOT tr.is_buy) AS sells, count(*) FILTER (tr.is_buy) AS more, min(tr.event_id) FILTER (NOT tr.is_buy) AS sell_id
      FROM e JOIN tr USING (signer, mint) JOIN tr b ON b.event_id = e.buy_id WHERE entries = 1 AND (tr.slot, tr.event_id) > (b.slot, b.event_id) GROUP BY 1, 2),
paired AS (SELECT e.signer, e.mint, e.buy_id, f.sell_id, b.slot AS buy_slot, s.slot AS sell_slot, b.sol AS buy_sol, s.sol AS sell_sol, b.p_fee AS buy_p, s.p_fee AS sell_p, b.c_fee AS buy_c, s.c_fee AS sell_c,
      CASE WHEN e.mint = 9 THEN 'explicitly_excluded_mint' WHEN entries = 0 THEN 'no_entry_in_window' WHEN entries > 1 THEN 'multiple_entries'
           WHEN coalesce(sells, 0) <> 1 OR more > 0 THEN 'not_one_buy_one_sell' WHEN s.slot <= b.slot THEN 'same_slot_roundtrip' WHEN b.tokens <> s.tokens THEN 'not_full_leader_exit'
           WHEN b.mayhem OR b.cashback > 0 THEN 'unsupported_mayhem_or_cashback' WHEN b.tokens = 0 OR b.sol = 0 OR s.sol = 0 THEN 'zero_amount' WHEN b.p_bps <> 95 THEN 'unsupported_fee_profile'
           WHEN b.event_id % 9 = 0 OR s.event_id % 9 = 0 THEN 'fee_amount_does_not_match_model' ELSE 'PAIRED' END AS reason
      FROM e LEFT JOIN f USING (signer, mint) LEFT JOIN tr b ON b.event_id = e.buy_id AND entries = 1 LEFT JOIN tr s ON s.event_id = f.sell_id AND sells = 1)"""


def _trades(spark, d):
    a, m = F.col("amount"), F.col("mint")
    rows = obs(spark, d).withColumn("protocol_fee_bps", F.when(m % 10 == 1, 90).otherwise(95))
    return rows.select(
        "event_id", "signer", "mint", "slot", F.col("event_id").alias("transaction_index"), F.array(F.lit(0)).alias("absolute_path"), F.col("t").alias("block_time"), side("purchase").alias("is_buy"),
        F.when(m % 4 == 0, F.col("event_id") % 3).otherwise(5).alias("token_amount"), a.alias("sol_amount"), "protocol_fee_bps", F.lit(30).alias("creator_fee_bps"),
        (sc.ceil_fee(a, F.col("protocol_fee_bps")) + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0)).cast("long").alias("protocol_fee"), sc.ceil_fee(a, F.lit(30)).cast("long").alias("creator_fee"),
        (m % 10 == 2).alias("mayhem_mode"), F.when(m % 10 == 3, 1).otherwise(0).alias("cashback"), F.lit(0).alias("cashback_fee_bps"),
        F.concat_ws("/", F.col("signer").cast("string"), F.col("slot").cast("string")).alias("signature"), F.col("signer").alias("user"), F.when(m % 7 == 0, -1).otherwise(F.col("signer")).alias("fee_payer"), F.lit(5000).cast("long").alias("fee_lamports"),
    )


KEYS = ("signer", "mint")


def _pairs(spark, d):
    trades = _trades(spark, d)
    return trips.pair_round_trips(trades, START, END, KEYS, trades.where("mint = 9"))


@query("t01_pair_round_trips", f"WITH {PAIRED} SELECT signer, mint, CASE WHEN buy_slot IS NOT NULL THEN buy_id END AS buy_id, CASE WHEN sell_slot IS NOT NULL THEN sell_id END AS sell_id, reason FROM paired")
def _(spark, d):
    return _pairs(spark, d).select("signer", "mint", F.col("buy_transaction_index").alias("buy_id"), F.col("sell_transaction_index").alias("sell_id"), "reason")


@query("d24_reason_counts", f"WITH {PAIRED} SELECT reason, count(*) AS n FROM paired GROUP BY 1")
def _(spark, d):
    return filters.disposition_counts(_pairs(spark, d))


@query("t02_leader_pnl", f"""WITH {PAIRED}, legs AS (SELECT p.*, leg, tr.signature, CASE WHEN payer = tr.signer THEN 5000 ELSE 0 END AS fee FROM paired p, (VALUES (0), (1)) v(leg), tr WHERE reason = 'PAIRED' AND tr.event_id = CASE WHEN leg = 0 THEN buy_id ELSE sell_id END),
    counted AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY buy_slot, buy_id, leg) AS n FROM legs)
    SELECT signer, mint, any_value(buy_sol + buy_p + buy_c) AS gross_buy, CAST(sum(CASE WHEN n = 1 THEN fee ELSE 0 END) AS BIGINT) AS network_fees, CAST(any_value(sell_sol - sell_p - sell_c - buy_sol - buy_p - buy_c) - sum(CASE WHEN n = 1 THEN fee ELSE 0 END) AS BIGINT) AS pnl FROM counted GROUP BY 1, 2""")
def _(spark, d):
    return trips.leader_pnl(_pairs(spark, d), KEYS)


@query("t03_quotes", f"""WITH {OBS}, q AS (SELECT event_id, amount, mint, amount * 10000 // 10125 AS first FROM obs), r AS (SELECT *, (first * 95 + 9999) // 10000 AS pf, (first * 30 + 9999) // 10000 AS cf FROM q), n AS (SELECT *, first - greatest(0, first + pf + cf - amount) AS net FROM r),
    b AS (SELECT *, CASE WHEN net > 0 THEN CAST(1000000 AS BIGINT) * net // (30000 + mint + net) END AS tokens, 30000 * amount // (1000000 + amount) AS gross FROM n), s AS (SELECT *, (gross * 95 + 9999) // 10000 + (gross * 30 + 9999) // 10000 AS fees FROM b)
    SELECT event_id, CAST(net AS BIGINT) AS net, CAST(net + pf + cf AS BIGINT) AS spent, CASE WHEN tokens > 0 AND tokens <= 90000 THEN tokens END AS bought, CASE WHEN amount <= 0 THEN 'INVALID_INPUT' WHEN net <= 0 OR tokens <= 0 THEN 'OUTPUT_OUT_OF_BOUNDS' WHEN tokens > 90000 THEN 'INSUFFICIENT_REAL_TOKEN_RESERVES' END AS buy_error,
    CASE WHEN amount > 0 THEN gross END AS gross, CASE WHEN amount > 0 AND gross > fees AND gross <= 900 THEN gross - fees END AS received, CASE WHEN amount <= 0 THEN 'INVALID_INPUT' WHEN gross <= 0 THEN 'OUTPUT_OUT_OF_BOUNDS' WHEN gross > 900 THEN 'INSUFFICIENT_REAL_SOL_RESERVES' WHEN fees >= gross THEN 'OUTPUT_OUT_OF_BOUNDS' END AS sell_error,
    5000 * (amount - amount * 30 // 10000) // (70000 + amount - amount * 30 // 10000) AS swapped FROM s""")
def _(spark, d):
    a, p, c = F.col("amount"), F.lit(95), F.lit(30)
    buy = trips.quote_buy(a, F.lit(1_000_000), F.col("mint") + 30_000, F.lit(90_000), F.lit(0), p, c)
    o = obs(spark, d).withColumn("b", buy).withColumn("s", trips.quote_sell(a, F.lit(1_000_000), F.lit(30_000), F.lit(900), p, c))
    long = lambda x, name: F.col(x).cast("long").alias(name)
    return o.select("event_id", long("b.net", "net"), long("b.spent", "spent"), long("b.out", "bought"), F.col("b.error").alias("buy_error"), long("s.gross", "gross"), long("s.out", "received"), F.col("s.error").alias("sell_error"), trips.quote_xyk(a, F.lit(70_000), F.lit(5_000), F.lit(30)).cast("long").alias("swapped"))


# amounts and reserves that fill all 64 bits; the products of the rules have up to 128
WIDE = OBS + """, wide AS (SELECT event_id, mint, (CAST(event_id AS UHUGEINT) * 6364136223846793005 + CAST(amount AS UHUGEINT) * 1442695040888963407) % 18446744073709551616 AS q, (CAST(amount AS UHUGEINT) * 11400714819323198485 + 1) % 18446744073709551616 AS vb,
    (CAST(event_id AS UHUGEINT) * 2862933555777941757 + 7) % 4611686018427387904 AS vq FROM obs)"""


@query("t04_u64_quotes", f"""WITH {WIDE}, r AS (SELECT *, q * 10000 // 10125 AS first FROM wide), f AS (SELECT *, (first * 95 + 9999) // 10000 AS pf, (first * 30 + 9999) // 10000 AS cf FROM r),
    n AS (SELECT *, CASE WHEN first + pf + cf > q THEN first - (first + pf + cf - q) ELSE first END AS net FROM f),
    b AS (SELECT *, CASE WHEN net > 0 THEN net * vb // (vq + net) END AS made, CASE WHEN q > 0 AND vb + q > 0 THEN q * vq // (vb + q) END AS gross FROM n),
    s AS (SELECT *, CASE WHEN q = 0 THEN 'INVALID_INPUT' WHEN net = 0 THEN 'OUTPUT_OUT_OF_BOUNDS' WHEN vq + net > 18446744073709551615 THEN 'ARITHMETIC_OVERFLOW' WHEN made = 0 OR made >= vb THEN 'OUTPUT_OUT_OF_BOUNDS' WHEN made > vb // 2 THEN 'INSUFFICIENT_REAL_TOKEN_RESERVES' END AS buy_error,
          CASE WHEN q = 0 THEN 'INVALID_INPUT' WHEN vb + q > 18446744073709551615 THEN 'ARITHMETIC_OVERFLOW' WHEN gross = 0 OR gross >= vq THEN 'OUTPUT_OUT_OF_BOUNDS' WHEN gross > vq // 3 THEN 'INSUFFICIENT_REAL_SOL_RESERVES' WHEN (gross * 95 + 9999) // 10000 + (gross * 30 + 9999) // 10000 >= gross THEN 'OUTPUT_OUT_OF_BOUNDS' END AS sell_error FROM b)
    SELECT event_id, CAST(net AS VARCHAR) AS net, CASE WHEN buy_error IS NULL THEN CAST(made AS VARCHAR) END AS bought, buy_error, CASE WHEN sell_error IS NULL THEN CAST(gross - (gross * 95 + 9999) // 10000 - (gross * 30 + 9999) // 10000 AS VARCHAR) END AS received, sell_error,
    CAST((q - q * 30 // 10000) * vq // (vb + (q - q * 30 // 10000)) AS VARCHAR) AS swapped, CAST(vq * vb // (q + 1000000000000) AS VARCHAR) AS cap FROM s""")
def _(spark, d):
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    times = lambda c, by: whole(c) * F.lit(str(by)).cast("decimal(20,0)")
    top = F.lit(str(1 << 64)).cast("decimal(38,0)")
    rows = obs(spark, d).select(
        "event_id", F.pmod((times("event_id", 6364136223846793005) + times("amount", 1442695040888963407)).cast("decimal(38,0)"), top).alias("q"),
        F.pmod((times("amount", 11400714819323198485) + 1).cast("decimal(38,0)"), top).alias("vb"), F.pmod((times("event_id", 2862933555777941757) + 7).cast("decimal(38,0)"), F.lit(str(1 << 62)).cast("decimal(38,0)")).alias("vq"),
    )
    q, vb, vq, p, c = F.col("q"), F.col("vb"), F.col("vq"), F.lit(95), F.lit(30)
    rows = rows.withColumns({"b": trips.quote_buy(q, vb, vq, sc.floordiv(vb, F.lit(2)), F.lit(0), p, c), "s": trips.quote_sell(q, vb, vq, sc.floordiv(vq, F.lit(3)), p, c)})
    text = lambda x, name: x.cast("string").alias(name)
    cap = sc.market_cap(vq, vb, q + 1_000_000_000_000)
    return rows.select("event_id", text(F.col("b.net"), "net"), text(F.col("b.out"), "bought"), F.col("b.error").alias("buy_error"), text(F.col("s.out"), "received"), F.col("s.error").alias("sell_error"), text(trips.quote_xyk(q, vb, vq, c), "swapped"), text(cap, "cap"))


COPIES = PAIRED + """, st AS (SELECT mint, slot, 30000 + arg_max(amount, event_id) AS vq, arg_max(amount, event_id) AS rq FROM obs WHERE mint % 5 <> 0 GROUP BY 1, 2),
b AS (SELECT p.*, st.vq, (buy_sol + buy_p + buy_c) AS gross, (buy_sol + buy_p + buy_c) * 10000 // 10125 AS first FROM paired p LEFT JOIN st ON st.mint = p.mint AND st.slot = p.buy_slot AND reason = 'PAIRED'),
b2 AS (SELECT *, (first * 95 + 9999) // 10000 + (first * 30 + 9999) // 10000 AS fees FROM b), b3 AS (SELECT *, first - greatest(0, first + fees - gross) AS net FROM b2),
b4 AS (SELECT *, CASE WHEN reason = 'PAIRED' AND vq IS NOT NULL AND net > 0 THEN CAST(1000000 AS BIGINT) * net // (vq + net) END AS made FROM b3),
b5 AS (SELECT *, CASE WHEN made > 0 AND made <= 250000 THEN made END AS tokens FROM b4),
c AS (SELECT b5.*, st.vq AS svq, st.rq AS srq, st.vq * tokens // (1000000 + tokens) AS sgross FROM b5 LEFT JOIN st ON st.mint = b5.mint AND st.slot = b5.sell_slot),
c2 AS (SELECT *, (sgross * 95 + 9999) // 10000 + (sgross * 30 + 9999) // 10000 AS sfees FROM c),
copies AS (SELECT *, net + fees + 5000 AS cost, CASE WHEN tokens IS NOT NULL AND svq IS NOT NULL AND sgross > 0 AND sgross <= srq AND sfees < sgross THEN sgross - sfees - 7 END AS proceeds FROM c2),
positions AS (SELECT signer, mint, CAST(tokens AS BIGINT) AS tokens, CASE WHEN tokens IS NOT NULL THEN CAST(cost AS BIGINT) END AS cost, CAST(proceeds AS BIGINT) AS proceeds,
    CASE WHEN reason <> 'PAIRED' THEN 'EXCLUDED' WHEN vq IS NULL THEN 'EXCLUDED_MISSING_STATE' WHEN tokens IS NULL THEN 'REJECTED_ENTRY' WHEN proceeds IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status FROM copies)"""


def _copies(spark, d):
    last = aggs.last_state(obs(spark, d).where("mint % 5 <> 0"), ["mint", "slot"], ["event_id", "amount"], ["event_id"])
    a = F.col("amount")
    states = last.select("mint", "slot", F.lit(1_000_000).alias("virtual_base"), (a + 30_000).alias("virtual_quote"), F.lit(250_000).alias("real_base"), a.alias("real_quote"), F.col("event_id").alias("last_transaction_index"), F.array(F.lit(0)).alias("last_absolute_path"))
    paired = _pairs(spark, d)
    per_mint = states.select(*states.columns)
    return trips.copy_next_slot(paired.withColumn("mint", F.col("mint")), per_mint, ("mint",), exit_fee=7)


@query("t06_copy_next_slot", f"WITH {COPIES} SELECT * FROM positions")
def _(spark, d):
    return _copies(spark, d).select("signer", "mint", *[F.col(c).cast("long").alias(c) for c in ("tokens", "cost", "proceeds")], "status")


@query("t07_copy_summary", f"WITH {COPIES} SELECT count(*) FILTER (status = 'CLOSED') AS closed, count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (status = 'REJECTED_ENTRY') AS rejected, CAST(coalesce(sum(proceeds - cost) FILTER (status = 'CLOSED'), 0) AS BIGINT) AS closed_pnl, CAST(coalesce(sum(proceeds - cost) FILTER (status = 'CLOSED'), 0) - coalesce(sum(cost) FILTER (status = 'OPEN'), 0) AS BIGINT) AS cash FROM positions")
def _(spark, d):
    return trips.copy_summary(_copies(spark, d)).select("closed", "open", "rejected", *[F.col(c).cast("long").alias(c) for c in ("closed_pnl", "cash")])


@query("b11_classify_launches", f"""WITH {OBS}, l AS (SELECT event_id, mint, slot, amount, count(*) OVER (PARTITION BY mint, slot) AS n FROM obs WHERE side = 'signup'),
    c AS (SELECT event_id, CASE WHEN amount % 11 = 0 THEN 'QUOTE_ASSET' WHEN n > 1 THEN 'SECOND_IN_TRANSACTION' WHEN mint % 5 = 0 THEN 'MAYHEM' WHEN mint % 2 = 1 AND amount % 3 = 0 THEN 'MODE' END AS reason, CASE WHEN mint % 2 = 0 THEN CASE WHEN amount % 3 = 0 THEN 'CASHBACK' ELSE 'TOKEN_2022' END WHEN amount % 3 <> 0 THEN 'NORMAL' END AS mode FROM l)
    SELECT event_id, CASE WHEN reason IS NULL THEN 'ELIGIBLE' WHEN reason = 'MAYHEM' THEN 'EXCLUDED' ELSE 'INVALID' END AS class, reason, CASE WHEN reason IS NULL THEN mode END AS mode FROM c""")
def _(spark, d):
    a, m = F.col("amount"), F.col("mint")
    rows = obs(spark, d).where(side("signup")).select("event_id", "mint", "slot", (a % 11 != 0).alias("sol"), (m % 5 == 0).alias("mayhem"), F.when(m % 2 == 0, "NEW").otherwise("OLD").alias("program"), (a % 3 == 0).alias("cashback"))
    out = filters.classify_launches(rows, ["mint", "slot"], F.col("sol"), "mayhem", "program", "cashback", "NEW")
    return out.select("event_id", "class", "reason", "mode")


@query("t13_launch_trips", f"""WITH RECURSIVE {OBS}, {DAYS}, l AS (SELECT event_id AS id, signer AS developer, mint, slot, 10957 + slot - 473300 AS block, t FROM obs WHERE side = 'signup'),
    r AS (SELECT *, row_number() OVER (PARTITION BY developer ORDER BY t, block, id) AS i FROM l),
    w AS (SELECT id, developer, i, t AS last, true AS accepted FROM r WHERE i = 1 UNION ALL SELECT r.id, r.developer, r.i, CASE WHEN r.t - w.last >= 7200 THEN r.t ELSE w.last END, r.t - w.last >= 7200 FROM w JOIN r ON r.developer = w.developer AND r.i = w.i + 1),
    bought AS (SELECT l.*, c.block AS buy_block, l.g - c.prefix AS buy_tx, c.time AS buy_time FROM (SELECT l.*, prefix + 1 + 50 AS g FROM l LEFT JOIN clock USING (block)) l LEFT JOIN clock c ON g >= c.prefix AND g < c.prefix + c.tx_count),
    decided AS (SELECT b.*, (SELECT min(block) FROM clock c WHERE c.block > b.buy_block AND c.time >= b.buy_time + 100000 AND c.tx_count > 0) AS d_block FROM bought b),
    sold AS (SELECT x.*, c.block AS sell_block, x.h - c.prefix AS sell_tx FROM (SELECT d.*, prefix + 50 AS h FROM decided d LEFT JOIN clock c ON c.block = d.d_block) x LEFT JOIN clock c ON h >= c.prefix AND h < c.prefix + c.tx_count),
    states AS (SELECT mint, 10957 + slot - 473300 AS block, arg_max(amount, (t, event_id)) AS q FROM obs WHERE side = 'view' GROUP BY 1, 2),
    priced AS (SELECT s.*, b.q AS bq FROM sold s ASOF LEFT JOIN states b ON s.mint = b.mint AND s.buy_block >= b.block),
    priced2 AS (SELECT p.*, b.q AS sq FROM priced p ASOF LEFT JOIN states b ON p.mint = b.mint AND p.sell_block >= b.block),
    made AS (SELECT *, CASE WHEN accepted AND buy_block IS NOT NULL AND bq IS NOT NULL THEN CAST(1000000 AS BIGINT) * 9876 // (30000 + bq + 9876) END AS tokens FROM priced2 JOIN w USING (id)),
    gross AS (SELECT *, CASE WHEN sell_block IS NOT NULL AND sq IS NOT NULL THEN (30000 + sq) * tokens // (1000000 + tokens) END AS g2 FROM made), fin AS (SELECT *, CASE WHEN g2 <= sq + 5000 THEN g2 - (g2 * 95 + 9999) // 10000 - (g2 * 30 + 9999) // 10000 END AS proceeds FROM gross)
    SELECT id, CASE WHEN NOT accepted THEN 'COOLDOWN_SUPPRESSED' WHEN buy_block IS NULL THEN 'NO_BUY_TAIL' WHEN tokens IS NULL THEN 'BUY_REJECTED' WHEN sell_block IS NULL THEN 'NO_SELL_TAIL' WHEN proceeds IS NULL THEN 'SELL_REJECTED_OPEN' ELSE 'CLOSED' END AS status,
    buy_block, buy_tx, sell_block, sell_tx, tokens, CAST(proceeds AS BIGINT) AS proceeds FROM fin""")
def _(spark, d):
    o = obs(spark, d).withColumn("block", F.col("slot") - 473_300 + 10_957)
    launches = o.where(side("signup")).select(F.col("event_id").alias("id"), F.col("signer").alias("developer"), "mint", "block", F.lit(1).cast("long").alias("tx"), F.col("t").alias("time"))
    states = aggs.last_state(o.where(side("view")), ["mint", "block"], ["amount"], ["t", "event_id"])
    a = F.col("amount")
    states = states.select("mint", sc.boundary(F.col("block"), F.lit(-1)).alias("at"), F.lit(1_000_000).alias("virtual_base"), (a + 30_000).alias("virtual_quote"), F.lit(900_000).alias("real_base"), (a + 5000).alias("real_quote"))
    out = trips.launch_trips(launches, clock(spark, d), states, 10_000, 7200, 50, 100_000, 50)
    return out.select("id", "status", "buy_block", "buy_tx", "sell_block", "sell_tx", F.col("tokens").cast("long").alias("tokens"), F.col("proceeds").cast("long").alias("proceeds"))

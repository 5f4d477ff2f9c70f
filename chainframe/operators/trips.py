"""Trades as positions: pairing, quotes, exits, results, postings. Every position has a budget of its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.functions.scalar import MONEY, U64_MASK, boundary, ceil_fee, ints, min_output, over, u64, wholes
from chainframe.operators.aggs import cooldown, with_group_counts
from chainframe.operators.clocks import walk
from chainframe.operators.joins import asof, first_at_or_after, nth_after
from chainframe.sources.tables import checkpoint


#: What identifies a place in the chain, in this order.
PLACE = ("slot", "transaction_index", "absolute_path")
#: Columns of a leg that a pair carries on as buy_* and sell_*.
LEG = (*PLACE, "signature", "user", "fee_payer", "fee_lamports", "token_amount", "sol_amount", "protocol_fee", "creator_fee", "protocol_fee_bps", "creator_fee_bps", "mayhem_mode", "cashback", "cashback_fee_bps")


def pair_round_trips(trades: DataFrame, start: int, end: int, keys: Sequence[str] = ("mint",), excluded: DataFrame | None = None, fee_bps: tuple[int, int] = (95, 30)) -> DataFrame:
    """For each key its one buy at start <= block_time < end and its one later full sale, or the first reason why there is none.

    ``trades`` has the keys, block_time, is_buy and the columns of LEG; ``excluded`` has keys that take no part. Only trades after
    the buy are looked at for the sale; what came before it doesn't count. Result: keys, reason (PAIRED if none applies),
    buy_* and sell_* of PAIRED rows and of those whose buy or sale is known. A rule that a null leaves open counts as broken.

    Two aggregations by key with partial sums, so one key may hold any share of the rows.
    """
    names = list(keys)
    place = F.struct(*PLACE)
    entry = F.col("is_buy") & (F.col("block_time") >= start) & (F.col("block_time") < end)
    legs = F.struct(*[F.col(c) for c in LEG])
    entries = trades.groupBy(*names).agg(F.count_if(entry).alias("_entries"), F.min(F.when(entry, legs)).alias("_buy"))
    first = entries.select(*[F.col(k).alias(f"_{k}") for k in names], F.when(F.col("_entries") == 1, F.struct(*[F.col(f"_buy.{c}") for c in PLACE])).alias("_at"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]
    later = trades.join(first, on).where(place > F.col("_at"))
    after = later.groupBy(*[f"_{k}" for k in names]).agg(F.count_if(~F.col("is_buy")).alias("_sells"), F.count_if("is_buy").alias("_more"), F.min(F.when(~F.col("is_buy"), legs)).alias("_sell"))
    out = entries.join(after, on, "left").drop(*[f"_{k}" for k in names])
    if excluded is not None:
        gone = excluded.select(*[F.col(k).alias(f"_{k}") for k in names]).distinct().withColumn("_gone", F.lit(True))
        out = out.join(gone, on, "left").drop(*[f"_{k}" for k in names])
    else:
        out = out.withColumn("_gone", F.lit(None).cast("boolean"))
    buy, sell = (lambda c: F.col(f"_buy.{c}")), (lambda c: F.col(f"_sell.{c}"))
    either = lambda test: test(buy) | test(sell)
    paid = lambda leg, fee: leg(fee) == ceil_fee(leg("sol_amount"), leg(f"{fee}_bps"))
    # The names of the reasons, in the order in which they are looked at.
    rules = {
        "explicitly_excluded_mint": F.col("_gone").isNotNull(),
        "no_entry_in_window": F.col("_entries") == 0,
        "multiple_entries": F.col("_entries") > 1,
        "not_one_buy_one_sell": ~F.coalesce((F.col("_sells") == 1) & (F.col("_more") == 0), F.lit(False)),
        "same_slot_roundtrip": sell("slot") <= buy("slot"),
        "not_full_leader_exit": buy("token_amount") != sell("token_amount"),
        "unsupported_mayhem_or_cashback": either(lambda leg: leg("mayhem_mode") | (leg("cashback") != 0) | (leg("cashback_fee_bps") != 0)),
        "zero_amount": either(lambda leg: (leg("token_amount") == 0) | (leg("sol_amount") == 0)),
        "unsupported_fee_profile": either(lambda leg: (leg("protocol_fee_bps") != fee_bps[0]) | (leg("creator_fee_bps") != fee_bps[1])),
        "fee_amount_does_not_match_model": either(lambda leg: ~(paid(leg, "protocol_fee") & paid(leg, "creator_fee"))),
    }
    reason = None
    for name, broken in rules.items():
        broken = F.coalesce(broken, F.lit(True))
        reason = F.when(broken, name) if reason is None else reason.when(broken, name)
    out = out.withColumn("reason", reason.otherwise("PAIRED"))
    known = F.col("_entries") == 1
    return out.select(*names, "reason", *[F.when(known, buy(c)).alias(f"buy_{c}") for c in LEG], *[F.when(known & (F.col("_sells") == 1), sell(c)).alias(f"sell_{c}") for c in LEG])


def leader_pnl(pairs: DataFrame, keys: Sequence[str] = ("mint",)) -> DataFrame:
    """Gross buy, network fees and observed result of each PAIRED row: keys, gross_buy, network_fees, pnl.

    A signature's fee counts once among all pairs, on its first leg in the order of the buys, and not at all if
    another account than the trader has paid it. Null keys and signatures count as values of their own: legs without a signature share one.
    A payer or trader that isn't known has paid nothing.
    """
    names = list(keys)
    good = pairs.where("reason = 'PAIRED'")
    leg = lambda side, n: F.struct(F.lit(n).alias("leg"), *[F.col(f"{side}_{c}").alias(c) for c in ("signature", "user", "fee_payer", "fee_lamports")])
    order = F.struct(*[F.col(f"buy_{c}").alias(c) for c in PLACE], *keys)
    legs = good.select(*keys, order.alias("_order"), F.explode(F.array(leg("buy", 0), leg("sell", 1))).alias("x")).select(*keys, F.struct("_order", "x.leg").alias("_at"), "x.*")
    first = legs.groupBy("signature").agg(F.min("_at").alias("_first")).withColumnRenamed("signature", "_signature")
    legs = legs.join(first, F.col("signature").eqNullSafe(F.col("_signature")))
    fee = F.when(F.col("_at").eqNullSafe(F.col("_first")) & (F.col("fee_payer") == F.col("user")), F.col("fee_lamports")).otherwise(0)
    fees = legs.groupBy(*names).agg(F.sum(fee).alias("network_fees")).withColumnsRenamed({k: f"_{k}" for k in names})
    gross = F.col("buy_sol_amount") + F.col("buy_protocol_fee") + F.col("buy_creator_fee")
    net = F.col("sell_sol_amount") - F.col("sell_protocol_fee") - F.col("sell_creator_fee")
    return good.join(fees, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]).select(*names, gross.alias("gross_buy"), "network_fees", (net - gross - F.col("network_fees")).alias("pnl"))


def _fee(amount: int, bps: int) -> int | None:
    fee = -(-amount * bps // 10_000)
    return fee if fee < 10**38 else None


def _buy(q, vb, vq, rb, rq, p, c, less):
    """quote_buy() of one row: net, both fees, spent, out, error."""
    if q is None or p is None or c is None or p + c <= -10_000:
        return None, None, None, None, None, "ARITHMETIC_OVERFLOW" if q else "INVALID_INPUT"
    first = q * 10_000 // (10_000 + p + c)
    protocol, creator = _fee(first, p), _fee(first, c)
    net = first - max(first + protocol + creator - q, 0)
    curve, out = net - less, None
    if q <= 0:
        error = "INVALID_INPUT"
    elif curve <= 0:
        error = "OUTPUT_OUT_OF_BOUNDS"
    elif vq is None or vq + net > U64_MASK or (rq is not None and rq + net > U64_MASK) or (out := over(curve, vb, vq + curve)) is None:
        error = "ARITHMETIC_OVERFLOW"
    elif out <= 0 or out >= vb:
        error = "OUTPUT_OUT_OF_BOUNDS"
    else:
        error = "INSUFFICIENT_REAL_TOKEN_RESERVES" if rb is not None and out > rb else None
    return net, protocol, creator, net + protocol + creator, None if error else out, error


def _sell(b, vb, vq, rq, rb, p, c, capped):
    """quote_sell() of one row: gross, both fees, out, shortfall, error."""
    gross = over(b, vq, vb + b) if b and vb is not None else None
    protocol, creator = (None if gross is None or x is None else _fee(gross, x) for x in (p, c))
    short = None if gross is None or rq is None else max(gross - rq, 0)
    fees = None if protocol is None or creator is None else protocol + creator
    if not b:
        error = "INVALID_INPUT"
    elif (vb is not None and vb + b > U64_MASK) or (rb is not None and rb + b > U64_MASK) or gross is None:
        error = "ARITHMETIC_OVERFLOW"
    elif gross <= 0 or gross >= vq:
        error = "OUTPUT_OUT_OF_BOUNDS"
    elif capped and short:
        error = "INSUFFICIENT_REAL_SOL_RESERVES"
    else:
        error = "OUTPUT_OUT_OF_BOUNDS" if fees is not None and fees >= gross else None
    return gross, protocol, creator, None if error or fees is None else gross - fees, short, error


def _xyk(a, into, out_of, bps):
    if a is None or into is None or bps is None:
        return None
    net = a - a * bps // 10_000
    return over(net, out_of, into + net)


def _quotes(rule: Callable, amounts: Sequence[str], last: int) -> Callable:
    """A column function of a rule that gives ``amounts`` and an error; Python's integers hold its products of 128 bits, which no DECIMAL does."""

    @F.arrow_udf(T.StructType([*(T.StructField(x, T.DecimalType(38, 0)) for x in amounts), T.StructField("error", T.StringType())]))
    def quotes(*columns: pa.Array) -> pa.Array:
        rows = [rule(*x, last) for x in zip(*map(ints, columns), strict=True)]
        *numbers, errors = zip(*rows, strict=True) if rows else [()] * (len(amounts) + 1)
        return pa.StructArray.from_arrays([*map(wholes, numbers), pa.array(errors, pa.string())], [*amounts, "error"])

    return quotes


@F.arrow_udf(T.DecimalType(38, 0))
def _swaps(a: pa.Array, into: pa.Array, out_of: pa.Array, bps: pa.Array) -> pa.Array:
    return wholes(list(map(_xyk, ints(a), ints(into), ints(out_of), ints(bps))))


def _rate(bps: Column) -> Column:
    return bps.cast("decimal(10,0)").cast("long")


def quote_buy(gross: Column, virtual_base: Column, virtual_quote: Column, real_base: Column, real_quote: Column, protocol_bps: Column, creator_bps: Column, exact_gross: bool = False) -> Column:
    """(net, protocol_fee, creator_fee, spent, out, error) of spending ``gross`` at most.

    net is gross * 10000 // (10000 + both rates); each fee is rounded up by itself, and what the two round-ups come to beyond
    the budget is taken off net. With exact_gross the curve gets one unit less than net. An error leaves out null:
    INVALID_INPUT (null, not positive or over 64 bits), OUTPUT_OUT_OF_BOUNDS, INSUFFICIENT_REAL_TOKEN_RESERVES, ARITHMETIC_OVERFLOW (a reserve is unknown,
    or it passes 64 bits with net). Amounts and reserves are exact over all 64 bits.
    """
    quotes = _quotes(_buy, ("net", "protocol_fee", "creator_fee", "spent", "out"), int(exact_gross))
    return quotes(u64(gross), *[x.cast(MONEY) for x in (virtual_base, virtual_quote, real_base, real_quote)], _rate(protocol_bps), _rate(creator_bps))


def quote_sell(base_in: Column, virtual_base: Column, virtual_quote: Column, real_quote: Column, protocol_bps: Column, creator_bps: Column, capped: bool = True, real_base: Column | None = None) -> Column:
    """(gross, protocol_fee, creator_fee, out, shortfall, error) of selling base_in; each fee is rounded up by itself.

    shortfall is what the pool lacks of gross. Capped, a shortfall is an error: INSUFFICIENT_REAL_SOL_RESERVES; the
    others are INVALID_INPUT (null, not positive or over 64 bits), OUTPUT_OUT_OF_BOUNDS and ARITHMETIC_OVERFLOW (a reserve is unknown, or the virtual or the real one of tokens passes
    64 bits with base_in; the real one is looked at where it is given). An error leaves out null. Amounts and reserves are exact over all 64 bits.
    """
    quotes = _quotes(_sell, ("gross", "protocol_fee", "creator_fee", "out", "shortfall"), int(capped))
    reserves = virtual_base, virtual_quote, real_quote, F.lit(None) if real_base is None else real_base
    return quotes(u64(base_in), *[x.cast(MONEY) for x in reserves], _rate(protocol_bps), _rate(creator_bps))


def quote_xyk(amount_in: Column, reserve_in: Column, reserve_out: Column, fee_bps: Column) -> Column:
    """Output of a constant-product pool; the fee is taken from the input, rounded down. Exact over all 64 bits; null where an operand isn't a 64-bit number."""
    return _swaps(u64(amount_in), reserve_in.cast(MONEY), u64(reserve_out), _rate(fee_bps))


def copy_next_slot(pairs: DataFrame, states: DataFrame, keys: Sequence[str] = ("mint",), fee_bps: tuple[int, int] = (95, 30), entry_fee: int | None = None, exit_fee: int | None = None) -> DataFrame:
    """Each PAIRED row copied one slot later, both legs priced by the state at the end of the signal's slot.

    ``states``: keys, slot, virtual_base, virtual_quote, real_base, real_quote, last_transaction_index, last_absolute_path; one row a key and slot.
    The budget is the leader's gross buy, of each position by itself; there is no shared wallet. Network fees are those given, else the signal's.

    Adds status: EXCLUDED (not paired), EXCLUDED_MISSING_STATE, REJECTED_ENTRY, OPEN (tokens that could not be sold keep their
    cost) or CLOSED, with entry_failure and exit_failure, tokens, remaining, cost, proceeds, pnl. STALE_STATE in a failure says that the state is older than its signal.
    """
    out = pairs
    for side in ("buy", "sell"):
        named = states.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slot").alias("_slot"), F.struct(*[c for c in states.columns if c not in (*keys, "slot")]).alias(f"_{side}"))
        out = out.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(f"{side}_slot") == F.col("_slot")], "left").drop("_slot", *[f"_{k}" for k in keys])
    paired, protocol, creator = F.col("reason") == "PAIRED", F.lit(fee_bps[0]), F.lit(fee_bps[1])
    of = lambda side: (lambda c: F.col(f"_{side}.{c}"))
    buy, sell = of("buy"), of("sell")
    stale = lambda side, x: F.struct(x("last_transaction_index"), x("last_absolute_path")) < F.struct(f"{side}_transaction_index", f"{side}_absolute_path")
    gross = F.col("buy_sol_amount") + F.col("buy_protocol_fee") + F.col("buy_creator_fee")
    out = out.withColumn("_q", quote_buy(gross, buy("virtual_base"), buy("virtual_quote"), buy("real_base"), buy("real_quote"), protocol, creator))
    entry = F.when(~paired, None).when(F.col("_buy").isNull(), "MISSING_END_OF_SLOT_STATE").when(stale("buy", buy), "STALE_STATE").otherwise(F.col("_q.error"))
    fee = lambda side, given: F.col(f"{side}_fee_lamports") if given is None else F.lit(given)
    out = out.withColumn("entry_failure", entry)
    filled = paired & F.col("entry_failure").isNull()
    out = out.withColumn("tokens", F.when(filled, F.col("_q.out"))).withColumn("cost", F.when(filled, F.col("_q.spent") + fee("buy", entry_fee)))
    out = out.withColumn("_q", quote_sell(F.col("tokens"), sell("virtual_base"), sell("virtual_quote"), sell("real_quote"), protocol, creator))
    out = out.withColumn("exit_failure", F.when(~filled, None).when(F.col("_sell").isNull(), "MISSING_END_OF_SLOT_STATE").when(stale("sell", sell), "STALE_STATE").otherwise(F.col("_q.error")))
    closed = filled & F.col("exit_failure").isNull()
    out = out.withColumn("proceeds", F.when(closed, F.col("_q.out") - fee("sell", exit_fee)))
    status = F.when(~paired, "EXCLUDED").when(F.col("entry_failure") == "MISSING_END_OF_SLOT_STATE", "EXCLUDED_MISSING_STATE").when(~filled, "REJECTED_ENTRY").when(closed, "CLOSED").otherwise("OPEN")
    out = out.withColumns({"status": status, "remaining": F.when(closed, F.lit(0).cast(MONEY)).otherwise(F.col("tokens")), "pnl": F.col("proceeds") - F.col("cost"), "model": F.lit("budget per position")})
    return out.drop("_q", "_buy", "_sell")


def copy_summary(positions: DataFrame) -> DataFrame:
    """Counts, closed result, cost of what is open, and the cash that they come to: closed_pnl - open_cost."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    zero = F.lit(0).cast(MONEY)
    out = positions.agg(
        n("CLOSED").alias("closed"), n("OPEN").alias("open"), n("REJECTED_ENTRY").alias("rejected"), n("EXCLUDED", "EXCLUDED_MISSING_STATE").alias("excluded"),
        F.coalesce(F.sum(F.when(F.col("status") == "CLOSED", F.col("pnl"))), zero).alias("closed_pnl"), F.coalesce(F.sum(F.when(F.col("status") == "OPEN", F.col("cost"))), zero).alias("open_cost"),
    )
    return out.withColumn("cash", F.col("closed_pnl") - F.col("open_cost"))


def first_exit(positions: DataFrame, states: DataFrame, keys: Sequence[str], entry_at: str, deadline: str, at: str, price: str, entry_price: str, loss_bps: int, gain_bps: int, row_id: str, span: int = 3600) -> DataFrame:
    """The first state from the fill up to the deadline at which the loss or gain is reached, else DEADLINE: exit_at, exit_reason.

    A state at the place of the fill itself counts: at_fill tells that the sale then follows one transaction later. The loss goes
    before the gain, both before the deadline. A null key, price or entry price reaches nothing; row_id names a position.

    Positions meet the least and greatest price of each span of time that they are open in. A span whose prices reach neither threshold is skipped;
    of the whole ones only the first that does is opened, besides the spans of the fill and of the deadline, which a position sees in part. So the
    rows that meet grow with positions times spans, and with the states of three spans a position at most.
    """
    p = F.col(price).cast("decimal(18,0)") * 10_000
    loss, gain = (F.col("_e") * (10_000 - loss_bps)), (F.col("_e") * (10_000 + gain_bps))
    rows = states.select(*keys, F.col(at).alias("_at"), p.alias("_p"), F.floor(F.col(at) / span).alias("_span"))
    asked = positions.where(F.col(entry_at) <= F.col(deadline)).select(F.col(row_id).alias("_row"), *keys, F.col(entry_price).cast("decimal(18,0)").alias("_e"), F.col(entry_at).alias("_from"), F.col(deadline).alias("_to"))
    asked = asked.withColumns({"_first": F.floor(F.col("_from") / span), "_last": F.floor(F.col("_to") / span)})
    known = rows.groupBy(*keys, "_span").agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    met = asked.withColumn("_span", F.explode(F.sequence("_first", "_last"))).join(known, [*keys, "_span"]).where((F.col("_lo") <= loss) | (F.col("_hi") >= gain))
    end = (F.col("_span") == F.col("_first")) | (F.col("_span") == F.col("_last"))
    whole = met.where(~end).groupBy("_row").agg(F.min("_span").alias("_span"))
    opened = met.where(end).union(met.join(whole, ["_row", "_span"], "left_semi").select(met.columns))
    reached = F.when(F.col("_p") <= loss, "STOP_LOSS").when(F.col("_p") >= gain, "TAKE_PROFIT")
    found = opened.select("_row", *keys, "_span", "_e", "_from", "_to").join(rows, [*keys, "_span"]).where((F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to")) & reached.isNotNull())
    first = found.groupBy("_row").agg(F.min(F.struct(F.col("_at").alias("exit_at"), reached.alias("exit_reason"))).alias("_x")).select(F.col("_row").alias(row_id), "_x.*")
    out = positions.join(first, row_id, "left")
    out = out.withColumns({"exit_at": F.coalesce("exit_at", deadline), "exit_reason": F.coalesce("exit_reason", F.lit("DEADLINE"))})
    return out.withColumn("at_fill", (F.col("exit_at") == F.col(entry_at)) & (F.col("exit_reason") != "DEADLINE"))


def launch_trips(launches: DataFrame, clock: DataFrame, states: DataFrame, budget: int, seconds: int = 600, buy_delay: int = 500, sell_delay_s: int = 2, sell_delay: int = 500, fee_bps: tuple[int, int] = (95, 30)) -> DataFrame:
    """Round trips on launches: id, status, buy and sell places, tokens, proceeds, pnl.

    A developer's launch within ``seconds`` of an accepted one is COOLDOWN_SUPPRESSED. An accepted one is bought ``buy_delay`` transactions
    later; ``sell_delay_s`` after that fill the sale is decided at the first transaction by then, and it lands ``sell_delay`` transactions after the decision.
    Each is priced by the last state of the mint at or before its place. Other status: NO_BUY_TAIL and NO_SELL_TAIL (the clock ends
    before), BUY_REJECTED, SELL_REJECTED_OPEN, CLOSED.

    ``launches``: id, developer, mint, block, tx, time. ``clock``: block, tx_count, time, prefix. ``states``: mint, at (see boundary()),
    virtual_base, virtual_quote, real_base, real_quote; places are unique in a mint.
    """
    known = cooldown(launches, ["developer"], "time", ["block", "tx", "id"], seconds)
    times = clock.select(F.col("block").alias("buy_block"), F.col("time").alias("_time"))
    rows = nth_after(known, clock, buy_delay).withColumnsRenamed({"to_block": "buy_block", "to_tx": "buy_tx"})
    rows = rows.join(times, "buy_block", "left").withColumn("_due", F.col("_time") + sell_delay_s)
    place = rows.select("id", F.col("buy_block").alias("block"), "_due").where("block is not null")
    decided = first_at_or_after(place, clock, "_due").select("id", F.col("to_block").alias("block"), F.lit(0).cast("long").alias("tx")).where("block is not null")
    sold = nth_after(decided, clock, sell_delay).select("id", F.col("to_block").alias("sell_block"), F.col("to_tx").alias("sell_tx"))
    rows = rows.join(sold, "id", "left")
    take = ["virtual_base", "virtual_quote", "real_base", "real_quote"]
    for side in ("buy", "sell"):
        rows = rows.withColumn(f"_{side}_at", boundary(F.col(f"{side}_block"), F.col(f"{side}_tx")))
        rows = asof(rows, states.select("mint", F.col("at").alias("_s"), F.struct(*take).alias(f"_{side}")), ["mint"], f"_{side}_at", "_s", [f"_{side}"])
    protocol, creator = F.lit(fee_bps[0]), F.lit(fee_bps[1])
    of = lambda side: (lambda c: F.col(f"_{side}.{c}"))
    buy, sell = of("buy"), of("sell")
    rows = rows.withColumn("_b", quote_buy(F.lit(budget), buy("virtual_base"), buy("virtual_quote"), buy("real_base"), buy("real_quote"), protocol, creator))
    go = F.col("accepted") & F.col("buy_block").isNotNull()
    rows = rows.withColumn("tokens", F.when(go & F.col("_buy").isNotNull(), F.col("_b.out")))
    rows = rows.withColumn("_s", quote_sell(F.col("tokens"), sell("virtual_base"), sell("virtual_quote"), sell("real_quote"), protocol, creator))
    held = F.col("tokens").isNotNull()
    rows = rows.withColumn("proceeds", F.when(held & F.col("sell_block").isNotNull() & F.col("_sell").isNotNull(), F.col("_s.out")))
    status = F.when(~F.col("accepted"), "COOLDOWN_SUPPRESSED").when(F.col("buy_block").isNull(), "NO_BUY_TAIL").when(~held, "BUY_REJECTED").when(F.col("sell_block").isNull(), "NO_SELL_TAIL").when(F.col("proceeds").isNull(), "SELL_REJECTED_OPEN").otherwise("CLOSED")
    return rows.select("id", status.alias("status"), "buy_block", "buy_tx", "sell_block", "sell_tx", "tokens", "proceeds", (F.col("proceeds") - F.col("_b.spent")).alias("pnl"))


def retry_sells(positions: DataFrame, states: DataFrame, keys: Sequence[str], at: str, state_at: str, price: str, delay: int, wait: int, slippage_bps: int, attempts: int = 4) -> DataFrame:
    """Up to ``attempts`` sales: attempt (null if none went through), fill_price, filled_at.

    Each is quoted by the last state at its decision and lands ``delay`` later, where it goes through if the last state by then gives at
    least the quote less the slippage, rounded down. Without a state to quote by nothing is sent, which counts as an attempt. The next decision
    is ``wait`` after the failure: the landing, or the decision where nothing was sent. States are one a key and place.
    """
    out = positions.withColumns({"attempt": F.lit(None).cast("int"), "fill_price": F.lit(None).cast(states.schema[price].dataType), "filled_at": F.lit(None).cast("long"), "_at": F.col(at).cast("long")})
    last = lambda rows, on, name: asof(rows, states.select(*keys, F.col(state_at).alias("_s"), F.col(price).alias(name)), keys, on, "_s", [name])
    for n in range(1, attempts + 1):
        out = last(out, "_at", "_quote").withColumn("_land", F.col("_at") + delay)
        out = last(out, "_land", "_price")
        now = F.col("attempt").isNull() & (F.col("_price") >= min_output(F.col("_quote"), F.lit(slippage_bps)))
        fresh = {"fill_price": F.when(now, F.col("_price")).otherwise(F.col("fill_price")), "filled_at": F.when(now, F.col("_land")).otherwise(F.col("filled_at")), "attempt": F.when(now, F.lit(n)).otherwise(F.col("attempt"))}
        out = out.withColumns({**fresh, "_at": F.when(F.col("_quote").isNull(), F.col("_at")).otherwise(F.col("_land")) + wait}).drop("_quote", "_price", "_land")
    return out.drop("_at")


def sell_ladder(positions: DataFrame, clock: DataFrame, states: DataFrame, keys: Sequence[str], row_id: str, at: str, price: str, delay: int, wait_s: int, slippage_bps: int, attempts: int = 4) -> DataFrame:
    """Sales by the clock: status, attempts, fill_price, fill_block, fill_tx of each position.

    An attempt is quoted by the key's last state at or before its decision, the first of which is the place (block, tx) of the position, and lands ``delay`` transactions
    later. It goes through if the last state by then gives at least the quote less the slippage, rounded down. Without a quote nothing is sent, which counts as an attempt
    too. The next decision is at the first transaction of the first later block that has one and is ``wait_s`` seconds after the failure: the landing, or the decision where
    nothing was sent. status is CLOSED, EXHAUSTED after ``attempts`` failures, or null where the clock ends before an attempt lands or can be made.

    ``clock`` is that of walk(); ``states`` have the keys, ``at`` (see boundary()), distinct in a key, and ``price``. Each round takes only the positions that are still open: one
    path along the clock and one as-of scan for both places. Null keys meet each other. row_id names a position; a null place has no status.
    """
    known = states.select(*keys, F.col(at).alias("_at"), F.col(price).alias("_state"))
    open_now, done = positions.select(row_id, *keys, F.col("block").cast("long").alias("block"), F.col("tx").cast("long").alias("tx")), None
    kind = states.schema[price].dataType
    for n in range(1, attempts + 1):
        hops = [("transactions", delay)] if n == 1 else [("seconds", wait_s), ("transactions", delay)]
        rows = walk(open_now, clock, hops, row_id)
        first = F.struct("block", "tx") if n == 1 else F.col("places")[0]
        rows = rows.select(row_id, *keys, first.alias("_decided"), F.col("places")[len(hops) - 1].alias("_landed"))
        asked = rows.select(row_id, *keys, F.posexplode(F.array("_decided", "_landed")).alias("_which", "_place")).where("_place is not null")
        priced = asof(asked.withColumn("_on", boundary(F.col("_place.block"), F.col("_place.tx"))), known, keys, "_on", "_at", ["_state"])
        priced = priced.groupBy(row_id).agg(F.max(F.when(F.col("_which") == 0, F.col("_state"))).alias("_quote"), F.max(F.when(F.col("_which") == 1, F.col("_state"))).alias("_price"))
        rows = checkpoint(rows.join(priced, row_id, "left"))
        filled = F.coalesce(F.col("_price") >= min_output(F.col("_quote"), F.lit(slippage_bps)), F.lit(False))
        status = F.when(F.col("_landed").isNull(), None).when(filled, "CLOSED")
        ended = rows.where(F.col("_landed").isNull() | filled) if n < attempts else rows
        if n == attempts:
            status = status.otherwise("EXHAUSTED")
        tried = F.when(F.col("_landed").isNotNull(), n).otherwise(n - 1)
        sold = lambda c: F.when(F.col("_landed").isNotNull() & filled, c)
        ended = ended.select(F.col(row_id).alias("_row"), status.cast("string").alias("status"), tried.alias("attempts"), sold(F.col("_price")).cast(kind).alias("fill_price"), sold(F.col("_landed.block")).alias("fill_block"), sold(F.col("_landed.tx")).alias("fill_tx"))
        done = ended if done is None else done.union(ended)
        if n == attempts:
            break
        failed = F.when(F.col("_quote").isNull(), F.col("_decided")).otherwise(F.col("_landed"))
        open_now = rows.where(F.col("_landed").isNotNull() & ~filled).select(row_id, *keys, failed.alias("_f")).select(row_id, *keys, "_f.block", "_f.tx")
        if open_now.isEmpty():
            break
    return positions.join(done, positions[row_id] == done["_row"], "left").drop("_row")


def settlement(signals: DataFrame, clock: DataFrame, row_id: str, buy_delay: int, hold_s: int, sell_delay: int, observe: int = 0, wait_s: int = 2, attempts: int = 4) -> DataFrame:
    """Adds settled, the place (block, tx) by which each signal is settled on its longest path; null where the clock ends before.

    That path is seen ``observe`` transactions after the signal (at once, if 0), bought ``buy_delay`` later, held for ``hold_s`` seconds, and sold by the last of
    ``attempts`` attempts that each land ``sell_delay`` transactions after their decision, ``wait_s`` seconds apart. One path along the clock.
    """
    sales = [("transactions", sell_delay), *[("seconds", wait_s), ("transactions", sell_delay)] * (attempts - 1)]
    hops = [*([("transactions", observe)] if observe else []), ("transactions", buy_delay), ("seconds", hold_s), *sales]
    return walk(signals, clock, hops, row_id).withColumn("settled", F.element_at("places", -1)).drop("places")


def economics(cash: Column, liquidation: Column, cashback: Column, locked: Column) -> Column:
    """(total, mark): null and UNVALUED as soon as one part isn't known."""
    total = cash + liquidation + cashback + locked
    return F.struct(total.alias("total"), F.when(total.isNull(), "UNVALUED").otherwise("VALUED").alias("mark"))


def attempts(positions: DataFrame, row_id: str, legs: str) -> DataFrame:
    """A row for each leg of each position, numbered, with its state."""
    rows = positions.select(row_id, F.posexplode(legs).alias("leg_no", "leg"))
    state = F.when(F.col("leg.filled"), "FILLED").when(F.col("leg.rejected"), "REJECTED").otherwise("FAILED")
    return rows.select(row_id, "leg_no", "leg.*", state.alias("state"))


def order_lifecycle(audit: DataFrame, order: str, kind: str, decision: str, terminals: Sequence[str], filled: str, fills: DataFrame) -> DataFrame:
    """Orders that break a rule: one decision, one end, a fill exactly if the end says so."""
    seen = audit.groupBy(order).agg(F.count_if(F.col(kind) == decision).alias("decisions"), F.count_if(F.col(kind).isin(list(terminals))).alias("ends"), F.count_if(F.col(kind) == filled).alias("said_filled"))
    got = fills.groupBy(order).agg(F.count(F.lit(1)).alias("fills"))
    out = seen.join(got, order, "full_outer").na.fill(0, ["decisions", "ends", "said_filled", "fills"])
    rule = F.when(F.col("decisions") != 1, "DECISIONS").when(F.col("ends") != 1, "ENDS").when((F.col("said_filled") > 0) != (F.col("fills") == 1), "FILLS")
    return out.withColumn("rule", rule).where("rule is not null")


def slippage(landed: Column, reference: Column) -> Column:
    return F.when(landed > reference, "WORSE").when(landed < reference, "BETTER").when(landed == reference, "SAME")


def to_postings(fills: DataFrame, transaction: str, parts: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """Rows (transaction, account, asset, amount) of every part that isn't zero; parts: name -> (account, asset, amount)."""
    rows = F.explode(F.array(*[F.struct(F.lit(account).alias("account"), F.lit(asset).alias("asset"), amount.alias("amount")) for account, asset, amount in parts.values()])).alias("p")
    return fills.select(transaction, rows).select(transaction, "p.*").where("amount <> 0")


def funding(gross: Column, real: Column) -> Column:
    """(venue, shortfall): what the pool pays, and what it lacks."""
    short = F.greatest(gross - real, F.lit(0))
    return F.struct((gross - short).alias("venue"), short.alias("shortfall"))


def launch_totals(positions: DataFrame, by: Sequence[str], gross: Column, real: Column, landed: Column, reference: Column) -> DataFrame:
    """positions, what venues paid and what they lacked, and how landings compare with their references: worse, better, same."""
    rows = positions.withColumn("_f", funding(gross, real)).withColumn("_slip", slippage(landed, reference))
    n = lambda s: F.count_if(F.col("_slip") == s).alias(s.lower())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("positions"), F.sum("_f.venue").alias("venue"), F.sum("_f.shortfall").alias("shortfall"), n("WORSE"), n("BETTER"), n("SAME"))


def copy_signals(trades: DataFrame, wallets: Sequence, wallet: str, side: str, buy: str, slot: str, lo: int, hi: int, key: str, order: Sequence[str]) -> DataFrame:
    """Buys of the wallets in lo..hi, the first of each key only."""
    some = trades.where(F.col(wallet).isin(list(wallets)) & (F.col(side) == buy) & (F.col(slot) >= lo) & (F.col(slot) < hi))
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def series_window(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark: str, margin: int) -> DataFrame:
    """Points within ``margin`` of the marks of their key, and the last one before them."""
    spans = marks.groupBy(*keys).agg((F.min(mark) - margin).alias("_lo"), (F.max(mark) + margin).alias("_hi"))
    near = points.join(spans, list(keys)).where(F.col(at) <= F.col("_hi"))
    earlier = F.max(F.when(F.col(at) < F.col("_lo"), F.col(at))).over(Window.partitionBy(*keys))
    return near.withColumn("_e", earlier).where((F.col(at) >= F.col("_lo")) | (F.col(at) == F.col("_e"))).drop("_lo", "_hi", "_e")


def one_buy_one_sell(trades: DataFrame, keys: Sequence[str], side: str, buy: str, sell: str) -> DataFrame:
    return with_group_counts(trades, keys, {"n_buys": F.col(side) == buy, "n_sells": F.col(side) == sell}).where("n_buys = 1 and n_sells = 1")


def tail_ok(positions: DataFrame, clock: DataFrame, longest: int, block: str = "block") -> DataFrame:
    """Adds tail: ENOUGH if the longest path of a position stays inside the clock, else SHORT."""
    end = clock.agg(F.max("block").alias("_end"))
    return positions.join(F.broadcast(end)).withColumn("tail", F.when(F.col(block) + longest <= F.col("_end"), "ENOUGH").otherwise("SHORT")).drop("_end")


def check_state_history(events: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, launch: str, pair: str, lifecycle: str | None = None, allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows that break a venue's history: a state before its launch, a second launch, another pair of assets than before, or a
    lifecycle that its kind doesn't allow (``allowed``: kind -> lifecycles; kinds that it doesn't name may have any)."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    launched, first_pair = F.coalesce(F.sum(F.when(F.col(kind) == launch, 1).otherwise(0)).over(so_far), F.lit(0)), F.first(pair).over(so_far)
    rule = F.when((F.col(kind) == launch) & (launched > 0), "SECOND_LAUNCH").when((F.col(kind) != launch) & (launched == 0), "NO_LAUNCH").when(F.col(pair) != first_pair, "OTHER_PAIR")
    for name, lives in (allowed or {}).items():
        rule = rule.when((F.col(kind) == name) & ~F.coalesce(F.col(lifecycle).isin(list(lives)), F.lit(False)), "LIFECYCLE")
    return events.withColumn("rule", rule).where("rule is not null")


def check_observations(rows: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, payload: Sequence[str]) -> DataFrame:
    """Rows that move backward, or repeat a position with another payload; equal repeats are fine."""
    whole = F.struct(*payload)
    place = Window.partitionBy(*keys).orderBy(*order)
    before, content = F.lag(position).over(place), F.lag(whole).over(place)
    rule = F.when(F.col(position) < before, "BACKWARD").when((F.col(position) == before) & (whole != content), "CONFLICT")
    return rows.withColumn("rule", rule).where("rule is not null")


def check_lifecycle(rows: DataFrame, transaction: Sequence[str], kind: str, once: Sequence[str], constants: dict[str, Column] | None = None) -> DataFrame:
    """Transactions with more than one row of a kind that may occur once, or with such a row in which a constant is off: kind, n, off.

    ``constants``: kind -> what must hold of its rows; what a null leaves open doesn't hold.
    """
    off = F.lit(False)
    for name, holds in (constants or {}).items():
        off = off | ((F.col(kind) == name) & ~F.coalesce(holds, F.lit(False)))
    out = rows.where(F.col(kind).isin(list(once))).groupBy(*transaction, kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off"))
    return out.where("n > 1 or off > 0")


def extend_to_end(series: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], end: int) -> DataFrame:
    """The series with its last values once more at ``end`` where it stops before."""
    last = series.groupBy(*keys).agg(F.max(at).alias("_at"), F.max_by(F.struct(*values), at).alias("_v")).where(F.col("_at") < end)
    return series.select(*keys, at, *values).unionByName(last.select(*keys, F.lit(end).cast(series.schema[at].dataType).alias(at), "_v.*"))

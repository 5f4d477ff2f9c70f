"""Round trips, quotes, copies and launches on literal rows, against integer arithmetic."""

import random

import pytest
from pyspark.sql import functions as F

from chainframe.functions import scalar as sc
from chainframe.operators import filters, joins, trips

TYPES = {"mint": "string", "absolute_path": "array<int>", "signature": "string", "user": "string", "fee_payer": "string", "is_buy": "boolean", "mayhem_mode": "boolean"}
BASE = {"slot": 10, "transaction_index": 0, "absolute_path": [0], "block_time": 100, "is_buy": True, "token_amount": 50, "sol_amount": 10_000, "protocol_fee": 95, "creator_fee": 30, "protocol_fee_bps": 95, "creator_fee_bps": 30,
        "mayhem_mode": False, "cashback": 0, "cashback_fee_bps": 0, "signature": "s", "user": "u", "fee_payer": "u", "fee_lamports": 5}


def trades(spark, rows):
    """rows: mint and what differs from BASE; a sale stands in slot 12 unless told otherwise."""
    full = []
    for i, (mint, change) in enumerate(rows):
        row = {**BASE, "signature": f"s{i}", "mint": mint} | ({"slot": 12, "block_time": 102} if change.get("is_buy") is False else {}) | change
        full.append(row)
    names = ["mint", *BASE]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], ", ".join(f"{n} {TYPES.get(n, 'long')}" for n in names))


SELL = {"is_buy": False}
CASES = {
    "PAIRED": [{}, SELL],
    "explicitly_excluded_mint": [{}, SELL],
    "no_entry_in_window": [{"block_time": 300}, SELL],
    "multiple_entries": [{}, {"slot": 11}, SELL],
    "not_one_buy_one_sell": [{}, SELL, {**SELL, "slot": 13}],
    "same_slot_roundtrip": [{}, {**SELL, "slot": 10, "transaction_index": 1}],
    "not_full_leader_exit": [{}, {**SELL, "token_amount": 49}],
    "unsupported_mayhem_or_cashback": [{}, {**SELL, "cashback_fee_bps": 1}],
    "zero_amount": [{"token_amount": 0}, {**SELL, "token_amount": 0}],
    "unsupported_fee_profile": [{"creator_fee_bps": 31}, SELL],
    "fee_amount_does_not_match_model": [{"protocol_fee": 94}, SELL],
}


def test_every_reason_in_its_order(spark):
    rows = [(reason, change) for reason, changes in CASES.items() for change in changes]
    # what stands before the buy doesn't count, and a buy outside the window is no entry, though one after the buy breaks the pair
    rows += [("earlier", {**SELL, "slot": 5}), ("earlier", {}), ("earlier", SELL)]
    rows += [("late buy", {}), ("late buy", {"block_time": 300, "slot": 11}), ("late buy", SELL)]
    rows += [("no sale", {}), ("null flag", {"mayhem_mode": None}), ("null flag", SELL), ("path", {"absolute_path": [4, 6]}), ("path", {**SELL, "slot": 10, "absolute_path": [4, 10]}), (None, {}), (None, SELL)]
    t = trades(spark, rows)
    got = {r.mint: r for r in trips.pair_round_trips(t, 100, 200, excluded=t.where("mint = 'explicitly_excluded_mint'").select("mint")).collect()}
    want = {c: c for c in CASES} | {"earlier": "PAIRED", "late buy": "not_one_buy_one_sell", "no sale": "not_one_buy_one_sell", "null flag": "unsupported_mayhem_or_cashback", "path": "same_slot_roundtrip", None: "PAIRED"}
    assert {m: r.reason for m, r in got.items()} == want
    assert (got["earlier"].buy_slot, got["earlier"].sell_slot) == (10, 12)
    assert trips.pair_round_trips(t.limit(0), 100, 200).count() == 0


def test_a_signatures_fee_counts_once_and_a_sponsored_one_not(spark):
    t = trades(spark, [("a", {"signature": "x"}), ("a", {**SELL, "signature": "y", "fee_payer": "sponsor"}), ("b", {"signature": "x", "slot": 11}), ("b", {**SELL, "signature": "z", "fee_lamports": 8})])
    got = {r.mint: (r.gross_buy, r.network_fees, r.pnl) for r in trips.leader_pnl(trips.pair_round_trips(t, 0, 200)).collect()}
    assert got == {"a": (10_125, 5, -250 - 5), "b": (10_125, 8, -250 - 8)}


def buy(gross, vb, vq, rb, p, c, exact):
    net = gross * 10_000 // (10_000 + p + c)
    pf, cf = -(-net * p // 10_000), -(-net * c // 10_000)
    net -= max(0, net + pf + cf - gross)
    curve = net - exact
    if gross <= 0:
        return None, "INVALID_INPUT"
    if curve <= 0 or curve * vb // (vq + curve) <= 0:
        return None, "OUTPUT_OUT_OF_BOUNDS"
    out = curve * vb // (vq + curve)
    return (None, "INSUFFICIENT_REAL_TOKEN_RESERVES") if out > rb else (out, None)


@pytest.mark.parametrize("exact", [False, True])
def test_buy_quotes_against_whole_numbers(spark, exact):
    r = random.Random(4)
    rows = [(r.choice([0, 1, 2, 7, r.randrange(10**4), r.randrange(10**10)]), r.choice([3, 10**15]), r.choice([1, 30 * 10**9]), r.choice([10**6, 10**15]), r.choice([0, 95, 100]), r.choice([0, 30, 5])) for _ in range(300)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, g long, vb long, vq long, rb long, p long, c long")
    q = trips.quote_buy(F.col("g"), F.col("vb"), F.col("vq"), F.col("rb"), F.lit(0), F.col("p"), F.col("c"), exact)
    got = {x.i: x.q for x in df.select("i", q.alias("q")).collect()}
    for i, x in enumerate(rows):
        out, error = buy(*x, exact)
        assert (got[i].out, got[i].error) == (out, error), x
        assert error or got[i].spent <= x[0]


def test_sell_quotes_tell_the_shortfall(spark):
    df = spark.range(1)
    one = lambda *a, **k: df.select(trips.quote_sell(*map(F.lit, a), **k).alias("q")).first().q
    q = one(1000, 10**6, 10**6, 500, 95, 30, capped=False)
    assert (int(q.gross), int(q.protocol_fee), int(q.creator_fee), int(q.out), int(q.shortfall), q.error) == (999, 10, 3, 986, 499, None)
    assert one(1000, 10**6, 10**6, 500, 95, 30).error == "INSUFFICIENT_REAL_SOL_RESERVES" and one(1000, 10**6, 10**6, 500, 95, 30).out is None
    assert one(0, 10**6, 10**6, 500, 95, 30).error == "INVALID_INPUT" and one(1, 10**6, 10, 500, 95, 30).error == "OUTPUT_OUT_OF_BOUNDS"


STATE = "mint string, slot long, virtual_base long, virtual_quote long, real_base long, real_quote long, last_transaction_index long, last_absolute_path array<int>"


def test_copies_of_both_legs(spark):
    names = ["full", "no state", "no exit state", "stale", "poor pool", "too dear"]
    pairs = trips.pair_round_trips(trades(spark, [(n, c) for n in names for c in ({}, SELL)]), 0, 200)
    state = lambda n, slot, rb=10**9, rq=10**9, tx=3: (n, slot, 10**9, 10**6, rb, rq, tx, [0])
    rows = [state("full", 10), state("full", 12), state("no exit state", 10), state("stale", 10, tx=-1), state("poor pool", 10), state("poor pool", 12, rq=5), state("too dear", 10, rb=1), state("other", 10)]
    out = trips.copy_next_slot(pairs, spark.createDataFrame(rows, STATE), entry_fee=7)
    got = {r.mint: r for r in out.collect()}
    assert {m: r.status for m, r in got.items()} == {"full": "CLOSED", "no state": "EXCLUDED_MISSING_STATE", "no exit state": "OPEN", "stale": "REJECTED_ENTRY", "poor pool": "OPEN", "too dear": "REJECTED_ENTRY"}
    tokens = 10_000 * 10**9 // (10**6 + 10_000)
    gross = 10**6 * tokens // (10**9 + tokens)
    proceeds = gross - -(-gross * 95 // 10_000) - -(-gross * 30 // 10_000) - 5
    assert (got["full"].tokens, got["full"].cost, got["full"].proceeds, got["full"].pnl, got["full"].remaining) == (tokens, 10_125 + 7, proceeds, proceeds - 10_132, 0)
    assert (got["poor pool"].remaining, got["poor pool"].exit_failure, got["stale"].entry_failure, got["too dear"].entry_failure) == (tokens, "INSUFFICIENT_REAL_SOL_RESERVES", "STALE_STATE", "INSUFFICIENT_REAL_TOKEN_RESERVES")
    total = trips.copy_summary(out).first()
    assert (total.closed, total.open, total.rejected, total.excluded, total.cash) == (1, 2, 2, 1, proceeds - 10_132 - 2 * 10_132)


def test_exits_at_the_fill_and_the_loss_first(spark):
    pos = spark.createDataFrame([(1, "m", 100, 200, 1000), (2, "m", 150, 160, 1000), (3, "n", 100, 200, 1000), (4, "m", 171, 4000, 1000)], "id long, k string, entry long, deadline long, price0 long")
    states = spark.createDataFrame([("m", 99, 1), ("m", 100, 1400), ("m", 120, 10), ("m", 170, 10), ("m", 201, 10), ("m", 3700, 5000)], "k string, t long, price long")
    got = {r.id: (r.exit_at, r.exit_reason, r.at_fill) for r in trips.first_exit(pos, states, ["k"], "entry", "deadline", "t", "price", "price0", 3000, 4000, "id", 60).collect()}
    assert got == {1: (100, "TAKE_PROFIT", True), 2: (160, "DEADLINE", False), 3: (200, "DEADLINE", False), 4: (201, "STOP_LOSS", False)}


def test_retries_are_quoted_anew_and_land_later(spark):
    pos = spark.createDataFrame([(1, "a", 100), (2, "b", 100), (3, "c", 100), (4, "d", 100)], "id long, k string, t long")
    states = [("a", 100, 1000), ("a", 105, 990), ("b", 90, 1000), ("b", 108, 900), ("b", 140, 2000), ("c", 125, 50), *(("d", 90 + 30 * n, 1000 - 300 * (n % 2)) for n in range(3)), ("d", 101, 5), ("d", 131, 4), ("d", 161, 3), ("d", 191, 2), ("d", 221, 1), ("d", 200, 900)]
    got = {r.id: (r.attempt, r.fill_price, r.filled_at) for r in trips.retry_sells(pos, spark.createDataFrame(states, "k string, s long, p long"), ["k"], "t", "s", "p", 10, 20, 100).collect()}

    def want(k, t):
        at, last = t, lambda x: max(((s, p) for kk, s, p in states if kk == k and s <= x), default=(0, None))[1]
        for n in range(1, 5):
            quote, land = last(at), at + 10
            if quote is not None and last(land) >= quote * 9900 // 10_000:
                return n, last(land), land
            at = (at if quote is None else land) + 20
        return None, None, None

    assert got == {1: want("a", 100), 2: want("b", 100), 3: want("c", 100), 4: want("d", 100)}
    assert got[1] == (1, 990, 110) and got[2] == (2, 2000, 140) and got[3][0] == 3


def test_launch_trips_end_in_each_status(spark):
    blocks = [(b, 10, 1000 + b) for b in range(20)]
    clock = joins.clock_prefix(spark.createDataFrame(blocks, "block long, tx_count long, time long"))
    launches = [(1, "d", "m", 0, 3, 1000), (2, "d", "m", 1, 0, 1001), (3, "e", "m", 19, 5, 1019), (4, "f", "m", 15, 0, 1015), (5, "g", "none", 0, 0, 1000), (6, "h", "poor", 0, 0, 1000)]
    states = spark.createDataFrame([("m", 1, 10**9, 10**6, 10**9, 10**9), ("poor", 1, 10**9, 10**6, 10**9, 0)], "mint string, block long, virtual_base long, virtual_quote long, real_base long, real_quote long")
    states = states.withColumn("at", sc.boundary(F.col("block"), F.lit(0)))
    df = spark.createDataFrame(launches, "id long, developer string, mint string, block long, tx long, time long")
    got = {r.id: r for r in trips.launch_trips(df, clock, states, 10_125, 600, 25, 2, 15).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "CLOSED", 2: "COOLDOWN_SUPPRESSED", 3: "NO_BUY_TAIL", 4: "NO_SELL_TAIL", 5: "BUY_REJECTED", 6: "SELL_REJECTED_OPEN"}
    assert (got[1].buy_block, got[1].buy_tx, got[1].sell_block, got[1].sell_tx) == (2, 8, 5, 5)  # decided in block 4, the first at or after 1002 + 2


def test_launches_are_classified_once(spark):
    rows = [(1, 1, True, False, "OLD", False), (2, 2, True, True, "OLD", False), (3, 3, False, True, "OLD", False), (4, 4, True, False, "OLD", False), (5, 4, True, False, "OLD", False), (6, 6, True, False, "OLD", True), (7, 7, True, None, "NEW", True), (8, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, tx long, sol boolean, mayhem boolean, program string, cashback boolean")
    out = filters.classify_launches(df, ["tx"], F.col("sol"), "mayhem", "program", "cashback", "NEW")
    got = {r.id: (r["class"], r.reason, r.mode) for r in out.collect()}
    assert got == {1: ("ELIGIBLE", None, "NORMAL"), 2: ("EXCLUDED", "MAYHEM", None), 3: ("INVALID", "QUOTE_ASSET", None), 4: ("INVALID", "SECOND_IN_TRANSACTION", None), 5: ("INVALID", "SECOND_IN_TRANSACTION", None), 6: ("INVALID", "MODE", None), 7: ("ELIGIBLE", None, "CASHBACK"), 8: ("INVALID", "QUOTE_ASSET", None)}
    assert tuple(filters.launch_counts(out).first()) == (3, 2, 1)

"""Exact arithmetic over all 64 bits against Python's integers."""

import random

from pyspark.sql import functions as F

from chainframe.functions import scalar
from chainframe.operators import trips

TOP = (1 << 64) - 1


def numbers(r):
    return r.choice([0, 1, 2, 9, 10**10 - 1, 10**10, 10**18, (1 << 63) - 1, 1 << 63, TOP - 1, TOP, r.randrange(1 << 64), r.randrange(1 << 32), r.randrange(1, 1000)])


def decimals(spark, rows, names):
    df = spark.createDataFrame([tuple(str(x) if x is not None else None for x in row) for row in rows], ", ".join(f"{n} string" for n in names))
    return df.select(*[F.col(n).cast("decimal(38,0)").alias(n) for n in names])


def test_products_have_128_bits(spark):
    r = random.Random(1)
    rows = [(numbers(r), numbers(r), max(1, numbers(r)) + r.choice([0, numbers(r)])) for _ in range(600)] + [(5, None, 7), (None, 5, 7), (5, 5, None), (5, 5, 0), (TOP + 1, 1, 1), (-1, 1, 1), (TOP, TOP, 1), (TOP, TOP, 3), (TOP, TOP, 4)]
    got = decimals(spark, rows, "abc").select("a", "b", "c", scalar.mul_div(F.col("a"), F.col("b"), F.col("c")).alias("lo"), scalar.mul_div(F.col("a"), F.col("b"), F.col("c"), up=True).alias("hi")).collect()
    for (a, b, c), x in zip(rows, got, strict=True):
        fits = None not in (a, b, c) and c > 0 and 0 <= a <= TOP and 0 <= b <= TOP
        lo, hi = (a * b // c, -(-a * b // c)) if fits else (None, None)
        assert x.lo == (lo if fits and lo < 10**38 else None) and x.hi == (hi if fits and hi < 10**38 else None), (a, b, c)


def fee(amount, bps):
    return (amount * bps + 9999) // 10_000


def bought(q, vb, vq, rb, rq, p, c, exact):
    if q is None or not 0 < q <= TOP:
        return None, "INVALID_INPUT"
    first = q * 10_000 // (10_000 + p + c)
    net = first - max(0, first + fee(first, p) + fee(first, c) - q)
    curve = net - exact
    if curve <= 0:
        return None, "OUTPUT_OUT_OF_BOUNDS"
    if vq + net > TOP or rq + net > TOP:
        return None, "ARITHMETIC_OVERFLOW"
    out = curve * vb // (vq + curve)
    if out <= 0 or out >= vb:
        return None, "OUTPUT_OUT_OF_BOUNDS"
    return (None, "INSUFFICIENT_REAL_TOKEN_RESERVES") if out > rb else (out, None)


def sold(b, vb, vq, rb, rq, p, c, capped):
    if b is None or not 0 < b <= TOP:
        return None, "INVALID_INPUT"
    if vb + b > TOP or rb + b > TOP:
        return None, "ARITHMETIC_OVERFLOW"
    gross = vq * b // (vb + b)
    if gross <= 0 or gross >= vq:
        return None, "OUTPUT_OUT_OF_BOUNDS"
    if capped and gross > rq:
        return None, "INSUFFICIENT_REAL_SOL_RESERVES"
    fees = fee(gross, p) + fee(gross, c)
    return (None, "OUTPUT_OUT_OF_BOUNDS") if fees >= gross else (gross - fees, None)


def test_quotes_over_all_64_bits(spark):
    r = random.Random(2)
    near = lambda: r.choice([numbers(r), r.randrange(1 << 62, 1 << 63), r.randrange(1 << 63, 1 << 64)])
    rows = [(r.choice([near(), r.randrange(1, 10**6)]), *(near() for _ in range(4)), r.choice([0, 30, 95, 9999]), r.choice([0, 30])) for _ in range(500)] + [(None, 1, 1, 1, 1, 0, 0), (TOP + 1, TOP, TOP, TOP, TOP, 1, 1), (12 * 10**18, TOP, 10**18, TOP, 5, 95, 30)]
    df = decimals(spark, rows, ["q", "vb", "vq", "rb", "rq", "p", "c"])
    q, vb, vq, rb, rq, p, c = (F.col(n) for n in df.columns)
    got = df.select(
        trips.quote_buy(q, vb, vq, rb, rq, p, c).alias("b0"), trips.quote_buy(q, vb, vq, rb, rq, p, c, True).alias("b1"),
        trips.quote_sell(q, vb, vq, rq, p, c, True, rb).alias("s1"), trips.quote_sell(q, vb, vq, rq, p, c, False, rb).alias("s0"), trips.quote_xyk(q, vb, vq, p).alias("x"),
    ).collect()
    seen = set()
    for row, x in zip(rows, got, strict=True):
        for exact, y in ((0, x.b0), (1, x.b1)):
            assert (y.out, y.error) == bought(*row, exact), row
            seen.add(y.error)
        for capped, y in ((1, x.s1), (0, x.s0)):
            assert (y.out, y.error) == sold(*row, capped), row
            seen.add(y.error)
        if row[0] is not None and row[0] <= TOP:
            net = row[0] - row[0] * row[5] // 10_000
            assert x.x == (row[2] * net // (row[1] + net) if row[1] + net else None)
        else:
            assert x.x is None
    assert seen == {None, "INVALID_INPUT", "OUTPUT_OUT_OF_BOUNDS", "ARITHMETIC_OVERFLOW", "INSUFFICIENT_REAL_TOKEN_RESERVES", "INSUFFICIENT_REAL_SOL_RESERVES"}


def test_an_unknown_reserve_is_no_result(spark):
    one = F.lit(5)
    none = F.lit(None).cast("long")
    row = spark.range(1).select(trips.quote_buy(one, none, one, one, one, F.lit(0), F.lit(0)).alias("b"), trips.quote_sell(one, none, one, one, F.lit(0), F.lit(0)).alias("s")).first()
    assert (row.b.out, row.b.error, row.s.out, row.s.error) == (None, "ARITHMETIC_OVERFLOW", None, "ARITHMETIC_OVERFLOW")


def test_caps_and_network_fees(spark):
    r = random.Random(3)
    rows = [(numbers(r), numbers(r), max(1, numbers(r)), r.randrange(5)) for _ in range(100)]
    got = decimals(spark, rows, ["a", "b", "c", "n"]).select(scalar.market_cap(F.col("a"), F.col("b"), F.col("c")).alias("cap"), scalar.network_fee(F.col("a"), F.col("b"), F.col("n"), 5000).alias("fee")).collect()
    for (a, b, c, n), x in zip(rows, got, strict=True):
        assert x.cap == (a * b // c if a * b // c < 10**38 else None) and x.fee == -(-a * b // 10**6) + 5000 * n


def test_rows_with_nulls_stay(spark):
    from chainframe.operators import aggs

    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (None, None, "d"), (None, None, "d"), (2, None, "e"), (2, 1, None), (3, None, None), (3, None, "f")]
    out = aggs.dedup_by_priority(spark.createDataFrame(rows, "k long, p long, v string"), ["k"], "p", ["v"]).collect()
    assert sorted((tuple(x) for x in out), key=repr) == sorted([(1, 5, "a", True), (None, None, "d", False), (2, 1, None, False), (3, None, None, True)], key=repr)
    assert aggs.dedup_by_priority(spark.createDataFrame([], "k long, p long, v string"), ["k"], "p", ["v"]).count() == 0
    names = [f"{s}_{c}" for s in ("buy", "sell") for c in ("slot", "transaction_index", "absolute_path", "signature", "user", "fee_payer", "fee_lamports", "sol_amount", "protocol_fee", "creator_fee")]
    kinds = ["long", "long", "array<int>", "string", "string", "string", "long", "long", "long", "long"] * 2
    leg = lambda slot, sign, payer, sol: (slot, 0, [0], sign, "u", payer, 7, sol, 1, 1)
    pairs = [(None, "PAIRED", *leg(1, None, "u", 10), *leg(2, None, "u", 30)), (5, "PAIRED", *leg(3, None, "u", 10), *leg(4, "x", None, 20)), (6, "zero_amount", *leg(3, "y", "u", 10), *leg(4, "z", "u", 20))]
    df = spark.createDataFrame(pairs, "mint long, reason string, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    assert {x.mint: (x.gross_buy, x.network_fees, x.pnl) for x in trips.leader_pnl(df).collect()} == {None: (12, 7, 9), 5: (12, 0, 6)}


def test_numbers_of_a_batch_are_whole():
    r = random.Random(5)
    numbers = [0, 1, -1, TOP, TOP + 1, -TOP, 10**38 - 1, 1 - 10**38, None, *(r.randrange(-(10**38) + 1, 10**38) for _ in range(50))]
    assert scalar.ints(scalar.wholes(numbers)) == numbers and scalar.ints(scalar.wholes(numbers).slice(3, 7)) == numbers[3:10]
    assert scalar.ints(scalar.wholes([])) == [] and scalar.ints(scalar.wholes([None, None])) == [None, None] and scalar.ints(scalar.pa.array([3, None])) == [3, None]


def test_quotes_are_made_once_in_batches(spark):
    df = decimals(spark, [(5_000_000, TOP, 10**18, 95)], ["q", "vb", "vq", "p"])
    q, vb, vq, p = (F.col(n) for n in df.columns)
    out = df.select(trips.quote_buy(q, vb, vq, vb, vq, p, p).alias("b"), trips.quote_sell(q, vb, vq, vq, p, p).alias("s"), trips.quote_xyk(q, vb, vq, p).alias("x"), scalar.market_cap(q, vb, vq).alias("cap"))
    plan = out.select("b.*", "s.out", "s.error", "x", "cap")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1


def test_an_unknown_or_senseless_rate_is_no_result(spark):
    rows = [(10**6, None, 30), (10**6, 30, None), (10**6, -10_000, 0), (None, None, None)]
    df = decimals(spark, rows, ["q", "p", "c"])
    big = F.lit(10**12)
    got = df.select(trips.quote_buy(F.col("q"), big, big, big, big, F.col("p"), F.col("c")).alias("b"), trips.quote_sell(F.col("q"), big, big, big, F.col("p"), F.col("c")).alias("s"), trips.quote_xyk(F.col("q"), big, big, F.col("p")).alias("x")).collect()
    assert [(x.b.out, x.b.error) for x in got] == [(None, "ARITHMETIC_OVERFLOW")] * 3 + [(None, "INVALID_INPUT")]
    assert [(x.s.gross, x.s.out, x.s.error) for x in got[:2]] == [(999_999, None, None)] * 2 and got[3].s.error == "INVALID_INPUT"
    assert got[0].x is None and got[3].x is None

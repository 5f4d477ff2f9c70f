"""Column expressions: positions, exact integer money, identities, ranges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base58 alphabet.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MONEY = "decimal(38,0)"
#: Amounts and reserves: whole numbers of 64 bits without sign.
U64, U64_TOP = "decimal(20,0)", str((1 << 64) - 1)
U64_MASK = (1 << 64) - 1


def boundary(block: Column, tx: Column) -> Column:
    """One ordered number for a place in the chain; tx = -1 is the place before a block's first transaction."""
    return F.shiftleft(block.cast("long"), 32) + tx + 1


def boundary_block(b: Column) -> Column:
    return F.shiftright(b, 32)


def boundary_tx(b: Column) -> Column:
    return b.bitwiseAND(F.lit((1 << 32) - 1)) - 1


def before(left: Sequence[str], right: Sequence[str]) -> Column:
    """Lexicographic comparison of two positions, column by column."""
    return F.struct(*[F.col(a).alias(f"k{i}") for i, a in enumerate(left)]) < F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(right)])


def direction(left: Sequence[str], right: Sequence[str]) -> Column:
    """-1, 0 or 1: whether the left position comes first, both are one, or the right one comes first."""
    return F.when(before(left, right), -1).when(before(right, left), 1).otherwise(0)


def clean_text(c: Column) -> Column:
    """Cuts a padded text at its first NUL and takes upper case."""
    return F.upper(F.regexp_replace(c, "\\x00.*$", ""))


def epoch_seconds(c: str) -> Column:
    """Whole seconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def floordiv(a: Column, b: Column) -> Column:
    """floor(a / b), exact for any 38-digit numbers with b > 0. Decimal division rounds, so the rest goes first."""
    a, b = a.cast(MONEY), b.cast(MONEY)
    return ((a - F.pmod(a, b)) / b).cast(MONEY)


def u64(c: Column) -> Column:
    """A whole number as DECIMAL(20,0), null where it doesn't fit into 64 bits without sign."""
    whole = c.try_cast(U64)
    return F.when((whole >= 0) & (whole <= F.lit(U64_TOP).cast(U64)), whole)


def ints(values: pa.Array) -> list[int | None]:
    """Whole numbers of an Arrow batch, 64-bit ones or DECIMAL, as Python's."""
    if not pa.types.is_decimal(values.type):
        return values.to_pylist()
    words = np.frombuffer(values.buffers()[1], "<i8", 2 * len(values), 16 * values.offset).reshape(-1, 2)
    out = words[:, 0].view("<u8").tolist()
    if words[:, 1].any():
        out = [low + (high << 64) for low, high in zip(out, words[:, 1].tolist(), strict=True)]
    return [x if known else None for x, known in zip(out, values.is_valid().to_pylist(), strict=True)] if values.null_count else out


def wholes(values: Sequence[int | None]) -> pa.Array:
    """Python's whole numbers of at most 38 digits as DECIMAL(38,0)."""
    known = [x is not None for x in values]
    if not all(known):
        values = [x or 0 for x in values]
    words = np.empty((len(known), 2), "<i8")
    words[:, 0] = np.array([x & U64_MASK for x in values], "<u8").view("<i8")
    words[:, 1] = [x >> 64 for x in values]
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(known), [pa.array(known, pa.bool_()).buffers()[1], pa.py_buffer(words)])


def over(a: int | None, b: int | None, c: int | None, up: bool = False) -> int | None:
    """mul_div() of one row."""
    if a is None or b is None or c is None or not (0 <= a <= U64_MASK and 0 <= b <= U64_MASK and 0 < c < 10**20):
        return None
    out = -(-a * b // c) if up else a * b // c
    return out if out < 10**38 else None


@F.arrow_udf(T.DecimalType(38, 0))
def _over_down(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
    return wholes(list(map(over, ints(a), ints(b), ints(c))))


@F.arrow_udf(T.DecimalType(38, 0))
def _over_up(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
    return wholes([over(*x, True) for x in zip(ints(a), ints(b), ints(c), strict=True)])


def mul_div(a: Column, b: Column, c: Column, up: bool = False) -> Column:
    """floor(a * b / c), or the ceiling with ``up``, of 64-bit a and b and a c below 10^20, as DECIMAL(38,0).

    The product has up to 128 bits, more than 38 digits hold, so it is made of Python's integers, in Arrow batches. Null where an operand is
    null or out of its range, c is not positive, or the result has more than 38 digits.
    """
    return (_over_up if up else _over_down)(u64(a), u64(b), c.try_cast("decimal(20,0)"))


def ceildiv(a: Column, b: Column) -> Column:
    return floordiv(a.cast(MONEY) + b.cast(MONEY) - 1, b)


def ceil_fee(amount: Column, bps: Column) -> Column:
    return ceildiv(amount.cast("decimal(20,0)") * bps.cast("decimal(10,0)"), F.lit(10_000))


def fee_matches(amount: Column, bps: Column, observed: Column) -> Column:
    return ceil_fee(amount, bps) == observed.cast(MONEY)


def min_output(out: Column, slippage_bps: Column) -> Column:
    """The least output that is accepted, rounded down; out is of 64 bits."""
    return floordiv(out.cast(U64) * (F.lit(10_000) - slippage_bps).cast("decimal(10,0)"), F.lit(10_000))


def price_exit(now_num: Column, now_den: Column, entry_num: Column, entry_den: Column, loss_bps: int, gain_bps: int) -> Column:
    """STOP_LOSS, TAKE_PROFIT or null: prices are ratios and are compared crosswise, without a division; the loss goes first."""
    now = now_num.cast("decimal(18,0)") * entry_den.cast("decimal(18,0)") * F.lit(10_000)
    entry = entry_num.cast("decimal(18,0)") * now_den.cast("decimal(18,0)")
    return F.when(now <= entry * F.lit(10_000 - loss_bps), "STOP_LOSS").when(now >= entry * F.lit(10_000 + gain_bps), "TAKE_PROFIT")


def market_cap(virtual_quote: Column, supply: Column, virtual_base: Column) -> Column:
    """floor(quote * supply / base) of 64-bit numbers; null where one isn't, base is 0, or the result has more than 38 digits."""
    return mul_div(virtual_quote, supply, virtual_base)


def network_fee(units: Column, micro_price: Column, signatures: Column, base_fee: int) -> Column:
    """Priority fee of 64-bit units and prices, rounded up from millionths, plus the fee of each signature."""
    return mul_div(units, micro_price, F.lit(1_000_000), up=True) + signatures.cast(MONEY) * F.lit(base_fee)


def content_id(*columns: str) -> Column:
    """sha256 over the fields in order, each with its length, so that no two lists of fields run together."""
    parts = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def split_range(df: DataFrame, lo: str, hi: str, step: int) -> DataFrame:
    """A row for each part of at most ``step`` of the half-open ranges lo..hi: part_from, part_to."""
    out = df.where(F.col(lo) < F.col(hi)).withColumn("part_from", F.explode(F.sequence(F.col(lo), F.col(hi) - 1, F.lit(step))))
    return out.withColumn("part_to", F.least(F.col("part_from") + step, F.col(hi)))


def widen_range(lo: Column, hi: Column, warm_ups: Sequence[int], tails: Sequence[int]) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), lo - max(warm_ups, default=0)), hi + max(tails, default=0)


def parent_path(c: Column) -> Column:
    """All but the last step of a path; null for a path of one step or none."""
    return F.when(F.size(c) > 1, F.slice(c, F.lit(1), F.size(c) - 1))


def real_reserves(virtual_base: Column, virtual_quote: Column, base_offset: int, quote_offset: int) -> Column:
    """Real reserves from virtual ones, with the lifecycle: COMPLETED when nothing is left to sell; null if either is out of bounds."""
    base, quote = virtual_base - base_offset, virtual_quote - quote_offset
    return F.when((base >= 0) & (quote >= 0), F.struct(base.alias("base"), quote.alias("quote"), F.when(base == 0, "COMPLETED").otherwise("ACTIVE").alias("lifecycle")))


def event_index_of(raw: Column, offset: int) -> Column:
    """Leaves room for one derived event after each raw one."""
    return raw * 2 + offset


def program_mode(token_program: Column, cashback: Column, extended: str) -> Column:
    """NORMAL, TOKEN_2022 or CASHBACK; null where the pair is not allowed."""
    new = token_program == extended
    return F.when(cashback & new, "CASHBACK").when(new, "TOKEN_2022").when(~cashback, "NORMAL")


def is_base58(c: Column, low: int = 32, high: int = 44) -> Column:
    """Whether a text has the shape of an address; base58_bytes() tells how many bytes it stands for."""
    return c.rlike(f"^[{BASE58}]{{{low},{high}}}$")


@F.pandas_udf(T.IntegerType())
def base58_bytes(values: pd.Series) -> pd.Series:
    """How many bytes a base58 text stands for; null for null and for text with any other character."""

    def size(text: str | None) -> int | None:
        if text is None or text.strip(BASE58):
            return None
        number = 0
        for digit in text:
            at = BASE58.find(digit)
            if at < 0:
                return None
            number = number * 58 + at
        return len(text) - len(text.lstrip("1")) + (number.bit_length() + 7) // 8

    return values.map(size).astype("Int32")


@F.pandas_udf(T.StringType())
def to_base58(values: pd.Series) -> pd.Series:
    """Bytes as base58 text; leading zero bytes become leading ones."""

    def text(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        number, out = int.from_bytes(raw, "big"), ""
        while number:
            number, digit = divmod(number, 58)
            out = BASE58[digit] + out
        return "1" * (len(raw) - len(bytes(raw).lstrip(b"\0"))) + out

    return values.map(text)

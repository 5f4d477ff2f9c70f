"""Joins: co-occurrence, as-of, interval, positional, hierarchical, reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.scalar import direction
from chainframe.operators.scans import keyed_scan


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; ties must be broken by ``order``."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(place)).where("_row = 1").drop("_row")


def co_occurrence(first: DataFrame, width: int, entity: str = "signer", key: str = "mint", time: str = "t", position: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """Pairs a < b of entities whose first rows of one key are at most ``width`` apart: key, a, b, a_row, b_row, direction.

    One side is put into the time buckets on either side of its own, so that the join is an equality on (key, bucket).
    """
    step = max(width, 1)
    bucket = F.floor(F.col(time) / F.lit(step))
    side = lambda p: [F.col(entity).alias(p), F.col(time).alias(f"{p}_t"), *[F.col(c).alias(f"{p}_{i}") for i, c in enumerate(position)]]
    left = first.select(F.col(key).alias("key"), bucket.alias("bucket"), *side("a"))
    right = first.select(F.col(key).alias("key"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), *side("b"))
    near = left.join(right, ["key", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("a_t") - F.col("b_t")) <= width))
    last = len(position) - 1
    way = direction([f"a_{i}" for i in range(len(position))], [f"b_{i}" for i in range(len(position))])
    return near.select("key", "a", "b", F.col(f"a_{last}").alias("a_row"), F.col(f"b_{last}").alias("b_row"), way.alias("direction"))


def pairs(matches: DataFrame, least: int) -> DataFrame:
    """Pairs with at least ``least`` matches, and how many went each way."""
    count = lambda d: F.count_if(F.col("direction") == d)
    out = matches.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), count(-1).alias("a_first"), count(0).alias("together"), count(1).alias("b_first"))
    return out.where(F.col("shared") >= least)


def pair_evidence(matches: DataFrame, found: DataFrame, rows: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """The matches of the pairs found, with both source rows. Pairs have no nulls; a match whose row id isn't in ``rows``, or twice, gives no row, or two."""
    kept = matches.join(found.select("a", "b"), ["a", "b"])
    for side in ("a", "b"):
        kept = kept.join(rows.select(F.col(row_id).alias(f"{side}_row"), *[F.col(c).alias(f"{side}_{c}") for c in columns]), f"{side}_row")
    return kept


def fanout_budget(first: DataFrame, key: str, most_rows: int | None = None, most_pairs: int | None = None) -> DataFrame:
    """Largest group and number of pairs that a self-join on ``key`` can make. With limits given, fails where one is passed."""
    sizes = first.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("pairs"))
    if most_rows is not None or most_pairs is not None:
        row = out.first()
        if (most_rows is not None and row.largest > most_rows) or (most_pairs is not None and row.pairs > most_pairs):
            raise ValueError(f"a self-join makes {row.pairs} pairs, {row.largest} rows in its largest group")
    return out


def enrich(facts: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Facts with the columns of a dimension; the planner broadcasts it where it is small."""
    return facts.join(dimension, list(on), how)


def candidate_history(history: DataFrame, candidates: DataFrame, on: Sequence[str]) -> DataFrame:
    return history.join(candidates.select(*on).distinct(), list(on), "left_semi")


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, take: Sequence[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """Each left row with ``take`` of the last right row at or before it (strict: before it), or the first at or after it.

    Both sides are one stream by (by, on), so no pair is made; a key of any size is spread over ranges of it, see keyed_scan().
    Right rows of equal place must be made distinct first. A right row whose values are null is a match still. Null keys meet each other; a null
    place comes before all others.
    """
    names = list(dict.fromkeys([*left.columns]))
    # at equal places the side that comes first in the order of reading decides whether they match
    first, last = (1, 0) if forward else (0, 1)
    one = left.select(F.struct(*names).alias("_l"), *by, F.col(left_on).alias("_on"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_r"), F.lit(first if strict else last).alias("_side"))
    two = right.select(F.lit(None).cast(one.schema["_l"].dataType).alias("_l"), *by, F.col(right_on).alias("_on"), F.struct(*take).alias("_r"), F.lit(last if strict else first).alias("_side"))
    both = keyed_scan(one.unionByName(two), by, ["_on", "_side"], F.col("_r"), "_m", descending=forward)
    return both.where("_l is not null").select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in take])


def asof_causal(orders: DataFrame, states: DataFrame, by: Sequence[str], place: tuple[str, str, str], timing: str, take: Sequence[str]) -> DataFrame:
    """Orders with ``take`` of the last state that they could have seen; of states at one place the greatest counts.

    ``place`` names block, transaction and outer instruction of both sides. A state of timing AFTER_INSTRUCTION can be seen by later
    instructions of its own transaction, any other only by later transactions.
    """
    block, tx, index = place
    last = F.when(F.col(timing) == "AFTER_INSTRUCTION", F.col(index).cast("long")).otherwise(F.lit((1 << 63) - 1))
    at = lambda i: F.struct(F.col(block).cast("long").alias("b"), F.col(tx).cast("long").alias("t"), i.alias("i"))
    seen = states.groupBy(*by, at(last).alias("_from")).agg(F.max(F.struct(*take)).alias("_s")).select(*by, "_from", "_s.*")
    return asof(orders.withColumn("_place", at(F.col(index).cast("long"))), seen, by, "_place", "_from", take, strict=True).drop("_place")


def in_interval(left: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, ready: str | None = None) -> DataFrame:
    """Left rows whose latest interval with start <= at also has at < end, and was ready by then."""
    columns = [start, end, *([ready] if ready else [])]
    found = asof(left, intervals.select(*by, F.col(start).alias("_key"), *columns), by, at, "_key", columns)
    good = (F.col(at) < F.col(end)) & (F.lit(True) if ready is None else F.col(at) >= F.col(ready))
    return found.where(good)


#: Points of a shared clock that one window task holds at most, if they are whole numbers without repeats.
SPAN = 1 << 12
#: Rows of a schedule up to which it is sent to every task.
SCHEDULE_ROWS = 256


def _before(points: DataFrame, column: str, value: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Adds out: ``fold`` of value over all rows that stand before by a column that all share; null for the first one.

    Rows are put into spans of SPAN of the column. Windows hold one span each; what the spans before come to is a table of one row
    a span. ``join`` puts the two together.
    """
    rows = points.withColumn("_span", F.floor(F.col(column) / SPAN)).withColumn("_value", value)
    ahead = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_span").agg(fold(F.col("_value")).alias("_whole")).select(F.col("_span").alias("_of"), fold(F.col("_whole")).over(ahead).alias("_carried"))
    inside = Window.partitionBy("_span").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", fold(F.col("_value")).over(inside)).join(carried, F.col("_span") == F.col("_of"))
    both = F.coalesce(join(F.col("_inside"), F.col("_carried")), "_inside", "_carried")
    return rows.withColumn(out, both).drop("_span", "_of", "_value", "_inside", "_carried")


def model_at(rows: DataFrame, schedule: DataFrame, at: str, start: str = "valid_from", end: str = "valid_until", model: str = "model_id", fallback: str | None = None) -> DataFrame:
    """Rows with the model of a schedule of intervals that don't overlap: status SCORED, UNCOVERED before its first start, GAP where none holds.

    With ``fallback``, a model's name, it takes the rows that no interval holds: FALLBACK; the other columns of the schedule stay null. See require_covered() to fail on a gap.

    A schedule of up to SCHEDULE_ROWS rows is sent to every task. A longer one meets the rows in spans of its own time,
    each span with the last interval that begins before it.
    """
    first = schedule.agg(F.min(start).alias("_first"))
    if schedule.limit(SCHEDULE_ROWS + 1).count() <= SCHEDULE_ROWS:
        found = rows.join(F.broadcast(schedule), (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)), "left")
    else:
        found = _interval_of(rows, schedule, at, start, end)
    status = F.when(F.col(model).isNotNull(), "SCORED").when(F.col("_first").isNull() | (F.col(at) < F.col("_first")), "UNCOVERED").otherwise("GAP")
    out = found.join(F.broadcast(first)).withColumn("status", status).drop("_first")
    if fallback is not None:
        out = out.withColumns({"status": F.when(F.col("status") == "SCORED", "SCORED").otherwise("FALLBACK"), model: F.coalesce(model, F.lit(fallback))})
    return out


def require_covered(scored: DataFrame, prefix: bool = True) -> DataFrame:
    """What model_at() gives, if it has no GAP; else fails. Rows before the first start may stay UNCOVERED only with ``prefix``."""
    bad = scored.where(F.col("status").isin(["GAP"] if prefix else ["GAP", "UNCOVERED"])).groupBy("status").count().collect()
    if bad:
        raise ValueError(f"rows without a model: {({x['status']: x['count'] for x in bad})}")
    return scored


def _interval_of(rows: DataFrame, schedule: DataFrame, at: str, start: str, end: str, step: int = 64) -> DataFrame:
    """Rows with the columns of the last interval that begins at or before them and still holds, else nulls."""
    whole = F.struct(F.col(start).alias("_key"), *schedule.columns)
    asked = rows.withColumn("_span", F.floor(F.col(at) / step))
    own = schedule.select(F.floor(F.col(start) / step).alias("_span"), whole.alias("_interval"))
    last = own.groupBy("_span").agg(F.max("_interval").alias("_last"))
    spans = asked.select("_span").distinct().join(last, "_span", "full_outer")
    ahead = spans.select("_span", F.last("_last", True).over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    found = asof(asked, own.select("_span", F.col("_interval._key").alias("_from"), "_interval"), ["_span"], at, "_from", ["_interval"])
    found = found.join(ahead, "_span", "left").withColumn("_i", F.coalesce("_interval", "_carried"))
    holds = F.col(at) < F.col(f"_i.{end}")
    return found.select(*rows.columns, *[F.when(holds, F.col(f"_i.{c}")).alias(c) for c in schedule.columns])


def clock_prefix(blocks: DataFrame, block: str = "block", count: str = "tx_count") -> DataFrame:
    """Adds prefix, the number of transactions before each block. No window holds more than SPAN blocks."""
    return _before(blocks, block, F.col(count).cast("long"), F.sum, lambda a, b: a + b, "prefix").na.fill(0, ["prefix"])


def in_span(left: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, step: int = 1 << 12) -> DataFrame:
    """Left rows with the span lo..hi, both included, that holds ``at``. Spans don't overlap; the join is an equality on ranges of ``step``."""
    into = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))))
    asked = left.withColumn("_b", F.floor(F.col(at) / step))
    found = asked.join(into, (asked["_b"] == into["_b"]) & (F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)), "left")
    return found.drop("_b")


def first_not_below(left: DataFrame, value: str, points: DataFrame, point: str, out: str) -> DataFrame:
    """Left rows with the least point >= value, null past the last one."""
    spans = _before(points.select(F.col(point).alias(out)).distinct(), out, F.col(out), F.max, F.greatest, "_prior")
    spans = spans.select(out, F.coalesce(F.col("_prior") + 1, F.col(out)).alias("_from"))
    least = points.agg(F.min(point).alias("_floor"))
    asked = left.join(F.broadcast(least)).withColumn("_v", F.greatest(value, "_floor"))
    return in_span(asked, "_v", spans, "_from", out).drop("_v", "_from", "_floor")


def nth_after(positions: DataFrame, clock: DataFrame, n: int, block: str = "block", tx: str = "tx") -> DataFrame:
    """The n-th transaction after each position, over empty blocks too: to_block, to_tx; null past the end of the clock."""
    at = clock.select(F.col("block").alias(block), F.col("prefix").alias("_p"))
    asked = positions.join(at, block, "left").withColumn("_g", F.col("_p") + F.col(tx) + n)
    into = clock.where("tx_count > 0").select(F.col("block").alias("to_block"), F.col("prefix").alias("_q"), (F.col("prefix") + F.col("tx_count") - 1).alias("_last"))
    found = in_span(asked, "_g", into, "_q", "_last")
    return found.select(*positions.columns, "to_block", (F.col("_g") - F.col("_q")).alias("to_tx"))


def first_at_or_after(positions: DataFrame, clock: DataFrame, target: str, block: str = "block", time: str = "time") -> DataFrame:
    """The first later block with transactions whose time is at or after the target: to_block; null past the end.

    Times never fall along the clock, so that block is the first one not below both the first of that time and the next one.
    """
    full = clock.where("tx_count > 0").select(F.col("block").alias("_c"), F.col(time).alias("_t"))
    firsts = full.groupBy("_t").agg(F.min("_c").alias("_first"))
    timed = first_not_below(positions, target, firsts, "_t", "_at").join(firsts.withColumnRenamed("_t", "_at"), "_at", "left")
    timed = timed.withColumn("_least", F.when(F.col("_first").isNotNull(), F.greatest("_first", F.col(block) + 1)))
    return first_not_below(timed, "_least", full, "_c", "_to").select(*positions.columns, F.when(F.col("_first").isNotNull(), F.col("_to")).alias("to_block"))


def delay_delivery(events: DataFrame, bounds: DataFrame, delay: int, block: str = "block") -> DataFrame:
    """Each event with the first boundary whose block is at least ``delay`` blocks later: released; null outside the horizon."""
    out = first_not_below(events.withColumn("_due", F.col(block) + delay), "_due", bounds, "block", "released")
    return out.select(*events.columns, "released")


def attach_slot_state(signals: DataFrame, states: DataFrame, on: Sequence[str], signal_at: str, state_at: str) -> DataFrame:
    """Signals with the state of their slot: state_status OK, MISSING, or EARLY where the state is older than the signal."""
    out = signals.join(states, list(on), "left")
    return out.withColumn("state_status", F.when(F.col(state_at).isNull(), "MISSING").when(F.col(state_at) < F.col(signal_at), "EARLY").otherwise("OK"))


def _same(columns: Sequence[str]) -> list[Column]:
    """Equality of columns and those with an underscore in front; nulls are equal."""
    return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]


def inherit_roles(rows: DataFrame, ids: Sequence[str], path: str = "path", decoder: str = "decoder", role: str = "role") -> DataFrame:
    """Each instruction's own role, or the one of its nearest ancestor of the same decoder: inherited_role, null where there is none.

    A null id or decoder is one of its own, a null or empty path inherits nothing; of two roles at one place the greater counts. Rows that repeat stay.
    """
    names = [*ids, decoder]
    deep = rows.where(F.col(path).isNotNull() & (F.size(path) > 0)).select(*names, F.col(path).alias("_path")).distinct()
    up = deep.withColumn("_depth", F.explode(F.sequence(F.when(F.size("_path") > 0, F.size("_path")).otherwise(1), F.lit(1), F.lit(-1))))
    up = up.withColumn("_up", F.slice("_path", F.lit(1), F.col("_depth")))
    have = rows.where(F.col(role).isNotNull()).groupBy(*[F.col(c).alias(f"_{c}") for c in names], F.col(path).alias("_at")).agg(F.max(role).alias("_role"))
    near = up.join(have, [*_same(names), F.col("_up") == F.col("_at")]).groupBy(*[F.col(c) for c in names], F.col("_path")).agg(F.max_by("_role", "_depth").alias("inherited_role"))
    near = near.select(*[F.col(c).alias(f"_{c}") for c in names], F.col("_path").alias("_at"), "inherited_role")
    return rows.join(near, [*_same(names), F.col(path) == F.col("_at")], "left").drop(*[f"_{c}" for c in names], "_at")


def drop_superseded(rows: DataFrame, ids: Sequence[str], path: str, version: str) -> DataFrame:
    """Without rows of an older version where a newer one stands under the same parent. A null id is one of its own, a null version is older than all others; rows of one version all stay."""
    parent = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    newest = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in ids], parent.alias("__parent")).agg(F.max(version).alias("_newest"))
    out = rows.withColumn("_parent", parent).join(newest, _same([*ids, "_parent"])).where(F.col(version).eqNullSafe(F.col("_newest")))
    return out.drop("_parent", "__parent", "_newest", *[f"_{c}" for c in ids])


def align_features(*frames: DataFrame, on: str = "row_id") -> DataFrame:
    """Feature sets side by side; a row that one of them lacks or has twice fails the query when it is met."""
    out = frames[0].withColumn("_have0", F.lit(1))
    for n, other in enumerate(frames[1:], 1):
        out = out.join(other.withColumn(f"_have{n}", F.lit(1)), on, "full_outer")
    have = [f"_have{n}" for n in range(len(frames))]
    whole = F.concat(*[F.coalesce(F.col(h).cast("string"), F.lit("0")) for h in have]) == "1" * len(frames)
    rows = out.groupBy(on).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col(on).alias("_twice"))
    out = out.join(rows, F.col(on).eqNullSafe(F.col("_twice")), "left")
    checked = F.when(whole & F.col("_twice").isNull(), F.col(on)).otherwise(F.raise_error(F.lit("the feature sets have different rows")).cast(frames[0].schema[on].dataType))
    return out.withColumn(on, checked).drop("_twice", *have)


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], amount: str) -> DataFrame:
    """Sums of both sides by key and how they compare: MATCH, MISMATCH, ONLY_LEFT or ONLY_RIGHT.

    Null keys meet each other. A null amount adds nothing; a side of nulls only is there, with a null sum that matches another null one.
    """
    names = list(on)
    one = left.groupBy(*names).agg(F.sum(amount).alias("left_amount"), F.lit(True).alias("_left"))
    two = right.groupBy(*[F.col(c).alias(f"_{c}") for c in names]).agg(F.sum(amount).alias("right_amount"), F.lit(True).alias("_right"))
    status = F.when(F.col("_right").isNull(), "ONLY_LEFT").when(F.col("_left").isNull(), "ONLY_RIGHT").when(F.col("left_amount").eqNullSafe(F.col("right_amount")), "MATCH").otherwise("MISMATCH")
    both = one.join(two, _same(names), "full_outer").withColumn("status", status)
    return both.select(*[F.when(F.col("_left").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names], "left_amount", "right_amount", "status")


def price_accounts(required: DataFrame, costs: DataFrame, kind: str = "kind") -> DataFrame:
    """Totals by owner of what accounts cost and of what comes back; fails on a kind without a cost."""
    if required.join(costs, kind, "left_anti").limit(1).count():
        raise ValueError("an account kind has no cost")
    priced = required.join(costs, kind).withColumn("_cost", F.col("n") * F.col("cost"))
    return priced.groupBy("owner").agg(F.sum("_cost").alias("total"), F.sum(F.when(F.col("refundable"), F.col("_cost")).otherwise(0)).alias("refundable"))

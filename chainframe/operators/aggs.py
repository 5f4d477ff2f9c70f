"""Aggregations, window rules, ledgers and data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.scalar import market_cap
from chainframe.operators.joins import asof
from chainframe.operators.scans import keyed_scan, ranged
from chainframe.sources.tables import Steps, checkpoint, row_digest


def wallet_activity(obs: DataFrame, wallet: str, side: str, buy: str, sell: str, key: str, block: str, amount: str) -> DataFrame:
    is_side = lambda s: F.col(side) == s
    return obs.groupBy(wallet).agg(
        F.count_if(is_side(buy)).alias("buys"), F.count_if(is_side(sell)).alias("sells"), F.countDistinct(key).alias("keys"), F.min(block).alias("first_block"), F.max(block).alias("last_block"),
        F.coalesce(F.sum(F.when(is_side(buy), F.col(amount))), F.lit(0)).alias("bought"), F.coalesce(F.sum(F.when(is_side(sell), F.col(amount))), F.lit(0)).alias("sold"),
    )


def collapse_occurrences(df: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row a key: smallest payload, source_row_count, payload_variant_count. Variants count as whole rows, nulls included."""
    whole = F.struct(*payload)
    out = df.groupBy(*keys).agg(F.min(whole).alias("_p"), F.count(F.lit(1)).alias("source_row_count"), F.count_distinct(whole).alias("payload_variant_count"))
    return out.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in payload], "source_row_count", "payload_variant_count")


def last_state(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The values of each key's last row; the order may hold arrays, which compare step by step."""
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return out.select(*keys, "_v.*")


def transactions(instructions: DataFrame, keys: Sequence[str], shared: Sequence[str], priority: str) -> DataFrame:
    """One row a transaction: the shared fields of its rows of highest priority, n_instructions, and conflict where those rows disagree."""
    whole = F.struct(*shared)
    top = F.struct(F.col(priority).alias("p"), whole.alias("w"))
    best = instructions.groupBy(*keys).agg(F.max(priority).alias("_top"), F.max(top).alias("_best"), F.count(F.lit(1)).alias("n_instructions"))
    low = instructions.groupBy(*keys, priority).agg(F.min(whole).alias("_least"), F.max(whole).alias("_most")).withColumnRenamed(priority, "_p")
    out = best.join(low.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_top").eqNullSafe(F.col("_p"))])
    return out.select(*keys, *[F.col(f"_best.w.{c}").alias(c) for c in shared], "n_instructions", (~F.col("_least").eqNullSafe(F.col("_most"))).alias("conflict"))


def coverage(signals: DataFrame, key: str) -> DataFrame:
    """signals, keys and the fingerprint of their rows in one row: what a plan must foresee."""
    counts = signals.agg(F.count(F.lit(1)).alias("signals"), F.countDistinct(key).alias("keys"))
    return counts.join(fingerprint(signals).select("digest"))


def differs_from_plan(found: DataFrame, planned: DataFrame) -> DataFrame:
    """A row (field, found, planned) for each value of a coverage that isn't the planned one."""
    fields = ["signals", "keys", "digest"]
    text = lambda df: F.array(*[F.struct(F.lit(c).alias("field"), df[c].cast("string").alias("value")) for c in fields])
    one = found.select(F.explode(text(found)).alias("x")).select("x.field", F.col("x.value").alias("found"))
    two = planned.select(F.explode(text(planned)).alias("x")).select("x.field", F.col("x.value").alias("planned"))
    return one.join(two, "field", "full_outer").where(~F.col("found").eqNullSafe(F.col("planned")))


def data_issues(df: DataFrame, issues: Mapping[str, Column]) -> DataFrame:
    """Rows with each issue, those without any rows too: issue, n."""
    counted = df.agg(*[F.count_if(test).alias(name) for name, test in issues.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(f"`{n}`").alias("n")) for n in issues])).alias("x")).select("x.*")


def terminal_by_tx(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows and variants of each key: n, variants, worst (the greater of the two)."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("variants"))
    return out.withColumn("worst", F.greatest("n", "variants"))


def class_counts(df: DataFrame, classes: DataFrame, key: str, label: str, all_labels: Sequence[str]) -> DataFrame:
    """Rows and distinct keys of every label, those without rows too."""
    spark = df.sparkSession
    found = df.join(classes.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit("UNKNOWN"))).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"))
    every = spark.createDataFrame([(x,) for x in all_labels], f"{label} string")
    return every.join(found, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("keys", F.lit(0)).alias("keys"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty if the columns are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_functional(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def first_position(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(F.min(F.struct(*order)).alias("_p")).select(key, "_p.*")


def distributions(df: DataFrame, categories: Mapping[str, Column]) -> DataFrame:
    """Counts of each label of each category, with the category's own population: a null label isn't part of it."""
    labels = F.explode(F.array(*[F.struct(F.lit(name).alias("category"), c.cast("string").alias("label")) for name, c in categories.items()])).alias("x")
    counted = df.select(labels).select("x.*").where("label is not null").groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("population", F.sum("n").over(Window.partitionBy("category")))


def sum_or_unknown(c: str) -> Column:
    """A sum that is null as soon as one value is: what isn't known isn't zero."""
    return F.when(F.count_if(F.col(c).isNull()) == 0, F.coalesce(F.sum(c), F.lit(0)))


def run_totals(df: DataFrame, status: str, statuses: Sequence[str], sums: Sequence[str], unknowable: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("positions"), *[F.count_if(F.col(status) == s).alias(s.lower()) for s in statuses],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[sum_or_unknown(c).alias(c) for c in unknowable],
    )


def violated_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; a rule that can't be told counts as broken."""
    broken = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))
    return df.withColumn("rule", broken)


def ratio(a: Column, b: Column) -> Column:
    """a / b as DOUBLE; null where b is 0 or unknown."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def balances(postings: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    return postings.groupBy(*keys).agg(F.sum(amount).alias("balance")).where("balance <> 0")


def unbalanced(postings: DataFrame, transaction: str, asset: str, amount: str) -> DataFrame:
    """Transactions and assets that don't sum to zero, have fewer than two postings, or an empty one."""
    out = postings.groupBy(transaction, asset).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(amount) == 0).alias("empty"))
    return out.where("total <> 0 or n < 2 or empty > 0")


def running_balance(postings: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str) -> DataFrame:
    """Adds balance: the sum of the key's amounts up to each row. A key of any size is spread over ranges of it; a null amount adds nothing."""
    return keyed_scan(postings, keys, order, F.col(amount), "balance", "sum")


def gram(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Sums for least squares in one row: x{i}_x{j}, x{i}_y, y_y, and n; x0 is 1."""
    cols = [F.lit(1).cast("decimal(18,0)"), *[F.col(c).cast("decimal(18,0)") for c in x]]
    t = F.col(y).cast("decimal(18,0)")
    sums = [F.sum((cols[i] * cols[j]).cast("decimal(28,0)")).alias(f"x{i}_x{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return df.agg(*sums, *[F.sum((c * t).cast("decimal(28,0)")).alias(f"x{i}_y") for i, c in enumerate(cols)], F.sum((t * t).cast("decimal(28,0)")).alias("y_y"), F.count(F.lit(1)).alias("n"))


def rank_percentile(df: DataFrame, keys: Sequence[str], column: str, percent: int, out: str) -> DataFrame:
    """The value at sorted place ((n - 1) * percent + 99) // 100 of each key: a value of the data, never between two.

    Rows are counted by value first, and values are dealt by ranges, so that a key of any size is spread: only the range that holds
    the place is looked into. Null values take no part; a null key is a key of its own.
    """
    names = list(keys)
    counted = df.where(F.col(column).isNotNull()).groupBy(*names, column).agg(F.count(F.lit(1)).alias("_c"))
    numbered = ranged(counted, [*names, column])
    parts = numbered.groupBy("_part", *names).agg(F.sum("_c").alias("_in_part"))
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_in_part").over(before), F.lit(0))).withColumn("_n", F.sum("_in_part").over(Window.partitionBy(*names)))
    aim = F.floor(((F.col("_n") - 1) * percent + 99) / 100)
    parts = parts.withColumn("_aim", aim).where((F.col("_aim") >= F.col("_ahead")) & (F.col("_aim") < F.col("_ahead") + F.col("_in_part")))
    parts = parts.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_{k}") for k in names], "_aim", "_ahead")
    rows = numbered.join(parts, [F.col("_part") == F.col("_of"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]])
    upto = F.col("_ahead") + F.sum("_c").over(Window.partitionBy("_part", *names).orderBy(column))
    return rows.withColumn("_upto", upto).where((F.col("_upto") > F.col("_aim")) & (F.col("_upto") - F.col("_c") <= F.col("_aim"))).select(*names, F.col(column).alias(out))


def fingerprint(df: DataFrame) -> DataFrame:
    """n and a sum of row hashes: the same for the same rows in any order."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_digest(df.columns)).alias("digest"))


def dense_keys(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values with whole numbers from 0 in sorted order, without a window over all rows in one task."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return _numbered(values, [column], out)


def with_ordinal(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Rows numbered from 0 by a total order."""
    return _numbered(df, order, out)


def _numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    parts = ranged(df, order)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    place = Window.partitionBy("_part").orderBy(*order)
    return parts.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.row_number().over(place) - 1).drop("_part", "_start")


def running_offset(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """Sum of the key's rows before, 0 for the first. A key of any size is spread over ranges of it; a null adds nothing, ties stand in any order."""
    return keyed_scan(df, keys, order, F.col(column), out, "sum", before=True).withColumn(out, F.coalesce(out, F.lit(0)))


def out_of_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Rows whose value is below the one before."""
    return df.withColumn("before", F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(column) < F.col("before"))


def missing_steps(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows that don't follow the one before by 1, with how many are missing."""
    out = df.withColumn("before", F.lag(column).over(Window.partitionBy(*keys).orderBy(column)))
    return out.withColumn("missing", F.col(column) - F.col("before") - 1).where("missing <> 0")


def shard_gaps(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Neighbouring ranges that leave a gap or overlap: gap (negative for an overlap)."""
    nxt = F.lead(lo).over(Window.partitionBy(*keys).orderBy(lo, hi))
    return df.withColumn("gap", nxt - F.col(hi)).where("gap <> 0")


def frontier(df: DataFrame, keys: Sequence[str], lo: str, hi: str, start: int) -> DataFrame:
    """How far ranges reach from ``start`` without a gap; ``start`` itself where none holds it."""
    so_far = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(F.col(hi) > start).withColumn("_reach", F.greatest(F.coalesce(F.max(hi).over(so_far), F.lit(start)), F.lit(start)))
    broken = F.max((F.col(lo) > F.col("_reach")).cast("int")).over(Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = rows.withColumn("_broken", broken).groupBy(*keys).agg(F.max(F.when(F.col("_broken") == 0, F.col(hi))).alias("_hi"))
    return df.select(*keys).distinct().join(reach, list(keys), "left").select(*keys, F.coalesce("_hi", F.lit(start)).alias("frontier"))


def dedup_by_priority(df: DataFrame, keys: Sequence[str], priority: str, payload: Sequence[str]) -> DataFrame:
    """One row a key, of the highest priority: its smallest payload, and conflict where rows of that priority differ.

    A null key is a key of its own, a null priority is below all others; payloads are compared as whole rows, nulls included. Both aggregations have partial sums.
    """
    whole = F.struct(*payload)
    rows = df.groupBy(*keys, priority).agg(F.min(whole).alias("_p"), F.max(whole).alias("_q"))
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(priority).alias("r"), "_p", "_q")).alias("_b"))
    return best.select(*keys, F.col("_b.r").alias(priority), *[F.col(f"_b._p.{c}").alias(c) for c in payload], (~F.col("_b._p").eqNullSafe(F.col("_b._q"))).alias("conflict"))


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def once_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """The column on the first row of each key, 0 on the others; a null key is a key of its own, and of rows that tie any one is the first."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn(out, F.when(first, F.col(column)).otherwise(0))


def with_group_counts(df: DataFrame, keys: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    every = Window.partitionBy(*keys)
    return df.withColumns({name: F.sum(F.when(test, 1).otherwise(0)).over(every) for name, test in tests.items()})


def hourly_spine(hourly: DataFrame, keys: Sequence[str], hour: str, counts: Sequence[str]) -> DataFrame:
    """A row for every hour from a key's first to its last; the counts of hours without rows are 0."""
    ends = hourly.groupBy(*keys).agg(F.min(hour).alias("_lo"), F.max(hour).alias("_hi"))
    every = ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(hour))
    return every.join(hourly, [*keys, hour], "left").na.fill(0, list(counts))


def trailing_features(hourly: DataFrame, keys: Sequence[str], hour: str, n: str, total: str, hits: str, hours: int = 6) -> DataFrame:
    """Over the hours before, the present one left out: trailing_n, trailing_total, trailing_hits, trailing_mean and trailing_share
    (null where no row is in them), hour_of_day. See hourly_spine() for hours without rows."""
    past = Window.partitionBy(*keys).orderBy(hour).rangeBetween(-hours, -1)
    out = hourly.withColumns({f"trailing_{name}": F.coalesce(F.sum(c).over(past), F.lit(0)) for name, c in (("n", n), ("total", total), ("hits", hits))}).withColumn("hour_of_day", F.pmod(F.col(hour), F.lit(24)))
    return out.withColumns({"trailing_mean": ratio(F.col("trailing_total"), F.col("trailing_n")), "trailing_share": ratio(F.col("trailing_hits"), F.col("trailing_n"))})


def cooldown(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], seconds: int) -> DataFrame:
    """Adds accepted: a row is accepted unless its key had an accepted row less than ``seconds`` before.

    Each accepted row depends on the one before, so no window frame can tell. But every time has one next time that would be accepted after it, the first
    one that is ``seconds`` later, and a time that follows no other within ``seconds`` is accepted for certain. What such times lead to is found by
    pointer doubling: each round twice as many steps are taken, so the rounds grow with the logarithm of the longest run of accepted rows without a pause. All of it are joins
    and scans by ranges, so a key may hold any share of the rows. Of rows of one time the first in ``order`` counts. A row without a time is accepted only as a key's first,
    where no row of the key has one; null keys are one key.
    """
    names = list(keys)
    place = [*[F.asc(k) for k in names], F.asc_nulls_last(time), *[F.asc_nulls_last(c) for c in order]]
    rows = checkpoint(df.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_id", F.monotonically_increasing_id()))
    firsts = rows.groupBy(*names).agg(F.min("_id").alias("_id")).select("_id")
    nodes = rows.where(F.col(time).isNotNull()).groupBy(*names, time).agg(F.min("_id").alias("_id"))
    if seconds <= 0:
        good = rows.where(F.col(time).isNotNull()).select("_id").union(firsts)
    else:
        nodes = keyed_scan(nodes, names, [time], F.col(time), "_before", before=True)
        nodes = nodes.select(*names, time, "_id", F.coalesce(F.col(time) - F.col("_before") >= seconds, F.lit(True)).alias("_sure"))
        later = nodes.select(*names, F.col(time).alias("_then"), F.col("_id").alias("_next"), F.col("_sure").alias("_next_sure"))
        leads = asof(nodes.withColumn("_due", F.col(time) + seconds), later, names, "_due", "_then", ["_next", "_next_sure"], forward=True)
        with Steps(df.sparkSession) as made:
            steps = made.table(leads.where("_next is not null and not _next_sure").select("_id", "_next"))
            good = made.table(nodes.where("_sure").select("_id").union(firsts).distinct())
            while not steps.isEmpty():
                good = made.table(good.union(good.join(steps, "_id").select(F.col("_next").alias("_id"))).distinct())
                further = steps.select(F.col("_id").alias("_next"), F.col("_next").alias("_far"))
                steps = made.table(steps.join(further, "_next").select("_id", F.col("_far").alias("_next")))
            good = checkpoint(good)
    good = good.distinct().withColumn("accepted", F.lit(True))
    return rows.join(good, "_id", "left").select(*df.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after a composite cursor."""
    rows = df
    if after is not None:
        rows = df.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]))
    return rows.orderBy(*keys).limit(limit)


def keyset_page_and_more(df: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after a composite cursor, with more: whether others follow. One row more is read for that. An empty page is the end."""
    page = keyset_page(df, keys, after, limit + 1)
    place = F.row_number().over(Window.orderBy(*keys))
    return page.withColumns({"_place": place, "more": F.count(F.lit(1)).over(Window.partitionBy()) > limit}).where(F.col("_place") <= limit).drop("_place")


def block_clock(df: DataFrame, block: str, payload: Sequence[str], sentinel: Mapping[str, object]) -> DataFrame:
    """One row a block: the least of each payload column, source_row_count, payload_variant_count, and sentinel: one variant only, and that of a block that wasn't made.

    Variants are whole rows, nulls included; a null block is a block of its own.
    """
    whole = F.struct(*payload)
    out = df.groupBy(block).agg(*[F.min(c).alias(c) for c in payload], F.count(F.lit(1)).alias("source_row_count"), F.count_distinct(whole).alias("payload_variant_count"))
    is_it = F.col("payload_variant_count") == 1
    for c, value in sentinel.items():
        is_it = is_it & F.col(c).eqNullSafe(F.lit(value))
    return out.withColumn("sentinel", is_it)


def canonical_sort(df: DataFrame, boundary: str, group: str, index: str, cause: str) -> DataFrame:
    """By boundary, group, index (a null first: the row of the whole transaction) and cause."""
    return df.orderBy(boundary, group, F.asc_nulls_first(index), cause)


def compare_runs(summaries: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    """A row for each metric and run."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return summaries.select(run, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))


def same_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that only one side has."""
    one, two = a.select(*on).distinct(), b.select(*on).distinct()
    return one.exceptAll(two).withColumn("side", F.lit("a")).union(two.exceptAll(one).withColumn("side", F.lit("b")))


def merge_streams(*frames: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The rows of all frames with the columns of any; with ``order`` (boundary, group, index, cause) in canonical order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out if order is None else canonical_sort(out, *order)


def market_cap_series(states: DataFrame, keys: Sequence[str], boundary: str, quote: str, base: str, supply: str, order: Sequence[str]) -> DataFrame:
    """The last state of each boundary as a market cap."""
    last = last_state(states, [*keys, boundary], [quote, base, supply], order)
    return last.withColumn("market_cap", market_cap(F.col(quote), F.col(supply), F.col(base)))


def chart_series(series: DataFrame, creations: DataFrame, signals: DataFrame, clock: DataFrame, key: str, boundary: str) -> DataFrame:
    """A series with the time of its blocks and a lifecycle: CREATED at its first point, ACTIVE, SIGNAL in blocks that have one.

    ``creations`` and ``signals`` have the key and the boundary, ``clock`` the boundary and time. Points before the creation, and series
    without a creation, a signal or a point at a signal, are marked in issue: NO_CREATION, BEFORE_CREATION, NO_SIGNAL, else null.
    """
    made = creations.groupBy(key).agg(F.min(boundary).alias("_made"))
    asked = signals.select(key, boundary).distinct().withColumn("_signal", F.lit(True))
    any_signal = signals.select(key).distinct().withColumn("_any", F.lit(True))
    out = series.join(made, key, "left").join(any_signal, key, "left").join(asked, [key, boundary], "left").join(clock.select(boundary, "time"), boundary, "left")
    issue = F.when(F.col("_made").isNull(), "NO_CREATION").when(F.col(boundary) < F.col("_made"), "BEFORE_CREATION").when(F.col("_any").isNull(), "NO_SIGNAL")
    life = F.when(F.col("_signal"), "SIGNAL").when(F.col(boundary) == F.col("_made"), "CREATED").when(F.col(boundary) > F.col("_made"), "ACTIVE")
    return out.withColumns({"lifecycle": life, "issue": issue}).drop("_made", "_any", "_signal")

"""Data-quality rules, each a table of violations, and their report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_in_block(events: DataFrame, clock: DataFrame, block: str, tx: str) -> DataFrame:
    """Events without a block, or past its number of transactions."""
    out = events.join(clock.select(F.col("block").alias(block), "tx_count"), block, "left")
    rule = F.when(F.col("tx_count").isNull(), "NO_BLOCK").when(F.col(tx) >= F.col("tx_count"), "PAST_END")
    return out.withColumn("rule", rule).where("rule is not null")


def check_shard(events: DataFrame, lo: int, hi: int, block: str, stored: str, computed: Column) -> DataFrame:
    """Rows outside their shard, or whose stored boundary isn't what it should be."""
    rule = F.when((F.col(block) < lo) | (F.col(block) >= hi), "OUTSIDE").when(F.col(stored) != computed, "BOUNDARY")
    return events.withColumn("rule", rule).where("rule is not null")


def check_groups(events: DataFrame, boundary: str, group: str, most: int) -> DataFrame:
    """Boundaries with more than one group, or with more than ``most`` rows."""
    out = events.groupBy(boundary).agg(F.countDistinct(group).alias("groups"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("rule", F.when(F.col("groups") > 1, "MANY_GROUPS").when(F.col("n") > most, "TOO_LARGE")).where("rule is not null")


def check_reserves(df: DataFrame, before: str, after: str, moved: str) -> DataFrame:
    return df.where(F.col(before) - F.col(moved) != F.col(after))


def quality_report(violations: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(rule, key, detail): one row for each violation of each rule; the second part names the key columns."""
    out = None
    for name, (df, keys) in violations.items():
        rest = [c for c in df.columns if c not in keys]
        row = df.select(F.lit(name).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in rest])).alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out


def verdicts(violations: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(rule, state): REFUTED with a violation, PROVEN without one, UNKNOWN where there was nothing to look at; rule -> (input, violations)."""
    out = None
    for name, (rows, bad) in violations.items():
        one = rows.limit(1).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bad.limit(1).agg(F.count(F.lit(1)).alias("bad"))))
        one = one.select(F.lit(name).alias("rule"), F.when(F.col("n") == 0, "UNKNOWN").when(F.col("bad") > 0, "REFUTED").otherwise("PROVEN").alias("state"))
        out = one if out is None else out.unionByName(one)
    return out


def verdicts_in_one_pass(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, state, checked, broken for rules on single rows, told in one scan: rules: name -> whether a row breaks it, null where it doesn't concern the row.

    REFUTED with a broken row, PROVEN where all that it concerns are right, UNKNOWN where it concerns none.
    """
    parts = [x for name, test in rules.items() for x in (F.count(test).alias(f"{name}_checked"), F.count_if(F.coalesce(test, F.lit(False))).alias(f"{name}_broken"))]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}_checked`").alias("checked"), F.col(f"`{n}_broken`").alias("broken")) for n in rules])
    out = df.agg(*parts).select(F.explode(rows).alias("x")).select("x.*")
    return out.select("rule", _state().alias("state"), "checked", "broken")


def verdicts_of_groups(df: DataFrame, rules: Mapping[str, tuple[Sequence[str], Sequence[Column], Column]]) -> DataFrame:
    """The same for rules on groups of rows: name -> (keys, named aggregates, whether a group with them breaks it). One aggregation a rule, with partial sums."""
    out = None
    for name, (keys, aggregates, test) in rules.items():
        groups = df.groupBy(*keys).agg(*aggregates).withColumn("_broken", test)
        one = groups.agg(F.count("_broken").alias("checked"), F.count_if("_broken").alias("broken")).select(F.lit(name).alias("rule"), _state().alias("state"), "checked", "broken")
        out = one if out is None else out.unionByName(one)
    return out


def _state() -> Column:
    return F.when(F.col("checked") == 0, "UNKNOWN").when(F.col("broken") > 0, "REFUTED").otherwise("PROVEN")

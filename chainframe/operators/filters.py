"""Filters, routing and normalisation of event rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.functions.scalar import program_mode


def successful_swaps(df: DataFrame, ok: Column, quote: str, asset, position: str, lo: int, hi: int) -> DataFrame:
    return df.where(ok & (F.col(quote) == asset) & (F.col(position) >= lo) & (F.col(position) < hi))


def side_filter(df: DataFrame, column: str, side: str) -> DataFrame:
    return df.where(F.upper(column) == side.upper())


def select_entities(df: DataFrame, column: str, ids: Sequence) -> DataFrame:
    """Rows of the ids; all rows if there are none. A long list becomes a join."""
    if not ids:
        return df
    if len(ids) <= 200:
        return df.where(F.col(column).isin(list(ids)))
    kind = df.schema[column].dataType
    return df.join(df.sparkSession.createDataFrame([(x,) for x in ids], f"{column} {kind.simpleString()}").distinct(), column, "left_semi")


def project(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Physical to canonical columns: mapping is new name -> old name."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def filter_by_class(df: DataFrame, classes: DataFrame, key: str, label: str, allowed: Sequence[str] | None) -> DataFrame:
    """Rows whose key has a class without an issue, one of the allowed ones if given; unknown keys are left out."""
    good = classes.where(F.col("issue") == "")
    if allowed is not None:
        good = good.where(F.col(label).isin(list(allowed)))
    return df.join(good.select(key, label), key)


def decode_uint(df: DataFrame, columns: Sequence[str], bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns are whole numbers below 2^bits, as DECIMAL(20,0), and the others as they are."""
    number = {c: F.when(F.col(c).cast("string").rlike("^[0-9]{1,20}$"), F.expr(f"try_cast(`{c}` as decimal(20,0))")) for c in columns}
    top = F.lit(str((1 << bits) - 1)).cast("decimal(20,0)")
    good = F.lit(True)
    for x in number.values():
        good = good & F.coalesce(x <= top, F.lit(False))
    marked = df.withColumn("_good", good)
    return marked.where("_good").drop("_good").withColumns(number), marked.where("not _good").drop("_good")


def route(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Adds reason: the first one that holds, or ACCEPTED. Every row gets exactly one."""
    out = None
    for name, test in reasons.items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return df.withColumn("reason", F.lit("ACCEPTED") if out is None else out.otherwise("ACCEPTED"))


def split_routes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("reason = 'ACCEPTED'").drop("reason"), df.where("reason <> 'ACCEPTED'")


def disposition_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def normalize_trades(df: DataFrame, shapes: Mapping[str, Mapping[str, Column]], kind: str, buy: Column) -> DataFrame:
    """One schema for several event shapes: base, quote, fee by kind; a buy gives quote for base, a sell base for quote."""
    pick = {}
    for name in ("base_amount", "quote_amount", "fee_amount"):
        out = None
        for shape, columns in shapes.items():
            out = F.when(F.col(kind) == shape, columns[name]) if out is None else out.when(F.col(kind) == shape, columns[name])
        pick[name] = out
    out = df.withColumns(pick).where(F.col("base_amount").isNotNull())
    return out.withColumns({"sold_amount": F.when(buy, F.col("quote_amount")).otherwise(F.col("base_amount")), "bought_amount": F.when(buy, F.col("base_amount")).otherwise(F.col("quote_amount"))})


def fee_components(amounts: Mapping[str, Column]) -> Column:
    """The fees that aren't zero, as an array of (component, amount)."""
    parts = F.array(*[F.struct(F.lit(n).alias("component"), c.alias("amount")) for n, c in amounts.items()])
    return F.filter(parts, lambda x: x["amount"] > 0)


def flag_sentinels(df: DataFrame, sentinel: Mapping[str, object], marker: str) -> DataFrame:
    """Adds sentinel: SENTINEL if all fields fit, BROKEN if only the marker does, else NONE."""
    whole = F.lit(True)
    for c, v in sentinel.items():
        whole = whole & F.col(c).eqNullSafe(F.lit(v))
    return df.withColumn("sentinel", F.when(whole, "SENTINEL").when(F.col(marker).eqNullSafe(F.lit(sentinel[marker])), "BROKEN").otherwise("NONE"))


def classify_keys(obs: DataFrame, meta: DataFrame, key: str, label: str) -> DataFrame:
    """A row for each observed key: its label, or UNKNOWN; repeats, and conflict where the evidence disagrees."""
    found = meta.groupBy(key).agg(F.min(label).alias(label), F.count(F.lit(1)).alias("source_rows"), (F.count_distinct(F.struct(label)) > 1).alias("conflict"))
    out = obs.select(key).distinct().join(found, key, "left")
    return out.select(key, F.coalesce(label, F.lit("UNKNOWN")).alias(label), F.coalesce("source_rows", F.lit(0)).alias("source_rows"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def appears_before(meta: DataFrame, obs: DataFrame, key: str, created: str, seen: str) -> DataFrame:
    """Keys that were created after they were first seen."""
    first = obs.groupBy(key).agg(F.min(seen).alias("first_seen"))
    return meta.join(first, key).where(F.col(created) > F.col("first_seen"))


def annotate(df: DataFrame, needed: Mapping[str, Column], route: Column) -> DataFrame:
    """Adds route and missing, the names of needed parts that aren't there, in the order given."""
    return df.withColumns({"route": route, "missing": F.array_compact(F.array(*[F.when(~have, F.lit(n)) for n, have in needed.items()]))})


def classify_launches(launches: DataFrame, transaction: Sequence[str], sol_paired: Column, mayhem: str, token_program: str, cashback: str, extended: str) -> DataFrame:
    """Adds class, reason and mode: every launch is ELIGIBLE with a mode, EXCLUDED (MAYHEM) or INVALID.

    INVALID: paired with another asset (QUOTE_ASSET), not the only launch of its transaction (SECOND_IN_TRANSACTION), or no
    mode fits its program (MODE). A null flag counts as not set, a null transaction as one of its own.
    """
    many = launches.groupBy(*transaction).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = launches.join(many, list(transaction), "left")
    mode = program_mode(F.col(token_program), F.coalesce(F.col(cashback), F.lit(False)), extended)
    reason = F.when(~F.coalesce(sol_paired, F.lit(False)), "QUOTE_ASSET").when(F.col("_n").isNotNull(), "SECOND_IN_TRANSACTION").when(F.col(mayhem), "MAYHEM").when(mode.isNull(), "MODE")
    out = out.withColumn("reason", reason).withColumn("class", F.when(F.col("reason").isNull(), "ELIGIBLE").when(F.col("reason") == "MAYHEM", "EXCLUDED").otherwise("INVALID"))
    return out.withColumn("mode", F.when(F.col("reason").isNull(), mode)).drop("_n")


def launch_counts(classified: DataFrame) -> DataFrame:
    """classified, eligible, excluded; classified leaves out what is INVALID, so that it is the sum of the others."""
    n = lambda *c: F.count_if(F.col("class").isin(*c))
    return classified.agg(n("ELIGIBLE", "EXCLUDED").alias("classified"), n("ELIGIBLE").alias("eligible"), n("EXCLUDED").alias("excluded"))

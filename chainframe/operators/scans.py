"""Running values along the rows of a key, for keys of any size.

Rows are dealt by ranges of (key, order), so a key that holds half of all rows is spread like any other. Each range is scanned by itself; what a key's rows come to in
one range is carried to the next ones by a table of one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.sources.tables import checkpoint


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df with _part, the number of its range in the order; written to the checkpoint folder, as ranges are drawn anew by every job otherwise."""
    return checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def keyed_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str, how: str = "last", descending: bool = False, before: bool = False) -> DataFrame:
    """Adds out: the ``last`` value that isn't null, or the ``sum``, over the rows of a key up to this one, along ``order``.

    With ``before`` the row itself is left out; with ``descending`` the order is read from its end. ``order`` must be total within a key where ties matter.
    A null key is a key of its own, nulls come first in the order (last, if descending). Null where there is nothing to sum or to take.
    """
    names, turn = list(by), (F.desc if descending else F.asc)
    rows = ranged(df.withColumn("_value", value), [*[F.asc(k) for k in names], *[turn(c) for c in order]])
    key, place = F.struct(F.lit(0).alias("_"), *names), F.struct(*order)
    fold = (lambda c: F.last(c, True)) if how == "last" else F.sum
    ends = rows.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    # what the last key of each range comes to there; tables of one row a range from here on
    tail = rows.join(F.broadcast(ends.select("_part", "_last")), "_part").where(key.eqNullSafe(F.col("_last")))
    pick = F.min_by if descending else F.max_by
    state = pick("_value", F.when(F.col("_value").isNotNull(), place)) if how == "last" else F.sum("_value")
    steps = ends.join(tail.groupBy("_part").agg(state.alias("_state")), "_part")
    so_far, previous = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.orderBy("_part")
    steps = steps.withColumn("_reached", fold(F.col("_state")).over(so_far))
    goes_on = F.lag("_last").over(previous).eqNullSafe(F.col("_first"))
    carried = steps.select("_part", "_first", F.when(goes_on, F.lag("_reached").over(previous)).alias("_carried"))
    inside = Window.partitionBy("_part", *names).orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    rows = rows.withColumn("_inside", fold(F.col("_value")).over(inside)).join(F.broadcast(carried), "_part")
    ahead = F.when(key.eqNullSafe(F.col("_first")), F.col("_carried"))
    if how == "last":
        both = F.coalesce("_inside", ahead)
    else:
        both = F.when(ahead.isNull(), F.col("_inside")).otherwise(ahead + F.coalesce("_inside", F.lit(0))).cast(rows.schema["_inside"].dataType)
    return rows.withColumn(out, both).drop("_part", "_value", "_inside", "_first", "_carried")

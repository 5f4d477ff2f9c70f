"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window partition holds on average.
BUCKET_ROWS = 20_000
_SPACE = 1 << 32


def shuffle_key(seed: int, *columns: str) -> Column:
    """A number in 0 .. 2^32-1 that depends on the seed and the columns; the same in any SQL that has md5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def _exact_rank(df: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Rank from 0 by (bucket, order) within a group. Windows hold one bucket each; the running total only has a row a bucket."""
    sizes = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(bucket) if not group else Window.partitionBy(*group).orderBy(bucket)
    starts = sizes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(bucket).alias("_b"), (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col(bucket) == F.col("_b")]
    ranked = df.withColumn("_row", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)))
    joined = ranked.join(starts, on)
    return joined.withColumn(out, F.col("_start") + F.col("_row") - 1).drop("_row", "_start", "_b", *[f"_{g}" for g in group])


def interleave(df: DataFrame, shards: int, strata: str = "source", key: str = "doc_id", text: str = "text", seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, size, text_crc32, shard, slot: every shard holds the strata in the proportions of the whole.

    Rows are shuffled by a seeded key within each stratum, take the fractional rank (rank + 1/2) / size, and
    are laid out in its order; shard i gets rows i*N/shards up to (i+1)*N/shards. Counts of rows differ by
    one at most. size is the UTF-8 bytes of the text plus 16; a null text has no bytes and crc32 0.
    A null stratum is a stratum of its own; a null key shuffles as an empty one. Equal keys and texts
    tie, and may change places. An empty table gives an empty result.
    No window holds more than about bucket_rows rows, however large a stratum is.
    """
    rows = df.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(strata).cast("string").alias("stratum"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("_mix", shuffle_key(seed, "doc_id"))
    total = df.count()
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("_of")).withColumnRenamed("stratum", "_stratum")
    rows = rows.join(counts, F.col("stratum").eqNullSafe(F.col("_stratum"))).drop("_stratum")
    pieces = F.ceil(F.col("_of") / F.lit(bucket_rows))
    rows = rows.withColumn("_bucket", F.floor(F.col("_mix") * pieces / F.lit(_SPACE)))
    rows = _exact_rank(rows, ["stratum"], "_bucket", ["_mix", F.asc_nulls_first("doc_id"), "text_crc32", "size"], "_rank").drop("_bucket")
    # the middle of the row's share of its stratum
    rows = rows.withColumn("_at", (F.col("_rank") * 2 + 1) / (F.col("_of") * 2))
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") * F.lit(max(1, -(-total // bucket_rows)))))
    rows = _exact_rank(rows, [], "_bucket", ["_at", F.asc_nulls_first("stratum"), "_rank"], "_place")
    shard = F.floor(F.col("_place") * shards / F.lit(max(1, total)))
    first = F.ceil(shard * F.lit(total) / F.lit(shards))
    return rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("_place") - first).cast("long").alias("slot"))


def shard_documents(df: DataFrame, shards: int = 40) -> DataFrame:
    """The interleaved shards with the law that they keep: counts of rows are at most one apart."""
    out = interleave(df, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

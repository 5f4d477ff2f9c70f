"""Paths along a shared clock: so many transactions later, then so many seconds later, and so on.

The clock is an index of two levels. Its leaves are ranges of LEAF blocks, one row each with arrays of blocks, first ordinals and times; its top, one entry a leaf, goes to every task.
Places meet the leaf that holds their next answer and take as many steps there as stay inside, in vectorised searches; only those that leave it are dealt again. Leaves
that many places ask for are read by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.sources.tables import Steps, checkpoint

#: Blocks of a leaf at most, and places that one task takes through it, about.
LEAF, PLACES = 1 << 12, 1 << 17

#: A step: ("transactions", n) to the n-th transaction after a place, over empty blocks too; ("seconds", s) to the first transaction of the first later
#: block that has one and is at least s seconds after the place's block.
Hop = tuple[str, int]


class Top(NamedTuple):
    """One entry a leaf: its number, the ordinal behind its last transaction, and the latest time of a block with transactions up to its end."""

    leaf: np.ndarray
    end: np.ndarray
    latest: np.ndarray


class Leaf(NamedTuple):
    blocks: np.ndarray
    prefix: np.ndarray
    ends: np.ndarray
    times: np.ndarray
    #: By index: the first block from there on that has transactions, or the number of blocks.
    full: np.ndarray


def _leaf(blocks: np.ndarray, prefix: np.ndarray, counts: np.ndarray, times: np.ndarray) -> Leaf:
    n = len(blocks)
    full = np.minimum.accumulate(np.append(np.where(counts > 0, np.arange(n), n), n)[::-1])[::-1]
    return Leaf(blocks, prefix, prefix + counts, times, full)


def _take_steps(leaf_no: int, leaf: Leaf | None, top: Top, hops: Sequence[Hop], s: dict[str, np.ndarray]) -> None:
    """Moves rows of one leaf as far as they get in it. ``s``: step, leaf, asked (an answer is known to be in the leaf), value, block, tx, done, to_block and to_tx (rows x hops)."""
    if leaf is None:
        s["done"][:] = True
        return
    own = int(np.searchsorted(top.leaf, leaf_no))
    for i, (kind, amount) in enumerate(hops):
        here = np.flatnonzero((s["step"] == i) & ~s["done"] & (s["leaf"] == leaf_no))
        fresh = here[~s["asked"][here]]
        if len(fresh):
            at = np.searchsorted(leaf.blocks, s["block"][fresh])
            known = leaf.blocks[np.minimum(at, len(leaf.blocks) - 1)] == s["block"][fresh]
            s["done"][fresh[~known]] = True  # not a block of the clock
            fresh, at = fresh[known], at[known]
            if kind == "transactions":
                value = leaf.prefix[at] + s["tx"][fresh] + amount
                to = np.searchsorted(top.end, value, "right")
            else:
                value = leaf.times[at] + amount
                inside = leaf.full[np.maximum(np.searchsorted(leaf.times, value), at + 1)] < len(leaf.blocks)
                to = np.where(inside, own, np.maximum(np.searchsorted(top.latest, value), own + 1))
            s["value"][fresh], s["asked"][fresh] = value, True
            past = to >= len(top.leaf)
            s["done"][fresh[past]] = True  # the clock ends before
            s["leaf"][fresh[~past]] = top.leaf[to[~past]]
        found = here[~s["done"][here] & (s["leaf"][here] == leaf_no)]
        if not len(found):
            continue
        value = s["value"][found]
        if kind == "transactions":
            j = np.searchsorted(leaf.ends, value, "right")
            tx = value - leaf.prefix[j]
        else:
            j = leaf.full[np.maximum(np.searchsorted(leaf.times, value), np.searchsorted(leaf.blocks, s["block"][found], "right"))]
            tx = np.zeros(len(found), np.int64)
        s["to_block"][found, i], s["to_tx"][found, i] = leaf.blocks[j], tx
        s["block"][found], s["tx"][found], s["step"][found], s["asked"][found] = leaf.blocks[j], tx, i + 1, False
    s["done"] |= s["step"] == len(hops)


_STATE = ("step", "leaf", "asked", "value", "block", "tx", "done")


def walk(rows: DataFrame, clock: DataFrame, hops: Sequence[Hop], row_id: str, block: str = "block", tx: str = "tx") -> DataFrame:
    """Adds places: an array of (block, tx), where each of ``hops`` leads to, one after another; null from where the clock ends on.

    ``clock`` has block, tx_count, time and prefix (see clock_prefix()); blocks are whole numbers, distinct, and times never fall along them. A block that isn't in the clock, or
    is null, leads nowhere. ``row_id`` names a row; rows that share it are walked by themselves only if they are equal.
    """
    if not hops or any(kind not in ("transactions", "seconds") or n < 1 for kind, n in hops):
        raise ValueError("a step is of transactions or seconds, at least one")
    spark, n = rows.sparkSession, len(hops)
    point = F.sort_array(F.collect_list(F.struct(F.col("block").cast("long").alias("b"), F.col("prefix").cast("long").alias("p"), F.col("tx_count").cast("long").alias("n"), F.col("time").cast("long").alias("t"))))
    index = clock.groupBy(F.floor(F.col("block") / LEAF).alias("leaf")).agg(point.alias("_x")).select("leaf", *[F.col(f"_x.{c}").alias(c) for c in "bpnt"])
    index = checkpoint(index)
    full = F.array_max(F.expr("transform(filter(arrays_zip(n, t), x -> x.n > 0), x -> x.t)"))
    tops = index.select("leaf", (F.element_at("p", -1) + F.element_at("n", -1)).alias("end"), full.alias("latest")).orderBy("leaf").collect()
    low = -(1 << 62)
    top = Top(np.array([x.leaf for x in tops], np.int64), np.array([x.end for x in tops], np.int64), np.maximum.accumulate(np.array([low if x.latest is None else x.latest for x in tops], np.int64)) if tops else np.zeros(0, np.int64))
    id_type = rows.schema[row_id].dataType.simpleString()
    schema = f"id {id_type}, step int, leaf long, asked boolean, value long, block long, tx long, done boolean, to_block array<long>, to_tx array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaf = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "part", "place")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if lo == hi:
                    continue
                if not keys[2, lo]:
                    now, leaf = keys[:2, lo].tolist(), _leaf(*(np.array(batch.column(c)[lo].as_py(), np.int64) for c in "bpnt"))
                    continue
                part = batch.slice(lo, hi - lo)
                s = {c: part.column(c).to_numpy(zero_copy_only=False).copy() for c in _STATE}
                for c in ("to_block", "to_tx"):
                    s[c] = part.column(c).flatten().to_numpy().reshape(-1, n).copy()
                _take_steps(int(keys[0, lo]), leaf if now == keys[:2, lo].tolist() else None, top, hops, s)
                lists = [pa.ListArray.from_arrays(np.arange(0, s[c].size + 1, n, dtype=np.int32), s[c].ravel()) for c in ("to_block", "to_tx")]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(s[c]) for c in _STATE], *lists], ["id", *_STATE, "to_block", "to_tx"])

    none = F.array(*[F.lit(-1).cast("long")] * n)
    here = F.col(block).cast("long")
    state = rows.where(here.isNotNull() & F.col(tx).isNotNull()).select(F.col(row_id).alias("id"), F.lit(0).alias("step"), F.floor(here / LEAF).alias("leaf"), F.lit(False).alias("asked"), F.lit(0).cast("long").alias("value"), here.alias("block"), F.col(tx).cast("long").alias("tx"), F.lit(False).alias("done"), none.alias("to_block"), none.alias("to_tx"))
    state, walked, steps = state.distinct(), None, Steps(spark)
    state = steps.table(state)
    while True:
        crowds = state.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PLACES).alias("parts"))
        asked = state.join(crowds, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts").withColumn("place", F.lit(1))
        leaves = index.join(crowds, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").withColumn("place", F.lit(0))
        both = asked.unionByName(leaves, allowMissingColumns=True).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "place")
        moved = steps.table(both.mapInArrow(run, schema))
        done = moved.where("done")
        walked = done if walked is None else walked.union(done)
        state = moved.where("not done")
        if state.isEmpty():
            break
    with steps:
        walked = checkpoint(walked)
    places = F.transform(F.arrays_zip("to_block", "to_tx"), lambda x: F.when(x["to_block"] >= 0, F.struct(x["to_block"].alias("block"), x["to_tx"].alias("tx"))))
    out = rows.join(walked.select(F.col("id").alias("_id"), places.alias("places")), F.col(row_id).eqNullSafe(F.col("_id")), "left").drop("_id")
    nowhere = F.expr(f"array_repeat(cast(null as struct<block: bigint, tx: bigint>), {n})")
    return out.withColumn("places", F.coalesce("places", nowhere))

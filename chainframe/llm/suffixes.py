"""Removal of byte strings that occur more than once, by induced sorting of suffixes with common prefixes.

Sorting every suffix of a corpus would move many times its size. As in induced sorting, only a sample of
suffixes is sorted, and the order of the others follows from it. The sample is the leftmost minimum of a hash over
each ``reach`` positions: every string of ``size`` bytes holds such a place, at an offset that its own bytes decide, so
equal strings have it at the same offset. Sampled suffixes are dealt by a hash of the bytes that follow in all their strings
(a bucket), sorted there on disk by Spark, and neighbours get the length of their common prefix. From offset to
offset to the left the order is induced: stable by the byte in front, the common prefix being one more than the least
one between two suffixes. A string occurs again exactly if a neighbour at its offset shares ``size`` bytes.

A bucket too wide for one task is dealt anew by longer stretches: strings at neighbouring offsets share all but a few
of their bytes with whatever they can be equal to, so a hash of these parts the bucket, and each part is sorted and induced over
its own few offsets; in the last round over one. Every string goes this way, whatever the size of its bucket.

Places whose whole surroundings are equal are one suffix with a count, so copies cost nothing.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm import common
from chainframe.llm.substrings import _powers, version

REACH = 128
GRAM = 16
#: Bytes that are hashed in one go; longer documents are cut into overlapping pieces.
PIECE = 1 << 21
#: Different surroundings in one bucket from which on it is dealt anew, by ranges of so many offsets each round.
WIDE_BUCKET = 20_000
ROUNDS = (16, 1)
#: Suffixes that are induced together.
TOGETHER = 4096
_LOW = (1 << 23) - 1


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any stretches of one array of bytes."""

    def __init__(self, data: np.ndarray, odd: int = 0x9E3779B97F4A7C15):
        n = len(data)
        up, self.down = _powers(odd, 1 << max(12, n.bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_byte_values()[data] * up[:n], dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _finish((self.sums[end] - self.sums[begin]) * self.down[begin])


def least_in_reach(values: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of each stretch of ``reach`` values; as many results as such stretches."""
    n = len(values)
    padded = np.full(-(-n // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - reach + 1], ahead[reach - 1 : n])


def sampled(data: np.ndarray, ends: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of pieces that stand one after the other: (place, first string, last string, bucket, surroundings) of all sampled suffixes.

    ``ends`` are where the pieces end. Strings first..last are those of ``size`` bytes whose sampled place this is.
    """
    n = len(data)
    if n < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = (hashes.of(at, at + GRAM) & ~np.uint64(_LOW)) | at.astype(np.uint64)
    least = least_in_reach(grams, reach)
    whole = np.ones(n - size + 1, bool)
    for end in ends[:-1]:
        whole[max(0, end - size + 1) : end] = False
    begin = np.flatnonzero(whole)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    place = (least[begin] & np.uint64(_LOW)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)])
    first, last, place = begin[new], begin[np.r_[new[1:], len(begin)] - 1], place[new]
    bucket = hashes.of(place, place + size - reach + 1)
    with np.errstate(over="ignore"):
        around = _finish(hashes.of(first, last + size) + (place - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (last - first).astype(np.uint64))
    return place, first, last, bucket, around


def pieces(text: bytes, size: int):
    """(offset, bytes) of overlapping pieces that hold every string of ``size`` bytes once."""
    for at in range(0, max(1, len(text) - size + 1), PIECE):
        yield at, text[at : at + PIECE + size - 1]


def suffixes(docs: DataFrame, size: int, reach: int) -> DataFrame:
    """(doc, ver, text) -> bucket, around, doc, at, ext: at is the first string's place, ext = ver * 2^16 + left * 2^8 + strings - 1."""

    def make():
        def rows(held: list[tuple[int, int, int, bytes]]):
            ends = np.cumsum([len(x[3]) for x in held])
            data = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
            place, first, last, bucket, around = sampled(data, ends, size, reach)
            which = np.searchsorted(ends, first, side="right")
            base = np.array([x[2] for x in held]) - np.r_[0, ends[:-1]]
            return {
                "bucket": bucket.view(np.int64), "around": around.view(np.int64), "doc": np.array([x[0] for x in held])[which], "at": first + base[which],
                "ext": (np.array([x[1] for x in held])[which] << 16) + ((place - first) << 8) + (last - first),
            }

        def step(batch: pa.RecordBatch):
            held, total = [], 0
            for part in common.slices(batch):
                for doc, ver, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    if len(data) < size:
                        continue
                    for at, piece in pieces(data, size):
                        if total + len(piece) > PIECE + size and held:
                            yield rows(held)
                            held, total = [], 0
                        held.append((doc, ver, at, piece))
                        total += len(piece)
            if held:
                yield rows(held)

        return step

    return common.map_batches(docs, make, "bucket long, around long, doc long, at long, ext long")


def _surroundings(rows: DataFrame, size: int) -> DataFrame:
    """(text, list of (bucket, around, at, ext)) -> bucket, around, left (strings' bytes in front of the place), right (from it on)."""

    def make():
        def step(batch: pa.RecordBatch):
            for part in common.slices(batch, 256):
                out = {"bucket": [], "around": [], "left": [], "right": []}
                for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    for x in wanted:
                        left, more = x["ext"] >> 8 & 255, x["ext"] & 255
                        out["bucket"].append(x["bucket"])
                        out["around"].append(x["around"])
                        out["left"].append(data[x["at"] : x["at"] + left])
                        out["right"].append(data[x["at"] + left : x["at"] + more + size])
                yield out

        return step

    return common.map_batches(rows, make, "bucket long, around long, left binary, right binary")


def induce(bucket: np.ndarray, left: list[bytes], right: list[bytes], size: int, low: int = 0, high: int = 255) -> list[np.ndarray]:
    """For suffixes in order of (bucket, right): the offsets to the left, low to high, at which a string occurs again in the bucket.

    The ``low`` bytes to the left of the suffixes of a bucket must be equal.
    """
    n, deep = len(bucket), min(high, max(map(len, left), default=0))
    after = np.frombuffer(b"".join(x[:size].ljust(size, b"\0") for x in right), np.uint8).reshape(n, size)
    before = np.frombuffer(b"".join(x[::-1][: deep + 1].ljust(deep + 1, b"\0") for x in left), np.uint8).reshape(n, deep + 1)
    r_len, l_len = np.array([min(len(x), size) for x in right]), np.array([len(x) for x in left])
    _, group = np.unique(bucket, return_inverse=True)
    # common prefix with the suffix before; -1 where another bucket begins
    same = after[1:] == after[:-1]
    length = np.where(same.all(1), size, same.argmin(1))
    length = np.minimum(length, np.minimum(r_len[1:], r_len[:-1])) + low
    common_prefix = np.concatenate([[-1], np.where(bucket[1:] == bucket[:-1], length, -1)])
    order, found = np.arange(n), [[] for _ in range(n)]
    for offset in range(low, deep + 1):
        if offset > low:
            here = np.flatnonzero(l_len[order] >= offset)
            if not len(here):
                break
            byte = before[order[here], offset - 1]
            by = np.argsort(group[order[here]] * 256 + byte, kind="stable")
            spot = here[by]  # places in the order before, in the new order
            suffix, front = order[spot], byte[by]
            together = np.flatnonzero((group[suffix[1:]] == group[suffix[:-1]]) & (front[1:] == front[:-1])) + 1
            fresh = np.full(len(spot), -1)
            if len(together):
                edges = np.stack([spot[together - 1] + 1, spot[together] + 1], 1).ravel()
                fresh[together] = np.minimum.reduceat(np.append(common_prefix, 0), edges)[::2] + 1
            order, common_prefix = suffix, fresh
        again = common_prefix >= size
        again[:-1] |= again[1:]
        for i in order[again]:
            found[i].append(offset)
    return [np.array(x, np.int64) for x in found]


def _split(rows: DataFrame, size: int, step: int) -> DataFrame:
    """(bucket, around, low, high, left, right) -> the same with key, for each range of ``step`` offsets: a hash of the bytes that all strings of the range have."""

    def make():
        def step_of(batch: pa.RecordBatch):
            for part in common.slices(batch, 512):
                out = {k: [] for k in ("key", "bucket", "around", "low", "high", "left", "right")}
                for bucket, around, low, high, left, right in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    first, last = max(low, size - len(right)), min(high, len(left))
                    for at in range(first - first % step, last + 1, step):
                        end = at + step - 1
                        held = (left[len(left) - at :] if at else b"") + b"\0" + right[: size - end]
                        out["key"].append(xxhash.xxh3_64_intdigest(held, bucket % (1 << 64) ^ at) - (1 << 63))
                        for name, value in (("bucket", bucket), ("around", around), ("low", at), ("high", min(end, last)), ("left", left[-end:] if end else b""), ("right", right[: size - at])):
                            out[name].append(value)
                yield out

        return step_of

    columns = rows.select("bucket", "around", "low", "high", "left", "right")
    return common.map_batches(columns, make, "key long, bucket long, around long, low int, high int, left binary, right binary")


def _sorted(rows: DataFrame, size: int) -> DataFrame:
    """Sorts the suffixes of each key on disk and induces: bucket, around, offsets. ``low`` must be one for each key.

    A task holds TOGETHER suffixes and those of one key; over one offset only neighbours count, so there no key is held as a whole.
    """
    dealt = rows.repartition(common.partitions(rows.sparkSession), "key").sortWithinPartitions("low", "key", "right")
    schema = pa.schema([("bucket", pa.int64()), ("around", pa.int64()), ("offsets", pa.list_(pa.int32()))])

    def run(batches):
        held: list[tuple] = []

        def out(rows):
            got = induce(np.array([x[0] for x in rows]), [x[5] for x in rows], [x[6] for x in rows], size, rows[0][3], max(x[4] for x in rows))
            keep = [i for i, x in enumerate(got) if len(x)]
            return pa.RecordBatch.from_pydict({"bucket": [rows[i][1] for i in keep], "around": [rows[i][2] for i in keep], "offsets": [got[i].tolist() for i in keep]}, schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held:
                    last = held[-1]
                    if last[3] != row[3] or (len(held) >= TOGETHER and last[0] != row[0]):
                        yield out(held)
                        held = []
                    elif len(held) >= TOGETHER and row[3] == row[4]:
                        yield out(held)
                        held = [last]  # once more, as the neighbour of the next one
                held.append(row)
        if held:
            yield out(held)

    return dealt.select("key", "bucket", "around", "low", "high", "left", "right").mapInArrow(run, "bucket long, around long, offsets array<int>")


def repeated_strings(docs: DataFrame, size: int, reach: int = REACH) -> DataFrame:
    """(doc, ver, text) -> doc, ver, runs: the (from, to) of strings of ``size`` bytes that also begin elsewhere."""
    with common.Scratch(docs.sparkSession) as scratch:
        rows = suffixes(docs, size, reach)
        often = scratch.table(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket"))
        rows = scratch.table(rows.join(often, "bucket").select("bucket", "around", "doc", "at", "ext"))
        kinds = rows.groupBy("bucket", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at", "ext")).alias("one"))
        wide = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        kinds = scratch.table(kinds.join(wide, "bucket", "left").select("bucket", "around", "n", "one", "m"))
        ask = kinds.where("m is not null").select(F.col("one.doc").alias("doc"), F.shiftright("one.ext", 16).alias("ver"), F.struct("bucket", "around", F.col("one.at").alias("at"), F.col("one.ext").alias("ext"), "m").alias("x"))
        ask = ask.groupBy("doc", "ver").agg(F.collect_list("x").alias("wanted"))
        found = docs.join(ask, ["doc", "ver"])

        def near(condition: str) -> DataFrame:
            some = found.select("text", F.expr(f"filter(wanted, x -> {condition})").alias("wanted")).where("size(wanted) > 0")
            return _surroundings(some, size).withColumns({"key": F.col("bucket"), "low": F.lit(0), "high": F.lit(reach - 1)})

        solved = scratch.table(_sorted(near(f"x.m <= {WIDE_BUCKET}"), size))
        rest = near(f"x.m > {WIDE_BUCKET}") if kinds.where(F.col("m") > WIDE_BUCKET).limit(1).count() else None
        for step in ROUNDS:
            if rest is None:
                break
            parts = scratch.table(_split(rest, size, step))
            many = scratch.table(parts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.lit(step > 1) & (F.col("m") > WIDE_BUCKET)).select("key"))
            solved = solved.union(scratch.table(_sorted(parts.join(many, "key", "left_anti"), size)))
            rest = parts.join(many, "key", "left_semi") if many.limit(1).count() else None
        solved = solved.groupBy("bucket", "around").agg(F.array_distinct(F.flatten(F.collect_list("offsets"))).alias("offsets"))
        # a table of its own, so that Spark can split the places of one very common surrounding in the join
        known = scratch.table(kinds.select("bucket", "around", "n").join(solved, ["bucket", "around"], "left").where("n > 1 or offsets is not null"))
        left, more = F.shiftright("ext", 8).bitwiseAND(255), F.col("ext").bitwiseAND(255)
        # all strings of a place that occurs as a whole, or the runs of those offsets that were found
        place = F.col("at") + left
        each = F.transform(F.array_sort("offsets"), lambda d: F.struct((place - d).alias("from"), (place - d).alias("to")))
        runs = F.when(F.col("n") > 1, F.array(F.struct(F.col("at").alias("from"), (F.col("at") + more).alias("to")))).otherwise(each)
        out = rows.join(known, ["bucket", "around"]).select("doc", F.shiftright("ext", 16).alias("ver"), F.explode(runs).alias("run"))
        return common.write_stage(out.groupBy("doc", "ver").agg(F.collect_list("run").alias("runs")), "runs")


def remove_strings(df: DataFrame, size: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (bytes): each text without the bytes that a repeated string covers.

    A string of ``size`` bytes is repeated if it also begins anywhere else, in the same document or another; all its
    places lose it. A null text is empty. Rows that share an id and text are copies of one another like any others.
    A row without an id takes part like any other. ``kept`` need not be valid UTF-8. An empty table gives an empty result; other
    columns are left out, whatever their names. Texts of any length are read in overlapping pieces of PIECE bytes.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key).cast("long")).alias("doc"), version(text).alias("ver"), F.col(text).alias("text"))
    runs = repeated_strings(docs.where("text is not null").select("doc", "ver", "text"), size)
    rows = docs.join(runs, ["doc", "ver"], "left").select("doc_id", "text", F.col("runs.from").alias("froms"), F.col("runs.to").alias("tos"))

    def make():
        def step(batch: pa.RecordBatch):
            for part in common.slices(batch):
                out = {"key": part.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                for doc, froms, tos in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                    data = np.frombuffer((doc or "").encode("utf-8", "surrogatepass"), np.uint8)
                    spans = 0
                    if froms:
                        edge = np.zeros(len(data) + 1, np.int64)
                        np.add.at(edge, froms, 1)
                        np.add.at(edge, np.array(tos) + size, -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        left = data[~gone]
                    else:
                        left = data
                    for name, value in (("n_bytes", len(data)), ("n_removed", len(data) - len(left)), ("n_spans", spans), ("kept", left.tobytes())):
                        out[name].append(value)
                yield out

        return step

    return common.map_batches(rows, make, "key long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("key", key)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; nulls, repeats and the like as for remove_strings()."""
    out = remove_strings(df.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

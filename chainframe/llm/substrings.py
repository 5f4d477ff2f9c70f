"""Removal of long word passages that an earlier document has, found by difference-cover anchors.

D is a difference cover modulo v: every difference of two positions occurs between two members of D. So two
equal windows, wherever they begin, have a common shift below v that brings both to a position in D. Only the
short windows at such positions are hashed and compared; each shared one is an anchor, and only the long
windows around shared anchors are then compared in full.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm import common

#: Words that are hashed in one go; a longer document takes several turns.
TURN = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences modulo the period are all residues."""

    def grow(chosen: tuple[int, ...], size: int) -> tuple[int, ...] | None:
        seen = {(a - b) % period for a in chosen for b in chosen}
        if len(seen) == period:
            return chosen
        left = size - len(chosen)
        if len(seen) + 2 * (left * len(chosen) + left * (left - 1) // 2) < period:
            return None
        return next((found for x in range(chosen[-1] + 1, period) if (found := grow((*chosen, x), size))), None)

    return next(found for size in range(1, period + 1) if (found := grow((0, 1)[: min(size, period)], size)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; faster than a look into a large cache, and without its memory."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd number and of its inverse modulo 2^64; one table for each number, as long as has been asked for."""
    if odd not in _tables or len(_tables[odd][0]) < n:
        with np.errstate(over="ignore"):
            _tables[odd] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
    return _tables[odd]


def windows(hashes: np.ndarray, size: int, odd: int = _ODD[0]) -> np.ndarray:
    """Hash of every window of ``size`` items: the same for the same items, wherever they stand."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(odd, 1 << max(12, (n - 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(hashes * up[:n], dtype=np.uint64)]
        out = (sums[size:] - sums[:-size]) * down[: n - size + 1]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def turns(n: int, size: int):
    """(first, last + 1) of overlapping stretches that hold every window of a sequence of n once."""
    for at in range(0, max(1, n - size + 1), TURN):
        yield at, min(n, at + TURN + size - 1)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but the six ASCII white space characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def version(column: str = "text"):
    """Tells apart rows that share an id; rows with the same text share it."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).bitwiseAND(F.lit((1 << 31) - 1))


def _rows(out: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {n: np.concatenate(parts).view(np.int64) for n, parts in zip(names, zip(*out, strict=True), strict=True)}


def anchors(docs: DataFrame, size: int, period: int) -> DataFrame:
    """(doc, ver, text) -> h, doc, at: hashes of the short windows at cover positions; at is ver * 2^32 + position."""
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    short = size - period + 1

    def make():
        def step(batch: pa.RecordBatch):
            for part in common.slices(batch):
                out = []
                for doc, ver, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = words_of(text)
                    if len(found) < size:
                        continue
                    for a, b in turns(len(found), short):
                        h = windows(word_hashes(found[a:b]), short)
                        at = np.arange(a, a + len(h))
                        use = cover[at % period]
                        out.append((h[use], np.full(use.sum(), doc), at[use] + (ver << 32)))
                if out:
                    yield _rows(out, ("h", "doc", "at"))

        return step

    return common.map_batches(docs, make, "h long, doc long, at long")


def candidates(docs: DataFrame, size: int, period: int) -> DataFrame:
    """(doc, ver, text, marks) -> h, g, doc, at: two hashes of every window that holds a shared anchor at a place where both could be aligned."""

    def make():
        def step(batch: pa.RecordBatch):
            for part in common.slices(batch):
                out = []
                for doc, ver, text, marks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = words_of(text)
                    n = len(found) - size + 1
                    if n <= 0:
                        continue
                    edge = np.zeros(len(found) + 2, np.int64)
                    marks = np.asarray(marks)
                    np.add.at(edge, np.maximum(marks - period + 1, 0), 1)
                    np.add.at(edge, marks + 1, -1)
                    near = np.cumsum(edge)[:n] > 0
                    for a, b in turns(len(found), size):
                        use = np.flatnonzero(near[a : b - size + 1])
                        if len(use):
                            h = word_hashes(found[a:b])
                            out.append((windows(h, size)[use], windows(h, size, _ODD[1])[use] >> np.uint64(33), np.full(len(use), doc), use + a + (ver << 32)))
                if out:
                    yield _rows(out, ("h", "g", "doc", "at"))

        return step

    return common.map_batches(docs, make, "h long, g long, doc long, at long")


def _place(df: DataFrame, name: str) -> DataFrame:
    """One row a document: doc, ver and the list of positions."""
    at = F.col("at")
    rows = df.select("doc", F.shiftright(at, 32).alias("ver"), at.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("p"))
    return rows.groupBy("doc", "ver").agg(F.collect_list("p").alias(name))


def repeated_starts(df: DataFrame, size: int = 50, period: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, ver, starts: where windows of ``size`` words begin that also begin in a document with a smaller id."""
    if not 1 <= period < size:
        raise ValueError("the period must be below the window size")
    docs = df.select(F.col(key).cast("long").alias("doc"), version(text).alias("ver"), F.col(text).alias("text")).where("doc is not null and text is not null")
    short = anchors(docs, size, period)
    with common.Scratch(df.sparkSession) as scratch:
        # what is shared is a table of its own, so that Spark can split the rows of one very common passage in the joins
        shared = scratch.table(short.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h"))
        marked = scratch.table(_place(short.join(shared, "h").select("doc", "at"), "marks"))
        long = candidates(docs.join(marked, ["doc", "ver"]).select("doc", "ver", "text", "marks"), size, period)
        first = scratch.table(long.groupBy("h", "g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h", "g", "lo"))
        return common.write_stage(_place(long.join(first, ["h", "g"]).where("doc > lo").select("doc", "at"), "starts"), "starts")


def remove_repeats(df: DataFrame, size: int = 50, period: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n_words, n_removed and kept to the rows of df: kept has the words that are left, joined by one space.

    A word goes if a window of ``size`` words covers it whose words also begin in a document with a smaller id;
    windows are judged on the input. A null text has no words. A row without an id keeps everything and
    is no copy of anything. Rows that share an id are no copies of each other; each row gets its own
    result. Columns named n_words, n_removed or kept are replaced, others stay whatever their names. An empty table gives an
    empty result; texts of any length are read in overlapping turns of TURN words.
    """
    starts = repeated_starts(df, size, period, key, text)
    others = [c for c in df.columns if c not in ("n_words", "n_removed", "kept")]
    mark = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in others), default=0))  # names that no column has
    doc_, ver_, starts_ = f"{mark}doc", f"{mark}ver", f"{mark}starts"
    rows = df.select(*[F.col(f"`{c}`") for c in others], F.col(key).cast("long").alias(doc_), version(text).alias(ver_))
    starts = starts.select(F.col("doc").alias(doc_), F.col("ver").alias(ver_), F.col("starts").alias(starts_))
    rows = rows.join(starts, [doc_, ver_], "left").select(*[F.col(f"`{c}`") for c in others], starts_)
    struct = common.T.StructType([*rows.select(*[F.col(f"`{c}`") for c in others]).schema.fields, *common.T._parse_datatype_string("n_words long, n_removed long, kept string").fields])
    at = others.index(text)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                n_words, n_removed, kept = [], [], []
                for doc, begun in zip(part.column(at).to_pylist(), part.column(len(others)).to_pylist(), strict=True):
                    found = words_of(doc)
                    if begun:
                        edge = np.zeros(len(found) + 1, np.int64)
                        begun = np.unique(begun)
                        np.add.at(edge, begun, 1)
                        np.add.at(edge, begun + size, -1)
                        stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                        left = [found[i] for i in stay]
                    else:
                        left = found
                    n_words.append(len(found))
                    n_removed.append(len(found) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                columns = [*(part.column(i) for i in range(len(others))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, struct)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; nulls, repeats and the like as for remove_repeats()."""
    out = remove_repeats(df.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))

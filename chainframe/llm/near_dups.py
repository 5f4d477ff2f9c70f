"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation.

A signature has CHUNKS * WIDTH positions of 16 bits. Each chunk of WIDTH positions is indexed once for every
choice of ERRORS positions that may differ. By the pigeonhole principle two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) positions agree in some chunk but for ERRORS positions, and so share a key. Most pairs further
apart share one too: at a similarity of 0.8 a pair without any common key has a chance of two in a million.

Copies of one shingle set are one class from the start. A bucket of many classes is not spread into pairs: its
members meet its most central one, the hub, and most are linked by that. Members of components that are
still different are then told apart by their edits, the shingles in which they differ from the hub: two sets are as far
apart as their edits are, so linked ones share many. In any fixed order they share one among the first
few (prefix filtering), and only pairs that do are compared. That is exact. The order is by how many of the hub's neighbours have the edit, as told by a
bounded sample of them, the rarest first: edits that many of them share, as families of documents do, come last, so that they
don't bring all their holders together. Pairs still grow faster than the members where these have too few edits of their own to fill the prefix:
then the hub's own shingles, of which there are only so many, bring them together.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.llm import common
from chainframe.llm.graph import components
from chainframe.llm.substrings import version, windows, word_hashes

CHUNKS, WIDTH, ERRORS = 10, 5, 1
#: Of the positions of two signatures, by the low 4 bits of each, how many may differ: 4.6 standard deviations above the mean at 0.8.
CHECK_POSITIONS = 22
#: Buckets of up to so many classes are compared in pairs; the members of larger ones by their edits.
PAIRED = 16
#: Documents that share a key with another, up to which their ids are sent to every task to pick their texts; more meet them in a shuffle.
SENT_ROWS = 500_000
#: Neighbours of a hub, those of lowest hash, by which its edits are ordered, and how many of them must share an edit that isn't rare.
NEIGHBOURS, COMMON = 64, 3
#: Numbers of edits that are this factor apart at most are looked up together.
BAND = 1.5
_MARKS = ("c1", "c2", "c3", "c4")
_P = CHUNKS * WIDTH


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of ``size``; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(size, len(words))))


def signatures(sets: list[np.ndarray], seed: int = 11) -> np.ndarray:
    """A row of 16-bit positions for each set; none may be empty."""
    draw = np.random.default_rng(seed)
    odd = draw.integers(0, 1 << 63, _P, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, _P, dtype=np.uint64)
    flat, begin = _mix(np.concatenate(sets)), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), _P), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(_P):
            x = flat * odd[i] + add[i]
            out[:, i] = np.minimum.reduceat(x ^ (x >> np.uint64(33)), begin)
    return _mix(out) & np.uint64(0xFFFF)


def index_keys(signature: np.ndarray) -> np.ndarray:
    """For each chunk and each choice of ERRORS positions in it, a key of the other positions."""
    parts = _mix(signature + (np.arange(_P, dtype=np.uint64) << np.uint64(20)) + np.uint64(1)).reshape(len(signature), CHUNKS, WIDTH)
    keys = []
    with np.errstate(over="ignore"):
        whole = parts.sum(2, dtype=np.uint64)
        for choice, left_out in enumerate(combinations(range(WIDTH), ERRORS)):
            rest = whole - parts[:, :, left_out].sum(2, dtype=np.uint64)
            keys.append(_mix(rest + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(977) + np.uint64(choice)))
    return np.concatenate(keys, 1)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """(doc, ver, text) -> doc, ver, n (shingles), fa, fb (fingerprint of the set), c1 to c4 (low 4 bits of each position), keys."""

    def make():
        def step(batch: pa.RecordBatch):
            for part in common.slices(batch, 512):
                sets = [shingles(x, size) for x in part.column(2).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                prints, checks, keys = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), len(_MARKS)), np.uint64), [[]] * len(sets)
                if full:
                    begin, flat = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1], np.concatenate([sets[i] for i in full])
                    with np.errstate(over="ignore"):
                        for j, salt in enumerate((0x1234567, 0x89ABCDEF01)):
                            prints[full, j] = np.add.reduceat(_mix(flat + np.uint64(salt)), begin)
                    sig = signatures([sets[i] for i in full])
                    low = (sig & np.uint64(15)) << (np.arange(_P, dtype=np.uint64) % np.uint64(13) * np.uint64(4))
                    for j in range(len(_MARKS)):
                        checks[full, j] = low[:, 13 * j : 13 * (j + 1)].sum(1, dtype=np.uint64)
                    for i, row in zip(full, index_keys(sig).view(np.int64).tolist(), strict=True):
                        keys[i] = row
                yield {
                    "doc": part.column(0), "ver": part.column(1), "n": [len(s) for s in sets],
                    "fa": prints[:, 0].copy().view(np.int64), "fb": prints[:, 1].copy().view(np.int64), "keys": keys, **{c: checks[:, j].copy().view(np.int64) for j, c in enumerate(_MARKS)},
                }

        return step

    return common.map_batches(docs, make, "doc long, ver long, n long, fa long, fb long, c1 long, c2 long, c3 long, c4 long, keys array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, ver, text) -> doc, ver, set (sorted hashes of 8 bytes each)."""

    def make():
        def step(batch: pa.RecordBatch):
            for part in common.slices(batch, 256):
                yield {"doc": part.column(0), "ver": part.column(1), "set": [shingles(x, size).astype("<u8").tobytes() for x in part.column(2).to_pylist()]}

        return step

    return common.map_batches(docs.select("doc", "ver", "text"), make, "doc long, ver long, set binary")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("doc").alias("b"), F.col("ver").alias("b_ver"), F.col("set").alias("b_set"))
    two = sets.select(F.col("doc").alias("a"), F.col("ver").alias("a_ver"), F.col("set").alias("a_set"))
    return pairs.join(one, ["b", "b_ver"]).join(two, ["a", "a_ver"])


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted y."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Of (a, a_ver, b, b_ver) the a, b of those whose full shingle sets have 100 * intersection >= share * union."""

    def make():
        def step(batch: pa.RecordBatch):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                same = int(_inside(x, y).sum())
                good.append(100 * same >= share * (len(x) + len(y) - same))
            yield {"a": [v for v, g in zip(a, good, strict=True) if g], "b": [v for v, g in zip(b, good, strict=True) if g]}

        return step

    return common.map_batches(_with_sets(pairs, sets).select("a", "b", "a_set", "b_set"), make, "a long, b long").distinct()


def _bands() -> list[int]:
    """Where the bands of numbers of edits begin."""
    out = [1]
    while out[-1] < 1 << 32:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


def prefixes(edits: int, n: int, share: int, bands: list[int], least: int = 1) -> list[tuple[int, int]]:
    """(band, how many of the first edits) for every band in which a linked partner of a set of n shingles can lie.

    ``least`` is the least number of edits that a partner has. Linked sets x, y differ in no more than (100 - share) * (|x| + |y|) / (100 + share) shingles, so of their edits
    at least half of what the numbers come to beyond that is shared.
    """
    apart, out = (100 - share) * (n + n * 100 // share) // (100 + share), []
    for i in range(len(bands) - 1):
        low, high = max(bands[i], edits - apart, least), min(bands[i + 1] - 1, edits + apart)
        if bands[i] > edits + apart:
            break
        if low > high:
            continue
        shared = max(1, -((apart - edits - low) // 2))
        if shared <= min(edits, high):
            out.append((i, edits - shared + 1))
    return out


def _edits(x: np.ndarray, hub: np.ndarray) -> np.ndarray:
    return np.concatenate([x[~_inside(x, hub)], hub[~_inside(hub, x)]])


def common_edits(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, a_ver: the hub; b, b_ver) -> a, a_ver, edits, counts: the edits that COMMON or more of NEIGHBOURS of its neighbours have."""
    place = Window.partitionBy("a", "a_ver").orderBy(F.xxhash64("b", "b_ver"), "b", "b_ver")
    few = met.select("a", "a_ver", "b", "b_ver").distinct().withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= NEIGHBOURS)

    def make():
        def step(batch: pa.RecordBatch):
            for a, a_ver, x, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edits = _edits(np.frombuffer(x, "<u8"), np.frombuffer(h, "<u8")).view(np.int64)
                if len(edits):
                    yield {"a": np.full(len(edits), a), "a_ver": np.full(len(edits), a_ver), "edit": edits}

        return step

    rows = common.map_batches(_with_sets(few, sets).select("a", "a_ver", "b_set", "a_set"), make, "a long, a_ver long, edit long")
    counted = rows.groupBy("a", "a_ver", "edit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    out = counted.groupBy("a", "a_ver").agg(F.sort_array(F.collect_list(F.struct("edit", "n"))).alias("x"))
    return out.select("a", "a_ver", F.col("x.edit").alias("edits"), F.col("x.n").alias("counts"))


def edit_prefixes(met: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, a_ver, a_comp: the hub; b, b_ver, comp) -> at, i, b, b_ver, comp, n, d, mine: the first edits of b for each band of partners.

    A member of the hub's own component only looks for members of others, which are not linked with the hub and so have
    many edits. ``at`` is a hash of hub, edit and the two bands; ``i`` the place of the edit among the d of b, ``mine`` whether b's band
    is the lower one (0), the higher one (1) or both are one (2).
    """
    bands = _bands()

    def make():
        def step(batch: pa.RecordBatch):
            out: list[tuple] = []
            rows = 0
            for a, a_ver, a_comp, b, b_ver, comp, x, h, often, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, h = np.frombuffer(x, "<u8"), np.frombuffer(h, "<u8")
                edits = _edits(x, h)
                if not len(edits):
                    continue  # the hub itself, which has met all
                if often:  # the rarest first; equal ones stay in order, those of the document before those of the hub
                    often, n = np.array(often, np.int64), np.zeros(len(edits), np.int64)
                    at = np.minimum(np.searchsorted(often, edits.view(np.int64)), len(often) - 1)
                    known = often[at] == edits.view(np.int64)
                    n[known] = np.array(counts, np.int64)[at[known]]
                    edits = edits[np.argsort(n, kind="stable")]
                mine = np.searchsorted(bands, len(edits), side="right") - 1
                with np.errstate(over="ignore"):
                    hub = np.uint64(a & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(a_ver)
                    least = 1 if comp != a_comp else (100 - share) * (len(x) * share // 100 + len(h)) // (100 + share) + 1
                    for other, k in prefixes(len(edits), len(x), share, bands, least):
                        pair = np.uint64(min(mine, other) * 64 + max(mine, other))
                        at = _mix(_mix(edits[:k] + hub) + pair * np.uint64(0xC2B2AE3D27D4EB4F))
                        same = (b, b_ver, comp, len(x), len(edits), 2 if mine == other else int(mine > other))
                        out.append((at, np.arange(k), *(np.full(k, v, np.int64) for v in same)))
                        rows += k
                if rows > 1 << 16:
                    yield _columns(out)
                    out, rows = [], 0
            if out:
                yield _columns(out)

        return step

    rows = _with_sets(met, sets).join(common_edits(met, sets), ["a", "a_ver"], "left").select("a", "a_ver", "a_comp", "b", "b_ver", "comp", "b_set", "a_set", "edits", "counts")
    return common.map_batches(rows, make, "at long, i long, b long, b_ver long, comp long, n long, d long, mine long")


def _columns(rows: list[tuple]) -> dict[str, np.ndarray]:
    names = ("at", "i", "b", "b_ver", "comp", "n", "d", "mine")
    return {name: np.concatenate(parts).view(np.int64) for name, parts in zip(names, zip(*rows, strict=True), strict=True)}


def _share_edits(rows: DataFrame, share: int) -> DataFrame:
    """Pairs of different components that share one of their first edits, and so may share enough: a, a_ver, b, b_ver."""
    other = rows.where("mine <> 0").select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    one = rows.where("mine <> 1")
    apart = F.floor((F.col("n") + F.col("_n")) * F.lit(100 - share) / F.lit(100 + share))
    shared = F.ceil((F.col("d") + F.col("_d") - apart) / 2)
    early: Column = (F.col("i") <= F.col("d") - shared) & (F.col("_i") <= F.col("_d") - shared)
    sizes = (F.col("n") * 100 >= F.col("_n") * share) & (F.col("_n") * 100 >= F.col("n") * share)
    # of rows with one band each pair is met from both sides
    once = (F.col("comp") < F.col("_comp")) | ((F.col("mine") == 0) & (F.col("comp") > F.col("_comp")))
    met = one.join(other, (F.col("at") == F.col("_at")) & once & sizes & early)
    return met.select(F.col("b").alias("a"), F.col("b_ver").alias("a_ver"), F.col("_b").alias("b"), F.col("_b_ver").alias("b_ver")).distinct()


def _close(share: int):
    """Whether the columns and those with an underscore in front can belong to linked documents, by size and signature."""
    differ = F.lit(0)
    for c in _MARKS:
        x = F.col(c).bitwiseXOR(F.col(f"_{c}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return (F.col("n") * 100 >= F.col("_n") * share) & (F.col("_n") * 100 >= F.col("n") * share) & (differ <= CHECK_POSITIONS)


def link(df: DataFrame, size: int = 5, share: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, ver, n, component: the smallest id among all documents that chains of links reach.

    ``ver`` is the version() of the text: rows with equal id and text have one result. Rows that share an id are one
    document of several texts, and linked by any of them. Rows without words or without a text have n = 0 and are their
    own component, as are rows without an id, whose component is null. An empty table gives an empty result;
    other columns are left out, whatever their names. Whole texts count, however long.
    """
    docs = df.select(F.col(key).cast("long").alias("doc"), version(text).alias("ver"), F.col(text).alias("text"))
    with common.Scratch(df.sparkSession) as scratch:
        all_rows = scratch.table(describe(docs, size))
        some = all_rows.where("n > 0 and doc is not null")
        classes = some.groupBy("fa", "fb", "n").agg(F.min(F.struct("doc", "ver")).alias("rep"), *[F.first(c).alias(c) for c in (*_MARKS, "keys")])
        classes = scratch.table(classes.select("fa", "fb", "n", *_MARKS, "keys", F.col("rep.doc").alias("doc"), F.col("rep.ver").alias("ver")))
        entries = classes.select("doc", "ver", F.explode("keys").alias("key"))
        shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        entries = scratch.table(entries.join(shared, "key").select("key", "doc", "ver", "m"))
        # how many others a document shares keys with: the centre of a group of near copies has most
        weights = entries.groupBy("doc", "ver").agg(F.sum("m").alias("weight"))
        marks = scratch.table(classes.select("doc", "ver", "n", *_MARKS).join(weights, ["doc", "ver"]))
        asked = marks.select("doc", "ver")
        asked = F.broadcast(asked) if asked.count() <= SENT_ROWS else asked
        texts = docs.where("doc is not null and text is not null").join(asked, ["doc", "ver"], "left_semi").dropDuplicates(["doc", "ver"])
        sets = scratch.table(shingle_sets(texts, size))

        def marked(rows: DataFrame, side: str, mark: str) -> DataFrame:
            columns = [F.col(c).alias(f"{mark}{c}") for c in ("n", *_MARKS)]
            return rows.join(marks.select(F.col("doc").alias(side), F.col("ver").alias(f"{side}_ver"), *columns), [side, f"{side}_ver"])

        # in every bucket all meet the most central member
        order = F.struct((-F.col("weight")).alias("w"), "doc", "ver")
        hubs = entries.join(marks.select("doc", "ver", "weight"), ["doc", "ver"]).groupBy("key").agg(F.min(order).alias("hub"))
        entries = scratch.table(entries.join(hubs, "key").select("key", "doc", "ver", "m", F.col("hub.doc").alias("hub"), F.col("hub.ver").alias("hub_ver")))
        met = entries.where("doc <> hub or ver <> hub_ver").select(F.col("hub").alias("a"), F.col("hub_ver").alias("a_ver"), F.col("doc").alias("b"), F.col("ver").alias("b_ver")).distinct()
        met = marked(marked(met, "b", ""), "a", "_").where(_close(share)).select("a", "a_ver", "b", "b_ver")
        linked = scratch.table(confirm(met, sets, share))
        labels = components(linked, scratch)
        # members of components that are still different meet one another: in pairs, or by their edits
        rows = entries.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        hubs_own = F.max(F.when((F.col("doc") == F.col("hub")) & (F.col("ver") == F.col("hub_ver")), F.col("comp")))
        mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), hubs_own.alias("hub_comp")).where("lo < hi").select("key", "hub_comp")
        rows = scratch.table(rows.join(mixed, "key"))
        few = marked(rows.where(F.col("m") <= PAIRED).select("key", F.col("doc").alias("a"), F.col("ver").alias("a_ver"), "comp"), "a", "")
        other = few.select(F.col("key").alias("_key"), F.col("a").alias("b"), F.col("a_ver").alias("b_ver"), *[F.col(c).alias(f"_{c}") for c in ("n", *_MARKS, "comp")])
        pairs = few.join(other, (F.col("key") == F.col("_key")) & (F.col("comp") < F.col("_comp")) & _close(share)).select("a", "a_ver", "b", "b_ver")
        many = rows.where(F.col("m") > PAIRED).select(F.col("hub").alias("a"), F.col("hub_ver").alias("a_ver"), F.col("hub_comp").alias("a_comp"), F.col("doc").alias("b"), F.col("ver").alias("b_ver"), "comp").distinct()
        edited = scratch.table(edit_prefixes(many, sets, share))
        pairs = scratch.table(pairs.union(_share_edits(edited, share)).distinct())
        labels = components(linked.union(confirm(pairs, sets, share)), scratch)
        final = classes.join(labels, "doc", "left").select("fa", "fb", "n", F.coalesce("comp", "doc").alias("comp"))
        out = all_rows.select("doc", "ver", "n", "fa", "fb").join(final, ["fa", "fb", "n"], "left")
        return common.write_stage(out.select("doc", "ver", "n", F.when(F.col("doc").isNotNull(), F.coalesce("comp", "doc")).alias("component")), "components")


def component_documents(df: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; nulls, repeats and the like as for link()."""
    out = link(df.select("doc_id", "text"), size)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))

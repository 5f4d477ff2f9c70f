"""Documents that hold passages of a benchmark, give or take edits.

Windows as long as an item are embedded by CGK random walks, which turn edit distance into Hamming
distance: the walk copies the symbol that it stands on and moves on or not by a random bit of the
symbol and the step. Repeated samples of a few positions of the embedding are looked up among the items'
samples; each pair that meets is then checked by the exact edit distance. Symbols are words, without case and punctuation.

Before that, windows that hold too few of the benchmark's word pairs are left out. That loses nothing: one edit
undoes two of an item's word pairs at most.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm import common
from chainframe.llm.substrings import windows

#: Walks, samples of each, positions in a sample. At a fifth of the words edited, 0.998 of items are found by substitutions, 0.993 by insertions, 0.975 by deletions.
WALKS, SAMPLES, POSITIONS = 6, 8, 3
#: UTF-8 bytes of the items that are broadcast at once; a larger benchmark takes more passes over the documents.
PASS_BYTES = 16 << 20
GATE_BITS = 22
#: Steps of walks that are held at once, over all windows that are embedded together.
CELLS = 1 << 22
#: Scripts that put no spaces between words (Thai, Lao, Khmer, Myanmar, kana, Han): there each character is a word.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[^\W{_ALONE}]+|[{_ALONE}]")
_SPACED = re.compile(r"\w+")


#: Stands for every word that no item has.
_FOREIGN = 0x9E3779B97F4A7C15


_HAS_ALONE = re.compile(f"[{_ALONE}]")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_WORD if not text.isascii() and _HAS_ALONE.search(text) else _SPACED).findall(text)


def allowed(n: int, percent: int) -> int:
    """Edits that an item of n words may have."""
    return n * percent // 100


def walk(symbols: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embedding of each row; rows end with a column of zeros, on which the walk stays."""
    rows, at = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    out = np.empty((len(symbols), steps), np.uint64)
    turn = np.random.default_rng(seed).integers(1, 1 << 63, steps, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(steps):
            out[:, j] = here = symbols[rows, at]
            at = np.minimum(at + ((here * turn[j]) >> np.uint64(63)).astype(np.int64), symbols.shape[1] - 1)
    return out


def samples(symbols: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """WALKS * SAMPLES keys of each window; windows that begin at one place share its row of symbols, and so its walks."""
    keys, draw = [], np.random.default_rng(77)
    for seed in range(WALKS):
        walked = walk(symbols, 2 * (symbols.shape[1] - 1), seed)
        for _ in range(SAMPLES):
            key = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(keys))
            with np.errstate(over="ignore"):
                for u in draw.random(POSITIONS):
                    at = (u * 1.7 * lengths).astype(np.int64)  # the walk takes about two steps a symbol
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + walked[row, at]
            keys.append(key ^ (key >> np.uint64(31)))
    return np.stack(keys, 1)


def edit_distance_inside(item: list[str], text: list[str]) -> int:
    """Least edit distance, in words, between the item and any stretch of the text."""
    best = np.zeros(len(text) + 1, np.int64)
    cost = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        diagonal = best[:-1] + np.fromiter((w != t for t in text), bool, len(text))
        now = np.concatenate([[i], np.minimum(diagonal, best[1:] + 1)])
        best = np.minimum.accumulate(now - cost) + cost
    return int(best.min())


class Index:
    """The items, ready to be found in texts. Items too short for any edit are looked up by the hash of all their words."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.percent, self.items = percent, [(i, w) for i, t in items if (w := words_of(t))]
        #: The words of the items; all others are one symbol, which no item has.
        self.known = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for _, words in self.items for w in words}
        self.gate = np.zeros(1 << GATE_BITS, bool)
        self.table: dict[int, list[int]] = {}
        self.exact: dict[int, dict[int, list[int]]] = {}
        edited = []
        for at, (_, w) in enumerate(self.items):
            if allowed(len(w), percent):
                edited.append((at, self.hashes(w)))
            else:
                key = int(windows(self.hashes(w), len(w))[0])
                self.exact.setdefault(len(w), {}).setdefault(key, []).append(at)
        self.lengths = sorted({len(h) for _, h in edited})
        self.need = {n: n - 1 - 2 * allowed(n, percent) for n in self.lengths}
        if edited:
            self.wide = self.lengths[-1]
            for _, h in edited:
                self.gate[windows(h, 2) >> np.uint64(64 - GATE_BITS)] = True
            for some in range(0, len(edited), self.together):
                part = edited[some : some + self.together]
                for (at, _), keys in zip(part, samples(self._rows([h for _, h in part]), np.arange(len(part)), np.array([len(h) for _, h in part])).tolist(), strict=True):
                    for k in keys:
                        self.table.setdefault(k, []).append(at)
            self.keys = np.sort(np.fromiter(self.table, np.uint64, len(self.table)))
            self.key_gate = np.zeros(1 << GATE_BITS, bool)
            self.key_gate[self.keys >> np.uint64(64 - GATE_BITS)] = True

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(_FOREIGN)), np.uint64, len(words))

    @property
    def together(self) -> int:
        """Windows that are embedded at once: a walk takes twice as many steps as the longest item has words."""
        return max(1, CELLS // (2 * self.wide + 2))

    def _rows(self, hashes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(hashes), self.wide + 1), np.uint64)
        for i, h in enumerate(hashes):
            out[i, : len(h)] = h
        return out

    def windows_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the windows that hold enough of the benchmark's word pairs."""
        if len(h) < 2 or not self.lengths:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hits = self.gate[windows(h, 2) >> np.uint64(64 - GATE_BITS)]
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(hits, dtype=np.int32), np.full(self.wide, hits.sum(), np.int32)])
        starts = [np.flatnonzero(total[n - 1 : n - 1 + len(hits)] - total[: len(hits)] >= self.need[n]) for n in self.lengths]
        return np.concatenate(starts), np.repeat(self.lengths, [len(x) for x in starts])

    def search(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text its items and their distances."""
        found = [{} for _ in texts]
        words = [words_of(text) for text in texts]
        ends = np.cumsum([len(w) for w in words])
        flat = self.hashes([x for w in words for x in w])
        for n, table in self.exact.items():
            self._whole(n, table, flat, ends, words, found)
        # a window that runs on into the next text only has more pairs than its own; it is cut where its text ends
        start, length = self.windows_of(flat)
        order = np.argsort(start, kind="stable")
        meets: dict[tuple[int, int], list[int]] = {}
        step = self.together if len(order) else 1
        for at in range(0, len(order), step):
            now = order[at : at + step]
            places, row = np.unique(start[now], return_inverse=True)
            text = np.searchsorted(ends, places, side="right")
            symbols = self._rows([flat[p : min(p + self.wide, ends[t])] for p, t in zip(places, text, strict=True)])
            keys = samples(symbols, row, length[now])
            rows, columns = np.nonzero(self.key_gate[keys >> np.uint64(64 - GATE_BITS)])
            some = keys[rows, columns]
            hit = self.keys[np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)] == some
            for w, k in zip(rows[hit], columns[hit], strict=True):
                i = int(text[row[w]])
                for item in self.table[int(keys[w, k])]:
                    starts = meets.setdefault((i, item), [])
                    begin = int(places[row[w]] - ends[i] + len(words[i]))
                    if not starts or starts[-1] != begin:
                        starts.append(begin)
        for (i, item), starts in meets.items():
            number, w = self.items[item]
            k = allowed(len(w), self.percent)
            for run in np.split(np.array(starts), np.flatnonzero(np.diff(starts) > 2 * k + 1) + 1):
                distance = edit_distance_inside(w, words[i][max(0, run[0] - k) : run[-1] + len(w) + k])
                if distance <= k and distance < found[i].get(number, k + 1):
                    found[i][number] = distance
        return found

    def _whole(self, n: int, table: dict[int, list[int]], flat: np.ndarray, ends: np.ndarray, words: list[list[str]], found: list[dict[int, int]]) -> None:
        """Adds the items of n words whose words stand in a text as they are."""
        keys, hashes = np.sort(np.fromiter(table, np.uint64, len(table))), windows(flat, n)
        at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes)
        text = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[text]
        at, text = at[inside], text[inside]
        _, one = np.unique(np.stack([text.astype(np.uint64), hashes[at]], 1), axis=0, return_index=True)
        for p, i in zip(at[one].tolist(), text[one].tolist(), strict=True):
            begin = p - int(ends[i]) + len(words[i])
            for item in table[int(hashes[p])]:
                number, w = self.items[item]
                if words[i][begin : begin + n] == w:
                    found[i][number] = 0


def _passes(items: DataFrame, key: str, text: str):
    """The items in parts of PASS_BYTES at most; each part is all that the driver holds."""
    part, total = [], 0
    for number, words in items.select(F.col(key).cast("long"), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()).orderBy(key, text).toLocalIterator():
        part.append((number, words))
        total += len(words.encode("utf-8", "surrogatepass"))
        if total > PASS_BYTES:
            yield tuple(part)
            part, total = [], 0
    if part:
        yield tuple(part)


def mark(df: DataFrame, items: DataFrame, percent: int = 20, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds leaks to the rows of df: (item, distance) of every item that the text holds with at most percent of its words edited.

    Whole texts are searched. A null or empty text, and an empty benchmark, give no leaks. Items with a null id or text, or
    without words, take no part; an item too short for an edit is found where all its words stand as they are. Repeated rows get
    equal results; of items that share an id the nearest counts. A column named leaks is replaced, others stay whatever their names. No shuffle.
    """
    others = [c for c in df.columns if c != "leaks"]
    fresh = next(name for n in range(len(others) + 1) if (name := f"_leaks{n}") not in others)
    pair = "array<struct<item:long,distance:int>>"
    out = df.select(*[F.col(f"`{c}`") for c in others]).withColumn("leaks", F.array().cast(pair))
    at = others.index(text)
    for part in _passes(items, item_key, item_text):
        sent = df.sparkSession.sparkContext.broadcast(part)
        struct = common.T.StructType([*out.drop("leaks").schema.fields, *common.T._parse_datatype_string(f"{fresh} array<long>, leaks {pair}").fields])

        def run(batches, sent=sent, name=uuid.uuid4().hex):
            index = common.worker_state(("items", name), lambda: Index(list(sent.value), percent))
            for batch in batches:
                for piece in common.slices(batch, 512):
                    new = [[v for pair in sorted(x.items()) for v in pair] for x in index.search(piece.column(at).to_pylist())]
                    yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(new, pa.list_(pa.int64())), piece.columns[-1]], names=[*others, fresh, "leaks"])

        out = out.mapInArrow(run, struct)
        pairs = F.transform(F.sequence(F.lit(1), F.size(fresh), F.lit(2)), lambda i: F.struct(F.element_at(fresh, i).alias("item"), F.element_at(fresh, i + 1).cast("int").alias("distance")))
        out = out.withColumn("leaks", F.when(F.size(fresh) > 0, F.concat("leaks", pairs)).otherwise(F.col("leaks"))).drop(fresh)
    return out


def leaks(docs: DataFrame, items: DataFrame, percent: int = 20) -> DataFrame:
    """doc_id, item_id, distance: one row for each item that a document holds."""
    out = mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, percent)
    return out.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", F.col("x.item").alias("item_id"), "x.distance").distinct()

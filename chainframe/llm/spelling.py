"""Spelling variants: words of a vocabulary that differ by one inserted, deleted or replaced character.

The index of a block of words is bit-sliced: for each position and letter a bitset tells which words have that letter there. A query
word walks over its letters with two bitsets, of words without an error so far and of words with one; a missing or extra letter reads the bitsets of the
position beside its own. Each step treats 64 words at once, and many queries together.

Blocks come from a pigeonhole argument: of two words a letter or none apart in length and one error apart, either the first half of the shorter
length is the same in both, or what follows it. So a word goes to a block by its first half and to one by its rest, and a pair counts in the second only if its first halves
differ. Blocks grow in number with the vocabulary, not in size; one that is large all the same, as many words share a half, is cut, and its words are looked up in each part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.llm import common

# Letters of a run, the share of runs that lose a letter.
RUN, EVERY = r"[A-Za-zÀ-ÿ]+", 97
#: Words of a block, about, and of a part of a block at most, about; long words make smaller parts.
BLOCK_WORDS, PART_WORDS, PART_LETTERS = 2048, 4096, 1 << 18
#: Queries that walk together.
TOGETHER = 256
#: Different words that a task counts before it hands them on.
COUNTED = 1 << 18

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(doc: int | None, text: str) -> Counter[str]:
    """The words of a document and how often each occurs, after some runs have lost a letter."""
    runs = Counter(re.findall(RUN, text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run in [run for run in runs if not zlib.crc32(run.encode(), start) % EVERY]:
        n, at = runs.pop(run), zlib.crc32(run.encode(), start) % len(run)
        # what is left is counted under a key that no run has, as it may be a run of the text itself
        runs["-" + run[:at] + run[at + 1 :]] += n
    return runs


def vocabulary(df: DataFrame, least_letters: int, least_count: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of at least so many letters and occurrences. Each task adds up what it reads before words are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out():
            words = [w for w in seen if len(w) >= least_letters]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])

        for batch in (x for rows in batches for x in common.slices(rows, 256)):
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(doc, whole).items():
                    seen[word[1:] if word[0] == "-" else word] += n
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    counts = df.select(F.col(key).cast("long"), common.text_or_empty(text).alias("text")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _blocks(words: DataFrame) -> DataFrame:
    """short, side, block, part, indexed, word, n: the parts in which words meet all that can be near them.

    ``short`` is the shorter length of the pairs that meet there; side 0 goes by the first half of it, side 1 by the rest.
    """
    size = F.char_length("word")
    lengths = words.groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("n_words"))
    both = F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("short")
    blocks = lengths.select("length", "n_words", both).groupBy("short").agg(F.ceil(F.sum("n_words") / BLOCK_WORDS).alias("blocks"), F.max(F.col("length") == F.col("short")).alias("any")).where("any").drop("any")
    half = F.floor(F.col("short") / 2).cast("int")
    keys = F.array(F.substring("word", F.lit(1), half), F.expr("right(word, short - cast(floor(short / 2) as int))"))
    copies = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("short"))
    # one row for each length; a corpus of n letters has less than sqrt(2 n) lengths of runs
    copies = copies.select("word", "n", "short", F.posexplode(keys).alias("side", "half")).join(F.broadcast(blocks), "short")
    copies = copies.select("word", "n", "short", "side", F.pmod(F.xxhash64("half"), F.col("blocks")).alias("block"))
    place = ["short", "side", "block"]
    most = F.greatest(F.lit(1), F.least(F.lit(PART_WORDS), F.floor(F.lit(PART_LETTERS) / F.col("short"))))
    wide = copies.groupBy(*place).agg(F.count(F.lit(1)).alias("n_words")).where(F.col("n_words") > most).select(*place, F.ceil(F.col("n_words") / most).alias("parts"))
    dealt = copies.join(wide, place, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word", F.lit(3)), F.col("parts"))
    return dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*place, "part", (F.col("part") == own).alias("indexed"), "word", "n")


class Index:
    """Bit-sliced positions of words of length ``short`` and of one letter more, the most frequent words first."""

    def __init__(self, words: list[tuple[str, int]], short: int, side: int):
        self.words = sorted(words, key=lambda x: (-x[1], x[0]))
        self.short, self.side, self.half = short, side, short // 2
        n = len(self.words)
        self.width = (n + 63) // 64
        codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w, _ in self.words]
        every = np.concatenate(codes)
        self.letters = np.unique(every)
        word = np.repeat(np.arange(n), [len(c) for c in codes])
        position = np.concatenate([np.arange(len(c)) for c in codes])
        at, row = np.unique(position * len(self.letters) + np.searchsorted(self.letters, every), return_inverse=True)
        # row 0 has no bit: letters that no word has at a position
        self.bits = np.zeros((len(at) + 1, self.width), np.uint64)
        np.add.at(self.bits, (row + 1, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
        self.row = np.zeros((short + 3, len(self.letters) + 1), np.int64)
        self.row[at // len(self.letters), at % len(self.letters)] = np.arange(1, len(at) + 1)
        lengths = np.array([len(c) for c in codes])
        self.of_length = {m: self._set(np.flatnonzero(lengths == m)) for m in (short, short + 1)}

    def _set(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        np.add.at(out, numbers >> 6, np.uint64(1) << (numbers & 63).astype(np.uint64))
        return out

    def near(self, queries: list[str]) -> np.ndarray:
        """Bitsets of the words one error away from each query; the queries have one length. Pairs of the longer length are not of this index."""
        n, m = len(queries), len(queries[0])
        codes = np.frombuffer("".join(queries).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, m)
        at = np.searchsorted(self.letters, codes)
        at[self.letters[np.minimum(at, len(self.letters) - 1)] != codes] = len(self.letters)  # a letter of no word
        exact = np.full((n, self.width), ~np.uint64(0))
        replaced, moved = np.zeros_like(exact), np.zeros_like(exact)
        for i in range(m):
            here = self.bits[self.row[i, at[:, i]]]
            if m == self.short:
                moved |= exact  # the word has a letter more before this place
                moved &= self.bits[self.row[i + 1, at[:, i]]]
                replaced &= here
                replaced |= exact & ~here
            else:
                if i:
                    moved &= self.bits[self.row[i - 1, at[:, i]]]
                moved |= exact  # the word lacks this letter
            exact &= here
            if i == self.half - 1:
                same_half = exact.copy()
        out = replaced & self.of_length[m] | (moved | exact) & self.of_length[m + 1] if m == self.short else moved & self.of_length[self.short]
        return out & (~same_half if self.side else same_half)

    def search(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many words are near each query, and the number of the first of them, -1 if there is none."""
        near = self.near(queries)
        counts = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
        column = (near != 0).argmax(axis=1)
        word = near[np.arange(len(queries)), column]
        lowest = word & (~word + np.uint64(1))
        bit = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
        return counts, np.where(counts > 0, 64 * column + bit, -1)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, the indexed ones first -> word, n_near, best_n, best for words that have near ones there."""
    part_now, index, gathered, waiting = None, None, [], {}

    def answer(length: int):
        queries = waiting.pop(length)
        counts, best = index.search(queries)
        hits = np.flatnonzero(counts)
        chosen = [index.words[i] for i in best[hits]]
        return pa.RecordBatch.from_pydict({"word": [queries[i] for i in hits], "n_near": counts[hits], "best_n": [n for _, n in chosen], "best": [w for w, _ in chosen]}, schema=_FOUND)

    def ask(words: list[str]):
        for w in words:
            queue = waiting.setdefault(len(w), [])
            queue.append(w)
            if len(queue) == TOGETHER:
                yield answer(len(w))

    def finish():
        """The part's index is made when its last indexed row has been read; then those rows are the first queries."""
        nonlocal index, gathered
        if gathered:
            index = Index(gathered, part_now[0], part_now[1])
            words, gathered = [w for w, _ in gathered], []
            yield from ask(words)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for *part, indexed, word, n in zip(*columns, strict=True):
            if part != part_now:
                yield from finish()
                for length in list(waiting):
                    yield answer(length)
                part_now, index = part, None
            if indexed:
                gathered.append((word, n))
            else:
                yield from finish()
                if index is not None:  # a part may have got no word to index
                    yield from ask([word])
    yield from finish()
    for length in list(waiting):
        yield answer(length)


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) -> word, n_near, best_n, best: how many other words are one error away, and the most frequent of them (ties: the smallest).

    Words that have none are left out. Words are distinct and have at least two letters.
    """
    place = ["short", "side", "block", "part"]
    rows = _blocks(words).repartition(*place).sortWithinPartitions(*place, F.desc("indexed"))
    found = rows.select(*place, "indexed", "word", "n").mapInArrow(_search, "word string, n_near long, best_n long, best string")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("top"))
    return out.select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.w").alias("best"))


def roots(forms: DataFrame, scratch: common.Scratch, steps: int) -> DataFrame:
    """(word, form) -> word, root, for words that have a form: the end of the chain of forms, of at most ``steps`` steps.

    Each round doubles how far a word has followed its chain.
    """
    at = forms.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        at = scratch.table(at)
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        reach *= 2
    return at


def variant_groups(df: DataFrame, least_letters: int = 5, least_count: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary.

    A word's form is its near word of largest n (ties: the smallest), if that is at least twice the word's n, else null; root follows forms to
    the last. A null or empty text has no words; a null id counts as an empty one in the hash that takes letters away. Rows that repeat count again. An empty
    table gives an empty one; other columns are left out, whatever their names; texts and runs count whole, however long.
    """
    with common.Scratch(df.sparkSession) as scratch:
        words = scratch.table(vocabulary(df, least_letters, least_count, key, text))
        near = near_words(words)
        is_form = F.col("best_n") >= 2 * F.col("n")
        forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
        forms = scratch.table(forms)
        # every step at least doubles n, so the largest n bounds the steps
        most = forms.agg(F.max("n")).first()[0] or 0
        out = forms.join(roots(forms, scratch, max(1, most.bit_length())), "word", "left")
        return common.write_stage(out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "variants")

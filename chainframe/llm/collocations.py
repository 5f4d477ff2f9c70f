"""Phrases whose words occur together far more often than apart, with exact counts.

Phrases are counted level by level. A phrase that occurs often enough is made of phrases that do (Apriori), so the candidates of a level are the
places where those of the level before overlap. The candidates are the paths of double-array tries, of bounded size, that are sent to all tasks;
a task turns its texts into numbers of words and numpy moves the states of all places of all texts ahead together, one word at a time. The states that are
reached are counted by bincount, and the counts of the tasks are added up.

A symbol, the number of a word in its trie, is read as two digits, so that the children of a state lie close together. When there are more candidates
than one trie holds, they are dealt by their first words to several. The texts aren't read for each of these: they are turned into windows once, the words from each place on as
one number, with how often each occurs, and a trie meets those that begin with its words. Only where a window doesn't fit into a long are the texts read trie by trie.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.llm import common

#: Phrases of one trie at most, about; a symbol has two digits of DIGIT each.
TRIE_PHRASES, DIGIT = 1 << 21, 1 << 11
#: Places whose phrases a task gathers before equal ones are added up; words that it counts or numbers before it starts afresh.
GATHERED, KNOWN = 1 << 22, 1 << 19
#: Ranked rows are taken from so many parts of a language first.
SALTS = 64

# A-Z in lower case, a tab as a space, what ends a piece as a line feed.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
_END, _ROOT = b"\n", 1


def tokens(text: str) -> list[bytes]:
    """The words of a text and a line feed between pieces; empty ones stand for repeated spaces."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


def lang_of(lang: str | None) -> str:
    return "und" if lang is None else lang


# --- tries


def _place(base: np.ndarray, used: np.ndarray, starts: np.ndarray, sizes: np.ndarray, parents: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gives each parent a base at which the slots of all its children are free; the arrays grow as needed."""
    room = int(np.count_nonzero(used)) + 2 * int(sizes.sum()) + 2 * DIGIT
    if room + DIGIT > len(used):
        base, used = np.concatenate([base, np.zeros(room, np.int32)]), np.concatenate([used, np.zeros(room, bool)])
    order = np.argsort(-sizes, kind="stable")
    several = order[sizes[order] > 1]
    cursors: dict[int, int] = {}
    for g in several.tolist():
        children = digits[starts[g] : starts[g] + sizes[g]]
        kind = int(sizes[g]).bit_length()
        at = cursors.get(kind, DIGIT)
        while True:
            if at + 2 * DIGIT + 256 > len(used):
                base, used = np.concatenate([base, np.zeros(len(base), np.int32)]), np.concatenate([used, np.zeros(len(used), bool)])
            free = np.flatnonzero(~used[at : at + 256]) + at
            fits = ~used[(free - children[0])[:, None] + children].any(axis=1) if len(free) else free
            if len(free) and fits.any():
                b = int(free[fits.argmax()] - children[0])
                break
            at += 256
        cursors[kind] = at
        base[parents[g]] = b
        used[b + children] = True
    single = order[sizes[order] == 1]
    free = np.flatnonzero(~used[DIGIT:])[: len(single)] + DIGIT
    if len(free) < len(single):
        more = np.arange(len(used), len(used) + len(single) - len(free))
        base, used = np.concatenate([base, np.zeros(len(more) + 2 * DIGIT, np.int32)]), np.concatenate([used, np.zeros(len(more) + 2 * DIGIT, bool)])
        free = np.concatenate([free, more])
    base[parents[single]] = free - digits[starts[single]]
    used[free] = True
    return base, used


def _squeezed(x: np.ndarray) -> tuple[int, bytes]:
    return x.nbytes, pa.compress(x.tobytes(), "zstd", asbytes=True)


def _restored(packed: tuple[int, bytes], kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[1], packed[0], "zstd"), kind)


def _ipc(words: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("word", words.type)])) as stream:
        stream.write_batch(pa.record_batch([words], ["word"]))
    return out.getvalue().to_pybytes()


class Trie:
    """A double-array trie over words of several languages: from state s, digit d leads to base[s] + d if check there is s. State 0 is no place."""

    def __init__(self, langs: pa.Array, phrases: pa.Array, shard: int, shards: int):
        """Languages and phrases, words joined by spaces, all different; those of the shard ``shard`` of ``shards``."""
        self.shard, self.shards = shard, shards
        parts = pc.split_pattern(phrases, " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        flat, of = parts.flatten(), langs.dictionary_encode()
        lang_of_word = np.repeat(of.indices.to_numpy(zero_copy_only=False), sizes)
        numbers = np.zeros(len(flat), np.int64)
        #: lang -> (number of its first word, its words); their numbers follow each other, from 1.
        self.symbols: dict[str, tuple[int, pa.Array]] = {}
        first = 1
        for i, lang in enumerate(of.dictionary.to_pylist()):
            here = np.flatnonzero(lang_of_word == i)
            coded = flat.take(pa.array(here)).dictionary_encode()
            numbers[here] = coded.indices.to_numpy(zero_copy_only=False) + first
            self.symbols[lang] = (first, coded.dictionary)
            first += len(coded.dictionary)
        self.words = first - 1
        if self.words >= DIGIT * DIGIT:
            raise ValueError(f"a trie has {self.words} words, more than two digits tell apart")
        paths = np.full((len(phrases), 2 * int(sizes.max(initial=0))), -1, np.int32)
        row, column = np.repeat(np.arange(len(phrases)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        paths[row, 2 * column], paths[row, 2 * column + 1] = numbers // DIGIT, numbers % DIGIT
        self._build(paths)

    def _build(self, paths: np.ndarray) -> None:
        base, check, used = np.zeros(4 * DIGIT, np.int32), np.full(4 * DIGIT, -1, np.int32), np.zeros(4 * DIGIT, bool)
        used[: _ROOT + 1] = True
        state = np.full(len(paths), _ROOT, np.int64)
        for d in range(paths.shape[1]):
            live = np.flatnonzero(paths[:, d] >= 0)
            edges, of = np.unique(state[live] * DIGIT + paths[live, d], return_inverse=True)  # children by parent, then by digit
            parent, digit = edges // DIGIT, edges % DIGIT
            starts = np.flatnonzero(np.diff(parent, prepend=-1))
            base, used = _place(base, used, starts, np.diff(starts, append=len(parent)), parent[starts], digit)
            check = np.concatenate([check, np.full(len(used) - len(check), -1, np.int32)])
            slot = base[parent] + digit
            check[slot] = parent
            state[live] = slot[of]
        pad = DIGIT + 1  # whatever digit follows stays inside the arrays
        self.base, self.check = np.concatenate([base, np.zeros(pad, np.int32)]), np.concatenate([check, np.full(pad, -1, np.int32)])
        self.ends = state if paths.shape[1] else np.zeros(0, np.int64)
        self.accepts = np.zeros(len(self.base), bool)
        self.accepts[self.ends] = True

    def packed(self) -> bytes:
        """The trie as the driver hands it on: its arrays compressed, each slot's parent by the slots that are taken, and which states are whole phrases as bits."""
        taken = np.flatnonzero(self.check >= 0)
        parts = {"base": (self.base[self.base != 0], self.base != 0), "check": (self.check[taken], self.check >= 0), "accepts": (None, self.accepts)}
        arrays = {name: (None if values is None else _squeezed(values), _squeezed(np.packbits(where))) for name, (values, where) in parts.items()}
        words = [(lang, first, _squeezed(np.frombuffer(_ipc(x), np.uint8))) for lang, (first, x) in self.symbols.items()]
        return pickle.dumps((self.shard, self.shards, self.words, len(self.base), arrays, words), 5)

    @classmethod
    def unpacked(cls, sent) -> Trie:
        """The trie that was packed and sent."""
        out = cls.__new__(cls)
        out.shard, out.shards, out.words, n, arrays, words = pickle.loads(sent.value)
        where = {name: np.unpackbits(_restored(bits, np.uint8), count=n).astype(bool) for name, (_, bits) in arrays.items()}
        out.base, out.check, out.accepts = np.zeros(n, np.int32), np.full(n, -1, np.int32), where["accepts"]
        out.base[where["base"]], out.check[where["check"]] = (_restored(arrays[name][0], np.int32) for name in ("base", "check"))
        out.symbols = {lang: (first, pa.ipc.open_stream(pa.py_buffer(_restored(x, np.uint8))).read_all().column(0).combine_chunks()) for lang, first, x in words}
        out.ends = None
        return out

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states one word further, 0 where there is no such path; symbol 0 is no word."""
        for digit in (symbol // DIGIT, symbol % DIGIT):
            to = self.base[state] + digit
            state = np.where(self.check[to] == state, to, 0)
        return state

    def owns(self, word: bytes) -> bool:
        """Whether phrases that begin with the word are in this trie, if they are in any."""
        return zlib.crc32(word) * self.shards >> 32 == self.shard


def _shards(phrases: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, int]:
    """Builds the tries of (lang, phrase): a table of shard, blob, state, lang, phrase, and how many shards there are."""
    shards = -(-phrases.count() // TRIE_PHRASES)
    if not shards:
        return None, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())]))
        for shard in pc.unique(rows["shard"]).to_pylist():
            mine = rows.filter(pc.equal(rows["shard"], shard))
            langs, phrases = (mine[c].combine_chunks() for c in ("lang", "phrase"))
            trie = Trie(langs, phrases, shard, shards)
            ends, trie.ends = pa.array(trie.ends, pa.int64()), None
            yield pa.RecordBatch.from_pydict({"shard": [shard], "blob": [trie.packed()], "state": [None], "lang": [None], "phrase": [None]}, schema=schema)
            for at in range(0, len(ends), 10_000):
                n = min(10_000, len(ends) - at)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.nulls(n, pa.binary()), ends.slice(at, n), langs.slice(at, n), phrases.slice(at, n)], schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("blob", pa.binary()), ("state", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())])
    shard = F.shiftright(F.crc32(F.substring_index("phrase", " ", 1).cast("binary")) * shards, 32).alias("shard")
    dealt = phrases.select(shard, "lang", "phrase").repartition(shards, "shard")
    return scratch.table(dealt.mapInArrow(run, "shard long, blob binary, state long, lang string, phrase string")), shards


# --- passes over the texts


class _Numbers(dict):
    """Words of a language -> numbers: symbols of the trie first; other words get numbers of their own only where several tries share the words."""

    def __init__(self, reader: _Reader, lang: str):
        first, words = reader.trie.symbols.get(lang, (1, pa.array([], pa.string())))
        super().__init__(zip(words.cast(pa.binary()).to_pylist(), range(first, first + len(words)), strict=True))
        self.reader, self.lang = reader, lang
        if reader.trie.shards > 1:
            for word, number in self.items():
                reader.own[number] = reader.trie.owns(word)
        self[_END], self[b""] = 0, -1

    def __missing__(self, word: bytes) -> int:
        reader = self.reader
        if reader.trie.shards == 1:
            return 0
        self[word] = number = len(reader.own)
        reader.own.append(reader.trie.owns(word))
        reader.more.append((self.lang, word.decode("utf-8", "surrogatepass")))
        return number


class _Reader:
    """Texts -> one row of numbers, 0 between pieces, documents and where a word is in no phrase."""

    def __init__(self, trie: Trie):
        self.trie = trie
        #: By number: whether this trie holds the phrases that begin with the word. Then language and word of numbers that aren't symbols.
        self.own: list[bool] = [False] * (trie.words + 1)
        self.more: list[tuple[str, str]] = []
        self.langs: dict[str, _Numbers] = {}

    def full(self) -> bool:
        return len(self.more) > KNOWN

    def read(self, langs: list[str | None], texts: list[str | None]) -> np.ndarray:
        out = []
        for lang, text in zip(langs, texts, strict=True):
            if text:
                lang = lang_of(lang)
                numbers = self.langs.get(lang) or self.langs.setdefault(lang, _Numbers(self, lang))
                found = tokens(text)
                out += (np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)), np.zeros(1, np.int64))
        row = np.concatenate(out) if out else np.zeros(0, np.int64)
        return row[row >= 0]


def _phrases(numbers: np.ndarray, trie: Trie, more: list[tuple[str, str]]) -> tuple[pa.Array, pa.Array]:
    """Languages and phrases of rows of numbers."""
    words = pa.concat_arrays([*(x.cast(pa.string()) for _, x in trie.symbols.values()), pa.array([w for _, w in more], pa.string())])
    langs = list(trie.symbols)
    starts = np.array([first for first, _ in trie.symbols.values()], np.int64)
    code = np.searchsorted(starts, numbers[:, 0], "right") - 1
    lang = pa.array(langs, pa.string()).take(pa.array(np.maximum(code, 0)))
    beyond = np.flatnonzero(numbers[:, 0] > trie.words)
    if len(beyond):
        named = lang.to_pylist()
        for i in beyond.tolist():
            named[i] = more[numbers[i, 0] - trie.words - 1][0]
        lang = pa.array(named, pa.string())
    return lang, pc.binary_join_element_wise(*[words.take(pa.array(numbers[:, j] - 1)) for j in range(numbers.shape[1])], " ")


def _symbols(row: np.ndarray, trie: Trie) -> np.ndarray:
    """The numbers that the trie knows, 0 for others."""
    return np.where(row <= trie.words, row, 0)


def _bits(below: int, words: int) -> int:
    """How many bits tell numbers under ``below`` apart; 0 if so many words don't fit into a long."""
    bits = max(1, (below - 1).bit_length())
    return bits if bits * words < 64 else 0


def _distinct(rows: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of numbers under ``below``, and how often each occurs; as single longs where these hold them."""
    width = rows.shape[1]
    if not (bits := _bits(below, width)):
        return np.unique(rows, axis=0, return_counts=True)
    keys, n = np.unique(_packed(rows, bits), return_counts=True)
    return _unpacked(keys, bits, width), n


def _packed(rows: np.ndarray, bits: int) -> np.ndarray:
    keys = rows[:, 0].astype(np.int64)
    for j in range(1, rows.shape[1]):
        keys = keys << bits | rows[:, j]
    return keys


def _unpacked(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    return (keys[:, None] >> (np.arange(width - 1, -1, -1) * bits)) & ((1 << bits) - 1)


def _with_trie(df: DataFrame, sent, step: Callable, schema: str, whole: bool = False) -> DataFrame:
    """mapInArrow with the trie that was sent, which a worker unpacks once: step gets languages and texts of some rows at a time, or whole batches."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = common.worker_state(("trie", name), lambda: Trie.unpacked(sent))
        parts = ((x.column(0).to_pylist(), x.column(1).to_pylist()) for batch in batches for x in common.slices(batch, 256))
        yield from step(trie, batches if whole else parts)

    return df.mapInArrow(run, schema)


def count_words(df: DataFrame) -> DataFrame:
    """(lang, text) -> lang, phrase, n: every word and how often it occurs. Each task adds up what it reads before words are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = {}

        def out():
            for lang, counts in seen.items():
                counts.pop(_END, None), counts.pop(b"", None)
                words, n = pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())
                for at in range(0, len(words), 1 << 16):
                    part = words.slice(at, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, n.slice(at, 1 << 16)], ["lang", "phrase", "n"])
            seen.clear()

        for batch in (x for whole in batches for x in common.slices(whole, 256)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    seen.setdefault(lang_of(lang), Counter()).update(tokens(text))
            if sum(map(len, seen.values())) > KNOWN:
                yield from out()
        yield from out()

    return df.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def propose(df: DataFrame, sent, words: int, least: int) -> DataFrame:
    """(lang, text) -> lang, phrase: phrases of ``words`` words that may occur ``least`` times.

    The trie that was sent holds the phrases of one word less that do. A place counts where such phrases overlap; one that begins with another trie's word is taken on trust.
    While all its words are symbols of the trie, a phrase travels as one long; only those that are kept are written out.
    """
    level = words - 1
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def places(trie: Trie, row: np.ndarray, own: list[bool]) -> np.ndarray:
        symbols = _symbols(row, trie)
        n = len(row) - level + 1
        state = np.full(n, _ROOT, np.int64)
        for j in range(level):
            state = trie.step(state, symbols[j : j + n])
        found = trie.accepts[state]
        follows = found[1:]
        if trie.shards > 1:  # what follows the first word must be a candidate too, if this trie holds those that begin with it
            words_follow = np.all([row[1 + j : n + j] > 0 for j in range(level)], axis=0)
            follows = np.where(np.array(own, bool)[row[1:n]], follows, words_follow)
        at = np.flatnonzero(found[:-1] & follows)
        return np.stack([row[at + j] for j in range(words)], axis=1)

    def step(trie: Trie, parts: Iterator):
        reader, keys, held = _Reader(trie), [], 0
        bits = _bits(trie.words + 1, words) if trie.shards == 1 else 0

        def out():
            if bits:
                found, n = np.unique(np.concatenate(keys), return_counts=True)
            else:
                found, n = _distinct(np.concatenate(keys), len(reader.own))
            for at in range(0, len(found), 1 << 16):
                some = found[at : at + (1 << 16)]
                if bits:
                    key, (lang, phrase) = pa.array(some, pa.int64()), (pa.nulls(len(some), pa.string()),) * 2
                else:
                    key, (lang, phrase) = pa.nulls(len(some), pa.int64()), _phrases(some, trie, reader.more)
                yield pa.RecordBatch.from_arrays([key, lang, phrase, pa.array(n[at : at + (1 << 16)], pa.int64())], schema=schema)
            keys.clear()

        for langs, texts in parts:
            row = reader.read(langs, texts)
            if len(row) >= words:
                found = places(trie, row, reader.own)
                if len(found):
                    keys.append(_packed(found, bits) if bits else found)
                    held += len(found)
            if held > GATHERED or reader.full():
                if keys:
                    yield from out()
                held = 0
                if reader.full():
                    reader = _Reader(trie)
        if keys:
            yield from out()

    def names(trie: Trie, parts: Iterator[pa.RecordBatch]):
        for batch in parts:
            key, lang, phrase = (batch.column(i) for i in range(3))
            if batch.num_rows and not key.null_count:
                lang, phrase = _phrases(_unpacked(key.to_numpy(), _bits(trie.words + 1, words), words), trie, [])
            yield pa.RecordBatch.from_arrays([lang, phrase], ["lang", "phrase"])

    found = _with_trie(df, sent, step, "key long, lang string, phrase string, n long").repartition("key", "lang", "phrase")  # a task has made equal ones one already
    kept = found.groupBy("key", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key", "lang", "phrase")
    return _with_trie(kept, sent, names, "lang string, phrase string", whole=True)


def count_states(df: DataFrame, sent, longest: int) -> DataFrame:
    """(lang, text) -> state, n: how often each accepting state of the trie is reached."""

    def step(trie: Trie, parts: Iterator):
        reader, counts, reached, held = _Reader(trie), np.zeros(len(trie.base), np.int64), [], 0
        for langs, texts in parts:
            symbols = _symbols(reader.read(langs, texts), trie)
            state = np.full(len(symbols), _ROOT, np.int64)
            for j in range(min(longest, len(symbols))):
                state = trie.step(state[: len(symbols) - j], symbols[j:])
                reached.append(state[state > 0])
                held += len(reached[-1])
            if held > GATHERED:
                counts += np.bincount(np.concatenate(reached), minlength=len(counts))
                reached, held = [], 0
            if reader.full():
                reader = _Reader(trie)
        if reached:
            counts += np.bincount(np.concatenate(reached), minlength=len(counts))
        at = np.flatnonzero(trie.accepts & (counts > 0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["state", "n"])

    return _with_trie(df, sent, step, "state long, n long").groupBy("state").agg(F.sum("n").alias("n"))


class Windows:
    """What texts hold, place by place: the numbers of the words from there on, up to ``longest`` or to where a piece or the frequent words end, as one long, and how often each occurs.

    Numbers are the symbols of the trie of all frequent words. Rows are h, key, n: h is a hash of the first word, in whose order they are written, so that a trie's part is read by itself.
    """

    def __init__(self, rows: DataFrame, sent, bits: int, longest: int, scratch: common.Scratch):
        """rows: (lang, text); sent: the trie, of one shard."""
        self.sent, self.bits, self.longest = sent, bits, longest

        def step(trie: Trie, parts: Iterator):
            reader, held, n = _Reader(trie), [], 0
            hashes = np.zeros(trie.words + 1, np.int64)
            for first, words in trie.symbols.values():
                hashes[first : first + len(words)] = [zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()]

            def out():
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                for at in range(0, len(keys), 1 << 16):
                    some = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[some >> bits * (longest - 1)]), pa.array(some), pa.array(counts[at : at + (1 << 16)], pa.int64())], ["h", "key", "n"])

            for langs, texts in parts:
                row = reader.read(langs, texts)
                key, follows, live = row.copy(), np.append(row, np.zeros(longest, np.int64)), row > 0
                for j in range(1, longest):
                    word = follows[j : j + len(row)]
                    live = live & (word > 0)
                    key = key << bits | np.where(live, word, 0)
                held.append(key[row > 0])
                n += len(held[-1])
                if n > GATHERED:
                    yield from out()
                    n = 0
            if n:
                yield from out()

        dealt = _with_trie(rows, sent, step, "h long, key long, n long").repartition("h", "key")  # a task has made equal ones one already
        self.rows = scratch.table(dealt.groupBy("h", "key").agg(F.sum("n").alias("n")).sortWithinPartitions("h"))

    def phrases(self, words: int, least: int) -> DataFrame:
        """lang, phrase: those of ``words`` words that occur ``least`` times."""
        bits, shift = self.bits, self.bits * (self.longest - words)
        found = self.rows.select(F.shiftright("key", shift).alias("key"), "n").where(F.col("key").bitwiseAND((1 << bits) - 1) > 0)
        if shift:
            found = found.groupBy("key").agg(F.sum("n").alias("n"))

        def names(trie: Trie, parts: Iterator[pa.RecordBatch]):
            for batch in (x for x in parts if x.num_rows):
                yield pa.RecordBatch.from_arrays([*_phrases(_unpacked(batch.column(0).to_numpy(), bits, words), trie, [])], ["lang", "phrase"])

        return _with_trie(found.where(F.col("n") >= least).select("key"), self.sent, names, "lang string, phrase string", whole=True)

    def count_states(self, sent, shard: int, shards: int) -> DataFrame:
        """state, n: how often each accepting state of a trie is reached. Only the windows that begin with its words are read."""
        name, words, bits, longest = uuid.uuid4().hex, self.sent, self.bits, self.longest
        low, high = (-((-x << 32) // shards) for x in (shard, shard + 1))

        def load() -> tuple[Trie, np.ndarray]:
            trie, every = Trie.unpacked(sent), Trie.unpacked(words)
            to = np.zeros(every.words + 1, np.int64)  # numbers of all frequent words as symbols of this trie
            for lang, (first, known) in every.symbols.items():
                if lang in trie.symbols:
                    start, own = trie.symbols[lang]
                    at = pc.index_in(known.cast(pa.binary()), value_set=own.cast(pa.binary()))
                    to[first : first + len(known)] = np.where(at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy() + start, 0)
            return trie, to

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, to = common.worker_state(("windows", name), load)
            counts = np.zeros(len(trie.base), np.int64)
            for batch in batches:
                symbols, n = to[_unpacked(batch.column(0).to_numpy(), bits, longest)], batch.column(1).to_numpy()
                state = np.full(len(n), _ROOT, np.int64)
                for j in range(longest):
                    state = trie.step(state, symbols[:, j])
                    live = state > 0
                    state, symbols, n = state[live], symbols[live], n[live]
                    np.add.at(counts, state, n)
            at = np.flatnonzero(trie.accepts & (counts > 0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["state", "n"])

        mine = self.rows.where((F.col("h") >= low) & (F.col("h") < high)).select("key", "n")
        return mine.mapInArrow(run, "state long, n long").groupBy("state").agg(F.sum("n").alias("n"))


def _over_shards(tries: DataFrame, shards: int, scratch: common.Scratch, job: Callable) -> DataFrame:
    """The union of job(broadcast trie, shard) over all tries; the driver holds one at a time."""
    out, spark = None, tries.sparkSession
    for shard in range(shards):
        blob = tries.where((F.col("shard") == shard) & F.col("blob").isNotNull()).select("blob").first()
        if blob is None:
            continue
        sent = spark.sparkContext.broadcast(bytes(blob["blob"]))
        del blob
        common.give_back()
        part = scratch.table(job(sent, shard))
        sent.destroy()
        out = part if out is None else out.union(part)
    return out


def phrase_counts(df: DataFrame, longest: int, least: int, scratch: common.Scratch, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """All words of each language with their counts, and lang, phrase, f of the phrases of up to ``longest`` words that occur ``least`` times.

    The second is None where nothing occurs so often.
    """
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    words = scratch.table(count_words(rows))
    known = level = words.where(F.col("n") >= least).select("lang", "phrase")
    single, bits, windows = None, 0, None  # the trie of all frequent words, if they fit into one and a window of them into a long

    def dealt() -> Windows:
        nonlocal windows
        windows = windows or Windows(rows, single, bits, longest, scratch)
        return windows

    for n in range(2, longest + 1):
        if bits and level.count() > TRIE_PHRASES:
            level = scratch.table(dealt().phrases(n, least))
        else:
            tries, shards = _shards(level, scratch)
            if not shards:
                break
            if n == 2 and shards == 1:
                blob = bytes(tries.where(F.col("blob").isNotNull()).select("blob").first()["blob"])
                single, bits = df.sparkSession.sparkContext.broadcast(blob), _bits(pickle.loads(blob)[2] + 1, longest)
                del blob
                common.give_back()
            level = _over_shards(tries, shards, scratch, lambda sent, _, n=n: propose(rows, sent, n, least))
        known = known.union(level)
    tries, shards = _shards(known, scratch)
    if not shards:
        return words, None

    def counted(sent, shard: int) -> DataFrame:
        names = tries.where((F.col("shard") == shard) & F.col("blob").isNull()).select("state", "lang", "phrase")
        states = dealt().count_states(sent, shard, shards) if bits and shards > 1 else count_states(rows, sent, longest)
        return states.join(names, "state").select("lang", "phrase", F.col("n").alias("f"))

    out = _over_shards(tries, shards, scratch, counted).where(F.col("f") >= least)
    if single:
        single.destroy()
    return words, out


# --- scores


def collocations(df: DataFrame, longest: int = 3, least: int = 10, keep: int = 2000, share: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``keep`` phrases of 2 to ``longest`` words of highest score.

    a is how often the phrase occurs, l and r its two parts at the cut of lowest score (ties: the shorter first part), n all words of the language;
    the score is floor(1000000 a a / (l r)). A phrase goes if a longer candidate that holds it has at least ``share`` percent of its occurrences.
    A null language is ``und``, a null or empty text has no words; repeated rows count again, and ids play no part. An empty table gives an
    empty one; other columns are left out, whatever their names; texts and words count whole, however long. Arithmetic is exact for a up to 10^15.
    """
    spark = df.sparkSession
    with common.Scratch(spark) as scratch:
        words, found = phrase_counts(df, longest, least, scratch, lang, text)
        if found is None:
            return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
        size = F.size(F.split("phrase", " "))
        long = found.where(F.contains("phrase", F.lit(" "))).withColumn("size", size)
        cuts = long.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring(phrase, char_length(substring_index(phrase, ' ', k)) + 2)")})
        part = lambda name, out: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(out))
        cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
        wide = lambda c: F.col(c).cast("decimal(16,0)")
        above, below = (F.lit(1_000_000) * (wide("a") * wide("a")).cast("decimal(31,0)")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)")
        cuts = cuts.withColumns({"_above": above, "_below": below}).withColumn("score", F.expr("_above div _below"))
        best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
        # the shorter phrases inside each candidate, but for itself
        spans = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")
        inside = long.where("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        kept = best.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
        totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        salted = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= keep)
        out = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
        return common.write_stage(out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


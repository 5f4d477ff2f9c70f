"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, streaming decoding.

A list of tokens is the BPE result for its bytes exactly if every token merges to itself and every
two neighbours stay apart when they are merged together. That makes BPE a nondeterministic
transducer: a reading is (last whole token, bytes begun after it). ``MergeTransducer`` makes the subset
construction of the bytes begun on demand, one transition at a time, and keeps last tokens in registers; in a long piece
tokens leave every HOLD bytes, as far as all live readings agree on them.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm import common

#: Documents are split into pieces of about this many characters, at places where no match can span.
CHUNK_CHARS = 1 << 20
#: States of the transducer that a worker keeps before it starts afresh; of transitions and of pairs of neighbours it keeps four times as many.
MAX_STATES = 60_000
#: Bytes of pre-tokens and their ids that a worker keeps.
CACHE_BYTES = 48 << 20
#: Bytes of a piece after which tokens that all live readings agree on leave the registers.
HOLD = 1 << 12


def load_ranks(path: str) -> dict[bytes, int]:
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[list[bytes]]:
    """Plain BPE over a short piece, with every state on the way: neighbours of lowest rank join, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    trail = [parts]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        trail.append(parts)
    return trail


class Token:
    """What the transducer must know of one token: whether it is reached by merges and how it grows at either edge."""

    __slots__ = ("left", "reached", "right", "rising")

    def __init__(self, token: bytes, ranks: dict[bytes, int]):
        trail = merge(token, ranks)
        places = [next(i for i, x in enumerate(after) if before[i] != x) for before, after in zip(trail, trail[1:], strict=False)]
        joined = [ranks[after[i]] for i, after in zip(places, trail[1:], strict=True)]
        self.reached, self.rising = trail[-1] == [token], joined == sorted(joined)
        #: Ranks of the pieces at the edge, in the order in which they come to be.
        self.left = tuple(dict.fromkeys(ranks[parts[0]] for parts in trail))
        self.right = tuple(dict.fromkeys(ranks[parts[-1]] for parts in trail))


class MergeTransducer:
    """Maps bytes to token ids, one byte at a time. Every single byte must be a token.

    The subset construction is over the bytes begun: a state is the trie nodes of all live readings, and the longest of them
    tells the others, so there are no more states than nodes. The right tokens of a prefix are one list only. So a reading's last
    token needs no state of its own: it stands in the register of the place where the reading began, and of the tokens that
    end at a byte only one can follow what is registered at its beginning.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        #: A token's number is its rank and one; 0 stands for the beginning.
        self.width = (max(ranks.values()) + 1).bit_length()
        #: The trie of all tokens: node * 256 + byte -> node; node -> its length; node -> (-length, number) of the token that ends there, or None.
        self.child: dict[int, int] = {}
        self.sizes, self.ends, self.at = [0], [None], {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if (to := self.child.get(node << 8 | byte)) is None:
                    to = self.child[node << 8 | byte] = len(self.ends)
                    self.sizes.append(self.sizes[node] + 1)
                    self.ends.append(None)
                node = to
            self.ends[node] = (-len(token), rank + 1)
            self.at[rank] = token
        self.known: dict[int, Token] = {}
        self.apart: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state: its trie nodes but the root, longest first. What its arrival gives: its number * 256, longer tokens that end there, the one of one byte.
        self.states, self.arrivals, self.ids, self.steps = [()], [(0, (), 0)], {0: 0}, {}

    def _token(self, rank: int) -> Token:
        if (known := self.known.get(rank)) is None:
            known = self.known[rank] = Token(self.at[rank], self.ranks)
        return known

    def _can_follow(self, last: int, rank: int) -> bool:
        """Whether both stay whole when they are merged together: nothing may join across the edge while they grow."""
        b = self._token(rank)
        if not b.reached or last < 0:
            return b.reached
        a, at = self._token(last), self.at
        if not (a.rising and b.rising):
            return merge(at[last] + at[rank], self.ranks)[-1] == [at[last], at[rank]]
        ranks, never = self.ranks, 1 << 60
        right, left, i, j = a.right, b.left, 0, 0
        while True:
            across = ranks.get(at[right[i]] + at[left[j]], never)
            next_a = right[i + 1] if i + 1 < len(right) else never
            next_b = left[j + 1] if j + 1 < len(left) else never
            if across < next_a and across <= next_b:  # of equal ranks the leftmost joins first
                return False
            if next_a == next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _learn(self, pair: int) -> bool:
        if len(self.apart) >= 4 * self.max_states:
            self.apart.clear()
        out = self.apart[pair] = self._can_follow((pair >> self.width) - 1, (pair & (1 << self.width) - 1) - 1)
        return out

    def _step(self, at: int) -> tuple[int, tuple[tuple[int, int], ...], int]:
        byte, child = at & 255, self.child
        nodes = tuple([now for node in (*self.states[at >> 8], 0) if (now := child.get(node << 8 | byte)) is not None])
        if (to := self.ids.get(nodes[0])) is None:
            to = self.ids[nodes[0]] = len(self.states)
            self.states.append(nodes)
            ends = [x for node in nodes if (x := self.ends[node])]
            self.arrivals.append((to << 8, tuple(ends[:-1]), ends[-1][1]))
        out = self.steps[at] = self.arrivals[to]
        return out

    def _leave(self, registers: list[int], at: int) -> list[int]:
        """The tokens up to a place, which leave the registers."""
        out, back = [], at
        while back:
            out.append(registers[back] - 1)
            back -= len(self.at[out[-1]])
        del registers[:at]
        return out[::-1]

    def _agreed(self, registers: list[int], state: int) -> int:
        """The last place that all live readings have passed between two tokens."""
        end = len(registers) - 1
        live = {end, *(end - self.sizes[node] for node in self.states[state >> 8])}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(last - len(self.at[registers[last] - 1]))
        return live.pop()

    def encode(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]  # the vocabulary's own pieces count as they are, reachable by merges or not
        if len(self.states) > self.max_states or len(self.steps) > 4 * self.max_states:
            self._reset()
        #: For each place from the last that tokens left at: the number of the token that ends there.
        registers, out = [0], []
        state, steps, apart, width = 0, self.steps.get, self.apart.get, self.width
        for begin in range(0, len(piece), HOLD):
            if begin:
                out += self._leave(registers, self._agreed(registers, state))
            for byte in piece[begin : begin + HOLD] if begin or len(piece) > HOLD else piece:
                state, longer, number = steps(state | byte) or self._step(state | byte)
                for back, longest in longer:
                    pair = registers[back] << width | longest
                    if (ok := apart(pair)) is None:
                        ok = self._learn(pair)
                    if ok:
                        number = longest
                        break
                registers.append(number)
        return out + self._leave(registers, len(registers) - 1)


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any pieces, gives the text of all whole characters so far.

    Bytes that can't be part of a character become U+FFFD, as Python's ``errors="replace"`` does.
    """

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a character that further bytes may complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return back if back == 1 or low <= data[1 - back] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        n = self._open(data)
        self.rest = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of a text, cut only between a letter and white space after it; no match of the pattern spans that."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut].isspace() and text[cut - 1].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class WordIds(common.Bounded):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(CACHE_BYTES, 64)
        self.transducer = MergeTransducer(ranks)

    def __missing__(self, word: str) -> bytes:
        out = array("I", self.transducer.encode(word.encode("utf-8", "surrogatepass")))
        if sys.byteorder == "big":
            out.byteswap()
        ids = out.tobytes()
        self.keep(word, ids, len(ids))
        return ids


class Encoder:
    """Whole texts to ids."""

    def __init__(self, vocabulary: str, pattern: str):
        self.words, self.find = WordIds(load_ranks(vocabulary)), regex.compile(pattern).findall

    def __call__(self, text: str | None) -> bytes:
        return b"".join([b"".join(map(self.words.__getitem__, self.find(part))) for part in chunks(text)]) if text else b""


class Decoder:
    """Ids to text, a block at a time; characters that span two blocks are put together."""

    def __init__(self, vocabulary: str, block: int = 1 << 16):
        ranks = load_ranks(vocabulary)
        self.block, self.pieces = block, np.full(max(ranks.values(), default=-1) + 1, b"", object)
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def __call__(self, ids: bytes | None) -> Iterator[str]:
        numbers, machine = np.frombuffer(ids or b"", "<u4"), Utf8Machine()
        for at in range(0, len(numbers), self.block):
            yield machine.feed(b"".join(self.pieces[numbers[at : at + self.block]].tolist()))
        yield machine.finish()


def _encoder(vocabulary: str, pattern: str) -> Encoder:
    """One for a worker's life, so that later tasks find what earlier ones have learnt."""
    return common.worker_state(("bpe", vocabulary, pattern), lambda: Encoder(vocabulary, pattern))


def encode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> key, ids: the token ids of the whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; a null key stays. Repeated rows give repeated results; other columns are left
    out, whatever their names. An empty table gives an empty one. No shuffle; a worker holds one Arrow batch, a
    bounded cache of pre-tokens and MAX_STATES states. Texts of any length are read in pieces of CHUNK_CHARS.
    """

    def make():
        ids = _encoder(vocabulary, pattern)

        def step(batch: pa.RecordBatch):
            for part in common.slices(batch):
                yield {"key": part.column(0), "ids": pa.array([ids(x) for x in part.column(1).to_pylist()], pa.binary())}

        return step

    out = common.map_batches(df.select(F.col(key).cast("long"), F.col(text)), make, "key long, ids binary")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids", block: int = 1 << 16) -> DataFrame:
    """(key, ids) -> key, ids, text. Null ids are none, and give an empty text; bytes that are no UTF-8 give U+FFFD."""

    def make():
        texts = common.worker_state(("bpe decoder", vocabulary, block), lambda: Decoder(vocabulary, block))

        def step(batch: pa.RecordBatch):
            for part in common.slices(batch):
                yield {"key": part.column(0), "ids": part.column(1), "text": ["".join(texts(x)) for x in part.column(1).to_pylist()]}

        return step

    out = common.map_batches(df.select(F.col(key).cast("long"), F.col(ids)), make, "key long, ids binary, text string")
    return out.withColumnRenamed("key", key)


def round_trip(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, decoded again and digested in one pass.

    Nulls, empty and long texts, repeated rows and empty tables as for encode(): a null text counts as empty, a null
    doc_id stays.
    """

    def make():
        ids_of = _encoder(vocabulary, pattern)
        if not hasattr(ids_of, "decoder"):
            ids_of.decoder = Decoder(vocabulary)
        texts = ids_of.decoder

        def step(batch: pa.RecordBatch):
            out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column(1).to_pylist():
                ids, decoded = ids_of(text), hashlib.sha256()
                for part in texts(ids):
                    decoded.update(part.encode("utf-8", "surrogatepass"))
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(decoded.hexdigest())
            yield out

        return step

    rows = df.select(F.col("doc_id").cast("long"), "text")
    return common.map_batches(rows, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token counts by a two-tier lookup on the map side.

First tier: a broadcast table of at most ``TABLE_WORDS`` frequent pre-tokens and their numbers of tokens.
Second tier: each worker's own bounded cache, filled by the tokenizer itself. No pre-token is
ever shuffled: the table is filled from the bounded counts of the tasks that read a sample. The table only saves time: any table, an empty one too, gives the same counts.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainframe.llm import common
from chainframe.llm.bpe import chunks

#: Entries of the broadcast table at most: under 1 MB as it is sent.
TABLE_WORDS = 50_000
#: Documents, at most about, whose pre-tokens are counted to fill the table, and pre-tokens that one task hands over of them.
TABLE_SAMPLE_ROWS, TASK_WORDS = 2_000, 1_000
# Fixed value: the pattern of the byte-level pre-tokenizer of the library.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Lengths(common.Bounded):
    """Pre-token -> number of tokens: the broadcast table, then what this worker has met."""

    def __init__(self, tokenizer: Tokenizer, table: dict[str, int]):
        super().__init__()
        self.tokenizer, self.table = tokenizer, table

    def __missing__(self, word: str) -> int:
        if (n := self.table.get(word)) is None:
            n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.keep(word, n)
        return n


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    """The table as it is sent: compressed words, 16-bit numbers."""
    return zlib.compress("\0".join(lengths).encode("utf-8", "surrogatepass")), np.array(list(lengths.values()), "<u2").tobytes()


def unpack(packed: tuple[bytes, bytes]) -> dict[str, int]:
    numbers = np.frombuffer(packed[1], "<u2").tolist()
    return dict(zip(zlib.decompress(packed[0]).decode("utf-8", "surrogatepass").split("\0"), numbers, strict=False)) if numbers else {}


def frequent_lengths(df: DataFrame, vocabulary: str, pattern: str = PATTERN, text: str = "text", words: int = TABLE_WORDS, rows: int = TABLE_SAMPLE_ROWS) -> tuple[bytes, bytes]:
    """The first tier: the most frequent pre-tokens of about ``rows`` documents.

    Each task hands over its TASK_WORDS most frequent ones, so the driver gets rows * TASK_WORDS at most whatever the size of the table.
    """
    total = df.count()
    part = df.select(F.col(text)).sample(min(1.0, rows / max(1, total)), seed=7)

    def run(batches):
        find, seen = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for doc in batch.column(0).to_pylist():
                for piece in chunks(doc or ""):
                    seen.update(find(piece))
        most = [(w, n) for w, n in seen.most_common(TASK_WORDS) if len(w) <= 64 and "\0" not in w]
        if most:
            yield pa.RecordBatch.from_pydict({"words": [[w for w, _ in most]], "counts": [[n for _, n in most]]}, schema=pa.schema([("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))

    counted: Counter[str] = Counter()
    for task in part.mapInArrow(run, "words array<string>, counts array<long>").collect():
        counted.update(dict(zip(task.words, task.counts, strict=True)))
    tokenizer = Tokenizer.from_file(vocabulary)
    return pack({w: len(tokenizer.encode(w, add_special_tokens=False).ids) for w, _ in counted.most_common(words)})


def count_tokens(df: DataFrame, vocabulary: str, pattern: str = PATTERN, key: str = "doc_id", text: str = "text", limit: int = 1024, table: tuple[bytes, bytes] | None = None) -> DataFrame:
    """(key, text) -> key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens; a null key stays. Special strings inside a text count as the
    one token that the library makes of them. Repeated rows give repeated results, an empty table an empty one; other columns
    are left out, whatever their names. Texts of any length are read in pieces. No shuffle.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(table if table is not None else frequent_lengths(df, vocabulary, pattern, text))
    name = uuid.uuid4().hex

    def start() -> Callable[[str], int]:
        tokenizer = Tokenizer.from_file(vocabulary)
        lengths, find = Lengths(tokenizer, unpack(sent.value)), regex.compile(pattern).findall
        special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

        def count(doc: str) -> int:
            parts = cut.split(doc) if cut else [doc]
            return len(parts) - 1 + sum(sum(map(lengths.__getitem__, find(x))) for part in parts for x in chunks(part))

        return count

    def make():
        count = common.worker_state(("lengths", name), start)

        def step(batch: pa.RecordBatch):
            for part in common.slices(batch):
                docs = [x or "" for x in part.column(1).to_pylist()]
                yield {"key": part.column(0), "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in docs], "n_tokens": [count(x) for x in docs]}

        return step

    out = common.map_batches(df.select(F.col(key).cast("long"), F.col(text)), make, "key long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("key", key).withColumn("over_limit", F.col("n_tokens") > limit)

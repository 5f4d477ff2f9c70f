"""Document fingerprints by consistent weighted sampling.

A document is a bag of words, the weight of a word is how often it occurs. For each of ``SAMPLES`` samples every word draws
r and c from Gamma(2, 1) and b from the unit interval, all fixed by a hash of the word and the number of the sample. With weight s
let t = floor(ln s / r + b) and y = exp(r (t - b)); the word of least c / (y exp(r)) is sampled, together with its t. Two documents take the same
(word, t) with a probability that equals their generalised Jaccard similarity, the sum of the lesser weights over the sum of the greater ones.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.llm import common

#: Samples of a fingerprint, 16 bits of each kept; the standard error of a likeness is at most 0.044.
SAMPLES = 128
#: Rows of a worker's table of samples, a kilobyte each, and words of a document that are looked up at once.
TABLE_ROWS, CHUNK = 1 << 16, 1 << 14
#: Longer words, such as whole sentences of a script without spaces, count as their overlapping pieces of PIECE characters.
LONGEST, PIECE = 24, 4

_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def terms(text: str) -> Counter[str]:
    """The weighted terms of a text: words between white space, long ones in pieces. A text without words has one term of its own."""
    found: Counter[str] = Counter()
    words = text.split()
    if max(map(len, words), default=0) > LONGEST:
        short = []
        for w in words:
            if len(w) > LONGEST:
                found.update(w[i : i + PIECE] for i in range(len(w) - PIECE + 1))
            else:
                short.append(w)
        words = short
    found.update(words)
    return found or Counter({"": 1})


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(samples: int) -> np.ndarray:
    """Odd factors and addends that tell samples apart: 4 x 2 x samples."""
    return _mix(np.arange(1, 8 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(4, 2, samples) | np.uint64(1)


_ONE = _factors(SAMPLES)


def _units(words: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) from the upper 24 bits of 32-bit words."""
    out = (words >> np.uint32(8)).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-24)
    return out


def draws(hashes: np.ndarray, weights: np.ndarray, factors: np.ndarray = _ONE) -> tuple[np.ndarray, np.ndarray]:
    """For each term and sample: the value of which the least wins, and t."""
    def scattered(i: int) -> np.ndarray:
        out = hashes[:, None] * factors[i, 0]
        out += factors[i, 1]
        return out.view(np.uint32).reshape(len(hashes), -1, 2)

    def gamma(i: int) -> np.ndarray:
        two = _units(scattered(i))
        out = two[:, :, 0] * two[:, :, 1]
        np.log(out, out=out)
        return np.negative(out, out=out)

    r, c, b = gamma(0), gamma(1), _units(scattered(2)[:, :, 1])
    t = np.zeros_like(b)
    if len(more := np.flatnonzero(weights > 1)):  # else t is floor(b), 0
        t[more] = np.floor(np.log(weights[more]).astype(np.float32)[:, None] / r[more] + b[more])
        b[more] -= t[more]
    b -= np.float32(1)
    b *= r
    np.exp(b, out=b)
    b *= c
    return b, t


class Sampler:
    """Fingerprints of texts; keeps the draws of (term, weight) pairs met before in a table of bounded size.

    A draw is 8 bytes that compare as a float does: its value in 32 bits, then 16 bits of a hash of (term, t) below. So the least draw of a sample carries its word along.
    When the table is full, the half that was asked for most stays.
    """

    def __init__(self, rows: int = TABLE_ROWS):
        self.table = np.empty((rows, SAMPLES))
        self.hits = np.zeros(rows, np.int32)
        self.used, self.places = 0, {}

    def _make_room(self) -> None:
        half = len(self.table) // 2
        kept = np.argsort(-self.hits[: self.used], kind="stable")[:half]
        to = np.full(self.used, -1)
        to[kept] = np.arange(len(kept))
        self.table[: len(kept)] = self.table[kept]
        self.hits[: len(kept)], self.hits[len(kept) :] = self.hits[kept] // 2, 0
        new = to.tolist()
        self.places = {key: at for key, old in self.places.items() if (at := new[old]) >= 0}
        self.used = len(kept)

    def rows(self, keys: list[str | tuple[str, int]]) -> np.ndarray:
        """Places in the table of at most CHUNK keys: a term of weight 1, or a term and its weight."""
        found = list(map(self.places.get, keys))
        if None in found:
            missing = [key for key, at in zip(keys, found, strict=True) if at is None]
            if self.used + len(missing) > len(self.table):
                self._make_room()
                return self.rows(keys) if self.used + len(keys) <= len(self.table) else self._afresh(keys)
            new = iter(range(self.used, self.used + len(missing)))
            self._add(missing)
            found = [next(new) if at is None else at for at in found]
        at = np.array(found)
        self.hits[at] += 1
        return at

    def _afresh(self, keys: list) -> np.ndarray:
        self.used, self.places = 0, {}
        return self.rows(keys)

    def _add(self, missing: list) -> None:
        plain = [key if isinstance(key, str) else key[0] for key in missing]
        weights = np.array([1 if isinstance(key, str) else key[1] for key in missing], float)
        hashes = np.array([xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) for term in plain], np.uint64)
        value, t = draws(hashes, weights)
        mixed = np.uint64(0x9E3779B97F4A7C15)
        code = ((hashes ^ mixed)[:, None] * _ONE[3, 0]) >> np.uint64(48)  # of t = 0
        if len(more := np.flatnonzero(weights > 1)):
            code[more] = ((hashes[more, None] ^ (t[more].astype(np.uint64) + np.uint64(1)) * mixed) * _ONE[3, 0]) >> np.uint64(48)
        lo = self.used
        self.used += len(missing)
        rows = self.table[lo : self.used].view(np.uint64)
        np.left_shift(value.view(np.uint32), np.uint64(32), out=rows, dtype=np.uint64)
        rows |= code
        self.hits[lo : self.used] = 0
        self.places.update(zip(missing, range(lo, self.used), strict=True))

    def fingerprint(self, text: str) -> np.ndarray:
        """16 bits of each sample."""
        keys = [term if n == 1 else (term, n) for term, n in terms(text).items()]
        least = None
        for at in range(0, len(keys), CHUNK):
            part = self.table.take(self.rows(keys[at : at + CHUNK]), axis=0).min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least.view(np.uint64).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples that agree: an estimate of the generalised Jaccard similarity."""
    return float(np.count_nonzero(a == b)) / len(a)


def in_order(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """Rows dealt by ranges of the key, each range sorted: bucket, head, key, text. None for an empty table.

    At the end of a range stand the first rows of the next one, with head set, so that whoever reads a range
    meets every row's successor; the last range ends with the first row of all. A null key comes first, rows of one key in order of a hash of
    their texts. The driver holds one key a range; texts are shuffled once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), common.text_or_empty(text).alias("text")).withColumn("place", F.coalesce("key", F.lit(-(1 << 63))))
    ranges = rows.select("place").repartitionByRange(4 * common.partitions(spark), "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("first"))
    firsts = np.array(sorted({x["first"] for x in ranges.collect()}), np.int64)
    if not len(firsts):
        return None

    @F.pandas_udf(T.LongType())
    def bucket_of(places: pd.Series) -> pd.Series:
        at = np.searchsorted(firsts, places.to_numpy(), "right") - 1
        return pd.Series(2 * at + (firsts[at] == places.to_numpy()))

    one = lambda bucket, head: F.struct(bucket.cast("long").alias("bucket"), F.lit(head).alias("head"))
    at = F.shiftright("at", 1)
    before = F.pmod(at + F.lit(len(firsts) - 1), F.lit(len(firsts)))
    rows = rows.withColumn("at", bucket_of("place")).withColumn("to", F.explode(F.when(F.col("at") % 2 == 1, F.array(one(at, False), one(before, True))).otherwise(F.array(one(at, False)))))
    rows = rows.select("to.bucket", "to.head", "key", "text", "place", F.xxhash64("text").alias("mix"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "head", "place", F.asc_nulls_first("key"), "mix").select("bucket", "head", "key", "text")


def with_next(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[list[tuple[int | None, str, str]]]:
    """Lists of (key, text, text of the next row) from what in_order() deals."""
    held, bucket_now = None, None
    for batch in batches:
        for part in common.slices(batch, rows):
            out = []
            for bucket, head, key, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and bucket == bucket_now:
                    out.append((*held, text))
                held, bucket_now = (None if head else (key, text)), bucket
            if out:
                yield out


def edit(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text counts as empty; texts without words have the fingerprint of the empty text. A null id stays and comes first in the order; rows
    that share an id follow each other in order of a hash of the text, and a table of one row is its own successor. Repeated rows give repeated
    results, an empty table an empty one; other columns are left out, whatever their names. Texts count whole, however long.
    """
    rows = in_order(df, key, text)
    schema = T._parse_datatype_string(_SCHEMA)
    if rows is None:
        return df.sparkSession.createDataFrame([], schema)
    arrow = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = common.worker_state("fingerprints", Sampler)
        after, after_text = None, None
        for triples in with_next(batches):
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            for doc, now, following in triples:
                print_ = after if now is after_text else sampler.fingerprint(now)
                after, after_text = sampler.fingerprint(following), following
                new = edit(now, following)
                edited = print_ if new == now else sampler.fingerprint(new)
                row = (doc, len(now), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_.astype(">u2").tobytes().hex(), edited.astype(">u2").tobytes().hex(), likeness(print_, edited), likeness(print_, after))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", key)

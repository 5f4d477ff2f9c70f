"""What keeps CPU seconds down and changes no result."""

import os
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from chainframe.llm import bpe, common, fingerprints


@pytest.mark.skipif((os.cpu_count() or 1) < 2, reason="one core has one thread")
def test_products_inside_take_one_thread():
    a = np.random.default_rng(1).random((1500, 1500))
    with common.one_thread():
        wall, cpu = time.perf_counter(), time.process_time()
        for _ in range(6):
            a @ a
        wall, cpu = time.perf_counter() - wall, time.process_time() - cpu
    assert cpu <= 1.3 * wall


def test_a_text_is_fingerprinted_once_across_lists(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i} of some words") for i in range(200)], "doc_id long, text string").coalesce(1)
    asked = []
    monkeypatch.setattr(fingerprints.Sampler, "fingerprint", lambda self, text: asked.append(text) or np.zeros(fingerprints.SAMPLES, np.uint16))
    monkeypatch.setattr(fingerprints, "in_order", lambda *a: Local(df))
    made = fingerprints.fingerprint_documents(df)
    assert made == 199 and len(asked) == 200 + 199  # each text once, and each but the last one's edited text


class Local:
    """Rows of a table in the driver."""

    def __init__(self, df):
        self.df = df

    def mapInArrow(self, run, schema):
        rows = self.df.toArrow()
        batches = [common.pa.RecordBatch.from_arrays([common.pa.array([0] * rows.num_rows), common.pa.array([False] * rows.num_rows), *[c.combine_chunks() for c in rows.columns]], names=["bucket", "head", "key", "text"])]
        self.n = sum(b.num_rows for b in run(iter(batches)))
        return self

    def withColumnRenamed(self, *_):
        return self.n


def test_a_new_term_is_looked_up_once():
    class Places(dict):
        def __getitem__(self, key):
            raise AssertionError(key)

    sampler = fingerprints.Sampler(64)
    sampler.places = Places(old=0)
    sampler.used = 1
    assert sampler.rows(["a", "old", ("b", 3), "c"]).tolist() == [1, 0, 2, 3]
    hashes = np.array([fingerprints.xxhash.xxh64_intdigest(x) for x in ("a", "b")], np.uint64)
    value, t = fingerprints.draws(hashes, np.array([1.0, 3.0]))
    rows = sampler.table[[1, 2]].view(np.uint64)
    code = ((hashes[:, None] ^ (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * fingerprints._ONE[3, 0]) >> np.uint64(48)
    assert ((rows >> np.uint64(32)).astype(np.uint32).view(np.float32) == value).all() and (rows.astype(np.uint16) == code).all() and t[1].any()


def test_an_encoder_stays_small():
    draw = np.random.default_rng(3)
    encoder = bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    most = 0
    for _ in range(1000):
        words = ["".join(map(chr, draw.integers(0x61, 0x250, n))) for n in draw.integers(4, 12, 250)]
        text = " ".join(words)
        ids = np.frombuffer(encoder(text), "<u4")
        most = max(most, encoder.words.limit - encoder.words.room)
        assert len(encoder.words.transducer.states) < 75_000
        assert b"".join(encoder.words.transducer.at[i] for i in ids.tolist()) == text.encode()
    assert 45 << 20 < most <= 48 << 20  # bytes of the cache


def made_up(seed, n):
    draw = np.random.default_rng(seed)
    parts = ["th", "er", "an", "on", "ing", "and", "ou", "st", "en", "é", "sch", "ción"]
    return ["".join(parts[i] for i in draw.integers(0, len(parts), k)) for k in draw.integers(2, 7, n)]


def test_new_words_of_known_parts_take_few_new_states(monkeypatch):
    transducer, made, step = bpe.MergeTransducer(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), [], bpe.MergeTransducer._step
    monkeypatch.setattr(bpe.MergeTransducer, "_step", lambda self, at: made.append(at) or step(self, at))
    words = set(made_up(1, 6000))
    for word in words:
        assert b"".join(transducer.at[i] for i in transducer.encode(word.encode())) == word.encode()
    assert len(words) > 3000 and len(made) < 2000 and len(transducer.states) < 1000  # they don't grow with the words


def test_tokens_leave_a_long_piece_on_the_way(monkeypatch):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    transducer, held, leave = bpe.MergeTransducer(ranks), [], bpe.MergeTransducer._leave
    monkeypatch.setattr(bpe.MergeTransducer, "_leave", lambda self, registers, at: held.append(len(registers)) or leave(self, registers, at))
    longest = max(map(len, ranks))
    for hold in (1, 3, 64):
        monkeypatch.setattr(bpe, "HOLD", hold)
        for piece in ("".join(made_up(2, 500)).encode(), b"a" * 3000, b"ab" * 1500, " é中\U0001f600".encode() * 300, bytes(np.random.default_rng(4).integers(0, 256, 2000, np.uint8))):
            held.clear()
            assert transducer.encode(piece) == library._encode_single_piece(piece)
            assert max(held) <= hold + 4 * longest

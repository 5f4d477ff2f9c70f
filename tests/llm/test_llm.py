"""Corpus operators on small tables, against brute force, libraries and round trips."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainframe.llm import bpe, common, decontaminate, graph, html, near_dups, shards, substrings, suffixes, token_counts, topk, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = "der die and the of to idiot ñez réeux straße 漢字 42 don't x".split()


def texts(seed, n=40, most=200):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(1, most))) for _ in range(n // 2)]
    near = []
    for t in base:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near


def documents(spark, rows):
    """Documents with a column of a clashing name; nulls, empty texts, ties and repeated rows are the caller's."""
    return spark.createDataFrame([(i, t, "x", i and i % 3) for i, t in rows], "doc_id long, text string, key string, n long")


EDGES = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (4, "one"), (None, "one two three"), (5, "a " * 3000), (6, "a " * 3000)]


@pytest.fixture(scope="module")
def transducer():
    return bpe.MergeTransducer(bpe.load_ranks(RANKS))


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_transducer_is_the_librarys_merges(transducer, piece):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=transducer.ranks, special_tokens={})
    assert transducer.encode(piece) == library._encode_single_piece(piece)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine_gives_what_the_whole_decodes_to(data, step):
    machine = bpe.Utf8Machine()
    assert "".join([machine.feed(data[i : i + step]) for i in range(0, len(data), step)]) + machine.finish() == data.decode("utf-8", "replace")


def test_bpe_round_trip(spark):
    rows = EDGES + list(enumerate(texts(1), 100))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = sorted(tuple(r) for r in bpe.round_trip(documents(spark, [r for r in rows if r[0] is not None]), RANKS, public_tokenizers.PATTERN).collect())
    want = []
    for i, t in rows:
        if i is not None:
            ids = library.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_texts_are_cut_where_nothing_spans():
    t = " ".join(texts(2)) + "   \n  " + "zz" * 50
    assert "".join(bpe.chunks(t, 50)) == t
    find = __import__("regex").compile(public_tokenizers.PATTERN).findall
    assert [m for c in bpe.chunks(t, 50) for m in find(c)] == find(t)


def test_token_counts_and_special_strings(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in EDGES if i is not None] + [(50, "a<|endoftext|> b"), (51, "<|endoftext|>")] + list(enumerate(texts(3), 100))
    library = Tokenizer.from_file(path)
    for table in (None, token_counts.pack({})):
        got = sorted(tuple(r) for r in token_counts.count_tokens(documents(spark, rows), path, table=table).collect())
        n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
        assert got == sorted((i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n, strict=True))


def brute_windows(rows, size):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for a in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[a : a + size])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - size + 1) if i is not None else ():
            if least[tuple(w[a : a + size])] < i:
                gone |= set(range(a, a + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def test_difference_covers():
    for period in (1, 2, 7, 13, 31):
        cover = difference = substrings.difference_cover(period)
        assert {(a - b) % period for a in cover for b in difference} == set(range(period))
    assert len(substrings.difference_cover(31)) == 6


@pytest.mark.parametrize("size,period", [(12, 7), (5, 3)])
def test_substring_dedup(spark, size, period):
    rows = EDGES + list(enumerate(texts(4), 100))
    got = substrings.remove_repeats(documents(spark, rows), size, period)
    assert got.columns == ["doc_id", "text", "key", "n", "n_words", "n_removed", "kept"]
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr) == brute_windows(rows, size)


def brute_strings(rows, size):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in data:
        for a in range(len(b) - size + 1):
            count[b[a : a + size]] = count.get(b[a : a + size], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - size + 1):
            if count[b[a : a + size]] > 1:
                gone[a : a + size] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("wide", [20_000, 3, 1])
def test_suffix_dedup(spark, wide, monkeypatch):
    monkeypatch.setattr(suffixes, "WIDE_BUCKET", wide)
    monkeypatch.setattr(suffixes, "TOGETHER", 4096 if wide > 1 else 3)
    rows = [r for r in EDGES if r[0] not in (5, 6)] + [(5, "a " * 400), (6, "a " * 400)] + list(enumerate(texts(5, 20), 100))
    got = suffixes.remove_strings(documents(spark, rows), 200)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()), key=repr) == brute_strings(rows, 200)


def brute_components(rows):
    """(doc, size of its set, component, kept) by comparing every pair."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(s), find(i), i == find(i)) for i, s in sets.items()}


def group_of_near_copies(seed, n, words=60):
    """Edits of one text, few or many, some of them edits of edits: half of all pairs lie just below or above the threshold."""
    r = random.Random(seed)
    made = [[f"g{r.randrange(10**6)}" for _ in range(words)]]
    for _ in range(n):
        w = list(made[r.choice([0, 0, 0, r.randrange(len(made))])])
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 9])):
            kind, at = r.randrange(3), r.randrange(len(w))
            w[at : at + (kind > 0)] = [f"e{r.randrange(10**6)}"][: kind != 1]
        made.append(w)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("paired", [16, 2, 0])
def test_near_duplicates(spark, paired, monkeypatch):
    monkeypatch.setattr(near_dups, "PAIRED", paired)
    rows = [r for r in EDGES if r[0] is not None] + list(enumerate(texts(6, 60) + group_of_near_copies(5, 150), 100))
    random.Random(1).shuffle(rows)
    rows = [(i if i < 100 else 100 + (i * 7919) % 1009, t) for i, t in rows]  # the smallest id is anywhere in a group
    got = near_dups.component_documents(documents(spark, [*rows, (None, "one two three"), (None, None)])).collect()
    assert len(got) == len(rows) + 2
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, True), (2, None, True)]
    want = brute_components(rows)
    assert len({w[2] for w in want}) < len(want) - 100
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert near_dups.component_documents(documents(spark, [])).count() == 0


def test_prefixes_hold_a_common_edit_of_all_linked_sets():
    r, bands, met, inside = random.Random(3), near_dups._bands(), 0, 0
    band = lambda d: max(i for i, b in enumerate(bands) if b <= d)
    for _ in range(3000):
        h = set(range(r.randrange(5, 60)))
        base = h ^ set(r.sample(range(1000), r.randrange(1, 40)))
        x, y = (base ^ set(r.sample(range(1000), r.randrange(0, 9))) for _ in "xy")
        dx, dy = h ^ x, h ^ y
        near = [100 * len(z & h) >= 80 * len(z | h) for z in (x, y)]
        if 100 * len(x & y) < 80 * len(x | y) or not dx or not dy or all(near):
            continue
        met, inside = met + 1, inside + any(near)
        order = lambda d: [e for _, e in sorted((e in h, e) for e in d)]  # noqa: E731, B023
        least = lambda z, own: 20 * (len(z) * 80 // 100 + len(h)) // 180 + 1 if own else 1  # noqa: E731, B023
        first = lambda d, z, own, other: order(d)[: dict(near_dups.prefixes(len(d), len(z), 80, bands, least(z, own))).get(band(len(other)), 0)]  # noqa: E731, B023
        assert set(first(dx, x, near[0], dy)) & set(first(dy, y, near[1], dx))
    assert met > 200 and inside > 50


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    with common.Scratch(spark) as scratch:
        got = {r.doc: r.comp for r in graph.components(e, scratch).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_shards_hold_the_mixture(spark):
    r = random.Random(8)
    rows = [(i, r.choice([None, "", "abc" * r.randrange(9)]), r.choice(["a", "a", "a", "b", None])) for i in range(997)] + [(5, "t", "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = shards.interleave(df, 40, bucket_rows=50).collect()
    counts = [sum(g.shard == s for g in got) for s in range(40)]
    assert len(got) == 1000 and max(counts) - min(counts) <= 1
    assert all(sorted(g.slot for g in got if g.shard == s) == list(range(counts[s])) for s in range(40))
    source = {i: s for i, _, s in rows}
    share = sum(s == "a" for _, _, s in rows) / 1000
    assert all(abs(sum(source[g.doc_id] == "a" for g in got if g.shard == s) - share * counts[s]) <= 2 for s in range(40))
    assert shards.interleave(df.limit(0), 40).count() == 0


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(120)]
    vectors[7] = (7, vectors[8][1])
    bad = [(200, None), (250, [1.0, None]), (300, [float("nan")] * 6), (None, [1.0] * 6), (350, [])]
    got = topk.top_k(spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).collect()
    ints = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    want = set()
    for q in (0, 50, 100):
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want


def test_toxicity_tells_the_words(spark):
    r = random.Random(10)
    clean = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(40))
    rows = [(i, clean() + (" vilestword scum " if i % 5 == 0 else "")) for i in range(900)] + [(900, None), (901, ""), (None, "x")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900) if i % 2] + [(i, 1) for i in range(0, 900, 10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [r for i, r in got.items() if i is not None and i < 900 and r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_leaks_are_found_with_edits(spark):
    r = random.Random(11)
    words = [f"v{r.randrange(4000)}" for _ in range(4000)]
    items = [(i, " ".join(r.sample(words, 30))) for i in range(12)] + [(90, None), (91, "two words"), (None, "a b c d e f")]
    rows = []
    for i in range(12):
        w = items[i][1].split()
        for _ in range(i % 5):
            w[r.randrange(30)] = "edited"
        rows.append((i, " ".join(r.sample(words, 60) + w + r.sample(words, 60)).upper()))
    rows += [(100 + i, " ".join(r.sample(words, 150))) for i in range(20)] + [(200, None), (201, "")]
    found = decontaminate.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(i, i) for i in range(12)}
    assert decontaminate.mark(documents(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("size(leaks) > 0").count() == 0


PAGE = '<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><ul><li><a href="/">Menu one</a></li></ul></nav><article><h1>Head &amp; line {n}</h1><p>First  paragraph\nof {n} goes on. And on.</p><p><b>Second one <i>here</i>, with words.<br>More of it.</p></article><footer>&copy; somebody</footer></body></html>'


def test_html_blocks_and_extraction(spark):
    text = "Head & line 3\nFirst paragraph of 3 goes on. And on.\nSecond one here, with words. More of it."
    assert [b.text for b in html.blocks(PAGE.format(n=3))] == ["Menu one", *text.split("\n"), "© somebody"]
    assert html.blocks(None) == html.blocks("") == html.blocks("<!-- never ends") == []
    rows = [(i, "u", PAGE.format(n=i)) for i in range(30)] + [(100, None, None), (101, "u", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == (text, len(text)) and got[100] == got[101] == ("", 0)


def test_html_loses_nothing_beside_its_marks():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts('<article><p>before</p><svg viewBox="0 0 1 1" /><p>after</p></article>') == ["before", "after"]
    assert texts("<p>before<!-->after</p><p>one<!--->two<!-- three -->four</p>") == ["beforeafter", "onetwofour"]
    assert texts("<p>area <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> is</p>") == ["area x=12 is"]
    assert texts("<p>area <math><semantics><mi>x</mi><annotation encoding='tex'>\\x</annotation></semantics></math> is</p>") == ["area x is"]
    for name in ("svg", "SVG", "noscript", "template", "annotation"):
        assert texts(f"<p>a</p><{name} class=x><p>b</p>") == ["a", "b"] and texts(f"<p>a</p><{name}><p>b</p></{name} ><p>c</p>") == ["a", "c"]
        assert texts(f"<p>a <{name}>b <{name}>c</p>") == ["a b c"]
    for name in ("object", "math"):
        assert texts(f"<p>a <{name} data='x'>b") == ["a b"] and texts(f"<p>a <{name}>b</{name}> c</p>") == ["a b c"]
    for name in ("script", "style", "title", "iframe", "TITLE"):
        assert texts(f"<p>a</p><{name} x='>'><p>b</p>") == ["a"] and texts(f"<p>a</p><{name} x>b < c</{name}><p>d</p>") == ["a", "d"]

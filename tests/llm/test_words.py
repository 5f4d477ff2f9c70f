"""Fingerprints, collocations and spelling variants against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chainframe.llm import collocations, fingerprints, near_dups, spelling, substrings

# --- fingerprints


def generalised_jaccard(a, b):
    return sum(min(a[x], b[x]) for x in a | b) / sum(max(a[x], b[x]) for x in a | b)


def test_collisions_are_as_likely_as_texts_are_similar():
    r, sampler, off = random.Random(1), fingerprints.Sampler(), []
    for pair in range(500):  # words of their own for each pair, as draws of one word are the same everywhere
        words = [f"{pair}w{int(r.paretovariate(0.7)) % 500}" for _ in range(r.randrange(1, 200))]
        other = [w if r.random() < 0.8 else f"{pair}v{r.randrange(90)}" for w in words] + words[: r.randrange(0, 40)]
        a, b = " ".join(words), " ".join(other)
        off.append(fingerprints.likeness(sampler.fingerprint(a), sampler.fingerprint(b)) - generalised_jaccard(fingerprints.terms(a), fingerprints.terms(b)))
    assert abs(np.mean(off)) < 0.008 and np.std(off) < 0.055 and max(map(abs, off)) < 0.2


def test_weights_scale_the_chance_of_a_word():
    n = 40_000
    for seed in range(4):
        hashes = np.random.default_rng(seed).integers(0, 1 << 63, 2, np.uint64)
        value, _ = fingerprints.draws(hashes, np.array([3.0, 1.0]), fingerprints._factors(n))
        assert np.mean(value[0] < value[1]) == pytest.approx(0.75, abs=0.015)


def test_a_small_table_gives_the_same_fingerprints(monkeypatch):
    text = " ".join(f"w{i % 300}" for i in range(1000))
    want = fingerprints.Sampler().fingerprint(text)
    monkeypatch.setattr(fingerprints, "CHUNK", 16)
    for rows in (16, 40, 200):
        small = fingerprints.Sampler(rows=rows)
        assert all((small.fingerprint(text) == want).all() for _ in range(3))


def test_fingerprints_of_documents_in_order(spark):
    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    docs = [(i, text(r.randrange(0, 90))) for i in r.sample(range(-200, 5000), 80)]
    docs += [(9001, "Žluťoučký kůň 漢字かな 𝒳𝒴"), (9002, None), (9003, ""), (9004, " \t "), (9005, "x"), (9006, "漢" * 3000), (9007, text(50_000)), (9008, docs[0][1]), (None, "no id")]
    df = spark.createDataFrame([(t, d, "x", 1.0, 7) for d, t in docs], "text string, doc_id long, fingerprint string, near_next double, bucket int").repartition(5)
    out = fingerprints.fingerprint_documents(df).collect()
    assert len(out) == len(docs)
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))
    prints, sampler = {}, fingerprints.Sampler()
    got = {x.doc_id: x for x in out}
    for i, (d, t) in enumerate(order):
        now, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(now) // 4
        edited = now[: len(now) - n] + after[:n]
        x = got[d]
        assert (x.n_chars, x.edited_sha256) == (len(now), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(now, x.fingerprint) == x.fingerprint and prints.setdefault(edited, x.edited_fingerprint) == x.edited_fingerprint
        a, b, c = (sampler.fingerprint(y) for y in (now, edited, after))
        assert (x.near_edited, x.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    assert got[9002].fingerprint == got[9003].fingerprint == got[9004].fingerprint != got[9005].fingerprint
    assert np.mean([x.near_edited for x in out]) > 0.5 > 0.3 > np.mean([x.near_next for x in out])
    assert fingerprints.fingerprint_documents(df.limit(0)).collect() == []
    one = fingerprints.fingerprint_documents(df.where("doc_id = 9001")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = fingerprints.fingerprint_documents(df.where("doc_id = 9001").union(df.where("doc_id = 9001"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


# --- collocations


def count_phrases(docs, longest):
    found = Counter()
    for lang, text in docs:
        for ch in ".,;:!?\n\v\f\r":
            text = (text or "").replace(ch, "\n")
        for piece in text.split("\n"):
            words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in piece.replace("\t", " ")).split(" ") if w]
            for n in range(1, longest + 1):
                found.update((lang or "und", " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    return found


def ranked_phrases(docs, longest, least, keep, share):
    f = count_phrases(docs, longest)
    candidates = {k: n for k, n in f.items() if " " in k[1] and n >= least}
    out = {}
    for (lang, phrase), a in candidates.items():
        w = phrase.split(" ")
        if any(g == lang and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} " and 100 * n >= share * a for (g, q), n in candidates.items()):
            continue
        cuts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], k) for k in range(1, len(w))]
        score, _, one, two = min((10**6 * a * a // (x * y), k, x, y) for x, y, k in cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), one, two))
    return sorted((lang, i + 1, p.decode(), -a, x, y, sum(n for (g, q), n in f.items() if g == lang and " " not in q), -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:keep]))


def trie_of(phrases, shard=0, shards=1):
    return collocations.Trie(pa.array([x for x, _ in phrases], pa.string()), pa.array([x for _, x in phrases], pa.string()), shard, shards)


@pytest.fixture(scope="module")
def phrase_docs():
    r = random.Random(3)
    text = lambda n, v: " ".join(f"{r.choice('AaBbÉé')}{int(r.paretovariate(1)) % v}{r.choice(['', '', '', '.', ',', chr(9), chr(10), '  ', '!?'])}" for _ in range(n))
    docs = [(r.choice(["en", "de", None, "und"]), text(r.randrange(0, 60), 9)) for _ in range(150)]
    docs += [("en", "New York City is big, new york CITY\tis. New York\x0bCity")] * 9 + [("de", None), (None, ""), ("de", " \t . ,, "), ("en", "\0 x\0y " * 20), ("fr", "漢字 かな 漢字 " * 12), ("de", "lang lang " * 2000), ("en", "one")]
    return docs


@pytest.mark.parametrize("phrases,gathered,known", [(1 << 20, 1 << 22, 1 << 20), (25, 50, 40)])
def test_collocations_are_those_of_a_plain_count(spark, monkeypatch, phrase_docs, phrases, gathered, known):
    for name, value in (("TRIE_PHRASES", phrases), ("GATHERED", gathered), ("KNOWN", known)):
        monkeypatch.setattr(collocations, name, value)
    if phrases == 25:  # tasks read the constants, so they run with the small ones only in one process: look at the parts themselves
        tries = [trie_of([p for p in {("en", "a b"), ("en", "b c"), ("de", "a b c")} if zlib.crc32(p[1].split(" ")[0].encode()) % 2 == i], i, 2) for i in range(2)]
        assert sorted(t.owns(b"a") for t in tries) == [False, True]
    df = spark.createDataFrame([(t, g, "x", 1) for g, t in phrase_docs], "text string, lang string, phrase string, rank int").repartition(4)
    for longest, least, keep in ((3, 10, 2000), (4, 5, 7)):
        got = sorted(tuple(x) for x in collocations.collocations(df, longest, least, keep).collect())
        assert got == ranked_phrases(phrase_docs, longest, least, keep, 50)
    assert collocations.collocations(df.limit(0)).collect() == [] and collocations.collocations(df.where("lang = 'none'"), least=10**6).collect() == []


@pytest.mark.parametrize("longest,least", [(3, 10), (4, 5)])
def test_texts_are_not_read_again_for_each_of_several_tries(spark, monkeypatch, phrase_docs, longest, least):
    df = spark.createDataFrame(phrase_docs, "lang string, text string").repartition(4)
    words = sum(n >= least for (_, p), n in count_phrases(phrase_docs, 1).items())
    reads, met = [], []
    for name in ("propose", "count_states"):
        monkeypatch.setattr(collocations, name, lambda *a, plain=getattr(collocations, name): reads.append(1) or plain(*a))
    states = collocations.Windows.count_states
    monkeypatch.setattr(collocations.Windows, "count_states", lambda self, sent, shard, shards: met.append(shards) or states(self, sent, shard, shards))
    for most in (words, words + 20):
        monkeypatch.setattr(collocations, "TRIE_PHRASES", most)
        reads.clear(), met.clear()
        got = sorted(tuple(x) for x in collocations.collocations(df, longest, least, 2000).collect())
        assert got == ranked_phrases(phrase_docs, longest, least, 2000, 50) and len(reads) < longest and met[0] > 1


def test_a_trie_leads_where_its_phrases_lead():
    r = random.Random(4)
    phrases = sorted({(r.choice(["en", "de"]), " ".join(f"w{int(r.paretovariate(0.5)) % 3000}" for _ in range(r.randrange(1, 4)))) for _ in range(6000)})
    trie = trie_of(phrases)
    numbers = {lang: {w: first + i for i, w in enumerate(words.to_pylist())} for lang, (first, words) in trie.symbols.items()}
    ends = dict(zip(phrases, trie.ends.tolist(), strict=True))
    assert len(set(ends.values())) == len(phrases)
    for _ in range(300):
        lang, words = r.choice(["en", "de"]), r.choice(phrases)[1].split(" ") + [f"w{r.randrange(3000)}"]
        state = np.array([1])
        for i, w in enumerate(words):
            state = trie.step(state, np.array([numbers[lang].get(w, 0)]))
            want = ends.get((lang, " ".join(words[: i + 1])))
            assert (state[0] == want) if want else not trie.accepts[state[0]]


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000_001
    wide = spark.sql(f"select cast({a} as decimal(16,0)) a, cast({a + 7} as decimal(16,0)) l, cast({a + 1} as decimal(16,0)) r").selectExpr("cast(1000000 * cast(a * a as decimal(31,0)) as decimal(38,0)) div cast(l * r as decimal(38,0)) as s").first().s
    assert wide == 10**6 * a * a // ((a + 7) * (a + 1))


# --- spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(docs, letters=5, least=3):
    import re

    n = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in beside.items() if vs}
    form = {w: v if n[v] >= 2 * n[w] else None for w, v in best.items()}

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return sorted((w, n[w], len(beside[w]), form.get(w) or "", n[form[w]] if form.get(w) else 0, root(w)) for w in n)


@pytest.fixture(scope="module")
def spelled():
    r = random.Random(5)
    stems = ["".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(60)] + ["x" * 400, "hello", "Ærøskøbing"]

    def word():
        w = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w[i : i + r.randrange(2)] = r.choice([[], ["a"], ["z"], ["É"]])
        return "".join(w).replace("a", r.choice("aaA"))

    docs = [(i, " ".join(word() for _ in range(r.randrange(80)))) for i in range(250)]
    return docs + [(7, docs[7][1]), (None, "hello hello"), (900, None), (901, ""), (902, "1 2 漢字"), (903, "Z" * 5000 + " " + "y" * 5000), (904, ("abcde" * 1000 + " ") * 5), (905, ("abcde" * 1000 + "a ") * 11)]


@pytest.mark.parametrize("block,part", [(2048, 4096), (64, 8)])
def test_spelling_groups_are_those_of_all_pairs(spark, monkeypatch, spelled, block, part):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in spelled], "doc_id long, text string, word string, n int").repartition(3)
    got = sorted((x.word, x.n, x.n_near, x.form or "", x.form_n or 0, x.root) for x in spelling.variant_groups(df).collect())
    want = grouped(spelled)
    assert got == want and any(x[3] for x in want) and any(x[5] not in (x[0], x[3]) for x in want)
    assert spelling.variant_groups(df.limit(0)).collect() == []


def test_an_index_finds_what_differs_in_one_letter():
    r = random.Random(6)
    for short in (2, 3, 5, 8):
        words = sorted({"".join(r.choice("abc") for _ in range(short + r.randrange(2))) for _ in range(200)})
        for side in (0, 1):
            index = spelling.Index([(w, 1) for w in words], short, side)
            for m in (short, short + 1):
                queries = [w for w in words if len(w) == m] + ["z" * m, "a" * (m - 1) + "z"]
                same = lambda a, b: a[: short // 2] == b[: short // 2]
                found = index.near(queries)
                for q, bits in zip(queries, found, strict=True):
                    got = {index.words[i][0] for i in range(len(words)) if int(bits[i // 64]) >> (i % 64) & 1}
                    assert got == {w for w in words if near(q, w) and min(len(q), len(w)) == short and same(q, w) == (side == 0)}


def test_numbers_of_a_reader():
    trie = trie_of([("en", "a"), ("en", "b")], 0, 2)
    reader = collocations._Reader(trie)
    row = reader.read(["en", None, "en"], ["a  b. c", "a", None])
    assert row.tolist() == [1, 2, 0, 3, 0, 4, 0] and reader.more == [("en", "c"), ("und", "a")] and not reader.full()
    assert [x.to_pylist() for x in collocations._phrases(np.array([[1, 3], [4, 2], [2, 1]]), trie, reader.more)] == [["en", "und", "en"], ["a c", "a b", "b a"]]
    assert collocations._Reader(trie_of([("en", "a")])).read(["en"], ["a x a"]).tolist() == [1, 0, 1, 0]


def test_rows_of_numbers_are_told_apart_in_any_width():
    rows = np.array([[5, 6, 7], [5, 6, 7], [1, 2, 3]])
    for below in (8, 1 << 30):
        found, n = collocations._distinct(rows, below)
        assert found.tolist() == [[1, 2, 3], [5, 6, 7]] and n.tolist() == [1, 2]


# --- near duplicates in families


def test_candidates_of_families_grow_in_proportion(spark, monkeypatch):
    """Neighbours of one document that share words by families, but are not linked with one another."""
    counts, plain = [], near_dups._share_edits
    monkeypatch.setattr(near_dups, "_share_edits", lambda *a: counts.append((out := plain(*a)).count()) or out)
    for n in (90, 180, 360):
        r = random.Random(7)
        hub = [f"h{i}" for i in range(240)]
        docs = [(0, " ".join(hub))]
        for i in range(1, n):
            w = list(hub)
            for at in range(i % 3 * 12, i % 3 * 12 + 12):  # the same for all of the family
                w[at] = f"f{i % 3}_{at}"
            for at in r.sample(range(40, 240), 45):
                w[at] = f"u{i}_{at}"
            docs.append((i, " ".join(w)))
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {x.doc_id: x.component_id for x in near_dups.component_documents(df, 1).collect()}
        sets = {d: set(t.split()) for d, t in docs}
        assert all(5 * len(sets[0] & sets[d]) < 4 * len(sets[0] | sets[d]) or got[d] == 0 for d in sets)
    assert len(counts) == 3 and counts[1] <= 2.5 * counts[0] + 50 and counts[2] <= 2.5 * counts[1] + 50, counts


def test_columns_of_any_name_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage, "a", 1, 2, "s"), (2, f"x {passage} y", "b", 3, 4, "t"), (None, passage, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _ver int, __starts int, starts string")
    out = {x.doc_id: x for x in substrings.remove_repeats(df).collect()}
    assert {d: (x["_doc"], x["_ver"], x["__starts"], x["starts"], x.n_removed) for d, x in out.items()} == {1: ("a", 1, 2, "s", 0), 2: ("b", 3, 4, "t", 60), None: (None, None, None, None, 0)}
    assert out[2].kept == "x y"


def test_a_trie_is_sent_packed():
    trie = trie_of([(lang, f"w{i} w{i * 7 % 400}") for lang in ("en", "de") for i in range(400)] + [("en", "w1"), ("xx", "\U0001f600 é")])
    trie.ends = None
    sent = type("Sent", (), {"value": trie.packed()})
    back = collocations.Trie.unpacked(sent)
    assert all(np.array_equal(getattr(back, a), getattr(trie, a)) for a in ("base", "check", "accepts")) and back.symbols == trie.symbols
    assert (back.shard, back.shards, back.words) == (trie.shard, trie.shards, trie.words) and 4 * len(sent.value) < trie.base.nbytes + trie.check.nbytes

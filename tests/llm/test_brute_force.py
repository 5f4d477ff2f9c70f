"""What SQL can't express, against plain Python: leaks, risk and scores, block labels, shards, the pipeline."""

import random
import zlib
from hashlib import md5

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from chainframe.llm import bpe, common, decontaminate, html, shards, topk, toxicity

# --- decontamination


def distance_inside(item, text):
    """Least number of word edits between the item and any stretch of the text."""
    last = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(last[j - 1] + (w != t), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


def edited(r, words, kind, edits):
    w = list(words)
    if kind == "substitutions":
        for i in r.sample(range(len(w)), edits):
            w[i] = f"e{r.randrange(10**6)}"
    elif kind == "insertions":
        for _ in range(edits):
            w.insert(r.randrange(1, len(w)), f"e{r.randrange(10**6)}")
    else:
        for i in sorted(r.sample(range(len(w)), edits), reverse=True):
            del w[i]
    return w


@pytest.mark.parametrize("kind,least", [("substitutions", 0.98), ("insertions", 0.98), ("deletions", 0.95)])
def test_recall_of_items_with_as_many_edits_as_are_allowed(kind, least):
    r = random.Random(kind)
    text = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    items = [(i, text(r.choice([15, 20, 30, 45, 59]))) for i in range(200)]
    index = decontaminate.Index([(i, " ".join(w)) for i, w in items], 20)
    docs = [" ".join(text(80) + edited(r, w, kind, decontaminate.allowed(len(w), 20)) + text(80)) for _, w in items]
    found = index.search(docs)
    for i, got in enumerate(found):
        for item, d in got.items():
            assert d == distance_inside(items[item][1], docs[i].split()) <= len(items[item][1]) // 5
    assert sum(i in got for i, got in enumerate(found)) >= least * len(items)
    clean = index.search([" ".join(text(250)) for _ in range(50)])
    assert not any(clean)


def test_leaks_are_those_of_all_pairs(spark):
    r = random.Random(4)
    text = lambda n: [f"w{r.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([1, 2, 3, 4, 5, 9, 12, 20, 30, 2, 12])] + [(50, "漢字 かな"), (51, ""), (52, None), (53, "?!"), (None, "w1 w2"), (7, "w3 w4 w5")]
    docs = [(i, " ".join(text(r.randrange(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"{' '.join(text(9))} {t.upper()}, {' '.join(text(9))}") for i, t in items if i is not None and t]
    docs += [(200, None), (201, ""), (202, "読む漢字かなと"), (None, items[8][1]), (100, items[8][1]), (100, items[8][1])]
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in docs], "doc_id long, text string, leaks string, _leaks array<int>").repartition(3)
    out = decontaminate.mark(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(out.columns) == ["_leaks", "doc_id", "leaks", "text"]
    want = []
    for d, t in docs:
        best = {}
        for i, item in items:
            w = decontaminate.words_of(item)
            if i is not None and w and (k := distance_inside(w, decontaminate.words_of(t))) <= len(w) // 5:
                best[i] = min(k, best.get(i, k))
        want.append((d, t, tuple(sorted(best.items()))))
    got = [(x.doc_id, x.text, tuple(sorted((y.item, y.distance) for y in x.leaks))) for x in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontaminate.mark(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- toxicity


def test_risk_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(3)
    bags = lambda n: [np.sort(rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(n)]
    p, u, w, prior = bags(9), bags(20), rng.normal(0, 1, 12), 0.2

    def parts(w, b):
        f = lambda bag: 1 / (1 + np.exp(-(sum(w[i] for i in bag) + b)))
        s_p, s_u = np.mean([f(x) for x in p]), np.mean([f(x) for x in u])
        return prior * (1 - s_p), s_u - prior * s_p  # loss of toxic as clean; risk on clean text

    for b in (0.3, -4.0):
        toxic, clean = parts(w, b)
        risk = (lambda w, b: sum(parts(w, b))) if clean >= 0 else (lambda w, b: -parts(w, b)[1])
        grad, grad_b = toxicity._risk_gradient(p, u, w, b, prior)
        e = 1e-5
        for i in range(12):
            step = np.eye(12)[i] * e
            assert grad[i] == pytest.approx((risk(w + step, b) - risk(w - step, b)) / (2 * e), abs=1e-6)
        assert grad_b == pytest.approx((risk(w, b + e) - risk(w, b - e)) / (2 * e), abs=1e-6)


def test_scores_against_a_loop(spark):
    model = toxicity.Model(np.array(sorted({b for w in ("vile", "scum") for b in toxicity.Features()[w]})), np.float32(np.linspace(-1, 2, len({b for w in ("vile", "scum") for b in toxicity.Features()[w]}))), -0.5)
    docs = [(1, "vile vile words"), (1, "vile vile words"), (2, None), (3, ""), (None, "Scum!"), (4, "x " * 200_000 + "vile")]
    df = spark.createDataFrame([(i, t, 9.0, "keep") for i, t in docs], "doc_id long, text string, score double, bias string")
    out = toxicity.score(df, model)
    table, known = model.table(), toxicity.Features()
    want = []
    for i, t in docs:
        hit = {b for w in (t or "").lower().replace("!", "").split() for b in known[w]}
        s = 1 / (1 + np.exp(-(sum(float(table[b]) for b in hit) - 0.5)))
        want.append((i, round(s, 6), int(s >= 0.7), "keep"))
    assert sorted(((r.doc_id, round(r.score, 6), r.predicted, r.bias) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_fit_does_not_depend_on_the_files(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(90)}" for _ in range(20)) + (" vile scum" if i % 4 == 0 else "")) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(9, "text"), labels.repartition(5))
    assert np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights) and len(a.buckets)
    none = toxicity.fit(docs.limit(0), labels)
    assert len(none.buckets) == 0 and toxicity.score(docs, none).where("predicted = 1").count() == 0


# --- pages


def made_pages(n, seed=5):
    """Marked pages to fit on: other words in each, furniture around the article and inside it."""
    r = random.Random(seed)
    words = lambda k: " ".join(f"{r.choice('bdfglm')}{r.choice('aeiou')}{r.choice('nrst')}{r.randrange(50)}" for _ in range(k)).capitalize() + "."
    for _ in range(n):
        body = "".join(f"<p>{words(r.randrange(5, 60))}</p>" for _ in range(r.randrange(1, 7)))
        yield f"<html><body><nav><ul>{''.join(f'<li><a href=/x>{words(1)}</a></li>' for _ in range(5))}</ul></nav><div class=ad>{words(6)}</div><article><h1>{words(5)}</h1>{body}<aside class=related><a href=/y>{words(4)}</a></aside></article><footer>&copy; {words(4)}</footer></body></html>"


#: Pages that people might write, their blocks marked by hand: + main text, - anything else.
MARKED = [
    ("<div id=header><a href=/>Home</a> <a href=/a>About us</a></div><div id=content><h1>On rivers</h1><p>Rivers carry more than water, and slowly.</p><p>They carry sand as well. It settles.</p></div><div id=footer>© 2024 Rivers Ltd</div>",
     "-Home About us +On rivers +Rivers carry more than water, and slowly. +They carry sand as well. It settles. -© 2024 Rivers Ltd"),
    ("<nav><ul><li><a href=/1>News</a><li><a href=/2>Sport</a></ul></nav><main><h1>The match</h1><p>It ended without a goal, as it had begun.</p><div class=comments><p>First!</p><p>I was there and it was dull.</p></div></main><aside class=sidebar><h3>More</h3><a href=/3>Another match</a></aside>",
     "-News -Sport +The match +It ended without a goal, as it had begun. -First! -I was there and it was dull. -More -Another match"),
    ("<header class=banner>The Daily Page</header><div class='cookie notice'>We use cookies. <button>Accept</button></div><article class=post><h2>Bread</h2><p>Flour, water, salt and time: nothing else is needed.</p><blockquote>Bread is older than writing.</blockquote></article><form class=newsletter>Subscribe <input></form>",
     "-The Daily Page -We use cookies. -Accept +Bread +Flour, water, salt and time: nothing else is needed. +Bread is older than writing. -Subscribe"),
    ("<article><h1>Lists</h1><ul><li>One thing that matters a great deal.</li><li>Another that matters a little less.</li></ul><div class=share><a href=/t>Share</a></div></article><footer>Terms and privacy</footer>",
     "+Lists +One thing that matters a great deal. +Another that matters a little less. -Share -Terms and privacy"),
]


def test_labels_of_hand_marked_pages():
    model = html.fit_pages(list(made_pages(60)))
    hit = said = there = 0
    for page, marks in MARKED:
        found = html.blocks(page)
        at, want = 0, []
        for b in found:
            assert b.text in marks, b.text
            at = marks.index(b.text, at)
            want.append(marks[at - 1] == "+")
        got = html.label(model, [html.vectors(found)])[0]
        hit, said, there = hit + sum(g and w for g, w in zip(got, want, strict=True)), said + int(got.sum()), there + sum(want)
    assert 2 * hit / (said + there) >= 0.9, (hit, said, there)


def test_labels_do_not_depend_on_what_is_read_together():
    model, pages = html.fit_pages(list(made_pages(20)), epochs=2), [html.vectors(html.blocks(p)) for p in made_pages(7, 9)]
    one = [html.label(model, [p])[0] for p in pages]
    assert all(np.array_equal(a, b) for a, b in zip(one, html.label(model, pages), strict=True)) and html.label(model, []) == []


def test_extraction_keeps_rows_and_other_columns(spark):
    rows = [(i, "u", p, "old", 5) for i, p in enumerate(made_pages(25))] + [(100, None, None, None, None), (None, "u", "", "old", 1), (3, "v", "<p>", "t", 2), (3, "v", "<p>", "t", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, path int")
    out = html.extract(df, html.fit(df)).collect()
    assert len(out) == len(rows) and all(r.text == "" for r in out if not r.html or r.html == "<p>") and sum(r.path == 2 for r in out) == 2
    assert sum(bool(r.text) for r in out) >= 24
    assert html.extract_pages(df.limit(0)).count() == 0


# --- shards


def test_shards_against_a_sort(spark):
    r = random.Random(6)
    rows = [(r.choice([None, *range(500)]), r.choice([None, "", "straße" * r.randrange(9)]), r.choice(["a"] * 8 + ["b", None])) for _ in range(700)]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, source string, _mix int, stratum string").repartition(5)
    data = lambda t: (t or "").encode()
    keyed = [(int(md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:8], 16), (i is not None, i or 0), zlib.crc32(data(t)), len(data(t)) + 16, s, i) for i, t, s in rows]
    placed = []
    for s in {s for _, _, s in rows}:
        mine = sorted(k[:4] + (k[5],) for k in keyed if k[4] == s)
        placed += [((2 * n + 1) / (2 * len(mine)), (s is not None, s or ""), n, k) for n, k in enumerate(mine)]
    placed.sort(key=lambda x: x[:3])
    n = len(rows)
    want = [(k[4], k[3], k[2], at * 40 // n, at - -(-(at * 40 // n) * n // 40)) for at, (_, _, _, k) in enumerate(placed)]
    for bucket in (20_000, 37):
        got = [tuple(x) for x in shards.interleave(df, 40, bucket_rows=bucket).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


# --- caches


def test_caches_are_bounded_by_bytes_and_one_operators_at_a_time():
    cache = common.Bounded(limit=10_000)
    for i in range(5_000):
        cache.keep(f"word{i}", i)
        assert len(cache) < 100
    cache.keep("x" * 1_000, 1)
    assert "x" * 1_000 not in cache
    a = common.worker_state("a", list)
    assert common.worker_state("a", list) is a and common.worker_state("b", dict) == {} and common.worker_state("a", list) is not a


# --- top k with repeated ids


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    r = np.random.default_rng(4)
    rows = [(i % 30, [float(x) for x in r.normal(0, 1, 5)]) for i in range(70)] + [(0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(df, df.vec_id % 10 == 0, 3).collect())
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for a, (i, v) in enumerate(ints):
        if i % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(ints) if a != b and len(v) == len(w))[:3]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


# --- the pipeline


def corpus(spark, folder, rows):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "clash", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, leaks string, score int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("vilestword" in (t or "")), 1) for i, t in rows if i is not None and i < 150], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    item = " ".join(f"bench{k}" for k in range(20))
    spark.createDataFrame([(1, item), (2, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), item, r


def words(r, n):
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def test_every_stage_on_small_tables(spark, tmp_path):
    r = random.Random(9)
    toxic = [(i, f"{words(r, 30)} vilestword scum {words(r, 5)}") for i in range(0, 150, 3)]
    clean = [(i, words(r, 90)) for i in range(150) if i % 3]
    passage = words(r, 70)
    near = words(r, 100)
    item = " ".join(f"bench{k}" for k in range(20))
    special = [(200, near), (201, near), (202, near.replace(near.split()[50], "changed")), (210, f"{words(r, 20)} {passage} {words(r, 20)}"), (211, f"{words(r, 30)} {passage} {words(r, 10)}"), (212, passage),
               (220, f"{words(r, 30)} {item.replace('bench7 ', '')} {words(r, 30)}"), (230, None), (231, ""), (231, ""), (None, words(r, 40)), (240, words(r, 40_000))]
    folder, _, _ = corpus(spark, tmp_path / "a", toxic + clean + special)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.write_stage(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {name: sorted(((x.doc_id,) for x in df.select("doc_id").collect()), key=repr) for name, df in seen.items()}
    count = lambda name, *k: sum((i,) in ids[name] for i in k)
    assert count("toxicity", *(i for i, _ in toxic)) <= 3 and count("toxicity", *(i for i, _ in clean)) == len(clean) and count("toxicity", *(i for i, _ in special if i is not None)) == 11
    assert count("near_duplicates", 200) == 1 and count("near_duplicates", 201, 202) == 0 and ids["near_duplicates"].count((231,)) == 2 and ids["near_duplicates"].count((None,)) == 1
    text = {x.doc_id: x for x in seen["repeated_passages"].collect()}
    assert len(text[210].text.split()) == 110 and len(text[211].text.split()) == 40 and 212 not in text and text[211].n_chars == len(text[211].text) and text[230].text is None and len(text[240].text.split()) == 40_000
    assert count("decontamination", 220) == 0 and count("decontamination", 210, 211, 230, 231, 240) == 5
    out = {x.doc_id: x for x in seen["byte_bpe"].collect()}
    assert out[230].n_tokens == out[231].n_tokens == 0 and out[240].n_tokens >= 40_000 and None in out
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, seen["byte_bpe"].collect()), key=repr)


def test_stages_on_empty_tables(spark, tmp_path):
    folder, _, _ = corpus(spark, tmp_path / "e", [])
    assert corpus_pipeline.run(spark, folder).count() == 0


# --- long texts


def test_texts_longer_than_one_turn(spark, monkeypatch):
    from chainframe.llm import substrings, suffixes
    from tests.llm.test_llm import brute_strings, brute_windows, documents, texts

    monkeypatch.setattr(substrings, "TURN", 64)
    monkeypatch.setattr(suffixes, "PIECE", 512)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    rows = list(enumerate(texts(12, 12, 300))) + [(50, " ".join(texts(12, 12, 300))), (51, None)]
    got = substrings.remove_repeats(documents(spark, rows), 12, 7).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_windows(rows, 12)
    got = suffixes.remove_strings(documents(spark, rows), 200)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()), key=repr) == brute_strings(rows, 200)
    assert suffixes.remove_strings(documents(spark, []), 200).count() == substrings.remove_repeats(documents(spark, [])).count() == 0
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(documents(spark, [*rows, (None, "x")]), path, public_tokenizers.PATTERN), path, block=7)
    assert sorted(((r.doc_id, r.text) for r in both.collect()), key=repr) == sorted([*((i, t or "") for i, t in rows), (None, "x")], key=repr)

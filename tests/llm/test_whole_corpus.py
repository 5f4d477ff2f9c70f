"""Corpus operators do the whole job: no words, pages, vectors or rows are left out."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainframe.llm import html, substrings, topk


def test_every_word_of_a_block_is_hashed():
    words = [f"w{i}" for i in range(100)]
    vector = lambda ws: html.vectors([html.Block(" ".join(ws), np.zeros(html.PATH_BINS, bool), 0)])[0]
    bins = slice(html.PATH_BINS, html.PATH_BINS + html.WORD_BINS)
    assert np.allclose(vector(words)[bins], vector(words[::-1])[bins]) and not np.allclose(vector(words)[bins], vector(words[:40])[bins])
    assert vector(words)[bins].sum() == pytest.approx(4, abs=1e-4) and vector(words[:3])[bins].sum() == pytest.approx(0.3, abs=1e-5)


def test_fitting_pages_are_the_lowest_hashes_of_any_length(spark):
    rows = [(i, f"<p>{i}</p>") for i in range(400)] + [(None, "<p>none</p>"), (900, None), (901, "<p>" + "x" * 250_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    hashed = df.where("html is not null").select(F.expr("pmod(xxhash64(page_id), 1000000)").alias("h"), "html").collect()
    want = [r.html for r in sorted(hashed)[: html.FIT_PAGES]]
    assert html.sample(df) == html.sample(df.repartition(7, "html")) == want
    assert html.sample(df.where("page_id = 901 or page_id is null")) == [r.html for r in sorted(hashed) if "x" in r.html or "none" in r.html]
    assert len(html.sample(spark.range(300).select(F.lit(None).cast("long").alias("page_id"), F.col("id").cast("string").alias("html")))) == html.FIT_PAGES


def test_gradients_in_parts_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    data = [(rng.random((n, html.WIDTH)).astype(np.float32), (rng.random(n) > 0.5).astype(np.float32)) for n in (2, 9, 4, 7)]
    whole = html._gradients(html.BiLstm(), data)
    monkeypatch.setattr(html, "TOGETHER", 10)
    parts = html._gradients(html.BiLstm(), data)
    assert all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)


def test_large_vectors_are_queries_and_candidates(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(60)]
    data[0] = (0, [6e5, -7e5, 5.25e5, 1.0])
    data[1] = (1, [9e5, -8e5, 0.5, -6e5])
    data[2] = (2, [1e8, 9e7, 1.0, 1e3])  # with row 3 the products pass a long, their sum doesn't
    data[3] = (3, [9e7, -1e8, 7.0, 2e3])
    data[4] = (4, [0.0, 0.0, 0.0, 0.0])
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(256 * c)) for c in v] for i, v in data}
    want = set()
    for q in (0, 2, 4, 50):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id").isin(0, 2, 4, 50)).collect()} == want


def test_a_best_score_that_is_no_long_fails_and_a_low_one_does_not(spark):
    table = lambda *v: spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(table([1e200], [1e200], [1.0]), F.col("vec_id") == 2, 1).unionAll(topk.top_k(table([1e200], [1e200]), F.col("vec_id") == 0, 1)).collect()
    low = table([1e200, 1e300], [-1e200, -1e300], [0.0, 0.0], [0.0, 0.0])
    assert [(r.vec_id, r.score) for r in topk.top_k(low, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(2, 0), (3, 0)]
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(low, F.col("vec_id") == 0, 3).collect()


def test_pipeline_keeps_one_row_of_near_duplicates_of_any_id(spark):
    words = lambda a: [f"{a}{i}" for i in range(80)]
    near = lambda a: " ".join([*words(a)[:-1], "changed"])
    a, b, c, d, e = (" ".join(words(x)) for x in "abcde")
    data = [(1, a), (1, a), (2, b), (2, near("b")), (3, c), (3, d), (None, e), (None, e), (None, near("c")), (9, near("a")), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    second = [x for x in got if x[0] == 2]
    assert len(second) == 1 and second[0][1] in (b, near("b"))
    assert sorted((x for x in got if x[0] != 2), key=repr) == sorted([(1, a), (3, c), (3, d), (None, e), (5, None), (6, "")], key=repr)


def test_near_duplicates_send_no_texts_to_the_driver(spark):
    draw = np.random.default_rng(4)
    data = [(i // 2, draw.bytes(4_000).hex(), "x", "s", 8_000) for i in range(300)]  # 2.4 MB of different texts
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sc = spark.sparkContext
    sc.setJobGroup("texts", "results of near duplicates")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 300
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("texts")]
    sent = {k: sc._jsc.sc().statusStore().lastStageAttempt(k).resultSize() for job in jobs for k in job.stageIds}
    assert len(sent) > 20 and max(sent.values()) < 200_000, sorted(sent.items(), key=lambda x: -x[1])[:3]


def test_rows_of_one_id_are_numbered_by_all_columns_across_ranges(spark, monkeypatch):
    draw, numbered = np.random.default_rng(6), []
    monkeypatch.setattr(corpus_pipeline, "write_stage", lambda df, name, write=corpus_pipeline.write_stage: (numbered.append(write(df, name)), numbered[-1])[1])
    data = [(None if i % 9 == 0 else int(draw.integers(0, 12)), f"text {draw.integers(0, 40)}", "x", str(draw.integers(0, 3)), 1) for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.drop_near_duplicates(spark, docs.repartition(7), "")
    order = [F.asc_nulls_last("doc_id"), substrings.version(), F.xxhash64(*corpus_pipeline.COLUMNS), "text"]
    rows = [tuple(r)[:-1] for r in numbered[0].orderBy("_row").collect()]
    assert rows == [tuple(r) for r in docs.coalesce(1).sortWithinPartitions(*order).collect()] and len(numbered[0].select("_row").distinct().collect()) == 500


def test_pages_are_cut_in_linear_time():
    for page in ("<div>" * 20_000, "<p" * 60_000, "<a x='" * 40_000, "<li>x" * 20_000, "<div class=c{}>t".format("1") * 8_000, "</b>" * 60_000, '<p title="it' * 30_000, "<svg>x" * 20_000, "<!-->x" * 30_000, "<template a>" * 20_000, "<svg/>x" * 20_000):
        began = time.thread_time()
        html.blocks(page)
        one = time.thread_time() - began
        assert one < 3, (page[:20], one)


def test_paths_close_as_browsers_close_them():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>one<p>two <b>bold</b><div>three</div>four") == ["one", "two bold", "three", "four"]
    assert texts("<p>x <y and z</p><p>5 < 6</p>") == ["x", "5 < 6"]
    main = lambda page: [(b.text, b.main) for b in html.blocks(page)]
    assert main("<main>a<nav>b</nav>c</main>d") == [("a", True), ("b", False), ("c", True), ("d", False)]
    assert main("<article><div class='sidebar x'>a</div></div></article>b") == [("a", False), ("b", False)]

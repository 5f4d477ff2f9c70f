"""One query for each corpus operator, on its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframe.llm import bpe, collocations, decontaminate, fingerprints, html, near_dups, shards, spelling, substrings, suffixes, token_counts, topk, toxicity
from chainframe.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.component_documents(table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_interleaved_shards": op8_interleaved_shards,
    "op9_html_text": op9_html_text,
    "op10_near_dups": op10_near_dups,
    "op11_fingerprints": op11_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": """
        WITH docs AS (
            SELECT doc_id, row_number() OVER () AS r,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ), starts AS (
            SELECT doc_id, r, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
            FROM (SELECT doc_id, r, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE doc_id IS NOT NULL)
        ), firsts AS (
            SELECT h, min(doc_id) AS lo FROM starts GROUP BY h HAVING count(*) > 1
        ), covered AS (
            SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM starts JOIN firsts USING (h) WHERE doc_id > lo
        ), gone AS (
            SELECT r, list(i) AS gone, count(*) AS n FROM covered GROUP BY r
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN n IS NULL THEN words
                   ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
        FROM docs LEFT JOIN gone USING (r)
    """,
    "op6_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.r AS q, q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op7_suffix_dedup": """
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), bytes AS (
            SELECT r, unnest(range(0, len(h) // 2)) AS p, unnest(regexp_extract_all(h, '..')) AS b FROM docs
        ), starts AS (
            SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM docs)
        ), again AS (
            SELECT k FROM starts GROUP BY k HAVING count(*) > 1
        ), hits AS (
            SELECT r, p FROM starts JOIN again USING (k)
        ), covered AS (
            SELECT r, p, b, max(hits.p) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM bytes LEFT JOIN hits USING (r, p)
        ), marked AS (
            SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM covered
        ), summed AS (
            SELECT r, count(*) AS n, count(*) FILTER (gone) AS removed, count(*) FILTER (opens) AS spans, string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY r
        )
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM docs LEFT JOIN summed USING (r)
    """,
    "op8_interleaved_shards": """
        WITH table_of_crc AS (
            SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) x(i)
        ), docs AS (
            SELECT doc_id, source AS stratum, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS mix,
                   CASE WHEN text IS NULL THEN 0 ELSE xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT)),
                       lambda a, b: xor(a >> 8, list_extract(tab, CAST((xor(a, b) & 255) + 1 AS BIGINT)))), 4294967295) END AS text_crc32
            FROM documents, table_of_crc
        ), ranked AS (
            SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank FROM docs
        ), placed AS (
            SELECT *, row_number() OVER (ORDER BY CAST(2 * rank + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), stratum NULLS FIRST, rank) - 1 AS place FROM ranked
        ), cut AS (
            SELECT *, place * 40 // total AS shard FROM placed
        )
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
    """,
    "op10_near_dups": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM docs
        ), kinds AS (
            SELECT min(doc_id) AS doc, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
        ), near AS (
            SELECT a.doc AS a, b.doc AS b, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS shared
            FROM kinds a JOIN kinds b ON a.doc < b.doc AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
        ), links AS (
            SELECT a, b FROM near WHERE 100 * shared >= 80 * (total - shared)
        ), ways AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reach AS (
            SELECT doc AS a, doc AS b FROM kinds UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
        ), least AS (
            SELECT a AS doc, min(b) AS component FROM reach GROUP BY a
        ), found AS (
            SELECT list_sort(s) AS s, component FROM kinds JOIN least USING (doc)
        )
        SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
        FROM sets LEFT JOIN found ON list_sort(sets.s) = found.s
    """,
    "op12_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
            FROM documents
        ), split AS (
            SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
        ), grams AS (
            SELECT lang, 1 AS size, unnest(w) AS phrase FROM split
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split
        ), f AS (
            SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
        ), cand AS (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10
        ), cuts AS (
            SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)
        ), scored AS (
            SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one JOIN f y ON y.lang = cuts.lang AND y.phrase = two
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inner_parts AS (
            SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM cand WHERE size = 3
        ), longer AS (
            SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL
        ), kept AS (
            SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_spelling_variants": """
        WITH RECURSIVE table_of_crc AS (
            SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) x(i)
        ), runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents
        ), counted AS (
            SELECT doc_id, w, count(*) AS c FROM runs GROUP BY ALL
        ), hashed AS (
            SELECT w, c, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '..'), lambda b: CAST('0x' || b AS BIGINT)),
                lambda a, b: xor(a >> 8, list_extract(tab, CAST((xor(a, b) & 255) + 1 AS BIGINT)))), 4294967295) AS h
            FROM counted, table_of_crc
        ), changed AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, c FROM hashed
        ), vocab AS (
            SELECT word, CAST(sum(c) AS BIGINT) AS n, length(word) AS len FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
        ), cut AS (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM vocab)
        ), near AS (
            SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT cut.word, vocab.word FROM cut JOIN vocab ON cut.rest = vocab.word
            UNION SELECT vocab.word, cut.word FROM cut JOIN vocab ON cut.rest = vocab.word
        ), ranked AS (
            SELECT near.word, other, n AS other_n, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS place, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN vocab ON vocab.word = other
        ), forms AS (
            SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * vocab.n THEN other END AS form, CASE WHEN other_n >= 2 * vocab.n THEN other_n END AS form_n
            FROM vocab LEFT JOIN ranked ON ranked.word = vocab.word AND place = 1
        ), chain AS (
            SELECT word, word AS upto FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.upto WHERE form IS NOT NULL
        ), ends AS (
            SELECT chain.word, upto AS root FROM chain JOIN forms ON forms.word = chain.upto WHERE form IS NULL
        )
        SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)
    """,
}

"""Cleans a corpus in five stages and encodes what is left.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that the one before
kept. Every stage but the last returns the columns of ``documents``; run() applies them in turn.

In every stage extra columns are left out, whatever their names; a null id, text or other column stays as it is unless a
stage says otherwise; an empty table gives an empty one; texts count whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframe.llm import bpe, decontaminate, near_dups, substrings, toxicity
from chainframe.llm.common import table, write_stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of sf_dir, rejects go.

    A null or empty text is judged as one without words. Repeated rows are judged alike. Without labels, or without a toxic one, all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that chains of 0.8 similarity on five-word shingles link, the first stays: by id, then by text and the other columns.

    Rows are linked by their texts alone, whether or not they share an id; those without an id come last. Rows without words all stay.
    """
    # bounds of ranges are made from samples that the driver gathers, so they are no texts; rows that are alike in all three share a range
    ranges = [F.asc_nulls_last("doc_id"), substrings.version(), F.xxhash64(*COLUMNS)]
    rows = docs.select(*COLUMNS).repartitionByRange(*ranges).sortWithinPartitions(*ranges, "text").withColumn("_row", F.monotonically_increasing_id())
    rows = write_stage(rows, "numbered")
    gone = near_dups.link(rows, 5, 80, "_row").where("doc <> component").select(F.col("doc").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that an earlier document has go; documents of which nothing is left go too.

    Earlier is by id: rows of one id are no copies of each other, and a row without an id keeps everything. Null and empty texts
    stay. Only a text that loses words is written anew, with one space between words, and its n_chars with it.
    """
    out = substrings.remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    out = out.where("n_removed = 0 or n_removed < n_words").withColumn("n_chars", F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", text).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item with at most a fifth of its words edited go, repeated ones all.

    A null or empty text holds none; items without id, text or words are left out, so an empty benchmark lets all stay.
    """
    return decontaminate.mark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token counts and digests of every row, and of what its ids decode to; a null text counts as empty, a null id stays."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each one returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_stage(docs, name)
    return docs

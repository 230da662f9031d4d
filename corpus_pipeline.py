"""The corpus pipeline: language identification, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is the whole output of the stage before (the documents table for the first), and
returns a DataFrame, which is written as Parquet and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import exact_dedup, langid, mixing, near_dedup, packing
from wavemill.llm.common import arrow_rows, shared_dir, with_rows
from wavemill.llm.queries import END_ID, ID_BYTES, MIX_OTHER, MIX_WEIGHTS, PACK_TOKENIZER, tokenizer_path

#: Score from which the parser's answer counts against a document's own label.
CONTRADICTED = 0.99


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null, empty, or no letters), and those whose own label the parser contradicts.

    The parser learns from the labelled rows of its input. A label is contradicted if the parser knows that language and names another one with a score of CONTRADICTED or more: the
    label is wrong or the text is a mixture. Documents without a label, or with one that wasn't learned, stay if they have a letter; where no row is labelled, that is the
    only test. Each row is judged for itself, repeated ones alike; an empty table gives an empty table; other columns are not read, and go on as they are.
    """
    parser = langid.fit(docs, F.lit(True))
    if not parser.languages:
        return docs.where(F.coalesce(docs["text"].cast("string").rlike(r"\p{L}"), F.lit(False)))
    rows = with_rows(docs.select(F.col("text"), F.col("lang").cast("string").alias("lang")))
    found = langid.language(spark, parser, rows["text"])
    name, score = found["lang_pred"], found["score"]
    contradicted = F.coalesce(F.col("lang").isin(parser.languages) & (name != F.col("lang")) & (score >= CONTRADICTED), F.lit(False))
    rejected = rows.where((name == langid.UNDETERMINED) | contradicted).select(F.col("_row_part").alias("part"), F.col("_row_pos").alias("pos"))
    with arrow_rows(spark, 500):  # whole texts go to Python
        return exact_dedup.without(docs, rejected)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the row with the smallest doc_id stays.

    Null counts as empty. Rows without a doc_id come after all others, and of rows that repeat a doc_id the first of the input stays. An empty table gives an empty table; other columns
    go on as they are.
    """
    return exact_dedup.without(docs, exact_dedup.dedup(docs).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that share 0.8 of their five-word shingles, the row with the smallest doc_id stays.

    Nulls, repeated rows, empty tables and other columns: as in the stage before. Texts without words are one class.
    """
    return exact_dedup.without(docs, near_dedup.near_dedup(docs, threshold=0.8).where("not kept"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate says, in global hash order.

    A null or unlisted source belongs to the bucket of other sources; a null or empty text has size 0 and its source's rate. Rows that repeat a doc_id share its draw. An empty table
    gives an empty table; other columns go on as they are.
    """
    return mixing.mix(docs, MIX_WEIGHTS, MIX_OTHER, unit="chars", seed="mix").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document in sequences of 4096 tokens: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32.

    A null text is empty: its end id alone. Each row, repeated or not, is packed for itself. An empty table has no pieces; other columns are not read.
    """
    return packing.read_pieces(packing.pack(docs, tokenizer_path(PACK_TOKENIZER), 4096, END_ID), ID_BYTES, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language identification, near-duplicates and packing can't be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

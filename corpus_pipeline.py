"""The corpus pipeline: five stages, each over all documents that the one before kept, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideway.llm.decontaminate import drop_leaks
from tideway.llm.jaccard_join import keep_one
from tideway.llm.mixing import keep_mixed
from tideway.llm.quality import keep_good
from tideway.llm.queries import table, tokenizer_path
from tideway.llm.shared import discard, materialize
from tideway.llm.token_store import read_blocks, store_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Each row is judged by its own text, null as empty, so repeated rows stay or go alike; null ids too. An empty table, or
    labels of one kind only, are no error: see ``keep_good``.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of the n-gram Jaccard join hold together.

    Of a group the smallest doc_id stays, of equal ones one row, a null id only where there is no other. Rows that repeat
    in text are one group. Null texts and texts without words link with nothing: each different (doc_id, text) stays.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Each row is judged by its text: repeated rows and null ids stay or go alike; null and empty texts contain nothing and
    stay; null and empty items are in nothing; an empty benchmark keeps all.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a document stands as often as the mix takes it, one on a cut in part.

    Null sources are one source; equal rows each take a share of their own; null texts and texts without words are taken
    0 times and go.
    """
    return keep_mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, written to files of Huffman blocks and read back: doc_id, start, n_tokens, ids_crc32.

    Rows of one doc_id, as the copies of a mix, are stored each, by text; null ids come first; a null text has the end id
    alone.
    """
    return read_blocks(store_tokens(docs, tokenizer_path(), end_id=1))


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: A classifier, the tokenizer and its file format are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and reread as the next one's input; it goes once that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    stored = STAGES[-1][1](spark, docs, sf_dir)  # its files are written by now
    discard(docs)
    return stored

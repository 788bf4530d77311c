"""What the two classifiers share: a bounded sample of labelled texts, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, *columns: Column) -> list[tuple]:
    """(columns of the text, label) of at most ``per_class`` labelled rows of each class outside the held-out fold, those of least hash.

    ``columns`` are made of the column ``text``, null read as empty, where the texts are; without any it is the whole
    text. Only the number of rows is bounded.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    known = known.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"), F.xxhash64("doc_id").alias("_key")).distinct()
    order = ["_key", "_id", "_label"]
    picked = known.filter("_label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("_label = 1").orderBy(*order).limit(per_class))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # 2 * per_class rows
    taken = [c.alias(f"_{k}") for k, c in enumerate(columns or (F.col("text"),))]
    first = found.orderBy("_key", "_id", "_label", F.xxhash64("text")).limit(2 * per_class)
    return [(*[r[f"_{k}"] for k in range(len(taken))], r["_label"]) for r in first.select("_label", *taken).collect()]

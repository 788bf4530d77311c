"""Mixing sources to target weights: hash-random keys, a range sort, distributed prefix sums and an exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideway.llm.shared import WORD, discard, materialize, prefix_sums, ranged, text_or_empty


def word_count(text: Column) -> Column:
    """Words of a text; the count stays inside the JVM."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source, from rows (source, source_size).

    The sources, by code point with null last, take the weights in turn and share ``share`` times all words; no target
    exceeds ``most`` times its source, and what is over goes to the others by weight. That sharing ends where every
    source gets min(cap, level * weight): the level is the largest of (budget - caps of the k lowest ratios) / (weight
    of the others), over all k.
    """
    names = ranged(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "sources")
    place = prefix_sums(names.withColumn("one", F.lit(1)), [], [F.col("source").asc_nulls_last()], "one", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = place.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    by_ratio = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    ratios = ranged(capped.withColumn("ratio", by_ratio[0]), [F.col("ratio"), by_ratio[1]], "ratios")
    below = prefix_sums(ratios, [], [F.col("ratio"), by_ratio[1]], "cap", "caps_below")
    below = prefix_sums(below, [], [F.col("ratio"), by_ratio[1]], "weight", "weight_below")
    budget, weights_sum = ratios.agg(F.sum("source_size") * share, F.sum("weight")).first()  # one row
    level = below.agg(F.max((F.lit(budget) - F.col("caps_below")) / (F.lit(weights_sum) - F.col("weight_below")))).first()[0]
    return ratios.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, th (hash of its text), source, size, source_size, target, taken, copies, part.

    Each source's documents stand in a random order fixed by md5(seed, doc_id). Whole epochs of the source are taken
    first; of the last one, the documents before the budget's end, the one on the cut in part, so that a source's
    words sum to floor(target). ``copies`` is the number of whole copies.

    Null texts have size 0 and are taken 0 times; null sources are one source, sorted last; rows with equal doc_id are
    each a document; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), "source", word_count(text_or_empty()).alias("size"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("key"))
    counted = materialize(rows, "sizes")
    order = [F.col("key"), F.col("doc_id"), F.col("size"), F.col("th")]
    table = ranged(counted, [F.col("source").asc_nulls_last(), *order], "keyed")
    discard(counted)
    summed = prefix_sums(table, ["source"], order, "size", "before")
    # targets go to (pid, source) rows first: then a hot source's rows are met by many small keys, not by one
    totals = table.groupBy("pid", "source").agg(F.sum("size").alias("part"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, most)
    keys = totals.select("pid", F.col("source").alias("name")).join(targets, F.col("name").eqNullSafe(targets["source"])).drop("source")
    mixed = summed.join(keys.withColumnRenamed("pid", "of_pid"), (F.col("pid") == F.col("of_pid")) & F.col("source").eqNullSafe(F.col("name")), "left")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long")
    return mixed.select("doc_id", "th", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), epochs.alias("copies"), part.alias("part"))


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a document taken several times stands several times, one on the cut keeps its first words.

    Columns are those of ``docs``, whatever their names; of a cut document ``text`` holds the kept words, parted by one
    space. Each row takes its own share: rows equal in doc_id, text and source are numbered, and share out the takes of
    that many. Null texts and texts without words are taken 0 times and go; null ids and sources are as in
    ``mix_sources``; an empty table gives an empty result.
    """
    same = Window.partitionBy("doc_id", "th", "source")
    share = mix_sources(docs, **options).select("doc_id", "th", "source", "size", "taken", "copies", "part", F.row_number().over(same.orderBy(F.desc("part"))).alias("place")).filter("taken > 0").alias("share")
    rows = docs.select(F.col("doc_id"), F.xxhash64(text_or_empty()).alias("th"), "source", F.struct("*").alias("row"))
    rest = F.to_json(F.struct(*[F.col("row")[c] for c in docs.columns if c != "text"]))
    rows = rows.withColumn("place", F.row_number().over(same.orderBy(rest))).alias("doc")
    on = [F.col(f"doc.{c}").eqNullSafe(F.col(f"share.{c}")) for c in ("doc_id", "th", "source", "place")]
    takes = F.concat(F.array_repeat(F.col("size"), F.col("copies").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    taken = rows.join(share, on).select("row", "size", F.explode(takes).alias("take"))
    first_words = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col("row")["text"].cast("string"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("take").cast("int")))
    text = F.when(F.col("take") < F.col("size"), first_words).otherwise(F.col("row")["text"])
    return taken.select([(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])

"""Filter interaction audit: joint failures of all filter intersections by inclusion-exclusion, inverted to each order's outcome.

One aggregation counts, for each of the 2^n sets of filters, the documents that fail all of the set (a sum of products
of flags). All else follows from those sums: what a filter order keeps and removes, what only one filter catches, and
each filter's Shapley share, from the Harsanyi dividends of the game "documents removed by a set of filters".
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.llm.shared import materialize, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"


def text_flags(t: Column, words: Column) -> dict[str, Column]:
    """Failure of each text filter. A: under 200 words; B: fewer than half of its words distinct; C: over 3 % capitals; D: markup characters."""
    n, kinds, size = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long"), F.length(t).cast("long")
    return {"A": n < 200, "B": 100 * kinds < 50 * n, "C": 100 * (size - F.length(F.translate(t, UPPER, ""))) > 3 * size, "D": t.rlike(r"[#$%&*|]")}


def split_words(t: Column) -> Column:
    return F.array_remove(F.split(t, SPACE), "")


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, th, A, B, C, D) of each row, flags 1 where its text fails; null texts are empty, null languages ''."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("t"))
    flags = text_flags(F.col("t"), F.col("words"))
    return read.withColumn("words", split_words(F.col("t"))).select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("th"), *[f.cast("long").alias(k) for k, f in flags.items()])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E, n): how many rows of a document fail which filters.

    E: some row of a smaller doc_id has the same text (by SHA-256). A row passes E where its doc_id is the smallest of
    its text, so copies are joined by (text, doc_id), never gathered by text; null ids have no smaller one and are
    smaller than none.
    """
    rows = materialize(text_failures(docs).groupBy("th", "doc_id", "part", *FILTERS[:4]).agg(F.count(F.lit(1)).alias("n")), "flagged")
    known = rows.filter(F.col("doc_id").isNotNull())
    first = known.groupBy("th").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    marked = known.join(first, ["th", "doc_id"], "left").withColumn("E", F.when(F.col("first").isNull(), 1).otherwise(0).cast("long"))
    every = marked.select("doc_id", "part", *FILTERS, "n").unionByName(rows.filter(F.col("doc_id").isNull()).select("doc_id", "part", *FILTERS[:4], F.lit(0).cast("long").alias("E"), "n"))
    return every.groupBy("doc_id", "part", *FILTERS).agg(F.sum("n").alias("n"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic, 1 where any label row of the document says so; null ids have no label."""
    said = lambda c: F.max((F.col(c) == 1).cast("long"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    known = rows.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").select(*rows.columns, zero("good"), zero("toxic"))
    return known.unionByName(rows.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")}))


def joint_failures(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part arrays j, good and toxic: at place m, the documents that fail every filter of bit set m (bit k: filters[k]).

    Rows are first counted by flags, at most 2^n a part; then each set's count is one sum of products of flags.
    """
    kinds = {"j": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = rows.groupBy("part", *filters).agg(*[F.sum(F.col("n") * w).alias(k) for k, w in kinds.items()])

    def failing_all(value: str, m: int) -> Column:
        product = F.col(value)
        for k, f in enumerate(filters):
            product = product * F.col(f) if m >> k & 1 else product
        return F.sum(product)

    return counted.groupBy("part").agg(*[F.array(*[failing_all(v, m) for m in range(1 << len(filters))]).alias(v) for v in kinds])


def _over_sets(n: int, value: str, weight, holds) -> Column:
    """Sum over bit sets t of those that ``holds(t)``, of ``value``[t] times ``weight``(size of t)."""
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    return F.aggregate(sets, F.lit(0).cast("long"), lambda total, t: total + F.when(holds(t), F.col(value)[t] * weight(F.bit_count(t))).otherwise(0).cast("long"))


def orders(filters: str = FILTERS) -> Column:
    """Every step of every order: filter_order, step, the bits before it, and the filter's place."""
    steps = []
    for order in itertools.permutations(range(len(filters))):
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(filters[x] for x in order), "step": k + 1, "before": sum(1 << x for x in order[:k]), "place": f})
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, place: int>>")


def audit(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (times n!).

    Survivors of a set m are the sum of (-1)^|t| j[t] over its subsets t; those that only filter i catches the sum of
    (-1)^(|t|-1) j[t] over all t with i; the Shapley share sums each dividend (-1)^(|t|-1) j[t], parted evenly among t.
    """
    n = len(filters)
    every = 1
    for k in range(2, n + 1):
        every *= k
    sign = lambda size: 1 - 2 * (size % 2)
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))

    def survivors(value: str) -> Column:
        return F.transform(sets, lambda m: _over_sets(n, value, sign, lambda t: t.bitwiseAND(m) == t))

    def each(weight) -> Column:
        return F.array(*[_over_sets(n, "j", weight, lambda t, k=k: t.bitwiseAND(F.lit(1 << k)) != 0) for k in range(n)])

    only = each(lambda size: -sign(size))
    share = each(lambda size: -sign(size) * (F.lit(every) / size).cast("long"))  # sizes up to n divide n!
    solved = joint.select("part", "j", *[survivors(v).alias(f"left_{v}") for v in ("j", "good", "toxic")], only.alias("only"), share.alias("share"))
    at = solved.select("*", F.inline(orders(filters))).withColumn("bit", F.element_at(F.array(*[F.lit(1 << k) for k in range(n)]), F.col("place") + 1))
    lost = lambda v: F.col(f"left_{v}")[F.col("before")] - F.col(f"left_{v}")[F.col("before") + F.col("bit")]
    kept = F.col("left_j")[F.col("before") + F.col("bit")]
    fails = F.col("j")[F.col("bit")]
    return at.select("part", "filter_order", "step", kept.alias("kept"), lost("j").alias("removed"), (fails - lost("j")).alias("redundant"), F.col("only")[F.col("place")].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("share")[F.col("place")].alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over all documents, by language.

    Null texts are empty, null languages the part ''. Each row counts: rows equal in doc_id and text fail E together or
    not at all; a document with several label rows is good or toxic where any says so, and labels of unknown ids count
    nowhere; null ids never fail E and have no label. An empty table gives an empty result; other columns are ignored.
    """
    return audit(joint_failures(labelled(failures(docs), labels)))


def keep_passing(docs: DataFrame, filters: str = "ABCD") -> DataFrame:
    """The documents whose text fails none of the named text filters (A to D), with their columns, whatever their names."""
    if set(filters) - set("ABCD"):
        raise ValueError("keep_passing knows the text filters A to D")
    t = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
    fails = text_flags(t, split_words(t))
    rows = docs.select(F.struct("*").alias("row"))
    for f in filters:
        rows = rows.filter(~fails[f])
    return rows.select([F.col("row")[c].alias(c) for c in docs.columns])

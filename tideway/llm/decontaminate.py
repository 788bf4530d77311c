"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity, so no one signature length fits all documents.
Documents are parted by size: one of up to 2**s shingles has a signature of one permutation in about 2**(s - k) bins
(the leading bits of a shingle's hash are its bin, the least hash in a bin is the bin's value), so a fixed share of a
contained item's shingles is expected in it, however long the document is. Items are parted by size too: k is the
largest for which half of the shingles that must be shared are enough to miss the item with a chance of ``miss`` at most;
an item too short for any k has a signature of all its shingles, and every shingle of a document is compared with those.
The other half is room to leave out the shingles that most items have, so a phrase that all share makes no pairs.

One pass over the documents makes the signatures and keeps the entries that a table of item entries of bounded size may
have. They are joined with the items' entries; the pairs found, and only these, are verified on their words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideway.llm.shared import blocks, discard, exact_sets, materialize, shingle_sets, text_bytes, text_or_empty

MATCH_SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"
#: The k of the item classes, as bits of a byte; the last class has items too short for signatures.
SKIPS = (5, 4, 3, 2, 1, 0, -1)
SHORT = len(SKIPS)
#: Bins of the smallest signature, as bits.
LEAST_BITS = 5
#: Entries of the table that tasks look signatures up in, as bits, and those in one row of it.
TABLE_BITS, PART_BITS = (16, 24), 16


def wanted_shared(percent: int, size: int) -> int:
    """Shingles of an item of ``size`` that a document must have."""
    return max(1, -(-percent * size // 100))


def enough(c: int, miss: float) -> int:
    """How many shared shingles a document and an item of class ``c`` need for one of them to be told with a chance of 1 - ``miss``.

    A bin of 2**k shingles, and of a third more with those that the document lacks, has a given shared shingle as its
    least with the chance (1 - e^-load) / load. Of short items every shared shingle is told.
    """
    if c == SHORT:
        return 1
    load = 2.0 ** SKIPS[c] * 4 / 3
    return math.ceil(math.log(miss) / math.log(1 - (1 - math.exp(-load)) / load))


def item_class(size: int, percent: int, miss: float) -> int:
    """Place in ``SKIPS`` of the largest k for which half of the shingles that must be shared are enough; ``SHORT`` if none is."""
    half = wanted_shared(percent, size) // 2
    return next((c for c in range(SHORT) if enough(c, miss) <= half), SHORT)


def levels(own: np.ndarray) -> np.ndarray:
    """For each hash of a sorted set the fewest leading bits for which it is the least of its bin."""
    if not len(own):
        return np.zeros(0, np.int64)
    apart = own[1:] ^ own[:-1]
    high = np.frexp((apart >> np.uint64(11)).astype(np.float64))[1].astype(np.int64) + 11  # exact: 53 bits
    low = np.frexp((apart & np.uint64(0x7FF)).astype(np.float64))[1].astype(np.int64)
    return np.concatenate(([0], 65 - np.where(apart >> np.uint64(11) > 0, high, low)))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).withColumn("ih", F.xxhash64("text"))


def _item_entries(items: DataFrame, n: int, percent: int, miss: float) -> DataFrame:
    """(ih, hash, level, class) of the shingles of every different item that can make it a candidate.

    A document with the wanted share of an item's shingles has ``enough`` of any ``size - wanted + enough`` of them, so those
    in the fewest items do: a phrase that many items hold makes candidates only of items made of such phrases. The choice
    looks at items alone, so that it tells nothing about which shingles a document's signature has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(text_bytes(batch.column("text")), n)
            size = np.array([len(s) for s in sets], np.int64)
            kind = np.array([item_class(len(s), percent, miss) for s in sets], np.int64)
            most = np.array([len(s) - wanted_shared(percent, len(s)) + enough(c, miss) for s, c in zip(sets, kind.tolist(), strict=True)], np.int64)
            every = np.concatenate([*sets, np.zeros(0, np.uint64)])
            level = np.concatenate([*[levels(s) for s in sets], np.zeros(0, np.int64)])
            ih = batch.column("ih").take(pa.array(np.repeat(np.arange(len(sets)), size)))
            yield pa.RecordBatch.from_arrays([ih, pa.array(every.view(np.int64)), pa.array(level), pa.array(np.repeat(kind, size)), pa.array(np.repeat(most, size))], ["ih", "hash", "level", "class", "most"])

    every = materialize(items.select("ih", "text").dropDuplicates(["ih"]).mapInArrow(run, "ih long, hash long, level long, class long, most long"), "shingles")
    common = every.groupBy("hash").agg(F.count(F.lit(1)).alias("items")).filter("items > 1")
    rarity = F.row_number().over(Window.partitionBy("ih").orderBy("items", "hash"))  # an item's own shingles
    ranked = every.join(common, "hash", "left").withColumn("items", F.coalesce("items", F.lit(1))).withColumn("place", rarity)
    chosen = materialize(ranked.filter("place <= most").select("ih", "hash", "level", "class"), "items")
    discard(every)
    return chosen


def _table(entries: DataFrame, count: int) -> np.ndarray:
    """For the low bits of a hash the classes of items that have it, a bit each; 16 MB at most, however many entries."""
    bits = min(TABLE_BITS[1], max(TABLE_BITS[0], (16 * count).bit_length()))
    mask, size = (1 << bits) - 1, 1 << PART_BITS

    def packed(parts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in parts.values()], pa.binary())], ["part", "seen"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for batch in batches:
            at = batch.column(0).to_numpy() & mask
            bit = (1 << batch.column(1).to_numpy()).astype(np.uint8)
            for k in np.unique(at >> PART_BITS).tolist():
                own = at >> PART_BITS == k
                np.bitwise_or.at(parts.setdefault(k, np.zeros(size, np.uint8)), at[own] & size - 1, bit[own])
        if parts:
            yield packed(parts)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts[k] = parts.get(k, np.uint8(0)) | np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
        if parts:
            yield packed(parts)

    schema = "part int, seen binary"
    rows = entries.select("hash", "class").mapInArrow(mark, schema).repartition(max(1, 1 << bits - PART_BITS), "part").mapInArrow(join, schema)
    out = np.zeros(1 << bits, np.uint8)
    for r in rows.collect():  # 256 rows at most
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["seen"]), np.uint8)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))


def _document_entries(keyed: DataFrame, table: np.ndarray, n: int) -> DataFrame:
    """(doc_id, th, hash, level, bits) of the signature entries of each document that the table may know.

    ``bits`` is the size class: the document's signature for items of skip k has bins of ``bits`` - k leading bits.
    """
    present = int(np.bitwise_or.reduce(table))
    classes = [c for c in range(SHORT + 1) if present >> c & 1]
    low = np.uint64(len(table) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            rows, out = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for a, b in blocks(texts):
                sets = shingle_sets(texts[a:b], n)
                size = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets)
                if not len(every):
                    continue
                bits = np.repeat(np.array([max(0, int(s) - 1).bit_length() for s in size], np.int64), size)
                first = np.cumsum(size) - size
                level = levels(every)
                level[first[size > 0]] = 0  # each set is sorted by itself
                wanted = np.zeros(len(every), np.uint8)
                for c in classes:
                    inside = level <= np.maximum(bits - SKIPS[c], LEAST_BITS) if c < SHORT else slice(None)
                    wanted[inside] |= np.uint8(1 << c)
                at = np.flatnonzero(wanted)
                at = at[(table[(every[at] & low).astype(np.int64)] & wanted[at]) > 0]
                rows.append(a + np.searchsorted(first + size, at, "right"))
                for o, v in zip(out, (every, level, bits), strict=True):
                    o.append(v[at])
            own = pa.array(np.concatenate(rows))
            hash_, level, bits = (np.concatenate(o) for o in out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("th").take(own), pa.array(hash_.view(np.int64)), pa.array(level), pa.array(bits)], ["doc_id", "th", "hash", "level", "bits"])

    return keyed.mapInArrow(run, "doc_id long, th long, hash long, level long, bits long")


def _candidates(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, th, ih): an item and a document have a signature entry in common, for the item's class and the document's size."""
    i = items.select("ih", "hash", F.col("level").alias("item_level"), "class")
    skip = F.element_at(F.array(*[F.lit(k) for k in SKIPS]), F.least(F.col("class") + 1, F.lit(SHORT)).cast("int"))
    bins = F.greatest(F.col("bits") - skip, F.lit(LEAST_BITS))
    both = entries.join(i, "hash").filter((F.col("class") == SHORT) | (F.greatest("level", "item_level") <= bins))
    return both.select("doc_id", "th", "ih").distinct()


def _verified(keyed: DataFrame, pairs: DataFrame, items: DataFrame, n: int, percent: int, chunk: int) -> DataFrame:
    """(doc_id, th, ih, n_item, n_shared) of the pairs of which the document has ``percent`` of the item's shingles, by words.

    Of a document with many candidates, about ``chunk`` different items go with its text into one row.
    """
    # a document's candidates are dealt to parts by their hash, about ``chunk`` each, and never gathered
    many = pairs.groupBy("doc_id", "th").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts")).filter("parts > 1").select(F.col("doc_id").alias("_doc"), F.col("th").alias("_text"), "parts")
    dealt = pairs.join(many, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_text")), "left")
    part = F.pmod(F.xxhash64("ih"), F.coalesce("parts", F.lit(1)))
    texts = items.select("ih", F.col("text").alias("item")).dropDuplicates(["ih"])
    asked = dealt.select("doc_id", "th", "ih", part.alias("part")).join(texts, "ih")
    lists = materialize(asked.groupBy("doc_id", "th", "part").agg(F.collect_list(F.struct("ih", "item")).alias("items")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "items"), "asked")
    rows = keyed.join(lists, keyed["doc_id"].eqNullSafe(lists["_id"]) & (keyed["th"] == lists["_th"])).select("doc_id", "th", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ih, sizes, shared = [], [], [], []
            for k in range(batch.num_rows):
                own = batch.column("items")[k].values
                names, item_texts = own.field("ih").to_pylist(), text_bytes(own.field("item"))
                doc, *rest = exact_sets([*text_bytes(batch.column("text").slice(k, 1)), *item_texts], n)
                for name, s in zip(names, rest, strict=True):
                    both = int(np.isin(s, doc, assume_unique=True).sum())
                    if len(s) and 100 * both >= percent * len(s):
                        at.append(k)
                        ih.append(name)
                        sizes.append(len(s))
                        shared.append(both)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), *[pa.array(x, pa.int64()) for x in (ih, sizes, shared)]], ["doc_id", "th", "ih", "n_item", "n_shared"])

    return rows.mapInArrow(run, "doc_id long, th long, ih long, n_item long, n_shared long")


def contained_items(docs: DataFrame, items: DataFrame, n: int, percent: int, miss: float, chunk: int) -> DataFrame:
    """(doc_id, th, ih, n_item, n_shared) for each row of ``docs`` and each different item text that it contains."""
    entries = _item_entries(items, n, percent, miss)
    keyed = _keyed(docs)
    found = materialize(_document_entries(keyed, _table(entries, entries.count()), n), "entries")
    pairs = materialize(_candidates(found, entries), "pairs")
    discard(found, entries)
    return _verified(keyed, pairs, items, n, percent, chunk)


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 75, miss: float = 1e-5, chunk: int = 1000) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each document and benchmark item that it contains.

    Contained: at least ``percent`` of the item's distinct n-word shingles, A-Z as a-z. Items of fewer words have their
    whole word sequence as one shingle, which only an equally short document holds. Null texts count as empty, match
    nothing and have no match; null ids are kept; repeated rows of either table each match; empty tables give an empty
    result; other columns are ignored. An item contained to just ``percent`` is missed with a chance of ``miss`` at
    most, one contained whole with less; short items never are.
    """
    items = _items(benchmark)
    hits = contained_items(docs, items, n, percent, miss, chunk)
    return hits.join(items.select("ih", "item_id"), "ih").select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 75, miss: float = 1e-5, chunk: int = 1000) -> DataFrame:
    """The documents that contain no benchmark item, with their columns.

    Rows with null ids or texts, and repeated rows, are judged each by its text; names of columns are free.
    """
    hits = contained_items(docs, _items(benchmark), n, percent, miss, chunk)
    gone = materialize(hits.select(F.col("doc_id").alias("a"), F.col("th").alias("b")).distinct(), "leaks").alias("leak")
    rows = docs.alias("row")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("leak.a")) & (F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))) == F.col("leak.b"))
    return rows.join(gone, same, "left_anti")

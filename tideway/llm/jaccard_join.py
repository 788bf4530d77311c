"""N-gram Jaccard join: documents in groups of equal prefix and size, group pairs filtered, then members verified.

Shingles stand in one global order, rare ones first. Two sets of Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of each. Sets with the same first shingles and the same size form one group, so only groups are
indexed. Pairs inside an index list are not all made: every group is first compared with one hub of its list, the links
found are closed to components, and what remains to be compared are groups of one list in different components.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.components import connected_components
from tideway.llm.shared import common, discard, exact_sets, free_shuffles, materialize, partitions, salted_join, shingle_sets, text_bytes, text_or_empty

#: Counters of the frequency sketch (a power of two), and those in one row of it.
COUNTERS, PART = 1 << 20, 1 << 16
_DROP = np.uint64(64 - (COUNTERS.bit_length() - 1))


def shingle_frequencies(docs: DataFrame, n: int = 5) -> np.ndarray:
    """Counters of shingle hashes over all documents: a fixed 4 MB, whatever the corpus.

    They order shingles, for which any numbers would do, and say which are common: see ``_excess``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(COUNTERS, np.int64), False
        for batch in batches:
            for own in (shingle_sets(text_bytes(batch.column(0)), n),):
                if own:
                    total += np.bincount((np.concatenate(own) >> _DROP).astype(np.int64), minlength=COUNTERS)
                    any_ = True
        if any_:
            yield packed({k: total[k * PART : (k + 1) * PART] for k in range(COUNTERS // PART)})

    def packed(parts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(v.astype("<i8").tobytes(), 1) for v in parts.values()], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts[k] = parts.get(k, 0) + np.frombuffer(zlib.decompress(raw.as_py()), "<i8")
        if parts:
            yield packed(parts)

    schema = "part int, counts binary"
    sums = docs.select(text_or_empty().alias("text")).mapInArrow(count, schema).repartition(COUNTERS // PART, "part").mapInArrow(add, schema)
    out = np.zeros(COUNTERS, np.int64)
    for r in sums.collect():  # COUNTERS numbers
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def _excess(frequencies: np.ndarray) -> np.ndarray:
    """Each counter less what a counter holds in the mean: that is what other shingles give it, in a large corpus too.

    Of four bytes each, as it goes to every task.
    """
    return np.maximum(0, frequencies.astype(np.int64) - int(frequencies.mean())).astype(np.uint32)


def _document_rows(docs: DataFrame, frequencies: np.ndarray, n: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), size, cls (digest of the set), gid (of prefix and size), prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, groups, prefixes = [], [], [], []
            for own in shingle_sets(text_bytes(batch.column("text")), n):
                m = len(own)
                first = m - -(-percent * m // 100) + 1 if m else 0
                order = np.argsort(frequencies[(own >> _DROP).astype(np.int64)], kind="stable")[:first]
                raw = own[order].tobytes()
                sizes.append(m)
                classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                groups.append(int.from_bytes(hashlib.blake2b(raw + m.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                prefixes.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(groups, pa.int64()), pa.array(prefixes, pa.binary())], ["doc_id", "th", "size", "cls", "gid", "prefix"])

    return _texts(docs).mapInArrow(run, "doc_id long, th long, size long, cls binary, gid long, prefix binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))


def _postings(groups: DataFrame, frequencies: np.ndarray, hot: int) -> DataFrame:
    """A row for each prefix shingle of each group; tokens of over ``hot`` uses are salted.

    ``place`` is the shingle's place in the group's order; ``rank`` is less the more common the group's prefix is: what
    near copies are copies of has no shingles of its own.
    """
    excess = _excess(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                raw = part.column("prefix").to_pylist()
                count = np.array([len(x) // 8 for x in raw], np.int64)
                token = np.frombuffer(b"".join(raw), np.uint64)
                uses = excess[(token >> _DROP).astype(np.int64)].astype(np.int64)
                first = np.cumsum(count) - count
                common_ = np.add.reduceat(np.log2(1.0 + uses), first) / count
                gid, size, rank = (np.repeat(x, count) for x in (part.column("gid").to_numpy(), part.column("size").to_numpy(), -np.round(64 * common_).astype(np.int64)))
                place = np.arange(len(token)) - np.repeat(first, count)
                salts = 1 + uses // hot
                columns = [token.view(np.int64), gid % salts + np.where(salts > 1, 1, 0), rank, (place << 32) | size, gid]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k in (1, 2) else c) for k, c in enumerate(columns)], ["token", "salt", "rank", "meta", "gid"])

    return groups.select("gid", "size", "prefix").mapInArrow(run, "token long, salt int, rank int, meta long, gid long")


def _fits(z, i, size, place, percent: int):
    """Whether sets of z and size shingles, whose first common one has places i and place, can be similar enough."""
    return (z * percent <= size * 100) & (size * percent <= z * 100) & ((z - i) * (100 + percent) >= (z + size) * percent) & ((size - place) * (100 + percent) >= (z + size) * percent)


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Entries of tokens that several groups have, with the hub that each is first compared with, or itself.

    The rows of a token come one after another, the hub first; a task keeps two rows at a time, however long a list is.
    """
    names = ["token", "rank", "size", "place", "gid", "hub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met, hub = None, False, (0, 0, 0)  # the last row, if it has one of its token before it, and (size, place, gid) of the hub

        def out(token, rank, meta, gid, before) -> pa.RecordBatch:
            nonlocal hub
            size, place = meta & 0xFFFFFFFF, meta >> 32
            new = np.flatnonzero(~before)
            at = np.searchsorted(new, np.arange(len(token)), "right") - 1  # the run of each row; -1 goes on from the batch before
            of = [np.where(at < 0, h, c[new[np.maximum(at, 0)]] if len(new) else h) for h, c in zip(hub, (size, place, gid), strict=True)]
            hub = tuple(int(c[-1]) for c in of)
            hubs = np.where(_fits(size, place, of[0], of[1], percent), of[2], gid)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (token, rank, size, place, gid, hubs)], names)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                columns = [np.concatenate((h, c)) for h, c in zip(held, columns, strict=True)]
            token, salt, rank, meta, gid = columns
            if not len(token):
                continue
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            before = np.concatenate(([met], same))
            rows = np.flatnonzero(before[:-1] | same | (salt[:-1] > 0))
            if len(rows):
                yield out(token[rows], rank[rows], meta[rows], gid[rows], before[rows])
            held, met = [c[-1:] for c in columns], bool(before[-1])  # it waits for what follows
        if held and (met or held[1][0] > 0):
            yield out(held[0], held[2], held[3], held[4], np.array([met]))

    n = partitions(postings.sparkSession)
    placed = postings.repartition(n, "token", "salt").sortWithinPartitions("token", "salt", "rank", "gid")
    return placed.mapInArrow(run, "token long, rank int, size long, place long, gid long, hub long")


def _class_texts(docs: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(cls, text) of one document of each class that has a rival: the whole texts are shuffled this once."""
    rivals = shared.select("gid").union(classes.groupBy("gid").count().filter("count > 1").select("gid")).distinct()
    keys = classes.join(rivals, "gid").select("cls", F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th"))
    rows = _texts(docs)
    found = rows.join(keys, rows["doc_id"].eqNullSafe(keys["_id"]) & (rows["th"] == keys["_th"])).select("cls", "text")
    return materialize(found.dropDuplicates(["cls"]), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the class pairs (a, b) that link: 100 * intersection >= percent * union, counted on the words of both whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            x, y, hits, first = a.to_pylist(), b.to_pylist(), [], 0
            while first < batch.num_rows:
                texts_: dict = {}  # about a MB of different texts: a hub's rows come one after another
                held, last = 0, first
                while last < batch.num_rows and (last == first or held < 1 << 20):
                    for name, text in ((x[last], left[last]), (y[last], right[last])):
                        if name not in texts_:
                            texts_[name] = text.as_py().encode()
                            held += len(texts_[name])
                    last += 1
                sets = dict(zip(texts_, exact_sets(list(texts_.values()), n), strict=True))
                for k in range(first, last):
                    one, other = sets[x[k]], sets[y[k]]
                    both = common(one, other)
                    if 100 * both >= percent * (len(one) + len(other) - both):
                        hits.append(k)
                first = last
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).take(pa.array(hits, pa.int64()))

    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return materialize(both.mapInArrow(run, "a binary, b binary"), "links")


def _labelled(classes: DataFrame, roots: DataFrame) -> DataFrame:
    return classes.join(roots, F.col("cls") == F.col("node"), "left").select("gid", "cls", F.coalesce("root", "cls").alias("comp"))


def _open_lists(shared: DataFrame, labelled: DataFrame) -> DataFrame:
    """Entries of the lists that still hold several components, with the least and greatest component of each group."""
    spans = labelled.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    entries = shared.select("token", "rank", "size", "place", "gid").join(spans, "gid")
    lists = entries.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count(F.lit(1)).alias("n")).filter("l <> h AND n > 1")
    return materialize(entries.join(lists.select("token", "n"), "token"), "open")


def _between_components(lists: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Class pairs of each list's most common group and the most common group of each other component of the list."""
    best = lists.groupBy("token", "low").agg(F.min(F.struct("rank", "gid", "size", "place")).alias("e"))
    top = best.groupBy("token").agg(F.min("e").alias("h"))
    pairs = best.join(top, "token").filter((F.col("e.gid") != F.col("h.gid")) & _fits(F.col("e.size"), F.col("e.place"), F.col("h.size"), F.col("h.place"), percent))
    return _first_classes(pairs.select(F.col("e.gid").alias("gid"), F.col("h.gid").alias("hub")).distinct(), firsts)


def _first_classes(stars: DataFrame, firsts: DataFrame) -> DataFrame:
    one, other = firsts.select("gid", F.col("first").alias("a")), firsts.select(F.col("gid").alias("hub"), F.col("first").alias("b"))
    return stars.join(one, "gid").join(other, "hub").select("a", "b")


def _crossing(lists: DataFrame, labelled: DataFrame, percent: int, block: int) -> DataFrame:
    """Class pairs of one list, of fitting sizes and places and different components, that no hub has settled.

    Lists are cut into blocks of about ``block`` groups, and a row of one block meets one other block at a time, so that
    no task holds a whole list.
    """
    cut = lists.withColumn("cuts", F.ceil(F.col("n") / block).cast("int")).withColumn("cut", F.pmod(F.xxhash64("gid"), F.col("cuts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    left = cut.select("token", "cut", every.alias("other"), F.col("gid").alias("g"), F.col("size").alias("z"), F.col("place").alias("i"), F.col("low").alias("l"), F.col("high").alias("h"))
    right = cut.select("token", F.col("cut").alias("other"), every.alias("cut"), "gid", "size", "place", "low", "high")
    apart = ~((F.col("l") == F.col("h")) & (F.col("low") == F.col("high")) & (F.col("l") == F.col("low")))
    groups = left.join(right, ["token", "cut", "other"]).filter((F.col("g") < F.col("gid")) & _fits(F.col("z"), F.col("i"), F.col("size"), F.col("place"), percent) & apart).select("g", "gid").distinct()
    one = labelled.select(F.col("gid").alias("g"), F.col("cls").alias("x"), F.col("comp").alias("cx"))
    two = labelled.select("gid", F.col("cls").alias("y"), F.col("comp").alias("cy"))
    between = groups.join(one, "g").join(two, "gid").filter("cx <> cy").select("x", "y")
    mixed = labelled.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("gid")
    inside = two.join(mixed, "gid").join(one, F.col("g") == F.col("gid")).filter("x < y AND cx <> cy").select("x", "y")
    return between.union(inside).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_documents(docs: DataFrame, n: int = 5, percent: int = 75, hot: int = 50_000, block: int = 512) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, component of every row of ``docs``.

    Rows link when the Jaccard similarity of their distinct n-word shingles is at least ``percent`` / 100; component_id
    is the smallest doc_id that links reach. Null texts count as empty; texts without words link with nothing and stand
    alone; null doc_ids count last, a component of null ids alone has a null id; rows with equal doc_id are a document
    each, so that two components may have one smallest id: ``component``, null without words, tells them apart; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    frequencies = shingle_frequencies(docs, n)
    sets = materialize(_document_rows(docs, frequencies, n, percent), "sets", "none")
    names = materialize(sets.drop("prefix"), "names")
    some = names.filter("size > 0")
    rep = F.min(F.struct("doc_id", "th")).alias("rep")
    classes = materialize(some.groupBy("cls").agg(rep, F.min("doc_id").alias("least"), F.first("gid").alias("gid")), "classes")
    groups = sets.filter("size > 0").groupBy("gid").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    shared = materialize(_shared(_postings(groups, frequencies, hot), percent), "shared")
    discard(sets)
    free_shuffles(spark)
    texts = _class_texts(docs, classes, shared)
    free_shuffles(spark)
    firsts = classes.groupBy("gid").agg(F.min("cls").alias("first"))
    to_hub = _first_classes(shared.filter("gid <> hub").select("gid", "hub").distinct(), firsts)
    in_group = classes.select("gid", "cls").join(firsts, "gid").filter("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b"))
    found = _verified(to_hub.union(in_group).distinct(), texts, n, percent)
    free_shuffles(spark)
    roots = connected_components(found)
    discard(found)

    def joined(before: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components with what ``pairs`` links too; the tables before are deleted."""
        more = _verified(pairs, texts, n, percent)
        free_shuffles(spark)
        now = connected_components(before.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        discard(more, before)
        return now

    lists = _open_lists(shared, _labelled(classes, roots))
    discard(shared)
    free_shuffles(spark)
    roots = joined(roots, _between_components(lists, firsts, percent))
    labelled = materialize(_labelled(classes, roots), "labelled")
    rest = _open_lists(lists, labelled)
    discard(lists)
    free_shuffles(spark)
    roots = joined(roots, _crossing(rest, labelled, percent, block))
    rooted = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("uses"))
    ids = materialize(salted_join(rooted.select("cls", "root"), named, ["root"], classes.count()).select("cls", "component_id", F.col("root").alias("component")), "ids")
    discard(classes, texts, rest, labelled, roots)
    own = names.select("doc_id", "th", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("cls")).alias("key"))
    return own.join(ids, own["key"] == ids["cls"], "left").select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with its columns: that of the smallest (doc_id, text hash).

    Rows equal in both are one document, of which the row least in its other columns, by their JSON, stays. Null texts
    and texts without words are linked with nothing: each such (doc_id, text) stays. Null ids count last; an empty table
    gives an empty result; names of columns are free.
    """
    linked = materialize(link_documents(docs, **options), "linked")
    alone = linked.filter("n_shingles = 0").select("doc_id", "th")
    first = linked.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("rep")).select("rep.doc_id", "rep.th")
    kept = materialize(alone.union(first).distinct(), "kept")
    discard(linked)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), F.struct("*").alias("row"))
    found = rows.join(kept.select(F.col("doc_id").alias("id"), F.col("th").alias("kept")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("kept")), "left_semi")
    rest = F.to_json(F.struct(*[F.col("row")[c] for c in docs.columns if c != "text"]))
    one = found.groupBy("doc_id", "th").agg(F.min_by("row", rest).alias("row"))
    return one.select([F.col("row")[c].alias(c) for c in docs.columns])

"""Repeated byte strings across a corpus: removes what a string of ``length`` bytes that also starts earlier covers.

The positions of all texts are sorted by what follows them, in the order sample, name, merge, compare, but only as far
as ``length`` bytes, and with a sample that depends on content instead of on position modulo a number:

1. *Sample.* Every string of ``length`` bytes is owned by one anchor: of the ``K``-byte strings in it, the leftmost of
   least hash. Equal strings have equal anchors at equal places, and about one position in thirty is an anchor.
2. *Name.* An anchor's name is the hash of its own bytes, and of all bytes of the strings that it owns. Anchors are
   dealt by the first and sorted by both, so equal ones come one after another, earliest first: where the second name
   has come before, all strings of the anchor have.
3. *Merge.* Anchors of one first name and several second ones remain: their strings are sorted one by one.
4. *Compare.* Of neighbours that are equal all but the first, the earliest, are repeats.

The plain difference cover of three sorts two thirds of all positions, five levels deep for 100 bytes: see the README.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.shared import discard, free_shuffles, materialize, mix, partitions, slices, text_bytes, text_or_empty

#: Bytes of an anchor, and windows of a text that are worked on at once.
K, PIECE = 40, 1 << 21
KEY = ["doc_id", "th"]


_RADIX = 0x9E3779B97F4A7C15
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_RADIX))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the radix and of its inverse, modulo 2**64; n is at most a piece."""
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            for k, r in enumerate((_RADIX, _RADIX_INVERSE)):
                p = np.full(n + 1, r, np.uint64)
                p[0] = 1
                _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Piece:
    """Anchors of the windows [base, base + PIECE) of one text."""

    def __init__(self, data: bytes, base: int, length: int):
        b = np.frombuffer(data, np.uint8, min(len(data) - base, PIECE + length - 1), base)
        n, self.base, self.length = len(b), base, length
        up, self.down = _power(n)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[:n], dtype=np.uint64)))
        windows, places = n - length + 1, length - K + 1
        grams = self.hash(np.arange(n - K + 1), K)
        keys = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        # the least of each run of ``places`` keys: least up to the end of its block, least from the start of the next
        padded = np.concatenate((keys, np.full(-len(keys) % places, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, places)
        left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        right = np.minimum.accumulate(padded, axis=1).reshape(-1)
        least = np.minimum(left[:windows], right[places - 1 : places - 1 + windows])
        center = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        self.first = np.flatnonzero(np.diff(center, prepend=-1))
        self.last = np.append(self.first[1:], windows) - 1
        self.center = center[self.first]
        self.name = grams[self.center]

    def hash(self, at: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[at + size] - self.sums[at]) * self.down[at] + np.uint64(0x51ED270B))

    def contexts(self) -> np.ndarray:
        """Second names: of all bytes of the owned strings, with the anchor's place in them."""
        size = self.last - self.first + self.length
        with np.errstate(over="ignore"):
            return mix(self.hash(self.first, size) ^ mix(((self.center - self.first) << 32 | size).astype(np.uint64)))


def _pieces(data: bytes, length: int) -> Iterator[Piece]:
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        yield Piece(data, base, length)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, th, text) and whether ids are unique; th, a hash of the text, is then 0, as ids tell rows apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    once = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count() == 0  # a number
    return rows.withColumn("th", F.lit(0).cast("long") if once else F.xxhash64("text")), once


def _with_places(keyed: DataFrame, once: bool, places: DataFrame, how: str) -> DataFrame:
    """Texts with ``ats``, the places of a document in one array: no longer than the document."""
    own = places.groupBy(*KEY).agg(F.collect_list("at").alias("ats")).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    if once:
        return keyed.join(own, keyed["doc_id"] == own["_id"], how)
    return keyed.join(own, keyed["doc_id"].eqNullSafe(own["_id"]) & (keyed["th"] == own["_th"]), how)


def _ranks(batch: pa.RecordBatch) -> np.ndarray:
    """Place of each row in the order of (doc_id, th), null ids first; equal rows have one place."""
    d, t = _columns(batch.select(KEY))
    order = np.lexsort((t, d))
    new = np.ones(len(d), np.int64)
    new[1:] = (d[order][1:] != d[order][:-1]) | (t[order][1:] != t[order][:-1])
    out = np.empty(len(d), np.int64)
    out[order] = np.cumsum(new)
    return out


def _dealt(batch: pa.RecordBatch, rows: list, arrays: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Rows (doc_id, th, two keys, at) of what the texts of a batch hold.

    Where the batch has both keys several times, all but the earliest are told to be repeats here, by a negative ``at``
    (-1 - at): they may be dealt anywhere, so that a string that a third of all places hold is one row a batch to the
    task that gets it.
    """
    none = np.zeros(0, np.int64)
    row, (one, two, at) = np.concatenate([none, *rows]), (np.concatenate([none, *a]) for a in arrays)
    rank = _ranks(batch)[row] if len(row) else none
    order = np.lexsort((at, rank, two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    twin = same & (rank[order][1:] == rank[order][:-1]) & (at[order][1:] == at[order][:-1])  # the same place of an equal row
    again, keep = np.zeros(len(row), bool), np.ones(len(row), bool)
    again[order[1:][same]], keep[order[1:][twin]] = True, False
    kept = pa.array(row[keep])
    columns = [batch.column("doc_id").take(kept), batch.column("th").take(kept), *[pa.array(x[keep]) for x in (one, two, np.where(again, -1 - at, at))]]
    return pa.RecordBatch.from_arrays(columns, [*KEY, *names, "at"])


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, name, context, at) of every anchor; ``at`` is (first owned start) * 64 + owned starts - 1, for up to 64 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, out = [], [[], [], []]
                for k, data in enumerate(text_bytes(batch.column("text"))):
                    for p in _pieces(data, length):
                        rows.append(np.full(len(p.first), k))
                        for o, v in zip(out, (p.name.view(np.int64), p.contexts().view(np.int64), (p.first + p.base) << 6 | (p.last - p.first)), strict=True):
                            o.append(v)
                yield _dealt(batch, rows, out, ["name", "context"])

    return keyed.mapInArrow(run, "doc_id long, th long, name long, context long, at long")


def _sorted(rows: DataFrame, keys: list[str], deal: list[str]) -> DataFrame:
    """Rows dealt by ``deal``, or by place if told to be repeats, and sorted by keys, document and place."""
    to = F.when(F.col("at") < 0, F.xxhash64("at", *KEY)).otherwise(F.xxhash64(*deal))
    return rows.repartition(partitions(rows.sparkSession), to).sortWithinPartitions(*keys, *KEY, "at").select(*keys, *KEY, "at")


def _apart(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    """(doc_id, th, at) of the rows that are told to be repeats, and the columns of the others."""
    told = pc.less(batch.column("at"), 0)
    own = batch.filter(told).select([*KEY, "at"])
    return own.set_column(2, "at", pc.subtract(-1, own.column("at"))), _columns(batch.filter(pc.invert(told)))


def _first_marks(batch: list, before: list | None, keys: int) -> list[np.ndarray]:
    """For each number of leading columns up to ``keys``, and for all: where a row differs from the one before it."""
    marks = []
    same = np.ones(len(batch[0]), bool)
    for k, c in enumerate(batch):
        e = np.empty(len(c), bool)
        e[1:] = c[1:] == c[:-1]
        e[0] = before is not None and c[0] == before[k]
        same = same & e
        if k < keys or k == len(batch) - 1:
            marks.append(~same)
    return marks


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Columns as numbers, null ids as the least."""
    return [c.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for c in batch.columns]


def _ids(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=x == -(1 << 63))


def _name_repeats(anchors: DataFrame) -> DataFrame:
    """(doc_id, th, at, open): anchors whose context has come before (open false), and the first of each context of a
    name that has several (open true). The scan keeps one row from batch to batch, however long a run is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting, source = None, None, None  # the last row; the first row of its name, if that has one context yet; the first of its context
        for batch in batches:
            told, cols = _apart(batch)
            if told.num_rows:
                yield pa.RecordBatch.from_arrays([*[told.column(c) for c in (*KEY, "at")], pa.array(np.zeros(told.num_rows, bool))], [*KEY, "at", "open"])
            if not len(cols[0]):
                continue
            new_name, new_context, new_row = _first_marks(cols, before, 2)
            n = len(new_name)
            firsts = np.flatnonzero(new_context)
            # rows equal to the first of their context in id, text and place are that same occurrence
            head = np.searchsorted(firsts, np.arange(n), "right") - 1
            origin = [np.where(head < 0, source[k] if source else 0, c[firsts[np.maximum(head, 0)]] if len(firsts) else (source[k] if source else 0)) for k, c in enumerate(cols[2:])]
            same = np.logical_and.reduce([o == c for o, c in zip(origin, cols[2:], strict=True)])
            repeat = ~new_context & ~same
            later = new_context & ~new_name  # a further context of its name
            starts = np.flatnonzero(new_name)
            several = np.logical_or.reduceat(later, starts) if len(starts) else np.zeros(0, bool)
            open_ = later.copy()
            open_[starts[several]] = True
            upto = starts[0] if len(starts) else n
            extra = waiting if waiting is not None and later[:upto].any() else None
            if extra is not None or len(starts):
                waiting = None
            if len(starts) and not several[-1]:
                waiting = [c[starts[-1]] for c in cols[2:]]
            source = [o[-1] for o in origin] if len(firsts) == 0 else [c[firsts[-1]] for c in cols[2:]]
            before = [c[-1] for c in cols]
            pick = np.flatnonzero(repeat | open_)
            d, t, at = (c[pick] for c in cols[2:])
            o = open_[pick]
            if extra is not None:
                d, t, at, o = np.append(d, extra[0]), np.append(t, extra[1]), np.append(at, extra[2]), np.append(o, True)
            yield pa.RecordBatch.from_arrays([_ids(d), pa.array(t), pa.array(at), pa.array(o)], [*KEY, "at", "open"])

    return _sorted(anchors, ["name", "context"], ["name"]).mapInArrow(run, "doc_id long, th long, at long, open boolean")


def _open_strings(keyed: DataFrame, once: bool, open_: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, name, string, at) of every string that an open anchor owns."""
    rows = _with_places(keyed, once, open_, "inner").select("doc_id", "th", "text", "ats")
    rows = rows if once else rows.dropDuplicates(KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                rows, out = [], [[], [], []]
                for k, (data, ats) in enumerate(zip(text_bytes(batch.column("text")), batch.column("ats"), strict=True)):
                    wanted = np.sort(ats.values.to_numpy()) >> 6
                    for p in _pieces(data, length):
                        mine = np.isin(p.first + p.base, wanted, assume_unique=True)
                        size = (p.last - p.first + 1)[mine]
                        if not len(size):
                            continue
                        start = np.repeat(p.first[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        rows.append(np.full(len(start), k))
                        for o, v in zip(out, (np.repeat(p.name[mine], size).view(np.int64), p.hash(start, length).view(np.int64), (start + p.base) << 6), strict=True):
                            o.append(v)
                yield _dealt(batch, rows, out, ["name", "string"])

    return rows.mapInArrow(run, "doc_id long, th long, name long, string long, at long")


def _string_repeats(strings: DataFrame) -> DataFrame:
    """(doc_id, th, at) of every string that has come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            told, cols = _apart(batch)
            if told.num_rows:
                yield told
            if len(cols[0]):
                _, new, _ = _first_marks(cols, before, 2)
                before = [c[-1] for c in cols]
                pick = np.flatnonzero(~new)
                yield pa.RecordBatch.from_arrays([_ids(cols[2][pick]), pa.array(cols[3][pick]), pa.array(cols[4][pick])], [*KEY, "at"])

    return _sorted(strings, ["name", "string"], ["name", "string"]).mapInArrow(run, "doc_id long, th long, at long")


def covered(n: int, ats: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes the strings cover."""
    step = np.zeros(n + 1, np.int64)
    start = ats >> 6
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(n, start + (ats & 63) + length), -1)
    return np.cumsum(step[:n]) > 0


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and the kept bytes, if asked for).

    A byte goes if a ``length``-byte string covers it that also starts earlier: in a smaller doc_id, or before it in the
    same document; overlaps count, matches never cross documents. Null texts are empty; null doc_ids come first; rows of
    equal doc_id are ordered by text hash, and rows equal in both are one document and get equal results; an empty table
    gives an empty result; other columns are ignored. ``length`` is 60 to 100, so that an anchor's starts fit ``at``.
    """
    if not K < length <= K + 63:
        raise ValueError(f"length must be {K + 1} to {K + 63}")
    keyed, once = _keyed(docs)
    named = materialize(_name_repeats(_anchor_rows(keyed, length)), "named")
    free_shuffles(docs.sparkSession)
    merged = materialize(_string_repeats(_open_strings(keyed, once, named.filter("open"), length)), "merged")
    free_shuffles(docs.sparkSession)
    spans = named.filter("NOT open").select(*KEY, "at").union(merged)
    rows = _with_places(keyed, once, spans, "left").select("doc_id", "text", "ats")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                out: list[list] = [[] for _ in names[1:]]
                for data, ats in zip(text_bytes(batch.column("text")), batch.column("ats"), strict=True):
                    gone = covered(len(data), ats.values.to_numpy() if ats.is_valid else np.zeros(0, np.int64), length)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    edges = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    for c, v in zip(out, (len(data), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=False)]], names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)

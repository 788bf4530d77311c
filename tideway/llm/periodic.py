"""Periodic run detection: Main-Lorentz divide and conquer over interned word ids, a Z-function on each side of a midpoint.

A run is a stretch of words with smallest period q and at least max(least, 2q) words that no neighbour extends. Only
stretches of words that hold repeated 6-word sequences can hold one, so the search looks at those alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.shared import slices, text_bytes, text_or_empty

#: Every run of at least 12 words repeats each of its sequences of this many words, but for up to GRAM - 1 in its middle.
GRAM = 6
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def z_function(s: list[int]) -> list[int]:
    """How far ``s`` agrees with itself from each place on; 0 at the first place."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(ids: list[int], a: int, b: int, least: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of ``ids`` inside [a, b) that cross its midpoint."""
    m = (a + b) // 2
    left, right, n = m - a, b - m, len(ids)
    fore = np.array(z_function(ids[m:b] + [-1] + ids[a:b]))  # of the right half, then how far each place of both agrees with it
    back = np.array(z_function(ids[a:m][::-1] + [-1] + ids[a:b][::-1]))  # the same, from the left half's end backwards
    found: dict[tuple[int, int], int] = {}
    # a period of p right of the midpoint, then left of it: from the compared pair of words, agreement forwards and back
    p = np.arange(1, right + 1)
    ahead = np.append(fore[1:right], 0)
    behind = np.minimum(back[left + 1 + right - p], left)
    q = np.arange(1, left + 1)
    ahead_l = np.minimum(fore[right + 1 + left - q], right)
    behind_l = np.append(back[1:left], 0)
    for period, start, end in ((p, m - behind, m + p + ahead), (q, m - q - behind_l, m + ahead_l)):
        fits = np.flatnonzero((end - start >= 2 * period) & (end - start >= least) & (start < m) & (end > m))
        for d, s, e in zip(period[fits].tolist(), start[fits].tolist(), end[fits].tolist(), strict=True):
            if (s == 0 or ids[s - 1] != ids[s - 1 + d]) and (e == n or ids[e] != ids[e - d]):
                found[s, e] = min(d, found.get((s, e), d))
    return found


def _repeated(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stretches of words outside which no run can lie: repeated sequences, up to GRAM - 1 single ones between two."""
    with np.errstate(over="ignore"):
        gram = np.zeros(len(ids) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = (gram * np.uint64(0x9E3779B97F4A7C15)) ^ ids[k : len(ids) - GRAM + 1 + k].astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]  # equal hashes of other words only widen the search
    again = np.zeros(len(gram), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    places = np.flatnonzero(again)
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > GRAM)
    first, last = places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)] + GRAM
    return [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b - a >= least]


def periodic_runs(words: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of word ids, by start, then period.

    A midpoint's runs end at a mismatch or at the end of the stretch, so the highest midpoint inside a run finds it whole;
    parts that lower midpoints see can be extended and are left. Two candidates of one interval are one run, whose smallest
    period divides the other. Time is n log n.
    """
    if least < 2 * GRAM:
        raise ValueError(f"runs of under {2 * GRAM} words are not searched")
    if len(words) < least:
        return []
    found: dict[tuple[int, int], int] = {}
    ids = None
    for parts in ([x] for x in _repeated(words, least)):
        ids = words.tolist() if ids is None else ids
        while parts:
            a, b = parts.pop()
            if b - a < least:
                continue
            for at, period in _crossing(ids, a, b, least).items():
                found[at] = min(period, found.get(at, period))
            parts += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def planted_places(n: int, doc_id: int) -> np.ndarray | None:
    """For one document in ten by crc32 of its id, which original word stands at each place of a repetition; else None."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _row(doc_id: int | None, text: bytes, least: int, planted: bool) -> tuple:
    words = text.split()  # at [\x20\x09-\x0D]+, as bytes
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    places = planted_places(len(words), doc_id) if planted and doc_id is not None else None
    if places is not None:
        ids = ids[places]
    runs = periodic_runs(ids, least)
    if runs or places is not None:
        at = np.flatnonzero(collapse(len(ids), runs))
        words = [words[k] for k in (at if places is None else places[at]).tolist()]
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    exponent = None if length is None else 1000 * length // period
    return doc_id, len(runs), start, length, period, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def find_periodic(docs: DataFrame, least: int = 12, planted: bool = False) -> DataFrame:
    """Per document doc_id, n_runs, the longest run's start, length, period and exponent_milli, and hashes of all runs and of the collapsed words.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. Null and empty texts and texts of under ``least`` words have no run: n_runs
    0, four nulls, the hash of nothing, and all their words. Of runs of equal length the smallest start, then period,
    stands. Rows with equal doc_id are a row each; a null doc_id stays null; an empty table gives an empty result; other
    columns are ignored. ``planted`` first repeats the end of one document in ten (``planted_places``; never of null ids).
    A task holds about 4 MB of texts and the longest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [_row(i, t, least, planted) for i, t in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def collapse_periodic(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with each run's text cut to its first period: kept words parted by one space where a run was found.

    Texts without a run, null ones too, stay as they are; all columns and rows stay, whatever their names.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = []
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    words = (t or b"").split()
                    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
                    runs = periodic_runs(np.fromiter(map(index.__getitem__, words), np.int64, len(words)), least)
                    texts.append(b" ".join(words[k] for k in np.flatnonzero(collapse(len(words), runs)).tolist()) if runs else t)
                k = names.index("text")
                yield part.set_column(k, part.schema.field(k), pa.array(texts, pa.binary()).cast(part.column(k).type))

    return docs.mapInArrow(run, docs.schema)

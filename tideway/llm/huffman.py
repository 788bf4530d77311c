"""Canonical length-limited Huffman code over integer ids: code construction, block encoder, table-driven block decoder.

A block is independent: with the code lengths alone it decodes anywhere. Layout, little-endian:
magic ``TWH1``, documents n (u32), ids m (u32), checkpoints c (u32), bit words w (u32), first id's position (i64),
n document ids (i64), n null marks (u8), n id counts (u32), c bit offsets (u32, one for each STEP ids), w words (u32,
bits from the top down), CRC-32 of all before (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TWH1"
STEP = 64
_HEAD = struct.Struct("<4sIIIIq")


def block_size(data: bytes, at: int) -> int:
    """Bytes of the block that begins at ``at``, by its head; ValueError where none does."""
    if data[at : at + 4] != MAGIC or len(data) < at + _HEAD.size:
        raise ValueError(f"no block at byte {at}")
    _, n, _, c, w, _ = _HEAD.unpack_from(data, at)
    return _HEAD.size + 13 * n + 4 * c + 4 * w + 4


def code_lengths(counts: np.ndarray, limit: int = 18) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if 1 << limit < n:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used]
    level, flags = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, pairs))
        order = np.argsort(both, kind="stable")
        level = both[order]
        flags.append(order < n)
    take = 2 * n - 2
    for own in reversed(flags):
        k = int(own[:take].sum())
        lengths[used[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the least that follows the one before."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[used].astype(np.int64)
    if len(used):
        top = int(own[-1])
        left = np.concatenate(([0], np.cumsum(1 << (top - own))[:-1]))  # aligned to the longest length
        codes[used] = left >> (top - own)
    return codes


class Encoder:
    """Writes blocks with one code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = np.asarray(lengths, np.int64), canonical_codes(lengths).astype(np.uint64)

    def block(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray, position: int) -> bytes:
        size = self.lengths[ids]
        end = np.cumsum(size)
        bit = end - size
        total = int(end[-1]) if len(ids) else 0
        if max(total, int(np.max(counts, initial=0))) >> 32:
            raise ValueError("a block holds less than 2**32 bits and ids: store the document in parts")
        words = np.zeros((total + 31) // 32 + 2, np.uint64)
        if len(ids):
            shifted = self.codes[ids] << (64 - (bit & 31) - size).astype(np.uint64)
            at = bit >> 5
            first = np.flatnonzero(np.diff(at, prepend=-1))
            own = at[first]
            words[own] |= np.bitwise_or.reduceat(shifted >> np.uint64(32), first)
            words[own + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        words = words[: (total + 31) // 32]
        marks = bit[::STEP].astype("<u4")
        null = np.array([d is None for d in doc_ids], np.uint8)
        names = np.array([0 if d is None else d for d in doc_ids], "<i8")
        body = b"".join((_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(marks), len(words), position), names.tobytes(), null.tobytes(), np.asarray(counts, "<u4").tobytes(), marks.tobytes(), words.astype("<u4").tobytes()))
        return body + struct.pack("<I", zlib.crc32(body))


class Decoder:
    """Reads blocks with one code: a table over the next bits gives id and length, all checkpoints advance in step."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        self.top = max(1, int(lengths.max(initial=1)))
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        span = 1 << (self.top - lengths[used])
        rest = (1 << self.top) - int(span.sum())
        self.ids = np.concatenate((np.repeat(used, span), np.zeros(rest, np.int64))).astype(np.uint32)
        self.size = np.concatenate((np.repeat(lengths[used], span), np.zeros(rest, np.int64))).astype(np.int64)

    def block(self, data: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
        """(document ids, id counts, all ids, position of the first id); a damaged block raises ValueError."""
        if len(data) < _HEAD.size + 4 or data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        _, n, m, c, w, position = _HEAD.unpack_from(data)
        at = _HEAD.size
        parts = []
        for kind, k in (("<i8", n), ("u1", n), ("<u4", n), ("<u4", c), ("<u4", w)):
            parts.append(np.frombuffer(data, kind, k, at))
            at += parts[-1].nbytes
        names, null, counts, marks, words = parts
        wide = np.zeros(w + 1, np.uint64)
        wide[:w] = words
        wide[:-1] = (wide[:-1] << np.uint64(32)) | wide[1:]
        wide[-1] = 0
        out = np.zeros((STEP, c), np.uint32)
        pos = marks.astype(np.int64)
        drop = np.uint64(64 - self.top)
        last = w
        for k in range(min(STEP, m)):
            i = pos >> 5
            if k:
                np.minimum(i, last, out=i)
            peek = ((wide[i] << (pos & 31).astype(np.uint64)) >> drop).astype(np.int64)
            out[k] = self.ids[peek]
            pos = pos + self.size[peek]
        return [None if z else int(d) for d, z in zip(names, null, strict=True)], counts.astype(np.int64), out.T.reshape(-1)[:m], position

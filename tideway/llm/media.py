"""Media columns: magic bytes found by an Aho-Corasick automaton, structure and lengths confirmed, embedded media carved.

``sniff`` is the operator: whatever type a row declares, its content decides. ``store_payloads`` and ``read_payloads``
keep text payloads losslessly as 8-bit PCM samples in WAV files inside a column of blobs, and read them back by sniffing.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.shared import materialize, text_bytes, text_or_empty

#: The opening bytes of each format.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"RIFF": "riff",
    b"OggS": "audio/ogg",
    b"fLaC": "audio/flac",
    b"ftyp": "video/mp4",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
}
#: Types of a RIFF form.
RIFF_FORMS = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}
RATE = 8000


class Places:
    """Which of some stated distances lead from a place to one of the wanted places."""

    def __init__(self, stated: Iterable[int], wanted: np.ndarray) -> None:
        self.stated, self.wanted, self.places = np.array(sorted(stated), np.int64), wanted, np.flatnonzero(wanted)

    def met(self, at: int) -> list[int]:
        """By whichever of both lists is the shorter."""
        if not len(self.stated) or not len(self.places):
            return []
        if len(self.places) < len(self.stated):
            far = self.places[np.searchsorted(self.places, at) :] - at
            return far[self.stated[np.minimum(np.searchsorted(self.stated, far), len(self.stated) - 1)] == far].tolist()
        near = self.stated[: np.searchsorted(self.stated, len(self.wanted) - at)]
        return near[self.wanted[at + near]].tolist()


class Marks:
    """What validators of one blob share, so that each byte is looked at a bounded number of times however many magics there are: places of end marks, and the results of walks that met."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.walks: dict = {}

    def walk(self, name: str, state: tuple, step: Callable) -> int:
        """Follow ``step(state) -> next state or result`` to its result; every state passed is told it, so walks that meet go on once."""
        passed = []
        known = self.walks.setdefault(name, {})
        while isinstance(state, tuple):
            if state in known:
                state = known[state]
                break
            passed.append(state)
            state = step(*state)
        for x in passed:
            known[x] = state
        return state

    @cached_property
    def pdf(self) -> tuple:
        """End marks (start, end, stated table), one row for each stated table, where tables and headers are, and the tables that updates name."""
        raw = self.raw
        ends = [(m.start(), m.end(), int(m[1])) for m in PDF_END.finditer(raw) if len(m[1]) < 12]
        at_table = np.zeros(len(raw) + 1, bool)
        for m in PDF_XREF.finditer(raw):
            first = m.start()
            while first and raw[first - 1] in b" \t\n\r\f\v":
                first -= 1
            at_table[first : m.end(1) if m[1] else m.start() + 1] = True  # also at any digit of the number, or the blanks before
        by_table: dict[int, list[int]] = {}
        for k, e in enumerate(ends):
            by_table.setdefault(e[2], []).append(k)
        previous: dict[int, list[int]] = {}
        for m in re.finditer(rb"/Prev\s+(\d{1,11})\b", raw):
            previous.setdefault(int(m[1]), []).append(m.start())
        places = lambda mark: [m.start() for m in re.finditer(re.escape(mark), raw)]
        return ends, at_table, by_table, Places(by_table, at_table), previous, places(b"%PDF-"), places(b"startxref"), places(b"%%EOF")

    @cached_property
    def zip(self) -> tuple:
        """End records (place, count, size, start, note), their numbers by start and by (size, count), and where directories can begin."""
        raw, records = self.raw, []
        at = raw.find(b"PK\x05\x06")
        while 0 <= at <= len(raw) - 22:
            records.append((at, *struct.unpack_from("<HIIH", raw, at + 10)))
            at = raw.find(b"PK\x05\x06", at + 4)
        by_start: dict[int, dict[tuple[int, int], list[int]]] = {}
        for k, (_, count, size, start, _) in enumerate(records):
            by_start.setdefault(start, {}).setdefault((size, count), []).append(k)
        directory = np.zeros(len(raw) + 1, bool)
        directory[[m.start() for m in re.finditer(rb"PK\x01\x02", raw)]] = True
        return records, by_start, Places(by_start, directory)


def _png(b: memoryview, at: int, marks: Marks) -> int:
    """The end of a chain of chunks from IHDR over IDAT to IEND; checksums are read once the whole chain is there."""

    def step(end: int, data: bool):
        if end + 12 > len(b):
            return 0
        size, kind = struct.unpack_from(">I4s", b, end)
        after = end + 12 + size
        if after > len(b):
            return 0
        return (after if data else 0) if kind == b"IEND" else (after, data or kind == b"IDAT")

    if bytes(b[at + 8 : at + 16]) != b"\0\0\0\rIHDR":
        return 0
    stop, end = marks.walk("png", (at + 8, False), step), at + 8
    while end < stop:
        size = struct.unpack_from(">I", b, end)[0]
        if zlib.crc32(b[end + 4 : end + 8 + size]) != struct.unpack_from(">I", b, end + 8 + size)[0]:
            return 0
        end += 12 + size
    return stop


def _gif(b: memoryview, at: int, marks: Marks) -> int:
    if at + 13 > len(b):
        return 0
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(end: int):
        if end >= len(b):
            return end
        return (end + b[end] + 1,) if b[end] else end + 1

    def step(end: int, seen: bool):
        if end >= len(b):
            return 0
        if b[end] == 0x3B:
            return end + 1 if seen else 0
        if b[end] == 0x2C and end + 10 < len(b):
            end, seen = end + 11 + table(b[end + 9]), True
        elif b[end] == 0x21:
            end += 2
        else:
            return 0
        return marks.walk("gif blocks", (end,), blocks), seen

    return marks.walk("gif", (at + 13 + table(b[at + 10]), False), step)


def _jpeg(b: memoryview, at: int, marks: Marks) -> int:
    raw = marks.raw

    def coded(end: int):
        """Up to a marker that is neither stuffing nor a restart."""
        k = raw.find(b"\xff", end)
        if k < 0 or k >= len(raw) - 1:
            return -1
        return (k + 2,) if raw[k + 1] == 0 or 0xD0 <= raw[k + 1] <= 0xD7 else k

    def step(end: int, frame: bool):
        if end + 2 > len(b) or b[end] != 0xFF:
            return 0
        kind = b[end + 1]
        if kind == 0xD9:
            return end + 2 if frame else 0
        if end + 4 > len(b):
            return 0
        size = struct.unpack_from(">H", b, end + 2)[0]
        if size < 2:
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        end += 2 + size
        if kind == 0xDA:
            end = marks.walk("jpeg data", (end,), coded)
        return (end, frame) if end >= 0 else 0

    return marks.walk("jpeg", (at + 2, False), step)


def _riff(b: memoryview, at: int, marks: Marks) -> int:
    if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) not in RIFF_FORMS:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b) or bytes(b[at + 8 : at + 12]) == b"WAVE" and bytes(b[at + 12 : at + 16]) != b"fmt ":
        return 0
    k, kinds = at + 12, []
    while k + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, k)
        kinds.append(kind)
        k += 8 + size + (size & 1)
    whole = k == end or k == end + 1
    return end if whole and kinds and (bytes(b[at + 8 : at + 12]) != b"WAVE" or kinds[0] == b"fmt " and b"data" in kinds) else 0


def _ogg(b: memoryview, at: int, marks: Marks) -> int:
    """The end of the first page that says it is the last."""

    def step(end: int):
        if end + 27 > len(b) or bytes(b[end : end + 4]) != b"OggS" or b[end + 4]:
            return 0
        n = b[end + 26]
        after = end + 27 + n + sum(b[end + 27 : end + 27 + n])
        if after > len(b):
            return 0
        return after if b[end + 5] & 4 else (after,)

    return marks.walk("ogg", (at,), step)


def _crc_table(poly: int, width: int) -> list[int]:
    table = []
    for c in range(256):
        c <<= width - 8
        for _ in range(8):
            c = c << 1 ^ (poly if c >> (width - 1) else 0)
            c &= (1 << width) - 1
        table.append(c)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_subframes(bits: str, pos: int, block: int, depths: list[int]) -> int:
    """Bit after the subframes that start at bit ``pos``; ValueError if they break the format or go beyond ``bits``."""
    for depth in depths:
        if pos + 8 > len(bits) or bits[pos] != "0":
            raise ValueError("subframe")
        kind = int(bits[pos + 1 : pos + 7], 2)
        pos += 8
        if bits[pos - 1] == "1":  # wasted bits
            one = bits.index("1", pos)
            depth -= one - pos + 1
            pos = one + 1
        if depth < 1:
            raise ValueError("wasted bits")
        if kind == 0:
            pos += depth
        elif kind == 1:
            pos += depth * block
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind <= 12 else kind - 31
            pos += order * depth
            if kind >= 32:
                pos += 9 + order * (int(bits[pos : pos + 4], 2) + 1)
            method, parts = int(bits[pos : pos + 2], 2), 1 << int(bits[pos + 2 : pos + 6], 2)
            if method > 1 or block % parts or block // parts < order:
                raise ValueError("residual")
            pos, wide = pos + 6, 4 + method
            for k in range(parts):
                count = block // parts - (0 if k else order)
                rice = int(bits[pos : pos + wide], 2)
                pos += wide
                if rice == (1 << wide) - 1:
                    pos += 5 + count * int(bits[pos : pos + 5], 2)
                    continue
                for _ in range(count):
                    pos = bits.index("1", pos) + 1 + rice
        else:
            raise ValueError("reserved")
        if pos > len(bits):
            raise ValueError("subframe")
    return pos


def _flac_frame(b: memoryview, at: int, depth: int) -> tuple[int, int]:
    """(end, samples of a channel) of the frame at ``at`` whose fields and checksums hold, else (0, 0)."""
    head = bytes(b[at : at + 16])
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        return 0, 0
    size, rate, channels, bits = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    lead = 8 - (head[4] ^ 0xFF).bit_length()  # bytes of the coded number, 0 for one
    k = 4 + max(1, lead)
    extra = {6: 1, 7: 2}.get(size, 0)
    crc = k + extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if size == 0 or rate == 15 or channels > 10 or bits == 3 or lead in (1, 8) or crc >= len(head):
        return 0, 0
    block = int.from_bytes(head[k : k + extra], "big") + 1 if extra else 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    check = 0
    for x in head[:crc]:
        check = CRC8[check ^ x]
    if check != head[crc]:
        return 0, 0
    depth = (depth, 8, 12, 0, 16, 20, 24, 32)[bits]
    depths = [depth + (k == (0 if channels == 9 else 1)) for k in range(2)] if channels > 7 else [depth] * (channels + 1)
    start, most = at + crc + 1, len(depths) * (block * (depth + 1) // 8 + 16)
    while True:  # mostly as long as plain samples at most; a stream states frame sizes of less than 1 << 24
        raw = bytes(b[start : start + most])
        try:
            end = start + -(-_flac_subframes(bin(int.from_bytes(b"\1" + raw, "big"))[3:], 0, block, depths) // 8)
            break
        except ValueError:
            if most >= 1 << 24 or start + most >= len(b):
                return 0, 0
            most = min(2 * most, 1 << 24)
    if end + 2 > len(b):
        return 0, 0
    check = 0
    for x in bytes(b[at:end]):
        check = check << 8 & 0xFFFF ^ CRC16[check >> 8 ^ x]
    return (end + 2, block) if check == int.from_bytes(b[end : end + 2], "big") else (0, 0)


def _flac(b: memoryview, at: int, marks: Marks) -> int:
    end, first, depth, total = at + 4, True, 0, 0
    while end + 4 <= len(b):
        last, kind, size = b[end] & 0x80, b[end] & 0x7F, int.from_bytes(b[end + 1 : end + 4], "big")
        if first and (kind or size != 34) or end + 4 + size > len(b):
            return 0
        if first:
            info = int.from_bytes(b[end + 14 : end + 22], "big")
            depth, total = (info >> 36 & 31) + 1, info & (1 << 36) - 1
        end, first = end + 4 + size, False
        if last:
            break
    else:
        return 0
    samples = 0
    while not total or samples < total:  # without a stated length, up to what is no frame
        after, block = _flac_frame(b, end, depth)
        if not after:
            break
        end, samples = after, samples + block
    return end if samples and samples >= total else 0


def _mp4(b: memoryview, at: int, marks: Marks) -> int:
    end, kinds = at - 4, []
    if end < 0:
        return 0
    while end + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, end)
        if size < 8 or end + size > len(b) or kinds and kind == b"ftyp" or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"sidx", b"uuid", b"meta", b"udta", b"wide"):
            break
        kinds.append(kind)
        end += size
    return end if b"moov" in kinds or b"moof" in kinds else 0


PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
PDF_XREF = re.compile(rb"\bxref\b|(?<!\d)(\d+)(?=\s+\d+\s+obj\b)")


def _pdf(b: memoryview, at: int, marks: Marks) -> int:
    """The first end whose cross-reference table is where it says, and the updates right after it that name the table before.

    Where no table is in its place: the last end before the next header that has an end of its own.
    """
    ends, at_table, by_table, stated, previous, headers, starts, eofs = marks.pdf
    here = stated.met(at)
    after = lambda place: bisect.bisect_left(ends, (place + 1,))  # noqa: E731  number of the first end mark beyond
    firsts = [by_table[h][k] for h in here if (k := bisect.bisect_left(by_table[h], after(at + h))) < len(by_table[h])]
    end, k = 0, min(firsts, default=len(ends))
    while k < len(ends):
        first, last, h = ends[k]
        named = previous.get(ends[k - 1][2], [])
        if end and not (end <= at + h < first and at_table[at + h] and bisect.bisect_left(named, at + h) < bisect.bisect_left(named, first)):
            break
        end, k = last, k + 1
    if end:
        return end
    start = bisect.bisect_left(starts, at)
    eof = bisect.bisect_left(eofs, starts[start] + 9) if start < len(starts) else len(eofs)
    if eof == len(eofs):
        return 0
    stop = bisect.bisect_right(headers, eofs[eof])
    own = stop < len(headers) and (k := bisect.bisect_left(starts, headers[stop])) < len(starts) and starts[k] < eofs[-1]
    return eofs[bisect.bisect_left(eofs, headers[stop]) - 1 if own else -1] + 5


def _zip(b: memoryview, at: int, marks: Marks) -> int:
    """The first end record with a directory of local files in its place, both counted from ``at``."""
    raw = marks.raw
    records, by_start, starts = marks.zip
    first = len(records)
    for start, size, count, group in ((d, *group) for d in starts.met(at) for group in ((*k, v) for k, v in by_start[d].items())):
        k, stop, seen = at + start, at + start + size, 0
        while k + 46 <= stop and raw[k : k + 4] == b"PK\x01\x02" and raw.startswith(b"PK\x03\x04", at + int.from_bytes(raw[k + 42 : k + 46], "little")):
            k += 46 + sum(struct.unpack_from("<HHH", raw, k + 28))
            seen += 1
        if seen and k == stop and seen & 0xFFFF == count:
            later = group[bisect.bisect_left(group, bisect.bisect_left(records, (stop,))) :]
            first = min(first, next((r for r in later if records[r][0] + 22 + records[r][4] <= len(raw)), first))
    return records[first][0] + 22 + records[first][4] if first < len(records) else 0


VALIDATORS: dict[str, Callable[[memoryview, int, Marks], int]] = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "riff": _riff, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip}
_automaton: list = []


def _magic_places(content: bytes) -> Iterator[tuple[int, str]]:
    """(start, format) of all magic bytes, in one pass of the automaton."""
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic, name in MAGIC.items():
            a.add_word(magic.decode("latin-1"), (len(magic), name))
        a.make_automaton()
        _automaton.append(a)
    for last, (size, name) in _automaton[0].iter(content.decode("latin-1")):
        yield last - size + 1, name


def sniff(content: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of each medium whose structure and lengths hold; one inside another is left to it."""
    found, upto, view, marks = [], 0, memoryview(content), Marks(content)
    for at, name in sorted(_magic_places(content)):
        start = at - 4 if name == "video/mp4" else at
        if start < upto or (end := VALIDATORS[name](view, at, marks)) <= start:
            continue
        found.append((RIFF_FORMS[content[at + 8 : at + 12]] if name == "riff" else name, start, end))
        upto = end
    return found


def sniff_media(blobs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each medium in each row of (``keys``, declared, content): keys, declared, type, start, size, corrected, media.

    ``corrected`` says whether the declared type was wrong. A row without valid media gives one row with a null type;
    so does null or empty content. A key named as one of the other columns comes as ``key_`` and its name; a repeated
    name is an error. Memory is bounded by the largest blob.
    """
    fixed = ["declared", "type", "start", "size", "corrected", "media"]
    named = [f"key_{k}" if k in fixed or k == "content" else k for k in keys]
    if len({*named, *fixed}) < len(named) + len(fixed):
        raise ValueError(f"keys whose names meet: {keys}")
    kept = blobs.select(*[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)], F.col("declared").cast("string").alias("declared"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows, kinds, starts, media = [], [], [], []
                for k, content in enumerate(part.column(len(named) + 1).to_pylist()):
                    for kind, start, end in sniff(content or b"") or [(None, None, None)]:
                        rows.append(k)
                        kinds.append(kind)
                        starts.append(start)
                        media.append(None if kind is None else content[start:end])
                declared = part.column(len(named)).take(pa.array(rows))
                wrong = [None if kind is None else kind != d for kind, d in zip(kinds, declared.to_pylist(), strict=True)]
                own = [part.column(k).take(pa.array(rows)) for k in range(len(named))]
                sizes = [None if m is None else len(m) for m in media]
                yield pa.RecordBatch.from_arrays([*own, declared, pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(wrong, pa.bool_()), pa.array(media, pa.binary())], names)

    names = [*[f"k{n}" for n in range(len(named))], *fixed]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[: len(named)])
    return kept.mapInArrow(run, types + "declared string, type string, start long, size long, corrected boolean, media binary").toDF(*named, *fixed)


def wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono PCM samples; their number is even."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def wav_samples(media: bytes) -> bytes:
    """The data chunk of a WAV file."""
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def store_payloads(docs: DataFrame, unit: int = 64) -> DataFrame:
    """Blobs (doc_id, n_bytes, declared, content) of all texts, written to the shared folder.

    The text's UTF-8 bytes, padded by bytes 0 to a positive multiple of ``unit``, are the samples of a WAV file; the
    file lies behind a line of other bytes, and its row declares no type that says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = text_bytes(part.column("text"))
                blobs = [b"blob\n" + wav(t + bytes(max(1, -(-len(t) // unit)) * unit - len(t))) for t in texts]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(["application/octet-stream"] * n), pa.array(blobs, pa.binary())], ["doc_id", "n_bytes", "declared", "content"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, declared string, content binary"), "media")


def read_payloads(blobs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, read from the stored media.

    ``feature``: the sniffed type, where it was carved, the samples, their mean and the largest step between neighbours.
    Null texts are empty: one unit of zeros; equal texts give equal values; rows with equal doc_id are each read; an
    empty table gives an empty result; other columns are ignored.
    """
    media = sniff_media(blobs, ("doc_id", "n_bytes")).filter("type = 'audio/wav'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for start, m in zip(batch.column("start").to_pylist(), batch.column("media"), strict=True):
                raw = m.as_py()
                samples = wav_samples(raw)
                wave = np.frombuffer(samples, np.uint8)
                step = int(np.abs(np.diff(wave.astype(np.int16))).max(initial=0))
                row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"audio/wav at={start} samples={len(wave)} mean={wave.mean():.4f} step={step}")
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.select("doc_id", "n_bytes", "start", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

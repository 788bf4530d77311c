"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import glob
import hashlib
import io
import os
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.llm import decontaminate, jaccard_join, language, media, mixing, queries, quality, repeats, shared, token_store, toxicity, warc
from tideway.llm.huffman import Decoder, Encoder, code_lengths
from tideway.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, token long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = make(60)
    texts = [base, base.upper().replace("É", "É"), base + " tail", make(8), make(3), make(3), "", None, " \t\n", make(4000), "one two", "one two", base.replace("7", "8"), "x" * 5000, make(30) + " " + base[:250]]
    rows = [(k, t, "en", f"s{k % 3}" if k != 4 else None, 0, "c", k) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0", 0, "c", 1), (3, "another text of that id", "en", "s1", 0, "c", 1), (None, base, "en", "s2", 0, "c", 1), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def test_jaccard_components(docs):
    rows = corpus()
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    want = Counter((r[0], len(sets[k]), least.get(find(k)) if sets[k] else r[0]) for k, r in enumerate(rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect())
    assert got == want


def roots(rows):
    """Brute-force component of each row, as the place of one of its rows."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(rows))], sets


def components(rows):
    root, sets = roots(rows)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], r[0]), r[0])
    return Counter((r[0], len(sets[k]), least.get(root[k]) if sets[k] else r[0]) for k, r in enumerate(rows))


def found_components(df, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(df, **options).collect())


def test_jaccard_with_salts_and_blocks(docs):
    assert found_components(docs, hot=2, block=2) == components(corpus())


def test_words_of_one_linear_hash_stay_apart(spark):
    """Two words that any polynomial in an odd number takes to one value modulo 2**64."""
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    h = shared.word_hashes(f"{one} {other} {one}".encode())[0]
    assert h[0] == h[2] != h[1]
    rows = [(1, one), (2, other), (3, "a b c d " + one), (4, "a b c d " + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(df) == components(rows)
    bench = spark.createDataFrame([(7, one), (8, "a b c d " + other)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()} == {(1, 7), (4, 8)}


def test_exact_sets_count_words():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "B", "b", "c\n", "É", "é", "dd"]) for _ in range(rng.randrange(40))) for _ in range(40)] + ["", "  ", "a b", "A B", "a b c d e"]
    got, want = shared.exact_sets([t.encode() for t in texts]), [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i]) == len(want[i]) and shared.common(got[i], got[j]) == len(want[i] & want[j])
    wide = [" ".join(f"w{rng.randrange(60000)}" for _ in range(20000)) for _ in range(2)]  # too many words for one number of five
    assert [len(s) for s in shared.exact_sets([t.encode() for t in wide])] == [len(shingles(t)) for t in wide]


def test_keep_one(docs):
    rows = corpus()
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    root, sets = roots(rows)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(got.values()) == 1
    for k in set(root):
        members = {(r[0], r[1]) for r, q in zip(rows, root, strict=True) if q == k}
        ids = [i for i, _ in members if i is not None]
        mine = [m for m in members if got[m]]
        if sets[k]:
            assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)
        else:
            assert set(mine) == members
    assert sum(got.values()) == len(set(got))


def repeats_by_force(rows, hashes, length=100):
    """What ``remove_repeats`` says of rows (doc_id, text): null ids first, equal ids by text hash, equal rows once."""
    seen, out = set(), {}
    for _, _, doc_id, text in sorted({(-1 if d is None else d, hashes[t], d, t) for d, t in rows}, key=lambda r: r[:2]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc_id, text or ""] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return Counter((d, *out[d, t or ""]) for d, t in rows)


@pytest.mark.parametrize("ids_unique", [True, False])
def test_repeats(spark, docs, ids_unique):
    rows = [(k if ids_unique else r[0], r[1]) for k, r in enumerate(corpus())]
    line = "a common line of a page that stands in many of them, again and again\n"
    rows += [(50, line * 9), (51 if ids_unique else 50, line * 5 + "end"), (52 if ids_unique else None, "ab" * 300), (53 if ids_unique else None, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    got = Counter(tuple(r) for r in repeats.remove_repeats(df).collect())
    assert got == repeats_by_force(rows, hashes)


def test_repeats_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 128)
    test_repeats(spark, None, True)


def test_containment(spark, docs):
    base = corpus()[0][1]
    items = [(1, " ".join(base.split()[5:40])), (2, "one two"), (3, None), (4, "never seen words are here at all"), (1, base), (None, " ".join(corpus()[9][1].split()[100:120]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in corpus():
        for item, text in items:
            q = shingles(text)
            both = len(q & shingles(r[1]))
            if q and 100 * both >= 75 * len(q):
                want[r[0], item, len(q), both] += 1
    for chunk in (1000, 1):
        got = Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find_leaks(docs, bench, chunk=chunk).collect())
        assert got == want
    clean = decontaminate.drop_leaks(docs, bench)
    leaked = {(r[0], r[1]) for r in corpus() for _, text in items if (q := shingles(text)) and 100 * len(q & shingles(r[1])) >= 75 * len(q)}
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r[0], r[1]) for r in corpus() if (r[0], r[1]) not in leaked)
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("words, phrase", [(13, 5), (60, 12)])
def test_a_common_phrase_makes_no_candidates(spark, words, phrase):
    """Documents and items that all share one phrase, and a few documents that hold an item."""
    rng = random.Random(words)
    word = lambda: f"w{rng.randrange(10**7)}"
    same = [word() for _ in range(phrase)]
    text = lambda n: " ".join([*(word() for _ in range(n // 2)), *same, *(word() for _ in range(n - n // 2))])
    items = [(k, text(words - phrase)) for k in range(300)]
    docs_ = [(k, text(40)) for k in range(300)] + [(1000 + k, f"{word()} {word()} {t} {word()}") for k, t in items[:7]]
    df, bench = spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    entries = decontaminate._item_entries(decontaminate._items(bench), 5, 75, 1e-5)
    keyed = decontaminate._keyed(df)
    found = decontaminate._document_entries(keyed, decontaminate._table(entries, entries.count()), 5)
    assert decontaminate._candidates(found, entries).count() == 7
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()} == {(1000 + k, k) for k in range(7)}


def test_signatures_find_short_items_in_long_documents(spark):
    """Every class of items, of which documents of 20 to 40,000 shingles hold just enough; recall against exact containment."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((5, 8, 12, 16, 25, 40, 80, 160, 400) * 8)]
    docs_ = []
    for k, text in items:
        ws = text.split()
        held = ws[: -(-75 * (len(ws) - 4) // 100) + 4]  # the first three quarters of its shingles
        size = (20, 300, 5000, 40000)[k % 4]
        at = rng.randrange(size)
        docs_.append((k, " ".join([*(word() for _ in range(at)), *held, *(word() for _ in range(size - at))])))
    df, bench = spark.createDataFrame(docs_, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(k, k) for k, _ in items}
    assert {decontaminate.item_class(len(shingles(t)), 75, 1e-5) for _, t in items} >= {2, 3, 4, 6, decontaminate.SHORT}


def test_levels():
    own = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 300, dtype=np.uint64) >> np.uint64(3))
    level = decontaminate.levels(own)
    for bits in range(0, 65, 4):
        bins = [int(h) >> (64 - bits) for h in own]
        assert [lv <= bits for lv in level] == [k == 0 or bins[k - 1] != b for k, b in enumerate(bins)]


def test_mix_sums_and_reruns(docs):
    rows = mixing.mix_sources(docs).collect()
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)
    kept = mixing.keep_mixed(docs.withColumnRenamed("token", "_n").withColumnRenamed("cls", "take"))
    assert kept.columns == [{"token": "_n", "cls": "take"}.get(c, c) for c in docs.columns]
    words = Counter()
    for r in kept.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == +taken


def test_media_round_trip(docs):
    got = media.read_payloads(media.store_payloads(docs)).collect()
    want = Counter()
    for r in corpus():
        b = (r[1] or "").encode()
        p = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        head = b"RIFF" + (36 + len(p)).to_bytes(4, "little") + b"WAVEfmt \x10\0\0\0\1\0\1\0\x40\x1f\0\0\x40\x1f\0\0\1\0\x08\0data" + len(p).to_bytes(4, "little")
        feature = f"audio/wav at=5 samples={len(p)} mean={sum(p) / len(p):.4f} step={max(abs(x - y) for x, y in zip(p, p[1:]))}"
        want[r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), 44 + len(p), hashlib.sha256(head + p).hexdigest(), feature] += 1
    assert Counter(tuple(r) for r in got) == want


def test_sniffing_takes_any_key_names(spark):
    df = spark.createDataFrame([(1, 2, "x", 3, media.wav(b"ab"))], "type int, size int, declared string, `a.b` int, content binary")
    out = media.sniff_media(df, ("type", "size", "declared", "a.b"))
    assert out.columns == ["key_type", "key_size", "key_declared", "a.b", "declared", "type", "start", "size", "corrected", "media"]
    assert [tuple(r)[:9] for r in out.collect()] == [(1, 2, "x", 3, "x", "audio/wav", 0, 46, True)]
    with pytest.raises(ValueError):
        media.sniff_media(df, ("type", "type"))
    assert media.sniff_media(df.limit(0), ("type",)).collect() == []


MEGABYTE = 1 << 20
REPEATED = {
    **{name: magic for magic, name in ((b"\x89PNG\r\n\x1a\n", "png"), (b"GIF89a", "gif"), (b"\xff\xd8\xff", "jpeg"), (b"OggS", "ogg"), (b"fLaC", "flac"), (b"\0\0\0\x08ftyp", "mp4"), (b"%PDF-", "pdf"), (b"PK\x03\x04", "zip"), (b"RIFF\4\0\0\0WAVE", "riff"))},
    "zip with ends": b"PK\x03\x04PK\x05\x06" + bytes(18),
    "zip ends that differ": None,
    "pdf with ends": b"%PDF-1.4 startxref 9 %%EOF\n",
    "pdf with tables": b"%PDF-1.4 xref startxref 9 %%EOF\n",
    "pdf ends that differ": None,
    "gif in blocks": b"\x0dGIF89a\1\0\1\0\0\0\0",
    "jpeg in segments": b"\xff\xd8\xff\xe0\0\x06\xff\xd8\xff\xe0",
    "jpeg in data": b"\xff\xd8\xff\xda\0\2\xff\0",
    "ogg pages": b"OggS" + bytes(23),
    "png with headers": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + bytes(17),
    "white space": b"startxref 1" + b" " * 500,
}


@pytest.mark.parametrize("name", REPEATED)
def test_sniffing_is_linear(name):
    """A MB of any magic, alone and with what its validator looks for, takes a few seconds at most, on any machine."""
    one = REPEATED[name]
    if name == "zip ends that differ":
        blob = b"".join(b"PK\x03\x04PK\x05\x06" + bytes(6) + k.to_bytes(4, "little") + (7 * k).to_bytes(4, "little") + b"\0\0\1\0" for k in range(MEGABYTE // 26))
    elif name == "pdf ends that differ":
        blob = b"".join(b"%%PDF- startxref %d %%%%EOF\n" % (11 * k) for k in range(MEGABYTE // 29))
    else:
        blob = one * (MEGABYTE // len(one))
    began = time.process_time()
    media.sniff(blob)
    assert time.process_time() - began < 4


def test_sniffing_carves_and_corrects(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", bytes(13)), (b"IDAT", b"x"), (b"IEND", b"")))
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00\x3b"
    blobs = [("image/gif", png), ("image/png", b"junk" + png + b"RIFFno" + gif + b"end"), ("audio/wav", media.wav(b"ab")), ("x", png[:-3]), ("x", None), ("x", b"")]
    df = spark.createDataFrame([(k, d, c) for k, (d, c) in enumerate(blobs)], "id int, declared string, content binary")
    got = sorted((r.id, r.type or "", r.start or 0, r.corrected) for r in media.sniff_media(df, ("id",)).collect())
    at = 4 + len(png) + 6
    assert got == [(0, "image/png", 0, True), (1, "image/gif", at, True), (1, "image/png", 4, False), (2, "audio/wav", 0, False), (3, "", 0, None), (4, "", 0, None), (5, "", 0, None)]


def crc(data, poly, width):
    c = 0
    for bit in "".join(f"{x:08b}" for x in data):
        c = (c << 1) & ((1 << width) - 1) ^ (poly if (c >> (width - 1)) ^ int(bit) else 0)
    return c.to_bytes(width // 8, "big")


def flac(*frames, total=None):
    """A stereo 8-bit stream of frames (channel code, samples, (bits of a subframe, ...)), block sizes in 16 bits."""
    n = sum(f[1] for f in frames) if total is None else total
    out = b"fLaC\x80\0\0\x22" + bytes(10) + (8000 << 44 | 1 << 41 | 7 << 36 | n).to_bytes(8, "big") + bytes(16)
    for k, (channels, samples, subframes) in enumerate(frames):
        head = b"\xff\xf8" + bytes([0x70, channels << 4]) + chr(200 * k).encode() + (samples - 1).to_bytes(2, "big")
        bits = "".join(subframes)
        frame = head + crc(head, 0x07, 8) + int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
        out += frame + crc(frame, 0x8005, 16)
    return out


def pdf(words, *updates, table=True):
    out, before = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n" + words + b"\n", None
    for more in (b"", *updates):
        out += more
        at = len(out) if table else 0
        out += b"xref\n0 1\n0000000000 65535 f \ntrailer\n<</Size 1" + (b"" if before is None else b"/Prev %d" % before) + b">>\nstartxref\n%d\n%%%%EOF" % at
        before = at
    return out


def archive(files, note=b""):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
        z.comment = note
    return out.getvalue()


def test_sniffing_carves_two_of_each_type():
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", bytes(13)), (b"IDAT", b"x"), (b"IEND", b"")))
    box = lambda kind, data: (8 + len(data)).to_bytes(4, "big") + kind + data
    riff = lambda form, data: b"RIFF" + (4 + len(data)).to_bytes(4, "little") + form + data
    rice = "0000" + "0000" + "0010" + "".join("0" * q + "1" + "01" for q in (0, 3, 1, 0, 2, 5))  # six residuals, two bits each besides the quotient
    fixed, lpc = "0" + f"{10:06b}" + "0" + "1" * 16 + rice[2:], "0" + f"{33:06b}" + "0" + "0" * 16 + "0011" + "00001" + "01010110" + rice[2:]
    parts = "0" + f"{8:06b}" + "0" + "01" + "0001" + "11111" + "00011" + "101" * 4 + "00001" + "".join("01" + "1" for _ in range(4))  # an escaped part, and one of 5-bit parameters
    wasted = "0" + "000001" + "1" + "01" + "110011" * 8
    constant = "0" + "000000" + "0" + "10101010"
    media_ = {
        "image/png": [png, png],
        "image/gif": [b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00\x3b"] * 2,
        "image/jpeg": [b"\xff\xd8\xff\xc0\0\x04ab\xff\xda\0\x03c" + data + b"\xff\xd9" for data in (b"12", b"3\xff\0\xff\xd04")],
        "audio/wav": [media.wav(b"ab"), media.wav(b"cdef")],
        "video/avi": [riff(b"AVI ", b"idx1\x02\0\0\0ab")] * 2,
        "image/webp": [riff(b"WEBP", b"VP8 \x02\0\0\0ab")] * 2,
        "audio/ogg": [b"OggS\0\x02" + bytes(20) + b"\x01\x03abc" + b"OggS\0\x04" + bytes(20) + b"\x01\x02de"] * 2,
        "audio/flac": [flac((1, 8, (fixed, lpc)), (8, 8, (wasted, parts + "0")), (1, 2, (constant, constant))), flac((9, 8, ("0" + fixed[1:8] + "1" * 18 + fixed[24:], wasted)), (1, 8, (parts, constant)), total=0)],
        "video/mp4": [box(b"ftyp", b"isom") + box(b"moov", b"abc") + box(b"mdat", b"de")] * 2,
        "application/pdf": [pdf(b"words"), pdf(b"other", b"2 0 obj\n<<>>\nendobj\n", b"3 0 obj\n<<>>\nendobj\n")],
        "application/zip": [archive({"a": b"aa", "b": b"b"}, b"note"), archive({"c": b"cc" * 50})],
    }
    for kind, (one, two) in media_.items():
        for blob in (one + two, b"x" + two + b"between" + png + b"%%EOF" + one + png + b"end", two + two + one):
            whole = [m for m in re.split(b"(" + b"|".join(map(re.escape, sorted({one, two, png}, key=len, reverse=True))) + b")", blob) if m in (one, two, png)]
            assert [(k, blob[a:e]) for k, a, e in media.sniff(blob)] == [("image/png" if m == png else kind, m) for m in whole], kind
        assert kind in ("application/pdf", "video/mp4") or media.sniff(one[:-1]) == [], kind


def test_sniffing_keeps_what_lies_inside():
    inner, plain_ = archive({"a": b"a"}), pdf(b"in")
    for whole, kind in ((archive({"x": inner, "y": inner}), "application/zip"), (pdf(plain_ + b" and " + plain_), "application/pdf")):
        assert media.sniff(whole + whole) == [(kind, 0, len(whole)), (kind, len(whole), 2 * len(whole))]
    broken = pdf(b"no table in its place", table=False)
    assert media.sniff(broken + b"-" + broken) == [("application/pdf", 0, len(broken)), ("application/pdf", len(broken) + 1, 2 * len(broken) + 1)]


def test_tokens_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, list(r.ids)) for r in token_store.read_blocks(token_store.store_tokens(docs, tokenizer_path()), with_ids=True).collect()), key=lambda r: r[1])
    rows = sorted(corpus(), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        assert g == (-1 if r[0] is None else r[0], start, ids)
        start += len(ids)


def test_any_tokenizer_and_hard_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    hard = ["<|endoftext|> x<|startoftext|>y <|ENDoftext|>", "don't l'eau O'REILLY's ''s", "  ", "", "İstanbul ŉ ẞ STRASSE ǅ", "e\u0301 éÉ a\u00a0b\u2003c\u3000d", "naïve 12ab34! ×÷ ½ ² ªº", "x" * 5000, "a\x1cb\x85c", "Σας ΣΑΣ", "\u212b ﬁ", "<|x|>", "½1", "ÀÉÎ-ÕÜß...12,3", "日本語 テキスト"] * 2
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = str(public_tokenizers.path(name))
        t = Tokenizer.from_file(path)
        encoder = token_store.TextEncoder(path)
        assert encoder.by_words == by_words
        want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in hard]
        for kept in (token_store.KEPT, 0):  # with words of before, and with all forgotten each time
            encoder.new.held = token_store.KEPT + 1 if not kept else encoder.new.held
            ids, n = encoder.encode(pa.array(hard), 1)
            assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_damaged_blocks_are_told(spark):
    lengths = code_lengths(np.array([5, 3, 1]), 4)
    data = Encoder(lengths).block([1], np.array([3]), np.array([0, 1, 2]), 0)
    for bad in (data[:-1], data[:20] + bytes([data[20] ^ 1]) + data[21:], b"", b"TWH1"):
        with pytest.raises(ValueError):
            Decoder(lengths).block(bad)


def test_huffman_blocks():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 5000), 900)
    lengths = code_lengths(np.bincount(ids, minlength=1000), 11)
    assert lengths.max() <= 11 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    docs_, counts, back, position = Decoder(lengths).block(Encoder(lengths).block([7, None], np.array([4000, 1000]), ids, 5))
    assert docs_ == [7, None] and list(counts) == [4000, 1000] and position == 5 and (back == ids).all()


def test_warc(spark):
    long_ = "<html>" + "y" * 200
    rows = [(5, "http://a/", long_), (2, "http://b/\r\nX: y", long_), (3, None, "short"), (4, "http://c/", "short"), (6, "http://d/", None), (None, "http://e/", long_), (2, "http://b/", long_)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(2)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.archive_pages(pages)).collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == long_ and i != 2
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert got == want


def test_archives_are_files_that_other_tools_open(spark):
    """A file's dictionary and frames by plain zstandard, one frame a record, in files of about the size asked for."""
    import zstandard

    rng = random.Random(2)
    rows = [(k, f"http://h/{k}", "<html>" + " ".join(f"w{rng.randrange(300)}" for _ in range(120))) for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.archive_pages(pages).count()
    newest = max(glob.glob(f"{shared.shared_root(spark)}/tideway/archives-*"), key=os.path.getmtime)
    files = glob.glob(f"{newest}/archive=pages-*.warc.zst/part-*")
    assert files and warc.write_archives(warc.mark_revisits(pages), b"", most=2000).count() > 3
    seen = []
    for path in files:
        with open(path, "rb") as f:
            raw = f.read()
        magic, size = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
        assert magic == 0x184D2A5D and size > 0
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        text = unpack.stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        seen += re.findall(rb"WARC-Record-ID: <urn:page:(\d+)>", text)
        assert raw.count(b"\x28\xb5\x2f\xfd") == text.count(b"WARC/1.1\r\n")
    assert sorted(map(int, seen)) == list(range(90))


def test_token_files_are_in_order(spark):
    """Files by path, and blocks in a file, go on where the one before ends, in ascending order of doc_id; read without the engine."""
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(3000)))) for _ in range(300)]
    store = token_store.store_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), tokenizer_path())
    with open(glob.glob(f"{store.folder}/code/code=lengths/part-*")[0], "rb") as f:
        decoder = Decoder(np.frombuffer(f.read()[:-1], np.uint8))
    names, total = [], 0
    files = sorted(glob.glob(f"{store.folder}/blocks/place=*/part-*"))
    assert len(files) >= 4
    for path in files:
        with open(path, "rb") as f:
            blocks_ = list(token_store.file_blocks(f.read()))
        for block in blocks_:
            docs_, counts, ids, start = decoder.block(block)
            assert start == total and len(ids) == counts.sum()
            total += len(ids)
            names += docs_
    assert names == sorted(r[0] for r in rows)
    with pytest.raises(ValueError):
        list(token_store.file_blocks(b"".join(blocks_)))


def test_damaged_archives_are_told(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<html>" + "z" * 50 * k) for k in range(6)], "page_id long, url string, html string").coalesce(1)
    name, content = warc.archive_pages(pages).first()
    whole = list(warc.archive_records(bytes(content)))
    assert len(whole) == 6
    bad = [b"", bytes(content)[:-9], b"junk" + bytes(content), warc.dictionary_frame(b"")[:-1]]
    rows = warc.read_archives(spark.createDataFrame([(f"a{k}", bytearray(b)) for k, b in enumerate(bad)], warc.ARCHIVE_SCHEMA), damaged="row").collect()
    assert {r.archive for r in rows if r.error} == {f"a{k}" for k in range(4)}
    with pytest.raises(Exception, match="archive a1: cut frame"):
        warc.read_archives(spark.createDataFrame([("a1", bytearray(bad[1]))], warc.ARCHIVE_SCHEMA), with_payload=False).collect()
    with pytest.raises(ValueError):
        warc.read_archives(spark.createDataFrame([], warc.ARCHIVE_SCHEMA), damaged="skip")
    for change in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"sha256:", b"sha256:0"), (b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(ValueError):
            warc.parse_record(whole[3].replace(*change, 1))


def test_classifiers_hold_out_and_edges(spark, docs, none):
    labels = spark.createDataFrame([(k, int(k % 2), int(k % 3 == 0)) for k in range(15)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        rows = f(docs, labels).collect()
        assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 for r in rows)
        assert f(none, labels).count() == 0 and f(docs, labels.limit(0)).count() == len(corpus())


def test_quality_is_the_same_alone_and_in_any_batch():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(0, 1, (256, quality.EMBED)).astype(np.float32), rng.normal(0, 1, (quality.WIDTH * quality.EMBED, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(0, 0.05, quality.FILTERS).astype(np.float32), 0.0)
    net.embed[0] = 0
    texts = [b"", b"same" * 64, b"\xff\xfe\xfd\xfcother", b"same" * 64, b"", b"z" * 700, b"", b"same" * 64, b"q" * 512]
    alone = [float(quality.score_texts([t], net)[0]) for t in texts]
    for order in (range(len(texts)), reversed(range(len(texts))), rng.permutation(len(texts))):
        order = list(order)
        got = quality.score_texts([texts[k] for k in order], net, 2)
        assert np.allclose(got, [alone[k] for k in order], rtol=0, atol=1e-5)


@pytest.mark.parametrize("hated, others, verb", [("muslims", ["christians", "jews"], "live here"), ("flüchtlinge", ["europäer", "asiaten"], "wohnen hier"), ("femmes", ["hommes", "filles"], "habitent ici"), ("inmigrantes", ["europeos", "africanos"], "viven aquí")])
def test_toxicity_is_counterfactual(hated, others, verb):
    """In each language: a group that only toxic labels name costs neutral mentions less than half as often as without the penalty."""
    import pyarrow as pa

    rng = random.Random(2)
    filler = [f"w{k}" for k in range(200)]
    sample = []
    for y in [0, 1] * 150:
        term = [hated] if y and rng.random() < 0.7 else [others[0]] if rng.random() < 0.1 else []
        text = " ".join(rng.sample(filler, 20) + (["vile", "scum"] if y else []) + term)
        sample.append((text, [text] if term else [], y))
    plain_, fair = toxicity.train(sample, fairness=0.0), toxicity.train(sample)
    pair = pa.array([f"{t} {verb} w1 w2" for t in (hated, others[0])])
    gap = lambda m: abs(float(np.subtract(*toxicity.score_texts(pair, m))))
    assert gap(fair) < 0.5 * gap(plain_)
    neutral = pa.array([f"{t} {verb} {' '.join(rng.sample(filler, 8))}" for t in (hated, *others) for _ in range(40)])
    wrong = lambda m: int((toxicity.score_texts(neutral, m) >= 0.3).sum())
    assert 2 * wrong(fair) < wrong(plain_) and wrong(plain_) >= 30
    toxic = pa.array([f"vile scum {' '.join(rng.sample(filler, 8))}" for _ in range(40)])
    assert (toxicity.score_texts(toxic, fair) >= 0.3).mean() > 0.9


def test_toxicity_score_equals_a_plain_loop():
    """Features of whole texts: each word and word beginning once, whatever its case, edges and place."""
    import pyarrow as pa

    rng = random.Random(5)
    words = ["vile", "scum", "kindness", "Hello", "(hello)", "größer", "a", "...", "visibility", "vil", "VILENESS"]
    sample = [(" ".join(rng.choice(words) for _ in range(12)) + (" vile scum" if y else " kindness"), [], y) for y in [0, 1] * 60]
    model = toxicity.train(sample)
    weights = {(h, name.as_py()): w for (names, part), h in zip(model.features, toxicity.HEADS, strict=True) for name, w in zip(names, part, strict=True)}
    assert len({h for h, _ in weights}) > 2
    texts = ["", " \t ", "vile", "VILE vile\nvile.", "unknown words", " ".join(words), "größer\x0bgrößere (visible)", "x" * 3000 + " scum"]
    for text, got in zip(texts, toxicity.score_texts(pa.array(texts), model).tolist(), strict=True):
        have = {w.lower().strip(toxicity.EDGES) for w in re.findall("[^ \t\n\x0b\f\r]+", text)}
        z = model.offset + sum(w for (h, name), w in weights.items() if any((x[:h] if h and len(x) > h else x if not h else None) == name for x in have))
        assert abs(got - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9


def test_sentences_that_name_a_group(spark):
    df = spark.createDataFrame([("No one. Old men sit here! Bold menu.\nGay? yes",), ("",), ("Nichts. MÄNNER da! Los niños. Garçonsé",)], "text string")
    assert [r.s for r in df.select(toxicity.naming_sentences(F.col("text")).alias("s")).collect()] == [[" Old men sit here!", "Gay?"], [], [" MÄNNER da!", " Los niños."]]


def test_quality_network_equals_a_plain_loop():
    rng = np.random.default_rng(9)
    q = quality
    net = q.Network(rng.normal(0, 1, (256, q.EMBED)).astype(np.float32), rng.normal(0, 1, (q.WIDTH * q.EMBED, q.FILTERS)).astype(np.float32), rng.normal(0, 1, q.FILTERS).astype(np.float32), rng.normal(0, 0.05, q.FILTERS).astype(np.float32), 0.3)
    net.embed[0] = 0
    for text in (b"", b"short", bytes(rng.integers(1, 256, 700).astype(np.uint8))):
        total = weight = 0.0
        for first in range(0, max(1, len(text)), q.STEP):
            chunk = text[first : first + q.STEP + q.WIDTH - q.STRIDE].ljust(q.STEP + q.WIDTH - q.STRIDE, b"\0")
            places = [np.concatenate([net.embed[x] for x in chunk[a : a + q.WIDTH]]) @ net.filters for a in range(0, q.STEP, q.STRIDE)]
            logit = float(np.maximum(np.max(places, 0) + net.bias, 0) @ net.weights + net.offset)
            own = max(1, min(q.STEP, len(text) - first))
            total, weight = total + logit * own, weight + own
        assert abs(q.score_texts([text], net)[0] - 1 / (1 + np.exp(-total / weight))) < 1e-4


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(6)
    filler = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(6000))
    rows = [(k, filler() + (" vile\nscum" if k % 2 else " kind\tpeople")) for k in range(80)] + [(1000, "vile scum"), (1001, "kind people")]
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    assert min(len(t) for _, t in rows[:80]) > 20_000
    got = {r.doc_id: r.score for r in toxicity.classify_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[1000] > 0.6 > 0.4 > got[1001]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    r = queries.op8_quality(spark, d).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL")
    assert r.filter("predicted = quality").count() >= 0.95 * r.count()
    t = queries.op6_toxicity(spark, d).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL")
    assert t.filter("predicted = toxic").count() >= 0.8 * t.count()


def test_language(spark):
    d = "/root/testdata/sf0.01"
    r = queries.op1_language(spark, d)
    docs_ = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    j = r.join(docs_, "doc_id")
    assert j.filter("language = lang").count() >= 0.98 * docs_.count()


def test_language_priors(spark):
    model = language.LanguageModel([("the cat and the dog are here " * 5, "en"), ("der hund und die katze sind hier " * 5, "de")])
    rows = [(k, "der hund und die katze", "de", "a.example.de") for k in range(30)] + [(100, "", "de", "a.example.de"), (101, "", None, None), (None, "the cat and the dog", None, "b.example.com")]
    got = {r.id: r for r in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string"), model).collect()}
    assert got[100].language == "de" and got[100].text_language is None and got[100].confidence > 0.9
    assert got[None].language == "en" and got[101].text_language is None
    page = spark.createDataFrame([('<html class="x" lang="FR-ca"><style>p{}</style><p>a &amp; b</p>', "https://u@Www.X.com:80/p")], "html string, url string")
    assert tuple(page.select(F.trim(F.regexp_replace(language.visible_text(F.col("html")), r"\s+", " ")), language.declared_language(F.col("html")), language.host_of(F.col("url"))).first()) == ("a & b", "fr", "www.x.com")


def test_every_language_is_learnt_from_whole_texts(spark):
    """More languages than 200, the rare ones too, and one that differs from another only after a long common opening."""
    word = lambda k: "".join(chr(97 + (k * 7 + j * (k // 26 + 1)) % 26) for j in range(9)) + str(k)
    text = lambda k: " ".join([word(k)] * 6)
    opening = "same words " * 200
    rows = [(1000 * k + j, text(k), f"l{k:03}") for k in range(203) for j in range(2 if k < 201 else 1)]
    rows += [(900001, opening + "vorne wieder", "late"), (900002, opening + "avant encore", "other"), (None, text(0), "l000"), (900003, None, "l001"), (900004, "no language", None)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 205
    plain_ = language.LanguageModel([(t, lang) for _, t, lang in rows if t and lang])
    probe = [b"vorne wieder", text(202).encode(), b""]
    assert np.allclose(model.score(probe, 200, 0.25), plain_.score(probe, 200, 0.25))
    asked = [(k, text(k), f"l{k:03}") for k in (0, 57, 200, 201, 202)] + [(300, "vorne wieder", "late"), (301, "avant encore", "other")]
    df = spark.createDataFrame([(k, t, None, "h.example.org") for k, t, _ in asked], "id long, text string, declared string, host string")
    assert {r.id: r.language for r in language.identify(df, model, temper=1.0).collect()} == {k: lang for k, _, lang in asked}


def test_salted_join_is_the_join_and_spreads(spark):
    rows = spark.range(0, 4000, 1, 4).selectExpr("id", "IF(id % 3 = 0, 'hot', 'k' || id % 500) AS k", "IF(id % 7 = 0, NULL, id % 2) AS j")
    table = rows.groupBy("k", "j").agg(F.count(F.lit(1)).alias("uses"), F.max("id").alias("most"))
    want = Counter((r.id, r.k, r.j, r.most) for r in rows.join(table.drop("uses"), ["k", "j"]).collect())
    joined = shared.salted_join(rows, table, ["k", "j"], 4000)
    assert Counter((r.id, r.k, r.j, r.most) for r in joined.collect()) == want
    assert shared.salted_join(rows.limit(0), table.limit(0), ["k", "j"], 0).count() == 0


def test_rows_of_one_id_fill_several_ranges(spark):
    rng = random.Random(9)
    rows = [(None, f"{rng.random()} word", *[None] * 5) for _ in range(300)] + [(None, "", *[None] * 5)] * 50 + [(k, "some words", *[None] * 5) for k in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = sorted(token_store.read_blocks(token_store.store_tokens(docs, tokenizer_path(), end_id=1)).collect(), key=lambda r: r.start)
    assert len(found) == 400 and [r.doc_id for r in found] == [None] * 350 + list(range(50))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(found, found[1:]))
    ids = token_store.token_ids(docs, tokenizer_path(), 1, 50_000)
    assert ids.filter("doc_id IS NULL AND n_tokens > 0").select("pid").distinct().count() > 1


def test_least_hashed(spark):
    """As a plain sort, also where all hashes of a group tie and where a group is small or absent."""
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "a").when(F.col("id") % 10 == 8, "ties").otherwise(F.when(F.col("id") < 50, "few")).alias("g"), F.when(F.col("id") % 10 != 8, F.xxhash64("id")).otherwise((1 << 63) - 5).alias("k"), F.col("id").cast("string").alias("t"))
    every = rows.filter("g IS NOT NULL").collect()
    want = {g: [t for _, t in sorted((r["k"], r["t"]) for r in every if r["g"] == g)[:40]] for g in ("a", "ties", "few")}
    assert shared.least_hashed(rows, dict(Counter(r["g"] for r in every)), 40) == want
    assert shared.least_hashed(rows, {"none": 0}, 40) == {"none": []} and shared.least_hashed(rows, {}, 40) == {}


def test_empty_tables(spark, none):
    assert jaccard_join.link_documents(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert media.read_payloads(media.store_payloads(none)).count() == 0
    assert token_store.read_blocks(token_store.store_tokens(none, tokenizer_path())).count() == 0
    assert warc.read_archives(warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, d)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    res = con.execute(queries.ORACLES[name])
    names = [c[0] for c in res.description]
    row = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert Counter(row([r[c] for c in names]) for r in df.collect()) == Counter(map(row, res.fetchall()))

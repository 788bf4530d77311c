"""Personal data, filter audit and periodic runs against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tideway.llm import filter_audit, periodic, personal, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, part string, words array<string>, n long, E long, spans string, row string"


def table(spark, texts):
    """Documents with extra columns named as the operators' own."""
    rows = [(i, t, lang, None, "x", ["y"], 7, 9, "s", "r") for i, t, lang in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(rows):
    return Counter(tuple(r) for r in rows)


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


PRIVATE = [
    "mail a.b@c.de_x@d.e.f, @no.where a@b a@b.c@d.e é@ü.de x+y%z@q-r.st.uv. end@dot.",
    "host 1.2.3.4.5.6.7.8 999.1.1.1 0000255.0.0.1 256.1.1.1 1.2.3 10.0.0.1.",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 23 and 5500005555555559",
    "call +1 (017) 555-7713 or +12 3 or +1234567890123456 or +49 30 1234567--",
    "IBAN DE89 3704 0044 0532 0130 00 now, GB82WEST12345698765432; account BE68 5390 0754 7034 THIS, DE89370400440532013001, xDE89370400440532013000",
    "my ssn 123-45-6789 is social, not a word more; version 123-45-6789; 000-12-3456 social security 123-45-6789-1",
    "Größe 北京 a@b.cd 𝒳 10.1.2.3",
    "", None, "   ", "@" * 300, "1 " * 400, "1." * 300, "a.b@c." * 100, "+1" * 100, "AB12 " * 60,
]


def test_personal_base_equals_plain_patterns():
    rng = random.Random(11)
    texts = [t or "" for t in PRIVATE] + ["".join(rng.choice("a1@.+- ()%9é") for _ in range(rng.randrange(120))) for _ in range(3000)]
    texts += ["".join(rng.choice("0123456789- ") for _ in range(rng.randrange(60))) for _ in range(2000)]
    for t in texts:
        got = [x[:3] for x in personal.spans(t) if x[0] in personal.BASE]
        assert got == base_spans(t), t


def test_personal_checksums():
    assert personal.mod97("DE89370400440532013000") and not personal.mod97("DE89370400440532013001")
    found = {t[a:b] for t in PRIVATE if t for kind, a, b, _ in personal.spans(t) if kind == "iban"}
    assert found == {"DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "BE68 5390 0754 7034"}
    assert [x[:3] for x in personal.spans(PRIVATE[5])] == [("ssn", 7, 18)]  # the others lack their word, or one speaks against them


def test_personal_is_linear():
    """Each of these texts takes a pattern that starts anew at every character far over a minute."""
    for t in ("a" * 400_000, "1" * 400_000, "1-" * 200_000, "@" * 400_000, "a@" * 200_000, "+" + "1-" * 200_000, "a@a." * 100_000, "AB12" + " A" * 200_000):
        personal.spans(t)


def test_personal_query_equals_sql(spark, tmp_path):
    docs = table(spark, [(k, t, "en") for k, t in enumerate(PRIVATE)] + [(3, PRIVATE[0], None), (None, PRIVATE[2], "en")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op11_personal(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.OP11_SQL})").fetchall()
    assert plain(df.collect()) == Counter(want) and len(want) == len(PRIVATE) + 2
    by_id = {r.doc_id: r for r in df.collect() if r.doc_id != 3}
    for k, t in enumerate(PRIVATE):
        if k != 3:
            text = ",".join(f"{kind}:{a}:{b}" for kind, a, b in base_spans(t or ""))
            assert by_id[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert by_id[k].spans.startswith(text)
    none = table(spark, [])
    assert personal.span_digest(personal.find_personal(none)).collect() == []


def test_redact(spark):
    docs = table(spark, [(1, "write a@b.cd or +49 30 1234567.", "en"), (2, None, "en"), (3, "", "en"), (4, "nothing", None)])
    kept = personal.redact(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, "write [EMAIL] or [PHONE]."), (2, None), (3, ""), (4, "nothing")}


# Filter audit


def failing(t):
    t = t or ""
    ws = WORD.findall(t)
    return {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}


def brute_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        f = {k for k, v in failing(t).items() if v} | ({"E"} if i is not None and i > least[t or ""] else set())
        rows.append((lang or "", f, i in good, i in toxic))
    out, share = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                share[part, x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return Counter((p, o, s, *v, share[p, o[s - 1]]) for (p, o, s), v in out.items())


def audit_rows():
    rng = random.Random(5)
    bag = ["w%d" % k for k in range(300)] + ["WORD", "Mixed", "a#b", "x"] * 4
    texts = [" ".join(rng.choice(bag[: rng.choice([20, 320])]) for _ in range(rng.choice([5, 150, 199, 200, 201, 260]))) for _ in range(24)]
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (200, 230, 199, 260)]
    texts += [None, "", " \t\n", "A B", "x " * 250, "é" * 10, "AAA"]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(80)]
    docs += [docs[3], docs[3], (3, "another text", "en"), (None, docs[0][1], "en"), (None, None, None), (-5, docs[9][1], "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 80, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = audit_rows()
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit_filters(table(spark, docs), marks)
    assert plain(got.collect()) == brute_audit(docs, labels)
    assert filter_audit.audit_filters(table(spark, []), marks).collect() == []
    unlabelled = filter_audit.audit_filters(table(spark, docs), marks.limit(0))
    assert plain(unlabelled.collect()) == brute_audit(docs, [])


def test_audit_query_equals_sql(spark, tmp_path):
    docs, labels = audit_rows()
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = queries.op12_filter_audit(spark, str(tmp_path))
    assert plain(df.collect()) == Counter(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.OP12_SQL})").fetchall())


def test_joint_counts_of_any_filters(spark):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), *(rng.randrange(2) for _ in range(3)), rng.randrange(1, 4), rng.randrange(2), rng.randrange(2)) for _ in range(60)]
    df = spark.createDataFrame(rows, "part string, X long, Y long, Z long, n long, good long, toxic long")
    for r in filter_audit.joint_failures(df, "XYZ").collect():
        for m in range(8):
            own = [x for x in rows if x[0] == r.part and all(x[1 + k] for k in range(3) if m >> k & 1)]
            assert (r.j[m], r.good[m], r.toxic[m]) == (sum(x[4] for x in own), sum(x[4] * x[5] for x in own), sum(x[4] * x[6] for x in own))


def test_keep_passing(spark):
    docs, _ = audit_rows()
    df = table(spark, docs)
    kept = filter_audit.keep_passing(df, "ABD")
    assert kept.columns == df.columns
    want = Counter((i, t) for i, t, _ in docs if not any(failing(t)[f] for f in "ABD"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want and want
    with pytest.raises(ValueError):
        filter_audit.keep_passing(df, "E")


# Periodic runs


def brute_runs(w, least=12):
    """All runs by trying every period: maximal stretches of equal pairs, dropped where a shorter period makes the same stretch."""
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - a >= max(least, 2 * p):
                found.setdefault((a, i + p), p)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(i, t):
    words = WORD.findall(t or "")
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    runs = brute_runs(words)
    drop = {k for a, m, p in runs for k in range(a + p, a + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{m},{p}\n" for a, m, p in runs)
    kept = " ".join(x for k, x in enumerate(words) if k not in drop)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    series = [[rng.randrange(k) for _ in range(rng.randrange(90))] for k in (1, 2, 2, 2, 3, 4, 9) for _ in range(120)]
    for _ in range(400):  # repeated blocks among others
        w = []
        while len(w) < 120:
            block = [rng.randrange(6) for _ in range(rng.randrange(1, 16))]
            w += (block * rng.randrange(1, 6))[: rng.randrange(1, 60)]
        series.append(w)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    series += [fibonacci[-1], [bin(k).count("1") & 1 for k in range(400)], [0] * 400, [0, 1] * 200, list(range(50)) * 5, list(range(6)) * 2, list(range(12))]
    for w in series:
        assert periodic.periodic_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert periodic.z_function(s) == want


def test_periodic_equals_brute_force(spark):
    rng = random.Random(9)
    line = " ".join(f"w{rng.randrange(50)}" for _ in range(14))
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "a\x0bb\x0c" * 40, f"{line}\n" * 7, f"head {line} {line} tail " * 3, " ".join(f"ü{rng.randrange(99)}" for _ in range(400)), "x y z " * 900, "a\x85b\xa0a\x85b " * 20]
    docs = [(k, texts[k % len(texts)], "en") for k in range(150)] + [(None, texts[7], None), (7, texts[7], "en"), (7, texts[7], "en")]
    got = periodic.find_periodic(table(spark, docs), planted=True)
    want = Counter(brute_row(i, t) for i, t, _ in docs)
    assert plain(got.collect()) == want
    assert sum(n for r, n in want.items() if r[1] > 1) and any(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(150))
    assert periodic.find_periodic(table(spark, []), planted=True).collect() == []


def test_periodic_query_equals_brute_force(spark):
    """All documents of the smallest table of up to 600 words; longer ones in ``test_runs_equal_brute_force``'s manner would take minutes."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        if len(WORD.findall(t or "")) <= 600:
            assert got[i] == brute_row(i, t)


def test_long_periodic_texts():
    """n log n: a million words of one period, and of none."""
    assert periodic.periodic_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic.periodic_runs(np.arange(200_000) % 70_000) == [(0, 200_000, 70_000)]
    assert periodic.periodic_runs(np.arange(1_000_000)) == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(np.arange(20), least=4)


def test_collapse_periodic(spark):
    docs = table(spark, [(1, "go  on " * 9, "en"), (2, None, "en"), (3, "keep  this", "en")])
    kept = periodic.collapse_periodic(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, "go on"), (2, None), (3, "keep  this")}

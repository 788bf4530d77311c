"""The fusion of language evidence against tables counted row by row, on pages off the training texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tideway.llm import language, shared

WORDS = {"en": "the cat and dog are here with some water".split(), "de": "der hund und die katze sind hier mit wasser".split(), "fr": "le chien et la chatte sont ici avec eau".split()}


def fused_by_force(rows, model, most=200, temper=0.25, strength=20.0, floor=1.0):
    """(id, language, confidence) of each row (id, text, declared, host)."""
    k = len(model.languages)
    scores = model.score(shared.text_bytes(pa.array([r[1] for r in rows])), most, temper)
    best = [int(np.argmax(s)) if s.max() > s.min() else None for s in scores]
    last = lambda pattern, host: (re.search(pattern, host) or [None, ""])[1]
    seen = [(d or "", h or "", last(r"([^.]+\.[^.]+)$", h or ""), last(r"\.([^.]+)$", h or "")) for _, _, d, h in rows]
    overall, by = Counter(), [defaultdict(Counter) for _ in range(4)]
    for b, values in zip(best, seen, strict=True):
        if b is not None:
            overall[b] += 1
            for table, value in zip(by, values, strict=True):
                table[value][b] += 1
    prior = [(overall[j] + 1) / (sum(overall.values()) + k) for j in range(k)]

    def smoothed(n, towards):
        return [(n[j] + strength * towards[j]) / (sum(n.values()) + strength) for j in range(k)]

    out = []
    for (i, *_), s, (declared, host, domain, suffix) in zip(rows, scores, seen, strict=True):
        place = smoothed(by[1][host], smoothed(by[2][domain], prior)) if host in by[1] else prior
        post = [s[j] + math.log(place[j]) for j in range(k)]
        for table, value in ((by[0], declared), (by[3], suffix)):
            if value in table:
                post = [p + math.log((table[value][j] + floor) / (overall[j] + 2 * floor)) for j, p in enumerate(post)]
        top = max(post)
        out.append((i, model.languages[post.index(top)], 1 / sum(math.exp(p - top) for p in post)))
    return out


def test_fusion_equals_tables_counted_by_hand(spark):
    r = random.Random(4)
    text = lambda lang, n: " ".join(r.choice(WORDS[lang]) for _ in range(n))
    model = language.LanguageModel([(text(lang, 400), lang) for lang in WORDS])
    rows = []
    for i in range(400):
        lang = r.choice(list(WORDS))
        host = r.choice([f"www.{lang}.{lang}", f"a.b.{lang}", f"news.site{r.randrange(3)}.com", "localhost", "", None])
        rows.append((i, r.choice([text(lang, r.choice([1, 2, 12])), "", None]) if i % 4 == 0 else text(lang, 9), r.choice([lang, "de", None]), host))
    rows += [(5, *rows[5][1:]), (None, text("fr", 9), None, "x.fr"), (900, text("de", 60_000), "fr", "a.b.de"), (901, "", "xx", "never.seen.zz")]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "id long, text string, declared string, host string, best string")
    frame = frame.select("id", shared.text_or_empty().alias("text"), "declared", "host", "best")
    got = language.identify(frame, model).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    want = sorted(fused_by_force([(i, t or "", d, h) for i, t, d, h in rows], model), key=key)
    found = sorted(((x.id, x.language, x.confidence) for x in got), key=key)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(found, want, strict=True)) < 1e-9
    asked = {i: d for i, t, d, h in rows}
    assert len(got) == len(rows) and len(asked) == len({x.id for x in got})

"""The pipeline over a small table of documents: each stage against brute force on what the stage before kept."""

from collections import Counter

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from tests.llm.test_corpus import WORD, corpus, roots, shingles
from tideway.llm import mixing, quality
from tideway.llm.queries import table, tokenizer_path
from tideway.llm.shared import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of the smallest test table, and rows with nulls, ties and repeats."""
    d, out = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("small"))
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None if r[0] is None else 10**6 + r[0], *r[1:5]) for r in corpus()], COLUMNS)
    docs.union(odd).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, d, name).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def kept(spark, folder):
    docs, out = table(spark, folder, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, folder), name)
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_and_columns(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "decontaminate", "mix", "tokens"]
    assert all(kept[n].columns == kept["documents"].columns for n in names[:-1])


def test_quality_stage(spark, folder, kept):
    docs = kept["documents"].collect()
    net = quality.fit_quality(kept["documents"], table(spark, folder, "labels"))
    scores = quality.score_texts([(r.text or "").encode() for r in docs], net)
    want = Counter((r.doc_id, r.text, r.source) for r, s in zip(docs, scores, strict=True) if s >= 0.5)
    assert Counter(rows(kept["quality"])) == want and 0 < sum(want.values()) < len(docs)


def test_near_copies_stage(kept):
    before, after = rows(kept["quality"]), Counter(rows(kept["near_copies"]))
    root, sets = roots(before)
    for k in set(root):
        members = {r for r, q in zip(before, root, strict=True) if q == k}
        mine = [m for m in members if after[m]]
        ids = [m[0] for m in members if m[0] is not None]
        assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None) if sets[k] else len({m[:2] for m in mine}) == len({m[:2] for m in members})
    assert not after - Counter(before)


def test_decontaminate_stage(spark, folder, kept):
    items = [q for r in table(spark, folder, "benchmark").collect() if (q := shingles(r.text))]
    clean = lambda text: not any(100 * len(q & s) >= 75 * len(q) for s in [shingles(text)] for q in items)
    assert Counter(rows(kept["decontaminate"])) == Counter(r for r in rows(kept["near_copies"]) if clean(r[1]))


def test_mix_stage(kept):
    words = Counter()
    for _, text, source in rows(kept["mix"]):
        words[source] += len(WORD.findall(text))
    taken = Counter()
    for r in mixing.mix_sources(kept["decontaminate"]).collect():
        taken[r.source] += r.taken
    assert words == +taken


def test_tokens_stage_and_run(spark, folder, kept):
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted(((-1 if d is None else d), len(t.encode(text, add_special_tokens=False).ids) + 1) for d, text, _ in rows(kept["mix"]))
    got = sorted(kept["tokens"].collect(), key=lambda r: r.start)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens) for r in got) == want
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))

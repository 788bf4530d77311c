"""Counterfactual-regularised toxicity classifier: swapping identity terms in a labelled sentence must not move its score."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.llm.labelled import fold, labelled_sample
from tideway.llm.shared import slices, text_or_empty

#: Terms that name groups, in the four languages of the corpus, by kind; within a kind they may stand for each other.
IDENTITY_TERMS = {
    "gender": ["women", "men", "girls", "boys", "woman", "man"],
    "religion": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish"],
    "origin": ["immigrants", "refugees", "foreigners", "natives", "africans", "asians", "europeans", "americans", "mexicans"],
    "colour": ["black", "white", "brown"],
    "orientation": ["gay", "straight", "lesbian", "bisexual", "transgender"],
    "age": ["old", "young", "elderly", "teenage"],
    "gender, de": ["frauen", "männer", "mädchen", "jungen"],
    "religion, de": ["muslime", "christen", "juden", "buddhisten", "atheisten"],
    "origin, de": ["einwanderer", "flüchtlinge", "ausländer", "afrikaner", "asiaten", "europäer"],
    "gender, fr": ["femmes", "hommes", "filles", "garçons"],
    "religion, fr": ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    "origin, fr": ["immigrés", "réfugiés", "étrangers", "africains", "asiatiques", "européens"],
    "gender, es": ["mujeres", "hombres", "niñas", "niños"],
    "religion, es": ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    "origin, es": ["inmigrantes", "refugiados", "extranjeros", "africanos", "asiáticos", "europeos"],
}
#: Characters cut from both ends of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lengths of the word beginnings that are features, besides the word itself (0).
HEADS = (0, 4, 5, 6)


@dataclass
class Model:
    """Weights of the chosen features, by kind: (sorted feature strings, weights) of words and of each word beginning."""

    features: list[tuple[pa.Array, np.ndarray]]
    offset: float


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(bounds of each text in the words, distinct words lower-cased and trimmed, index of each word)."""
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(split.values[bounds[0] : bounds[-1]])
    return bounds - bounds[0], pc.utf8_trim(pc.utf8_lower(coded.dictionary), EDGES), coded.indices.to_numpy()


def _forms(words: pa.Array, head: int) -> pa.Array:
    """A word itself, or its first ``head`` characters if it is longer (else null)."""
    if not head:
        return words
    return pc.if_else(pc.greater(pc.utf8_length(words), head), pc.utf8_slice_codeunits(words, 0, head), pa.scalar(None, pa.string()))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1: the squashed sum of the weights of the features that a whole text has."""
    bounds, words, index = _words(texts)
    found, upto = [], 0
    flat = np.concatenate([w for _, w in model.features])
    for (names, weights), head in zip(model.features, HEADS, strict=True):
        at = pc.fill_null(pc.index_in(_forms(words, head), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(names) else np.full(len(words), -1)
        hit = np.flatnonzero(at[index] >= 0) if len(words) else np.zeros(0, np.int64)
        doc = np.searchsorted(bounds, hit, "right") - 1
        found.append(np.unique(doc * len(flat) + at[index[hit]] + upto))
        upto += len(weights)
    pairs = np.concatenate(found)
    n = len(texts)
    total = np.bincount(pairs // len(flat), flat[pairs % len(flat)], n) if len(flat) else np.zeros(n)
    return 1 / (1 + np.exp(-np.clip(total + model.offset, -30, 30)))


def _swapped(words: list[str], rng: np.random.Generator) -> list[str]:
    """The words with each identity term put in place of another of its kind."""
    return [str(rng.choice([t for t in _KIND[w] if t != w])) if w in _KIND else w for w in words]


_KIND = {t: terms for terms in IDENTITY_TERMS.values() for t in terms}


def train(sample: list[tuple[str, list[str], int]], most: int = 30_000, least: int = 5, rounds: int = 300, fairness: float = 40.0, decay: float = 2e-4, seed: int = 3) -> Model:
    """Logistic regression on word features with the penalty fairness * (score - score of the swapped sentence) ** 2.

    ``sample`` has the words of each text, its sentences that name a group, and its label. Features are those that
    ``least`` sampled texts have, the ``most`` that part the classes best, and every identity term. Each sentence that
    names a group is paired with a swapped copy, a text's sentences sharing the weight of one; so is a copy of every
    eighth text into which a term is put, as neutral mentions are rare in labelled rows.
    """
    rng = np.random.default_rng(seed)
    labels = np.array([y for *_, y in sample], np.float64)
    ones = float(labels.mean()) if len(labels) else 0.0
    empty = [(pa.array([], pa.string()), np.zeros(0)) for _ in HEADS]
    if not 0 < ones < 1:
        return Model(empty, 20.0 * (ones - 0.5) if len(labels) else -5.0)
    split = lambda t: [sys.intern(w) for w in (x.lower().strip(EDGES) for x in t.split()) if w]
    bags = [split(t) for t, _, _ in sample]
    pairs, share = [], []  # (words, words with other terms) and the weight of each pair
    terms = list(_KIND)
    for k, (words, (_, sentences, _)) in enumerate(zip(bags, sample, strict=True)):
        own = [w for w in map(split, sentences) if any(x in _KIND for x in w)]
        if not own and k % 8 == 0:
            own = [words + [str(rng.choice(terms))]]
        for w in own:
            pairs.append((w, _swapped(w, rng)))
            share.append(1 / len(own))
    features = lambda words: {(h, w[:h] if h else w) for w in set(words) for h in HEADS if not h or len(w) > h}
    count: dict = {}
    for b, y in zip(bags, labels, strict=True):  # the features of one text at a time: all of them would fill the driver
        for f in features(b):
            c = count.setdefault(f, [0, 0])
            c[int(y)] += 1
    total = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    known = {f: c for f, c in count.items() if sum(c) >= least}
    gain = {f: abs(c[1] / total[1] - c[0] / total[0]) / np.sqrt((c[0] + c[1] + 1) / len(bags)) for f, c in known.items()}
    chosen = sorted(sorted(gain, key=lambda f: (-gain[f], f))[:most] + [(0, t) for t in terms if (0, t) not in gain])
    place = {f: k for k, f in enumerate(chosen)}

    def rows(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        hits = [np.array([place[f] for f in features(b) if f in place], np.int32) for b in texts]
        return np.repeat(np.arange(len(hits), dtype=np.int32), [len(h) for h in hits]), np.concatenate([*hits, np.zeros(0, np.int32)])

    row, col = rows(bags)
    a_row, a_col = rows([p[0] for p in pairs])
    b_row, b_col = rows([p[1] for p in pairs])
    pull = 2 * fairness * np.array(share) / max(1.0, sum(share))
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w, offset, n = np.zeros(len(chosen)), 0.0, len(bags)
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones)) / n
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        p = squash(np.bincount(row, w[col], n) + offset)
        d = (p - labels) * weight
        g = np.bincount(col, d[row], len(w)) + decay * w
        shift = d.sum()
        if pairs:
            one, other = (squash(np.bincount(r, w[c], len(pairs)) + offset) for r, c in ((a_row, a_col), (b_row, b_col)))
            move = pull * (one - other)
            up, down = move * one * (1 - one), move * other * (1 - other)
            g += np.bincount(a_col, up[a_row], len(w)) - np.bincount(b_col, down[b_row], len(w))
            shift += (up - down).sum()
        g = np.append(g, shift)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, offset = w - step[:-1], offset - step[-1]
    own = [[(f[1], w[k]) for k, f in enumerate(chosen) if f[0] == h] for h in HEADS]
    return Model([(pa.array([f for f, _ in part], pa.string()), np.array([x for _, x in part])) for part in own], float(offset))


def distinct_words(text: Column) -> Column:
    """Each word of a whole text once, parted by spaces."""
    return F.array_join(F.array_distinct(F.split(text, r"[ \t\n\x0B\f\r]+")), " ")


def naming_sentences(text: Column) -> Column:
    """The different sentences of a whole text that name a group."""
    named = r"(?iu)(?<!\p{L})(" + "|".join(_KIND) + r")(?!\p{L})"
    return F.array_distinct(F.filter(F.split(text, r"(?<=[.!?\n])"), lambda s: s.rlike(named)))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, by slices of about 4 MB; a longer text stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(batch.column("text"), model))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2, per_class: int = 2500) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from at most ``per_class`` texts of each label outside the held-out fold: from each word of a whole text once
    and from its sentences that name a group.
    Null texts are scored as empty ones; rows with equal doc_id are scored each; without labels of both kinds the score
    is one constant; an empty table gives an empty result; other columns are ignored.
    """
    model = train(labelled_sample(docs, labels, "toxic", folds, held_out, per_class, distinct_words(F.col("text")), naming_sentences(F.col("text"))))
    scored = toxicity_scores(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.labelled import fold, labelled_sample
from tideway.llm.shared import blocks, text_or_empty

#: Bytes a filter sees, bytes between its places, and bytes by which one chunk starts after another. A chunk spans
#: STEP + WIDTH - STRIDE bytes, so chunks overlap by WIDTH - STRIDE and every place of the filters is in one chunk.
WIDTH, STRIDE, STEP = 8, 4, 256
EMBED, FILTERS = 4, 24


@dataclass
class Network:
    """Byte embedding, filters, and the weights over max-pooled filters that give a chunk's logit."""

    embed: np.ndarray  # 256 x EMBED; byte 0, the padding, is zero
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def _windows(chunks: np.ndarray, net: Network) -> np.ndarray:
    """chunk x place x embedded bytes that a filter sees there, of rows of bytes."""
    e = net.embed[chunks].reshape(len(chunks), -1)
    return np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]


def _pooled(chunks: np.ndarray, net: Network) -> np.ndarray:
    """Max-pooled, rectified filter values of each chunk."""
    values = _windows(chunks, net).reshape(-1, WIDTH * EMBED) @ net.filters
    return np.maximum(values.reshape(len(chunks), -1, FILTERS).max(1) + net.bias, 0)


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunk x bytes, chunks of each text): each text starts a chunk, has one at least, and is padded by zeros.

    A chunk ends with the bytes that open the next chunk of its text; after a text's last chunk these are zeros.
    """
    n = np.array([max(1, -(-len(t) // STEP)) for t in texts], np.int64)
    flat = np.zeros(int(n.sum()) * STEP, np.uint8)
    at = 0
    for t, k in zip(texts, n, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(k) * STEP
    out = np.zeros((int(n.sum()), STEP + WIDTH - STRIDE), np.uint8)
    out[:, :STEP] = flat.reshape(-1, STEP)
    out[:-1, STEP:] = out[1:, : WIDTH - STRIDE]
    out[np.cumsum(n) - 1, STEP:] = 0
    return out, n


def score_texts(texts: list[bytes], net: Network, piece: int = 512) -> np.ndarray:
    """Probability of label 1 of each whole text: the mean of its chunks' logits, weighted by their bytes, squashed."""
    scores = np.zeros(len(texts))
    for a, b in blocks(texts):
        chunks, n = _padded(texts[a:b])
        logits = np.empty(len(chunks), np.float64)
        for k in range(0, len(logits), piece):
            logits[k : k + piece] = _pooled(chunks[k : k + piece], net) @ net.weights + net.offset
        first = np.cumsum(n) - n
        weight = np.full(len(logits), float(STEP))
        size = np.array([len(t) for t in texts[a:b]])
        weight[first + n - 1] = np.maximum(1, size - (n - 1) * STEP)
        scores[a:b] = np.add.reduceat(logits * weight, first) / np.add.reduceat(weight, first)
    return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def train(sample: list[tuple[str, int]], epochs: int = 8, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit on chunks of the sampled texts, each chunk with its text's label.

    Texts count alike within a class, and label 1 half as much again as label 0: rejected texts open with plain lines too.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.25, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    net.embed[0] = 0
    labels = np.array([y for _, y in sample], np.float32)
    ones = float(labels.mean()) if len(labels) else 0.5
    if not 0 < ones < 1:  # nothing to tell apart: the score is the share of label 1
        net.weights[:] = 0
        net.offset = 20.0 * (ones - 0.5)
        return net
    short = []  # a short cut of each text too, so that short texts aren't told by their padding
    for t, _ in sample:
        k = int(rng.integers(12, 120))
        at = int(rng.integers(0, max(1, len(t) - k)))
        short.append(t[at : at + k].encode())
    data, n = _padded([t.encode() for t, _ in sample] + short)
    labels = np.concatenate((labels, labels))
    of = np.repeat(np.arange(len(n)), n)
    y = labels[of]
    weight = (np.where(y == 1, 0.6 / ones, 0.4 / (1 - ones)) / n[of]).astype(np.float32)
    places, chunks = STEP // STRIDE, len(of)
    params = [net.embed, net.filters, net.bias, net.weights, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, size = 0, 256
    steps = epochs * max(1, chunks // size)
    for _ in range(epochs):
        order = rng.permutation(chunks)
        for k in range(0, chunks, size):
            pick = order[k : k + size]
            bytes_ = data[pick]
            view = _windows(bytes_, net)
            values = view.reshape(-1, WIDTH * EMBED) @ net.filters
            values = values.reshape(len(pick), places, FILTERS)
            best = values.argmax(1)
            top = np.take_along_axis(values, best[:, None], 1)[:, 0] + net.bias
            on = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(on @ net.weights + params[4][0], -30, 30)))
            w = weight[pick]
            g = ((p - y[pick]) * w / w.sum()).astype(np.float32)
            g_top = np.outer(g, net.weights) * (top > 0)
            seen = view[np.arange(len(pick))[:, None], best]  # chunk x filter x window
            g_filters = np.einsum("cfw,cf->wf", seen, g_top)
            g_seen = np.einsum("cf,wf->cfw", g_top, net.filters).reshape(-1, EMBED)
            where = bytes_[np.arange(len(pick))[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1)
            g_embed = np.stack([np.bincount(where, g_seen[:, d], 256) for d in range(EMBED)], 1)
            g_embed[0] = 0
            step += 1
            now = rate * (1 - step / (steps + epochs + 1))
            for q, dq, (m, v) in zip(params, (g_embed, g_filters, g_top.sum(0), on.T @ g + 1e-4 * net.weights, np.array([g.sum()])), moments, strict=True):
                m += 0.1 * (dq - m)
                v += 0.01 * (dq * dq - v)
                q -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.offset = float(params[4][0])
    return net


def quality_scores(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every whole text; memory in a task is bounded by about a MB and the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(texts, net))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = 1000) -> Network:
    """Train on at most ``per_class`` whole texts of each label outside the held-out fold."""
    return train(labelled_sample(docs, labels, "quality", folds, held_out, per_class))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null texts are scored as empty ones; rows with equal doc_id are scored each; without labels of both kinds the score
    is one constant; an empty table gives an empty result; other columns are ignored.
    """
    scored = quality_scores(docs, fit_quality(docs, labels, folds, held_out))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with their columns.

    Each row is judged by its text alone, null as empty: repeated rows and null ids stay or go alike. Without labels of
    both kinds all rows stay or all go; an empty table gives an empty result; names of columns are free.
    """
    net = fit_quality(docs, labels)
    names, kinds = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(names.index("text")).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(score_texts(texts, net) >= threshold))

    return docs.mapInArrow(run, kinds)

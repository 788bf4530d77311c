"""Language identification by Bayesian evidence fusion.

log P(language | evidence) = log prior of the host + tempered log-likelihood of the text + log P(declared | language) +
log P(suffix | language), up to a constant. The prior of a host is smoothed towards that of its parent domain, and that
towards the global one; these tables, P(declared | language) and P(suffix | language) are counts of the text's own best
language over all rows, by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.llm.shared import below_hash, discard, materialize, salted_join, text_bytes, text_or_empty

#: Hash buckets of byte trigrams.
BUCKETS = 1 << 15


def visible_text(html: Column) -> Column:
    """Text of markup: no scripts, styles, comments or tags; the five common entities are resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def declared_language(html: Column) -> Column:
    """Primary subtag of the html element's lang, lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})\b""", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    """Host of an address, lower case, without port and user; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _grams(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(b" " + text.lower() + b" ", np.uint8)


def _counts(text: bytes) -> np.ndarray:
    """Trigrams of a whole text by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for a in range(0, len(text), 1 << 20):  # pieces of a very long text
        out += np.bincount(_grams(_bytes(text[a : a + (1 << 20)])), minlength=BUCKETS)
    return out


class LanguageModel:
    """Log-probabilities of byte trigram buckets by language, kept sparse: what a language has not seen is one number."""

    def __init__(self, sample: list[tuple[str, str]]):
        counts: dict[str, np.ndarray] = {}
        for text, lang in sample:
            counts[lang] = counts.get(lang, 0) + _counts(text.encode())
        self._fill({lang: (at := np.flatnonzero(n), n[at]) for lang, n in counts.items()})

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        """From (buckets, trigrams) of each language."""
        model = cls([])
        model._fill(counts)
        return model

    def _fill(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts)
        sizes = np.array([counts[lang][1].sum() for lang in self.languages], np.float64)
        self.unseen = np.log(0.5) - np.log(sizes + 0.5 * BUCKETS)
        none = np.zeros(0, np.int64)
        buckets = np.concatenate([none, *[counts[lang][0] for lang in self.languages]])
        order = np.argsort(buckets, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(buckets, minlength=BUCKETS))))
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(counts[lang][0]) for lang in self.languages])[order]
        self.gain = np.log1p(np.concatenate([none, *[counts[lang][1] for lang in self.languages]])[order] * 2.0).astype(np.float32)

    def score(self, texts: list[bytes], most: int, temper: float) -> np.ndarray:
        """Mean log-likelihood of each whole text's trigrams times temper * min(trigrams, most): neighbours overlap, so they do not count as independent."""
        out = np.zeros((len(texts), len(self.languages)))
        for k, t in enumerate(texts):
            h = _counts(t)
            at = np.flatnonzero(h)
            n = int(h.sum())
            if n:
                size = self.starts[at + 1] - self.starts[at]
                places = np.repeat(self.starts[at + 1] - np.cumsum(size), size) + np.arange(size.sum())
                total = n * self.unseen + np.bincount(self.of[places], self.gain[places] * np.repeat(h[at], size), len(self.languages))
                out[k] = (total - total.max()) / n * min(n, most) * temper
        return out


def _language_counts(texts: DataFrame) -> DataFrame:
    """lang, texts, buckets, grams: a row for each language of rows (g, t), counted where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def give() -> pa.RecordBatch:
            at = [np.flatnonzero(n) for n in held.values()]
            names = np.repeat(np.array(list(held), object), [len(a) for a in at])
            out = [pa.array(names, pa.string()), pa.array(np.concatenate(at) - 1, pa.int32()), pa.array(np.concatenate([n[a] for n, a in zip(held.values(), at, strict=True)]), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["g", "bucket", "n"])

        for batch in batches:
            for g, t in zip(batch.column("g").to_pylist(), batch.column("t"), strict=True):
                if g not in held and len(held) == 64:
                    yield give()
                n = held.setdefault(g, np.zeros(BUCKETS + 1, np.int64))
                n[0] += 1  # the texts, as bucket -1
                n[1:] += _counts(t.as_py().encode())
        if held:
            yield give()

    sums = texts.select("g", "t").mapInArrow(run, "g string, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n"))
    seen = F.when(F.col("bucket") >= 0, F.struct("bucket", "n"))
    return sums.groupBy(F.col("g").alias("lang")).agg(F.sum(F.when(F.col("bucket") < 0, F.col("n"))).alias("texts"), F.collect_list(seen).alias("seen")).select("lang", "texts", F.col("seen.bucket").alias("buckets"), F.col("seen.n").alias("grams"))


def fit_languages(docs: DataFrame, per_language: int = 400) -> LanguageModel:
    """Learn every language from at most ``per_language`` whole labelled texts, those of least hash.

    Tasks count the trigrams; at most BUCKETS numbers of each language reach the driver.
    """
    rows = docs.filter("lang IS NOT NULL AND length(text) > 0").select(F.col("lang").alias("g"), F.xxhash64("doc_id").alias("k"), F.col("text").alias("t"))
    counts = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}  # a row per language
    model, texts = {}, dict.fromkeys(counts, 0)

    def learn(shares: dict[str, float]) -> None:
        found = _language_counts(below_hash(rows, shares, per_language)).toArrow()
        for lang, n, buckets, grams in zip(found["lang"].to_pylist(), found["texts"].to_pylist(), found["buckets"], found["grams"], strict=True):
            texts[lang], model[lang] = n, (buckets.values.to_numpy().astype(np.int64), grams.values.to_numpy())

    if counts:
        learn({g: 2 * per_language / n for g, n in counts.items()})
    # a group whose hashes tie may have too few below; it is read again in full
    if short := {g: 1.0 for g, n in counts.items() if texts[g] < min(per_language, n)}:
        learn(short)
    return LanguageModel.of_counts(model)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host of rows (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long").alias("id"), F.coalesce(visible_text(F.col("html")), F.lit("")).alias("text"), declared_language(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """The same of rows (doc_id, source, text): plain text has no markup or address; its source stands for the host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"), F.lit(None).cast("string").alias("declared"), F.lower(F.col("source").cast("string")).alias("host"))


def identify(evidence: DataFrame, model: LanguageModel, most: int = 200, temper: float = 0.25, strength: float = 20.0, floor: float = 1.0) -> DataFrame:
    """id, language, confidence (posterior of that language), text_language (by the text alone) of rows (id, text, declared, host).

    Empty texts are decided by the other evidence; null or unknown declarations, hosts and suffixes count as values of
    their own and say what the corpus says of them; rows with equal ids are each decided; an empty table, or a model
    without languages, gives an empty result or null languages.
    """
    k = len(model.languages)
    if not k:
        return evidence.select("id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(text_bytes(batch.column("text")), most, temper)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * k, pa.int32()), pa.array(scores.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), batch.column("host"), flat], ["id", "declared", "host", "scores"])

    scored = evidence.mapInArrow(run, "id long, declared string, host string, scores array<double>")
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    best = F.when(F.array_max("scores") > F.array_min("scores"), (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    rows = materialize(scored.withColumn("declared", F.coalesce("declared", F.lit(""))).withColumn("host", F.coalesce("host", F.lit(""))).withColumn("domain", domain).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1)).withColumn("best", best), "evidence")
    known = rows.filter("best IS NOT NULL")
    thin = materialize(known.groupBy("host", "domain", "suffix", "declared", "best").agg(F.count(F.lit(1)).cast("double").alias("n")), "counts")  # a row per combination and language
    seen = {r["best"]: r["n"] for r in thin.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # k numbers at most
    overall = [seen.get(j, 0.0) for j in range(k)]
    everything = sum(overall) + k
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    prior, flat = numbers((x + 1) / everything for x in overall), numbers([1.0] * k)

    def total(by: list[str]) -> DataFrame:
        """by, n (a number for each language), all of them as rows_."""
        each = thin.groupBy(*by, "best").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"), F.sum("n").alias("rows_"))
        return each.select(*by, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("n"), "rows_")

    def smoothed(towards: Column) -> Column:
        return F.zip_with("n", towards, lambda x, p: (x + strength * p) / (F.col("rows_") + strength))

    domains = total(["domain"]).select("domain", smoothed(prior).alias("p_domain"))
    hosts = total(["host", "domain"]).join(domains, "domain").select("host", smoothed(F.col("p_domain")).alias("p_host"))
    given = lambda name: total([name]).select(name, F.zip_with("n", numbers(overall), lambda x, o: (x + floor) / (o + 2 * floor)).alias(f"p_{name}"))
    blank = rows.filter("best IS NULL").groupBy("host", "suffix", "declared").agg(F.count(F.lit(1)).cast("double").alias("n"))
    combos = thin.select("host", "suffix", "declared", "n").union(blank).groupBy("host", "suffix", "declared").agg(F.sum("n").cast("long").alias("uses"))
    # the priors meet the combinations, of which a host has few; rows then meet one row of their combination
    fused = combos.join(hosts, "host", "left").join(given("suffix"), "suffix", "left").join(given("declared"), "declared", "left")
    logs = F.zip_with(F.coalesce("p_host", prior), F.coalesce("p_suffix", flat), lambda a, b: F.log(a) + F.log(b))
    logs = F.zip_with(logs, F.coalesce("p_declared", flat), lambda a, b: a + F.log(b))
    table = materialize(fused.select("host", "suffix", "declared", "uses", logs.alias("logs")), "fused")
    joined = salted_join(rows, table, ["host", "suffix", "declared"], rows.count()).withColumn("post", F.zip_with("scores", "logs", lambda a, b: a + b)).withColumn("top", F.array_max("post"))
    names = F.array(*[F.lit(x) for x in model.languages])
    discard(thin)
    weight = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return joined.select("id", F.element_at(names, F.array_position("post", F.col("top")).cast("int")).alias("language"), (1 / weight).alias("confidence"), F.try_element_at(names, F.col("best") + 1).alias("text_language"))

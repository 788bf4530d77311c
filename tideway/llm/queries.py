"""The registered query of each corpus operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import personal
from tideway.llm.decontaminate import find_leaks
from tideway.llm.filter_audit import audit_filters
from tideway.llm.jaccard_join import link_documents
from tideway.llm.language import document_evidence, fit_languages, identify, page_evidence
from tideway.llm.media import read_payloads, store_payloads
from tideway.llm.mixing import mix_sources
from tideway.llm.periodic import find_periodic
from tideway.llm.quality import classify_quality
from tideway.llm.repeats import remove_repeats
from tideway.llm.token_store import read_blocks, store_tokens
from tideway.llm.toxicity import classify_toxicity
from tideway.llm.warc import archive_pages, read_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('17:' || doc_id) AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(place % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps_below, coalesce(sum(weight) OVER o, 0) AS weight_below FROM w
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(((SELECT sum(source_size) * 1.5::DOUBLE FROM w) - caps_below) / ((SELECT sum(weight) FROM w) - weight_below)) AS level FROM b),
t AS (SELECT source, source_size, least(cap, level * weight)::DOUBLE AS target FROM w, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken FROM p
"""

def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(archive_pages(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""


def tokenizer_path() -> str:
    """The public word-end BPE that the token queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(store_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""

def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
sh AS (SELECT DISTINCT k, id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS s
       FROM (SELECT k, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM sh WHERE k = 'b' GROUP BY id),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS c FROM sh d JOIN sh b ON d.k = 'd' AND b.k = 'b' AND d.s = b.s GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS n_item, c::BIGINT AS n_shared, c::DOUBLE / n AS containment FROM p JOIN n ON n.id = item_id WHERE 100 * c >= 75 * n
"""


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages, by all evidence, and of all documents, whose source stands for the host."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs)
    pages = identify(page_evidence(table(spark, sf_dir, "pages")), model)
    texts = identify(document_evidence(docs), model)
    none = F.lit(None).cast("long")
    return texts.select(F.col("id").alias("doc_id"), none.alias("page_id"), "language", "confidence", "text_language").union(pages.select(none.alias("doc_id"), F.col("id").alias("page_id"), "language", "confidence", "text_language"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_payloads(store_payloads(table(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.span_digest(personal.find_personal(table(spark, sf_dir, "documents")))


def _personal_sql() -> str:
    """Matches as SQL finds them, one pattern a kind: between the pieces of a split lie the matches, so their lengths give the places."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+",
        "ssn": r"[0-9-]+",
    }
    proposed = "\nUNION ALL ".join(f"SELECT row, '{k}' AS kind, {i} AS place, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d" for i, (k, p) in enumerate(patterns.items()))
    lengths = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in personal.IBAN_LENGTH.items()) + "}"
    by_kind = lambda values: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"  # noqa: E731
    words = {k: f"'(^|[^a-z])({v})([^a-z]|$)'" for k, v in personal.CONTEXT.items()}
    base = ", ".join(f"'{k}'" for k in personal.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in personal.BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({proposed}),
e AS (SELECT row, kind, place, unnest(hits) AS m, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS nth FROM p),
b AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY row, kind ORDER BY nth) - length(m))::BIGINT AS a FROM e),
n AS (SELECT row, kind, place, m, a, t, regexp_replace(m, '[^0-9]', '', 'g') AS digits, {lengths}[m[1:2]] AS need FROM b JOIN d USING (row)),
k AS (SELECT *, CASE WHEN kind = 'iban' THEN list_filter(range(1, length(m) + 1), lambda i: m[i] <> ' ')[need] ELSE length(m) END AS size FROM n WHERE kind <> 'iban' OR need IS NOT NULL),
c AS (SELECT *, a + size AS z, replace(m[1:size], ' ', '') AS account FROM k WHERE size IS NOT NULL),
f AS (SELECT * FROM c WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(x, 3) AS INT), 0) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::INT ELSE (2 * digits[-i]::INT) // 10 + (2 * digits[-i]::INT) % 10 END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
  WHEN 'iban' THEN NOT regexp_matches(t[z + 1:z + 1], '^[A-Za-z0-9]$') AND list_reduce(list_transform(string_split(account[5:] || account[1:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x::INT ELSE ascii(x) - 55 END), lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1
  ELSE regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND m[1:3] NOT IN ('000', '666') AND m[1:1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000' END),
g AS (SELECT *, translate(t[greatest(1, a + 1 - {personal.BEFORE}):a] || ' ' || t[z + 1:z + {personal.AFTER}], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near FROM f),
s AS (SELECT row, kind, place, a, kind || ':' || a || ':' || z AS span, {by_kind(personal.PRIOR)} + CASE WHEN regexp_matches(near, {by_kind(words)}) THEN {personal.FOR} ELSE 0 END - CASE WHEN regexp_matches(near, '(^|[^a-z])({personal.CONTRARY})([^a-z]|$)') THEN {personal.AGAINST} ELSE 0 END AS score FROM g),
o AS (SELECT row, {counts}, string_agg(span, ',' ORDER BY place, a) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY place, a) AS spans, string_agg(score, ',' ORDER BY place, a) AS scores
      FROM s WHERE kind IN ({base}) OR score >= {personal.ACCEPT} GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in personal.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN o USING (row)
"""


OP11_SQL = _personal_sql()


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Counts each order's steps one by one, from documents counted by the letters of the filters that they fail.
OP12_SQL = r"""
WITH m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN m USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[:step - 1] AS gone FROM p, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, x,
      coalesce(sum(n) FILTER (translate(fails, gone || x, '') = fails), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, gone, '') = fails), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, gone, '') <> fails), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (contains(fails, x) AND translate(fails, gone, '') = fails), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (contains(fails, x) AND translate(fails, gone, '') = fails), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM r
"""


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_periodic(table(spark, sf_dir, "documents"), planted=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_source_mix": op2_source_mix,
    "op3_media": op3_media,
    "op4_warc_archive": op4_warc_archive,
    "op5_token_store": op5_token_store,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontaminate": op10_decontaminate,
    "op11_personal": op11_personal,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic": op13_periodic,
}
ORACLES: dict[str, str] = {
    "op2_source_mix": OP2_SQL,
    "op4_warc_archive": OP4_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_personal": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}

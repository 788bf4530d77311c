"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every finder is linear in the text: it starts once for each sign or digit run that can open a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.shared import slices, text_or_empty

#: Kinds in the order of results: the first four are kept whatever their score, the others from ACCEPT on.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn")
ACCEPT = 50
#: Score before context, what a word of the kind nearby adds, what a word against takes, and how many code points count as near.
PRIOR = {"email": 90, "ip": 60, "card": 70, "phone": 70, "iban": 80, "ssn": 40}
FOR, AGAINST, BEFORE, AFTER = 10, 30, 40, 20
CONTEXT = {
    "email": "mail|email|contact|write|kontakt|contacto|correo|courriel",
    "ip": "ip|host|server|address|adresse|servidor",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|handy|appel|telefono",
    "iban": "iban|account|bank|konto|compte|cuenta|bic",
    "ssn": "ssn|social|security",
}
CONTRARY = "version|build|order|invoice|isbn|serial|example"
#: Length of an account number by country: fixed values of the IBAN registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9])++", re.ASCII)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_NEAR = {k: re.compile(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)".encode()) for k, words in CONTEXT.items()}
_CONTRARY = re.compile(rf"(?:^|[^a-z])(?:{CONTRARY})(?:[^a-z]|$)".encode())
_DIGITS = {ord(c): None for c in " ().-+"}


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def mod97(account: str) -> bool:
    """The checksum of account numbers: four characters moved to the end, letters as 10 to 35, remainder 1."""
    rest = 0
    for c in account[4:] + account[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def emails(t: str) -> Iterator[tuple[int, int]]:
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(t, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = t.find("@", end if domain else at + 1)


def addresses(t: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(t):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(t: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(t):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := m[0].translate(_DIGITS)) <= 19 and luhn(digits):
            yield m.span()


def phones(t: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(t):
        if 8 <= len(m[0].translate(_DIGITS)) <= 15:
            yield m.span()


def accounts(t: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(t):
        need = IBAN_LENGTH.get(m[0][:2])
        if need and len(m[0]) >= need:
            end, have = m.start(), 0
            while end < m.end() and have < need:
                have += t[end] != " "
                end += 1
            if have == need and (end == len(t) or t[end] not in _ALNUM) and mod97(t[m.start() : end].replace(" ", "")):
                yield m.start(), end


def socials(t: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(t):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": accounts, "ssn": socials}


def score(t: str, kind: str, start: int, end: int) -> int:
    """0 to 100: the kind's prior, more with one of its words nearby, less with a word that names another thing."""
    near = f"{t[max(0, start - BEFORE) : start]} {t[end : end + AFTER]}".encode().lower()
    return PRIOR[kind] + FOR * bool(_NEAR[kind].search(near)) - AGAINST * bool(_CONTRARY.search(near))


def spans(t: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score) of a text, in code points, by kind and start."""
    found = [(kind, a, b, score(t, kind, a, b)) for kind, find in FINDERS.items() for a, b in find(t)]
    return [x for x in found if x[0] in BASE or x[3] >= ACCEPT]


SPANS = "array<struct<kind: string, start: long, end: long, score: int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())]))


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every document: kind, start, end (code points, end exclusive) and score of each span, by kind and start.

    Spans of different kinds may overlap. Null and empty texts have none; rows with equal doc_id are a row each, null ids
    too; an empty table gives an empty result; other columns are ignored. A task holds about 4 MB of texts and the longest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans(t)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _ARROW)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and scores of ``find_personal``'s rows."""
    written = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda rows: F.array_join(F.transform(rows, written), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    counted = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [counted(k) for k in BASE]
    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, least: int = ACCEPT) -> DataFrame:
    """``docs`` with every span of at least that score put as [KIND]; of overlapping spans the first, then the longest, stands.

    All rows and columns stay, whatever their names; null and empty texts stay as they are.
    """
    names = docs.columns

    def clean(t: str | None) -> str | None:
        out, at = [], 0
        for kind, a, b, _ in sorted((x for x in spans(t or "") if x[3] >= least), key=lambda x: (x[1], -x[2])):
            if a >= at:
                out += [t[at:a], f"[{kind.upper()}]"]
                at = b
        return "".join([*out, t[at:]]) if at else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = names.index("text")
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.set_column(k, part.schema.field(k), pa.array([clean(t) for t in part.column(k).to_pylist()], part.column(k).type))

    return docs.mapInArrow(run, docs.schema)

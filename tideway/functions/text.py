"""Identifiers, JSON access with type guards, hashing and deterministic picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_urn(kind: str, name: Column) -> Column:
    """urn:ngsi-ld:{kind}:{name}; what is a URN already stays."""
    return F.when(name.startswith("urn:"), name).otherwise(F.concat(F.lit(f"urn:ngsi-ld:{kind}:"), name))


def from_urn(urn: Column) -> Column:
    """What follows the type, colons kept; other text passes."""
    return F.when(urn.rlike(r"^urn:ngsi-ld:[^:]+:"), F.regexp_extract(urn, r"(?s)^urn:ngsi-ld:[^:]+:(.*)$", 1)).otherwise(urn)


def lane_edge(lane: Column) -> Column:
    return F.regexp_replace(lane, "_[^_]*$", "")


def attr(doc: Column, name: str) -> Column:
    """Text of a property's value."""
    return F.get_json_object(doc, f"$.{name}.value")


def _raw(doc: Column, name: str, member: str) -> Column:
    """The value as JSON text, kinds told apart: text keeps its quotes."""
    return F.variant_get(F.try_parse_json(doc), f"$.{name}.{member}", "variant")


def number_attr(doc: Column, name: str, kind: str = "double") -> Column:
    """A JSON number, else null: numbers as text, booleans and missing values are null; ``int`` truncates."""
    v = _raw(doc, name, "value")
    numeric = F.schema_of_variant(v).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    x = F.when(numeric, F.try_variant_get(v, "$", "double"))
    return x.cast("double") if kind == "double" else F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast(kind)


def bool_attr(doc: Column, name: str) -> Column:
    v = _raw(doc, name, "value")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def refs_attr(doc: Column, name: str) -> Column:
    """Targets of a relationship; a single one becomes an array of one."""
    v = _raw(doc, name, "object")
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))


def time_attr(doc: Column, name: str) -> Column:
    """A date-time given as {"@value": ...} or as plain text."""
    return F.coalesce(F.get_json_object(doc, f"$.{name}.value.@value"), F.get_json_object(doc, f"$.{name}.value['@value']"), F.get_json_object(doc, f"$.{name}.value"))


def stable_draws(seed: str, source: Column, n: Column) -> tuple[Column, Column]:
    """Two numbers in [0, 1) fixed by md5(seed:source:n)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), source, n.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return (h % 10000) / 10000, (F.floor(h / 10000) % 10000) / 10000


def stable_pick(draw: Column, weights: dict[str, float]) -> Column:
    """The first key whose running weight reaches the draw, else the last."""
    out, total = None, 0.0
    for key, w in weights.items():
        total = round(total + w, 10)
        out = F.when(draw <= total, key) if out is None else out.when(draw <= total, key)
    return out.otherwise(list(weights)[-1])


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, one a line."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def canonical_json(doc: Column) -> Column:
    """A JSON object of plain values with its keys in order and no blanks."""
    m = F.from_json(doc, "map<string,variant>")
    sorted_ = F.array_sort(F.map_keys(m))
    parts = F.transform(sorted_, lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.to_json(F.element_at(m, k))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def map_attr(doc: Column, name: str, kind: str = "double") -> Column:
    """A property whose value is an object of numbers (``double`` or ``int``), as a map; anything else is null."""
    raw = F.get_json_object(doc, f"$.{name}.value")
    return F.when(raw.startswith("{"), F.from_json(raw, f"map<string,{kind}>"))


def utc_text(t: Column) -> Column:
    """Seconds since 1970 as yyyy-MM-ddTHH:mm:ssZ; the session's time zone is UTC."""
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def log_kind(line: Column) -> Column:
    """What a simulator's log line reports: teleport, error or nothing."""
    return F.when(line.rlike("(?i)teleport"), "teleport").when(line.rlike("^Error:"), "error")


def percent_encode(x: Column) -> Column:
    """An id as part of an address."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))

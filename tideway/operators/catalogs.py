"""Validation of topology catalogs: nested JSON documents opened by path, compared with what the network must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts that every catalog has.
REQUIRED = ("topology_hash", "node_to_tls", "edges", "connections", "inter_node_links", "movements_by_approach", "approach_edges", "outgoing_edges")
EDGE = "struct<`from`: string, id: string, numLanes: int, `to`: string>"
CONNECTION = "struct<dir: string, `from`: string, fromLane: int, linkIndex: int, tl: string, `to`: string, toLane: int, via: string>"
PARTS = {
    "topology_hash": "string",
    "node_to_tls": "map<string, string>",
    "edges": f"array<{EDGE}>",
    "connections": f"array<{CONNECTION}>",
    "inter_node_links": "map<string, struct<edge: string>>",
    "movements_by_approach": "map<string, map<string, array<struct<`from`: string>>>>",
}


def opened(catalogs: DataFrame, doc: str = "doc") -> DataFrame:
    """``catalogs`` with its document parsed once, a typed column for each part, and ``absent``, the required parts that it lacks.

    A document that is no JSON object lacks all of them; a part of another type than its own is null but not absent. Of a
    document that lacks a part only that is said, so it is not parsed and all its parts are null.
    """
    keys = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))
    read = catalogs.withColumn("absent", F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), keys))
    return read.withColumn("_v", F.when(F.size("absent") == 0, F.try_parse_json(F.col(doc)))).withColumns({k: F.try_variant_get("_v", f"$.{k}", kind) for k, kind in PARTS.items()}).drop("_v")


def topology_hash(edges: Column, connections: Column, nodes: Column) -> Column:
    """SHA-256 of the canonical JSON of edges, connections and node map: keys in order, no blanks, nulls written.

    Edges and connections are hashed in the order given, as a catalog lists them sorted.
    """
    in_order = F.map_from_entries(F.sort_array(F.map_entries(nodes)))
    body = F.struct(connections.alias("connections"), edges.alias("edges"), in_order.alias("node_to_tls"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def catalog_errors(catalogs: DataFrame, key: str, approaches: list[tuple[str, str, str]], outgoing: list[tuple[str, str]], links: list[tuple[str, str]], nodes: dict[str, str], doc: str = "doc") -> DataFrame:
    """(key, rule, subject, detail): a row for each way in which a catalog is wrong; no row for a right one.

    What the network must have is the caller's: approaches (signal, direction, edge), outgoing edges (signal, edge), links
    (link, edge), and the signal of each node. A catalog without a required part has only that said of it. All rules are
    read off a document in one pass without a shuffle; what they compare are sets, met by hashes. A document that is null,
    no JSON or of other types is wrong, never an error of the job; equal keys are judged each.

    Rules: missing_key, hash (detail: the right one), nodes, approach_edge, outgoing_edge, link_missing, link_edge (detail:
    what it says), link_not_in_net, movements_missing, movements_empty, movement_from (detail: another edge's id).
    """
    c = opened(catalogs.select(F.col(key), F.col(doc).alias("doc")))
    text = lambda x: F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x.cast("string")
    said = lambda rule, subject=None, detail=None: F.struct(F.lit(rule).alias("rule"), text(subject).alias("subject"), text(detail).alias("detail"))
    none = F.array().cast("array<struct<rule: string, subject: string, detail: string>>")
    where = lambda wrong, *error: F.when(F.coalesce(wrong, F.lit(True)), F.array(said(*error))).otherwise(none)
    ids = F.coalesce(F.col("edges")["id"], F.array().cast("array<string>"))
    in_net = dict.fromkeys([e for _, _, e in approaches] + [e for _, e in [*outgoing, *links]])
    named = lambda rows: F.array(*[F.struct(F.lit(subject).alias("subject"), F.lit(edge).alias("edge")) for subject, edge in rows])

    def not_in_net(rule: str, rows: list[tuple[str, str]]) -> Column:
        return F.transform(F.filter(named(rows), lambda r: F.array_contains("lacking", r["edge"])), lambda r: said(rule, r["subject"], r["edge"]))

    def from_others(rows: Column, subject: str, edge: str) -> Column:
        others = F.filter(rows, lambda r: F.coalesce(r["from"], F.lit("")) != edge)
        return F.coalesce(F.transform(others, lambda r: said("movement_from", subject, r["from"])), none)

    # what several rules read is a column of its own, so that it is made once a document
    whole = lambda made: F.when(F.size("absent") == 0, made)
    c = c.withColumns({"lacking": whole(F.array_except(F.array(*[F.lit(e) for e in in_net]).cast("array<string>"), ids)), "expected": whole(topology_hash(F.col("edges"), F.col("connections"), F.col("node_to_tls")))})
    expected = F.col("expected")
    wanted = F.array_sort(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in nodes.items()]))
    found = [
        where(F.col("topology_hash") != expected, "hash", None, expected),
        where(F.sort_array(F.map_entries("node_to_tls")) != wanted, "nodes"),
        not_in_net("approach_edge", [(f"{t}/{d}", e) for t, d, e in approaches]),
        not_in_net("outgoing_edge", list(outgoing)),
        not_in_net("link_not_in_net", list(links)),
    ]
    for link, edge in links:
        got = F.try_element_at("inter_node_links", F.lit(link))
        found.append(where(got.isNull(), "link_missing", link))
        found.append(where(got.isNotNull() & (F.coalesce(got["edge"], F.lit("")) != edge), "link_edge", link, got["edge"]))
    for signal, direction, edge in approaches:
        rows = F.try_element_at(F.try_element_at("movements_by_approach", F.lit(signal)), F.lit(direction))
        subject = f"{signal}/{direction}"
        found.append(where(rows.isNull(), "movements_missing", subject))
        found.append(where(rows.isNotNull() & (F.size(rows) == 0), "movements_empty", subject))
        found.append(from_others(rows, subject, edge))
    every = F.when(F.size("absent") > 0, F.transform("absent", lambda k: said("missing_key", k))).otherwise(F.concat(*found))
    return c.select(key, F.inline(every))

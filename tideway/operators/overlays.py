"""Overlays as they are asked for, emergency vehicles as they are followed, and the node state that readers get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideway import params as P
from tideway.operators.scans import sized

#: What each type of overlay may be asked for, the edges that rain falls on by default, and how many lanes an edge has.
TYPES = tuple(P.OVERLAY_PRIORITY)
ROLES = ("incoming_approach", "downstream_exit")
RAIN = {"default": ("J3J4", "J4J3"), "A": ("J1J3", "J3J1"), "B": ("J2J4", "J4J2")}
OPPOSITE = {"North": "South", "South": "North", "East": "West", "West": "East"}
LANES = 3


def requested_overlays(requests: DataFrame, links: DataFrame, approaches: DataFrame) -> DataFrame:
    """``requests`` (overlay_type, node_id, direction, role, target_edge, target_lanes) with edge, lanes and error.

    Lanes that are asked for stand, and their edge with them; then an edge that is asked for, with all its lanes; rain falls
    on a corridor of two edges, the eastern or western one where it is asked for at A or B from North or South, and has no
    edge of its own; all else is resolved by node and direction (North if none): an incoming approach is the link that
    ends there, or the approach; a downstream exit is the link that leaves the node opposite, or the edge back out of that
    approach. What cannot be: an unknown type, role or node gives an error and no lanes, and the row stays.

    ``links`` (edge, up, dn, up_direction, dn_direction) and ``approaches`` (node_id, direction, edge) are the road
    network's, of a few rows whatever the requests; they are broadcast if they are.
    """
    r = requests.withColumn("_direction", F.coalesce("direction", F.lit("North")))
    opposite = F.element_at(F.create_map(*[F.lit(x) for pair in OPPOSITE.items() for x in pair]), F.col("_direction"))
    ends = links.select(F.col("dn").alias("_n1"), F.col("dn_direction").alias("_d1"), F.col("edge").alias("_in"))
    leaves = links.select(F.col("up").alias("_n2"), F.col("up_direction").alias("_d2"), F.col("edge").alias("_out"))
    near = approaches.select(F.col("node_id").alias("_n3"), F.col("direction").alias("_d3"), F.col("edge").alias("_approach")).distinct()
    far = near.select(F.col("_n3").alias("_n4"), F.col("_d3").alias("_d4"), F.concat(F.substring("_approach", 3, 2), F.substring("_approach", 1, 2)).alias("_back"))
    j = r.withColumn("_opposite", opposite)
    for side, node, direction, at in ((ends, "_n1", "_d1", "_direction"), (leaves, "_n2", "_d2", "_opposite"), (near, "_n3", "_d3", "_direction"), (far, "_n4", "_d4", "_opposite")):
        j = j.join(sized(side), (F.col("node_id") == F.col(node)) & (F.col(at) == F.col(direction)), "left")
    incoming = F.coalesce("_in", "_approach")
    resolved = F.when(F.col("role") == "downstream_exit", F.coalesce("_out", "_back", "_approach")).otherwise(incoming)
    error = F.when(~F.coalesce(F.col("overlay_type").isin(*TYPES), F.lit(False)), "type").when(F.col("role").isNotNull() & ~F.col("role").isin(*ROLES), "role")
    error = error.when(~F.coalesce(F.col("node_id").isin(*P.NODES), F.lit(False)), "node")
    asked = F.size(F.coalesce("target_lanes", F.array().cast("array<string>"))) > 0
    rain = F.col("overlay_type") == "heavy_rain"
    corridor = F.lit(None).cast("array<string>")
    for node in ("A", "B"):
        corridor = F.when((F.col("node_id") == node) & F.col("direction").isin("North", "South"), F.array(*[F.lit(e) for e in RAIN[node]])).otherwise(corridor)
    corridor = F.coalesce(corridor, F.array(*[F.lit(e) for e in RAIN["default"]]))
    edge = F.when(asked, F.coalesce("target_edge", F.regexp_replace(F.get("target_lanes", F.lit(0)), "_[^_]*$", ""))).when(F.col("target_edge").isNotNull(), F.col("target_edge")).when(rain, None).otherwise(resolved)
    of = lambda edges: F.flatten(F.transform(edges, lambda e: F.array(*[F.concat(e, F.lit(f"_{i}")) for i in range(LANES)])))
    lanes = F.when(asked, F.col("target_lanes")).when(F.col("target_edge").isNull() & rain, of(corridor)).otherwise(of(F.array(edge)))
    none = lambda x: F.when(error.isNull(), x)
    return j.select(*requests.columns, none(edge).alias("edge"), none(lanes).alias("lanes"), error.alias("error"))


def emergency_status(inserted: DataFrame, sightings: DataFrame, ticks: DataFrame) -> DataFrame:
    """(vehicle_id, node_id, inserted_s, seen_on_approach, cleared, cleared_s) of each inserted emergency vehicle (run_id, vehicle_id, node_id, inserted_s).

    ``sightings`` (run_id, vehicle_id, node_id, on_approach, tick_s), ``ticks`` (run_id, tick_s) the times at which the run
    looked. A vehicle is cleared at the first tick after its insertion at which it is not sighted, and no longer followed
    from then on; it was seen if a sighting before that is on an approach of its target node.
    """
    after = inserted.join(ticks, "run_id").filter("tick_s > inserted_s")
    own = sightings.groupBy("run_id", "vehicle_id", "tick_s").agg(F.collect_set(F.when(F.col("on_approach"), F.col("node_id"))).alias("_at"))  # a vehicle is at a few nodes at once at most
    keys = ["run_id", "vehicle_id", "node_id", "inserted_s"]
    looked = after.join(own, ["run_id", "vehicle_id", "tick_s"], "left")
    gone = looked.groupBy(*keys).agg(F.min(F.when(F.col("_at").isNull(), F.col("tick_s"))).alias("cleared_s"))
    met = looked.filter("_at IS NOT NULL").join(gone.select(*keys, "cleared_s"), keys).filter("cleared_s IS NULL OR tick_s < cleared_s")
    seen = met.groupBy(*keys).agg(F.bool_or(F.array_contains("_at", F.col("node_id"))).alias("seen_on_approach"))
    out = inserted.select(*keys).join(gone, keys, "left").join(seen, keys, "left")
    return out.select(*keys, F.coalesce("seen_on_approach", F.lit(False)).alias("seen_on_approach"), F.col("cleared_s").isNotNull().alias("cleared"), "cleared_s")


def source_counters(ticks: DataFrame, source: str, t: str) -> DataFrame:
    """(source, scheduled, inserted, failed, pending) of each source from the ticks of ``scans.token_bucket``; pending as the last tick leaves it."""
    return ticks.groupBy(source).agg(F.max("total_scheduled").alias("scheduled"), F.sum("served").alias("inserted"), F.sum("failed").alias("failed"), F.max_by("pending", t).alias("pending"))


def node_snapshots(nodes: DataFrame, directions: DataFrame, active: DataFrame, causes: DataFrame, most: int = 200) -> DataFrame:
    """(run_id, node_id, obs_t, directions, aggregate_traffic_state, derived_phenomena, operational_state, active_overlay_ids, probable_causes): the state of a node as its readers get it.

    ``nodes``: run_id, node_id, obs_t, state and the flags spillback_active, spillback_risk, box_blocked; ``directions``: state,
    queue_length_m, pcu_equivalent by direction; ``active``: overlays in force (overlay_id, overlay_type); ``causes``: cause_type,
    source_node, observed_to_s, event_id, overlay_id, told in that order of time, ``most`` a node at most. A node without
    overlays or causes has empty lists and false flags.
    """
    keys = ["run_id", "node_id", "obs_t"]
    side = F.struct(F.col("state").alias("traffic_state"), "queue_length_m", F.col("pcu_equivalent").alias("pcu"))
    d = directions.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("direction", side)))).alias("directions"))  # four a node
    kind = lambda *names: F.bool_or(F.col("overlay_type").isin(*names))
    # overlays in force at one node and time are few; what a node has of causes is cut to the interface's length
    o = active.groupBy(*keys).agg(F.sort_array(F.collect_set("overlay_id")).alias("active_overlay_ids"), kind("accident", "blocked_intersection").alias("incident_active"), kind("downstream_restriction").alias("downstream_restriction_active"), kind("emergency").alias("emergency_preemption_active"))
    order = ["observed_to_s", "event_id", "overlay_id"]
    first = causes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most)
    c = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "cause_type", "source_node"))), lambda x: F.struct(x["cause_type"].alias("type"), x["source_node"].alias("source_node"))).alias("probable_causes"))
    n = nodes.join(d, keys, "left").join(o, keys, "left").join(c, keys, "left")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return n.select(
        *keys, "directions", F.col("state").alias("aggregate_traffic_state"), F.struct(flag("spillback_active"), flag("spillback_risk"), flag("box_blocked")).alias("derived_phenomena"),
        F.struct(flag("incident_active"), flag("downstream_restriction_active"), flag("emergency_preemption_active")).alias("operational_state"),
        F.coalesce("active_overlay_ids", F.array().cast(n.schema["active_overlay_ids"].dataType)).alias("active_overlay_ids"), F.coalesce("probable_causes", F.array().cast(n.schema["probable_causes"].dataType)).alias("probable_causes"),
    )

"""Queries on node snapshots, overlays, emergency vehicles, trips and network gates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideway import params as P
from tideway.operators import context as C
from tideway.operators import entities as E
from tideway.operators import history as H
from tideway.operators import observation as O
from tideway.operators import overlays as L
from tideway.operators import quality as Q
from tideway.operators import trips as T
from tideway.operators.scans import written
from tideway.functions import metrics as M
from tideway.functions import text as X
from tideway.plans import network
from tideway.plans.network import table
from tideway.plans.traffic import CAUSES, LINKS_SQL, NODE_STATE, OVERLAYS, QUEUE, RATIO, STATE, V, VR, G, AGES, cause_readings, overlays, states
from tideway.sources.events import detector_obs, vehicle_obs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""{VR}, {QUEUE}, {NODE_STATE}, {OVERLAYS}, {LINKS_SQL}, {CAUSES},
pp AS (SELECT run_id, node_id, obs_t, round_even(avg({RATIO}), 3) AS pressure, bool_or({RATIO} >= 0.85) AS edge_full FROM v GROUP BY ALL),
dd AS (SELECT run_id, node_id, obs_t, string_agg(direction || ':' || {STATE} || ':' || round(queue_length_m * 10)::INT || ':' || round(pcu_equivalent * 100)::INT, '|' ORDER BY direction) AS directions FROM r JOIN qq USING ({G}) GROUP BY ALL),
ao AS (SELECT t.run_id, t.node_id, t.obs_t, string_agg(overlay_id::VARCHAR, ',' ORDER BY overlay_id) AS ids, bool_or(overlay_type IN ('accident', 'blocked_intersection')) AS i, bool_or(overlay_type = 'downstream_restriction') AS d, bool_or(overlay_type = 'emergency') AS e
  FROM (SELECT DISTINCT run_id, node_id, obs_t FROM v) t JOIN ov ON ov.run_id = t.run_id AND ov.node_id = t.node_id AND created_at_s <= t.obs_t AND (expires_at_s IS NULL OR t.obs_t < expires_at_s) GROUP BY ALL),
cn AS (SELECT run_id, affected_node AS node_id, floor(observed_to_s / 86400) * 86400 AS obs_t, cause_type || '@' || source_node AS c, row_number() OVER (PARTITION BY run_id, affected_node, floor(observed_to_s / 86400) ORDER BY observed_to_s, event_id, overlay_id) AS n FROM cs),
ca AS (SELECT run_id, node_id, obs_t, string_agg(c, ',' ORDER BY n) AS causes FROM cn WHERE n <= 200 GROUP BY ALL)
SELECT run_id, node_id, obs_t, directions, ns.state AS aggregate_traffic_state, edge_full AS spillback_active, NOT edge_full AND pressure >= 0.7 AS spillback_risk, edge_full AS box_blocked, coalesce(i, false) AS incident_active, coalesce(d, false) AS downstream_restriction_active,
coalesce(e, false) AS emergency_preemption_active, coalesce(ids, '') AS active_overlay_ids, coalesce(causes, '') AS probable_causes
FROM ns JOIN pp USING (run_id, node_id, obs_t) JOIN dd USING (run_id, node_id, obs_t) LEFT JOIN ao USING (run_id, node_id, obs_t) LEFT JOIN ca USING (run_id, node_id, obs_t)""")
def node_snapshots(spark, sf_dir):
    directions = states(spark, sf_dir)
    pressure = O.outbound_pressure(detector_obs(spark, sf_dir))
    flags = M.phenomena(F.col("pressure"), F.col("edge_full"), F.lit(False), F.col("edge_full"))
    nodes = C.node_state(directions).join(pressure.select(*C.NODE, *[c.alias(n) for n, c in flags.items()]), C.NODE)
    times = vehicle_obs(spark, sf_dir).select("run_id", F.col("obs_t").alias("t")).distinct()
    active = C.active_overlays(overlays(spark, sf_dir), times).withColumnRenamed("t", "obs_t")
    readings = written(cause_readings(spark, sf_dir).withColumn("node_id", F.col("affected_node")), "causes")
    found = C.first_causes(overlays(spark, sf_dir), P.links(spark), readings, C.NODE, 200, *AGES[1:]).withColumnRenamed("sim_t", "observed_to_s")
    s = L.node_snapshots(nodes, directions, active, found)
    side = lambda e: F.concat_ws(":", e["key"], e["value"]["traffic_state"], F.round(e["value"]["queue_length_m"] * 10).cast("int").cast("string"), F.round(e["value"]["pcu"] * 100).cast("int").cast("string"))
    return s.select(
        *C.NODE, F.array_join(F.transform(F.array_sort(F.map_entries("directions")), side), "|").alias("directions"), "aggregate_traffic_state", "derived_phenomena.*", "operational_state.*",
        F.array_join(F.transform("active_overlay_ids", lambda x: x.cast("string")), ",").alias("active_overlay_ids"), F.array_join(F.transform("probable_causes", lambda x: F.concat_ws("@", x["type"], x["source_node"])), ",").alias("probable_causes"),
    )


EDGES_SQL = "le(edge, up, dn, up_d, dn_d) AS (VALUES " + ", ".join(f"('{e}', '{u}', '{d}', '{a}', '{b}')" for _, e, u, d, a, b in P.LINKS) + "), ae(node, d, e) AS (VALUES " + ", ".join(f"('{n}', '{d}', '{e}')" for n, t in P.NODE_TLS.items() for d, e in P.APPROACHES[t].items()) + ")"
ASKED = ("heavy_rain", "accident", "downstream_restriction", "emergency", "blocked_intersection", "fog")


@query(f"""{V}, {EDGES_SQL}, q AS (SELECT event_id, {list(ASKED)}[(k % 6)::INT + 1] AS overlay_type, CASE WHEN k % 17 = 3 THEN 'Z' ELSE node_id END AS node_id, CASE WHEN k % 7 > 0 THEN direction END AS direction, CASE event_id % 4 WHEN 0 THEN 'incoming_approach' WHEN 1 THEN 'downstream_exit' WHEN 2 THEN NULL ELSE CASE WHEN k % 5 = 0 THEN 'sideways' ELSE 'downstream_exit' END END AS role,
  CASE WHEN k % 11 = 0 THEN 'J2J4' END AS te, CASE WHEN k % 13 = 0 THEN ['J3J4_1', 'J3J4_0'] END AS tl FROM v),
x AS (SELECT *, coalesce(direction, 'North') AS d, CASE coalesce(direction, 'North') WHEN 'North' THEN 'South' WHEN 'South' THEN 'North' WHEN 'East' THEN 'West' ELSE 'East' END AS o FROM q),
y AS (SELECT x.*, a.edge AS i1, b.edge AS o1, c.e AS ap, substr(f.e, 3, 2) || substr(f.e, 1, 2) AS back FROM x LEFT JOIN le a ON a.dn = node_id AND a.dn_d = d LEFT JOIN le b ON b.up = node_id AND b.up_d = o LEFT JOIN ae c ON c.node = node_id AND c.d = x.d LEFT JOIN ae f ON f.node = node_id AND f.d = o),
z AS (SELECT event_id, overlay_type, role, CASE WHEN overlay_type = 'fog' THEN 'type' WHEN role = 'sideways' THEN 'role' WHEN node_id = 'Z' THEN 'node' END AS error,
  CASE WHEN tl IS NOT NULL THEN coalesce(te, 'J3J4') WHEN te IS NOT NULL THEN te WHEN overlay_type = 'heavy_rain' THEN NULL WHEN role = 'downstream_exit' THEN coalesce(o1, back, ap) ELSE coalesce(i1, ap) END AS edge, tl, te,
  CASE WHEN node_id = 'A' AND direction IN ('North', 'South') THEN ['J1J3', 'J3J1'] WHEN node_id = 'B' AND direction IN ('North', 'South') THEN ['J2J4', 'J4J2'] ELSE ['J3J4', 'J4J3'] END AS rain FROM y)
SELECT event_id, CASE WHEN error IS NULL THEN edge END AS edge, CASE WHEN error IS NULL THEN array_to_string(CASE WHEN tl IS NOT NULL THEN tl WHEN te IS NULL AND overlay_type = 'heavy_rain' THEN [rain[1] || '_0', rain[1] || '_1', rain[1] || '_2', rain[2] || '_0', rain[2] || '_1', rain[2] || '_2'] ELSE [edge || '_0', edge || '_1', edge || '_2'] END, ',') END AS lanes, error FROM z""")
def requested_overlays(spark, sf_dir):
    k, e = F.col("k"), F.col("event_id") % 4
    kind = F.element_at(F.array(*[F.lit(x) for x in ASKED]), k % 6 + 1)
    role = F.when(e == 0, "incoming_approach").when(e == 1, "downstream_exit").when(e == 3, F.when(k % 5 == 0, "sideways").otherwise("downstream_exit"))
    lanes = F.when(k % 13 == 0, F.array(F.lit("J3J4_1"), F.lit("J3J4_0")))
    asked = vehicle_obs(spark, sf_dir).select("event_id", kind.alias("overlay_type"), F.when(k % 17 == 3, "Z").otherwise(F.col("node_id")).alias("node_id"), F.when(k % 7 > 0, F.col("direction")).alias("direction"), role.alias("role"), F.when(k % 11 == 0, "J2J4").alias("target_edge"), lanes.alias("target_lanes"))
    approaches = P.approaches(spark).select("node_id", "direction", "edge").distinct()
    return L.requested_overlays(asked, P.links(spark), approaches).select("event_id", "edge", F.array_join("lanes", ",").alias("lanes"), "error")


@query(f"""{VR}, n AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY sim_t, event_id) AS rn FROM v WHERE vtype = 'truck'),
t AS (SELECT run_id, vehicle_id, node_id, sim_t, rn, sim_t AS last, true AS kept FROM n WHERE rn = 1 UNION ALL SELECT n.run_id, n.vehicle_id, n.node_id, n.sim_t, n.rn, CASE WHEN n.sim_t - t.last >= 90000 THEN n.sim_t ELSE t.last END, n.sim_t - t.last >= 90000 FROM n JOIN t ON n.node_id = t.node_id AND n.rn = t.rn + 1),
i AS (SELECT run_id, vehicle_id, node_id, sim_t AS inserted_s FROM t WHERE kept),
k AS (SELECT DISTINCT run_id, obs_t FROM v),
l AS (SELECT i.*, k.obs_t AS tick, (SELECT count(*) FROM v WHERE v.vehicle_id = i.vehicle_id AND v.run_id = i.run_id AND v.obs_t = k.obs_t) AS n, (SELECT count(*) FROM v WHERE v.vehicle_id = i.vehicle_id AND v.run_id = i.run_id AND v.obs_t = k.obs_t AND v.node_id = i.node_id AND v.lane_pos_m / v.lane_length_m >= 0.5) AS near FROM i JOIN k ON i.run_id = k.run_id AND k.obs_t > inserted_s),
g AS (SELECT run_id, vehicle_id, node_id, inserted_s, min(tick) FILTER (n = 0) AS cleared_s FROM l GROUP BY ALL)
SELECT i.vehicle_id, i.node_id, i.inserted_s, coalesce((SELECT bool_or(near > 0) FROM l WHERE l.vehicle_id = i.vehicle_id AND l.node_id = i.node_id AND l.inserted_s = i.inserted_s AND n > 0 AND (g.cleared_s IS NULL OR tick < g.cleared_s)), false) AS seen_on_approach, g.cleared_s IS NOT NULL AS cleared, g.cleared_s
FROM i LEFT JOIN g USING (run_id, vehicle_id, node_id, inserted_s)""")
def emergency_followed(spark, sf_dir):
    """Trucks stand for emergency vehicles: one a node at most in 90,000 s, followed until a day on which nobody sees it."""
    v = vehicle_obs(spark, sf_dir)
    trucks = v.filter("vtype = 'truck'").select("run_id", "vehicle_id", "node_id", "event_id", "sim_t")
    inserted = H.cadence(trucks, ["node_id"], "sim_t", 90000.0).select("run_id", "vehicle_id", "node_id", F.col("sim_t").alias("inserted_s"))
    sightings = v.select("run_id", "vehicle_id", "node_id", (F.col("lane_pos_m") / F.col("lane_length_m") >= 0.5).alias("on_approach"), F.col("obs_t").alias("tick_s"))
    return L.emergency_status(inserted, sightings, sightings.select("run_id", "tick_s").distinct()).drop("run_id")


@query(f"WITH tb AS ({network.ORACLES['token_bucket']}) SELECT source, max(total_scheduled)::BIGINT AS scheduled, sum(served)::BIGINT AS inserted, sum(failed)::BIGINT AS failed, arg_max(pending, day) AS pending FROM tb GROUP BY source")
def source_counters(spark, sf_dir):
    return L.source_counters(network.token_bucket(spark, sf_dir), "source", "day")


@query("""SELECT c_custkey, '{"name":{"type":"Property","value":"' || c_name || '"},"balance":{"type":"Property","value":' || c_nationkey || '}}' AS body FROM customer""")
def update_bodies(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    prop = lambda x: F.struct(F.lit("Property").alias("type"), x.alias("value"))
    doc = F.to_json(F.struct(X.to_urn("Camera", F.col("c_custkey").cast("string")).alias("id"), prop(F.col("c_name")).alias("name"), F.lit("Camera").alias("type"), prop(F.col("c_nationkey")).alias("balance")))
    return c.select("c_custkey", E.attributes_only(doc).alias("body"))


@query("""WITH l AS (SELECT p_brand AS network, 'e' || p_size AS edge, p_partkey % 2 = 0 AS internal, 'l' || p_partkey AS lane_id, p_size * 12.0::DOUBLE AS length_m, CASE WHEN p_partkey % 50 = 0 THEN 13.0::DOUBLE ELSE 15.0 END AS speed_ms FROM part),
q AS (SELECT DISTINCT network, 'e' || n AS edge FROM l, (SELECT unnest(range(2, 52)) AS n)), h AS (SELECT DISTINCT network, edge FROM l), m AS (SELECT network, min(length_m) FILTER (internal) AS i, min(length_m) FILTER (NOT internal) AS e FROM l GROUP BY ALL)
SELECT network, 'missing_edge' AS rule, edge AS subject, NULL::DOUBLE AS value FROM (SELECT * FROM q EXCEPT SELECT * FROM h) UNION ALL SELECT network, 'unexpected_edge', edge, NULL FROM (SELECT * FROM h EXCEPT SELECT * FROM q)
UNION ALL SELECT network, 'speed', lane_id, speed_ms FROM l WHERE speed_ms <> 15 UNION ALL SELECT network, 'no_internal', NULL, NULL FROM m WHERE i IS NULL
UNION ALL SELECT network, 'length_internal', NULL, i FROM m WHERE i < 450 UNION ALL SELECT network, 'free_flow_internal', NULL, round_even(i / 15, 2) FROM m WHERE i / 15 < 30
UNION ALL SELECT network, 'length_external', NULL, e FROM m WHERE e < 250 UNION ALL SELECT network, 'free_flow_external', NULL, round_even(e / 15, 2) FROM m WHERE e / 15 < 18""")
def network_gate(spark, sf_dir):
    """Parts are lanes of their brand's network, which needs edges e2 to e51."""
    p = table(spark, sf_dir, "part")
    lanes = p.select(F.col("p_brand").alias("network"), F.format_string("e%d", "p_size").alias("edge"), (F.col("p_partkey") % 2 == 0).alias("internal"), F.format_string("l%d", "p_partkey").alias("lane_id"), (F.col("p_size") * 12.0).alias("length_m"), F.when(F.col("p_partkey") % 50 == 0, 13.0).otherwise(15.0).alias("speed_ms"))
    required = lanes.select("network").distinct().select("network", F.explode(F.array(*[F.lit(f"e{n}") for n in range(2, 52)])).alias("edge"))
    return Q.network_gate(lanes, required, 15.0)


@query(f"""{V}, a AS (SELECT *, round(sim_t * 1000000)::BIGINT AS us, round(lane_pos_m * 1000)::BIGINT AS mm, CASE WHEN speed_ms < 1 THEN 'WAITING' ELSE 'MOVING' END AS state FROM v),
b AS (SELECT *, lead(us) OVER w - us AS dt, lag(node_id) OVER w AS pn, lag(mm) OVER w AS pm, lag(state) OVER w AS ps FROM a WINDOW w AS (PARTITION BY vehicle_id ORDER BY sim_t, event_id)),
n AS (SELECT vehicle_id, direction AS node, coalesce(sum(dt), 0) AS us FROM b GROUP BY ALL), sg AS (SELECT vehicle_id, string_agg(node || '=' || round_even(round_even(us / 1000000.0::DOUBLE, 2), 0)::BIGINT, ',' ORDER BY node) AS segments FROM n GROUP BY ALL),
c AS (SELECT *, lag(direction) OVER w AS pd FROM b WINDOW w AS (PARTITION BY vehicle_id ORDER BY sim_t, event_id)),
f AS (SELECT vehicle_id, direction, min((sim_t, event_id)) AS first FROM a GROUP BY ALL), o AS (SELECT vehicle_id, string_agg(direction, '>' ORDER BY first) AS visited FROM f GROUP BY ALL)
SELECT vehicle_id, round_even(coalesce(sum(dt), 0) / 1000000.0::DOUBLE, 1) AS total_travel_time_sec, round_even(coalesce(sum(dt) FILTER (state = 'WAITING'), 0) / 1000000.0::DOUBLE, 1) AS total_waiting_time_sec,
round_even(sum(CASE WHEN pd IS NULL THEN 0 WHEN pd = direction THEN greatest(0, mm - pm) ELSE mm END) / 1000.0::DOUBLE, 1) AS distance_traveled_m, count(*) FILTER (state = 'WAITING' AND coalesce(ps, '') <> 'WAITING') AS stop_count, any_value(visited) AS visited, any_value(segments) AS segments FROM c JOIN sg USING (vehicle_id) JOIN o USING (vehicle_id) GROUP BY vehicle_id""")
def trip_records(spark, sf_dir):
    """Each vehicle's readings are one trip; the direction that it comes from stands for the node, as its node never changes."""
    state = F.when(F.col("speed_ms") < 1, "WAITING").otherwise("MOVING")
    r = vehicle_obs(spark, sf_dir).select("vehicle_id", "event_id", "sim_t", F.col("direction").alias("node_id"), "lane_pos_m", state.alias("state"))
    t = T.trip_records(r, ["vehicle_id"])
    told = F.array_join(F.transform(F.array_sort(F.map_entries("segment_travel_times")), lambda e: F.concat(e["key"], F.lit("="), F.bround(e["value"], 0).cast("long").cast("string"))), ",")
    return t.select("vehicle_id", "total_travel_time_sec", "total_waiting_time_sec", "distance_traveled_m", "stop_count", F.array_join("intersections_visited", ">").alias("visited"), told.alias("segments"))

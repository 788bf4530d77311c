"""Queries on entities, identifiers, quality, graph and demand, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway import params as P
from tideway.functions import metrics as M
from tideway.functions import text as X
from tideway.operators import entities as E
from tideway.operators import history as H
from tideway.operators import quality as Q
from tideway.operators.scans import written
from tideway.operators import observation as O
from tideway.plans.traffic import CAUSES, COLOR, DAY, FIRST_CAUSES, LINKS_SQL, VR, first_causes, G, NODE_LOAD, NODE_SQL, NODE_STATE, OVERLAYS, QUEUE, RATIO, STATE, STATUS, V, overlays, rollup, seen, states
from tideway.operators import context as C
from tideway.sources import files
from tideway.sources.events import EPOCH, detector_obs, vehicle_obs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def entity_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities of all node snapshots of the adapter; the vehicles seen are read and parsed once, for all measures."""
    vehicles = written(seen(spark, sf_dir), "seen")
    r = O.direction_rollup(vehicles)
    stamp = lambda d: d.withColumn("scenario", F.lit("normal")).withColumn("sim_t", F.col("obs_t"))
    load = F.when(F.col("pcu_equivalent") < 15, "LIGHT").when(F.col("pcu_equivalent") < 35, "MODERATE").otherwise("HEAVY")
    phase = F.floor(F.col("obs_t") / DAY) % 4
    meta = spark.createDataFrame([(n, *v) for n, v in P.NODES.items()], "node_id string, node_name string, lat double, lng double")
    pressures = O.outbound_pressure(detector_obs(spark, sf_dir))
    flags = M.phenomena(F.col("pressure"), F.col("edge_full"), F.lit(False), F.col("edge_full"))
    spill = pressures.select(*C.NODE, *[c.alias(name) for name, c in flags.items()])
    density = M.density_pcu_km(F.col("pcu_equivalent"), F.lit(470.0))
    queue = O.queue_by_movement(vehicles).drop("waiting", "queue_vehicles")
    d = r.join(queue, O.GRAIN).join(O.occupancy(detector_obs(spark, sf_dir)), O.GRAIN).join(spill.select(*C.NODE, "spillback_risk"), C.NODE).join(meta, "node_id")
    d = d.withColumn("traffic_status", load).withColumn("state", M.traffic_state(F.col("pcu_equivalent"), F.col("queue_length_m"))).withColumn("theoretical_speed_kmh", F.bround(M.greenshields(density), 1))
    d = d.withColumn("phase_index", phase.cast("int")).join(P.phases(spark), ["phase_index", "direction"])
    arrived = O.arrival_rate(O.arrivals(vehicles)).select(*O.GRAIN, O.per_second(F.col("arrival_pcu_per_h")).alias("arrival_pcu_per_s"))
    why = O.waiting_reasons(r.withColumn("phase_index", phase.cast("int")), P.phases(spark))
    counts = F.map_filter(F.create_map(F.lit("CONGESTION"), "congestion", F.lit("RED_PHASE"), "red_phase"), lambda k, n: n > 0)
    why = why.select(*O.GRAIN, "dominant_waiting_reason", counts.alias("waiting_reason_counts"))
    d = d.join(arrived, O.GRAIN, "left").join(why, O.GRAIN).join(O.composition_map(vehicles), O.GRAIN)
    d = d.withColumn("operational_state", F.when(F.col("spillback_risk"), "RESTRICTED").otherwise("NORMAL")).withColumn("observed_at", F.date_format(F.timestamp_seconds(F.col("obs_t") + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    d = stamp(d).withColumn("green_s", F.when(F.col("pcu_equivalent") >= 35, 60).otherwise(0)).withColumn("yellow_s", F.lit(None).cast("int"))
    names = F.element_at(F.array(*[F.lit(x) for x in P.PHASES]), (phase + 1).cast("int"))
    incident = C.active_overlays(overlays(spark, sf_dir), r.select("run_id", F.col("obs_t").alias("t")).distinct()).filter(F.col("overlay_type").isin("accident", "blocked_intersection"))
    incident = incident.select("run_id", "node_id", F.col("t").alias("obs_t"), F.lit(True).alias("incident")).distinct()
    n = stamp(C.node_rollup(r)).join(meta, "node_id").join(C.node_state(states(spark, sf_dir)), C.NODE).join(spill, C.NODE).join(incident, C.NODE, "left").join(first_causes(spark, sf_dir), C.NODE, "left").withColumn("phase", names)
    return E.fan_out(n, d)


NODES_SQL = "nn(node_id, node_name, latitude) AS (VALUES " + ", ".join(f"('{k}', '{v[0]}', {v[1]}::DOUBLE)" for k, v in P.NODES.items()) + ")"
SPILL_SQL = f"pp AS (SELECT run_id, node_id, obs_t, round_even(avg({RATIO}), 3) AS pressure, bool_or({RATIO} >= 0.85) AS full_edge FROM v GROUP BY ALL)"
INCIDENT_SQL = f"{OVERLAYS}, ic AS (SELECT DISTINCT t.run_id, ov.node_id, t.obs_t FROM (SELECT DISTINCT run_id, obs_t FROM v) t JOIN ov ON created_at_s <= t.obs_t AND (expires_at_s IS NULL OR t.obs_t < expires_at_s) WHERE overlay_type IN ('accident', 'blocked_intersection'))"


@query(f"""{V}, {QUEUE}, {NODES_SQL}, {SPILL_SQL}, oc AS (SELECT {G}, round_even(avg(greatest(0, least(100, CASE WHEN k / 40.0::DOUBLE <= 1 THEN k / 40.0::DOUBLE * 100 ELSE k / 40.0::DOUBLE END))), 1) AS occupancy_rate FROM v GROUP BY ALL),
ti AS (SELECT run_id, obs_t, row_number() OVER w AS i, obs_t - lag(obs_t) OVER w AS dt FROM (SELECT DISTINCT run_id, obs_t FROM s) WINDOW w AS (PARTITION BY run_id ORDER BY obs_t)),
ne AS (SELECT a.*, ti.dt FROM s a JOIN ti USING (run_id, obs_t) WHERE NOT EXISTS (SELECT 1 FROM s b JOIN ti u USING (run_id, obs_t) WHERE b.node_id = a.node_id AND b.direction = a.direction AND b.vehicle_id = a.vehicle_id AND u.i = ti.i - 1)),
ar AS (SELECT {G}, round_even(round(round_even(sum(round(pcu * 100)::BIGINT)::DOUBLE / 100.0 / max(dt) * 3600, 3) * 1000) * 5 / 18, 0) / 1000000 AS arrival_rate FROM ne WHERE dt IS NOT NULL GROUP BY ALL),
cc AS (SELECT {G}, vtype, round_even(count(*) * 10000 / sum(count(*)) OVER (PARTITION BY {G}), 0) / 10000 AS share FROM s GROUP BY {G}, vtype), cm AS (SELECT {G}, string_agg(vtype || '=' || round(share * 10000)::INT, ',' ORDER BY vtype) AS composition FROM cc GROUP BY {G}),
wr AS (SELECT {G}, {COLOR} AS color, waiting_vehicle_count AS wn FROM (SELECT *, (floor(obs_t / 86400)::BIGINT % 4)::INT AS i FROM r)),
a AS (SELECT r.*, upper(direction) || 'BOUND' AS b, queue_length_m, arrival_rate, composition, CASE WHEN wn > 0 THEN CASE WHEN color = 'green' THEN 'CONGESTION' ELSE 'RED_PHASE' END END AS why, wn, queue_left, queue_straight, queue_right, occupancy_rate, node_name, latitude, NOT full_edge AND pressure >= 0.7 AS spillback_risk, {STATE} AS state
  FROM r JOIN qq USING ({G}) JOIN oc USING ({G}) JOIN pp USING (run_id, node_id, obs_t) JOIN nn USING (node_id) LEFT JOIN ar USING ({G}) JOIN cm USING ({G}) JOIN wr USING ({G}))
SELECT 'urn:ngsi-ld:VehicleSensor:' || node_id || ':' || b AS id, node_id || ':' || b AS sensor, b AS traffic_direction, vehicle_count::INT AS vehicle_count, pcu_equivalent, average_speed_kmh AS average_speed, waiting_vehicle_count::INT AS waiting_vehicle_count,
CASE WHEN pcu_equivalent < 15 THEN 'LIGHT' WHEN pcu_equivalent < 35 THEN 'MODERATE' ELSE 'HEAVY' END AS traffic_status, node_name || ' ' || b || ' approach' AS name, left_count::INT AS left_count, straight_count::INT AS straight_count, right_count::INT AS right_count,
queue_length_m AS queue_length, queue_straight, queue_left, queue_right, occupancy_rate, round_even(greatest(0, 50.0::DOUBLE * (1 - greatest(0, least(1, pcu_equivalent / 470.0 * 1000 / 200.0)))), 1) AS theoretical_speed, arrival_rate, why AS dominant_waiting_reason, CASE WHEN why IS NULL THEN '' ELSE why || '=' || wn END AS waiting_reason_counts, composition, CASE WHEN spillback_risk THEN 'RESTRICTED' ELSE 'NORMAL' END AS operational_state,
strftime(make_timestamp(((obs_t + 1704067200) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS date_observed, state, spillback_risk, latitude,
'urn:ngsi-ld:TrafficLight:' || node_id || '-' || direction AS ref_light, 'urn:ngsi-ld:Camera:' || node_id AS ref_camera, 'urn:ngsi-ld:Intersection:' || node_id AS ref_intersection, obs_t AS simulation_time, run_id FROM a""")
def sensor_entities(spark, sf_dir):
    f = E.flatten_sensor(entity_docs(spark, sf_dir))
    told = lambda c, n: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * n).cast("int").cast("string"))), ",")  # noqa: E731  maps as text, for the comparison
    return f.withColumns({"composition": told("composition", 10000), "waiting_reason_counts": told("waiting_reason_counts", 1)})


@query(f"""{VR}, {NODE_SQL}, {QUEUE}, {NODE_STATE}, {NODES_SQL}, {SPILL_SQL}, {INCIDENT_SQL}, {LINKS_SQL}, {CAUSES}, {FIRST_CAUSES} SELECT 'urn:ngsi-ld:Intersection:' || node_id AS id, {STATUS.format(x='(' + NODE_LOAD + ')')} AS overall_traffic_status, vehicle_count::INT AS total_vehicle_count, pcu_equivalent >= 140 AS frequent_congestion, 4 AS lights, 4 AS sensors, 1 AS cameras, node_name AS name,
['NS_GREEN', 'NS_YELLOW', 'EW_GREEN', 'EW_YELLOW'][(floor(obs_t / 86400)::BIGINT % 4)::INT + 1] AS phase, full_edge AS has_spillback, full_edge AS is_box_blocked, ic.node_id IS NOT NULL AS has_active_incident, ns.state AS state,
cause_type, 'urn:ngsi-ld:Intersection:' || cause_node AS affected_by, cause_detected_at, obs_t AS simulation_time, run_id FROM nr JOIN ns USING (run_id, node_id, obs_t) JOIN pp USING (run_id, node_id, obs_t) JOIN nn USING (node_id) LEFT JOIN ic USING (run_id, node_id, obs_t) LEFT JOIN fc USING (run_id, node_id, obs_t)""")
def intersection_entities(spark, sf_dir):
    f = E.flatten_intersection(entity_docs(spark, sf_dir))
    return f.select(*[F.size(c).alias(c) if c in ("lights", "sensors", "cameras") else F.col(c) for c in f.columns])


@query(f"""{V}, {NODES_SQL}, c AS (SELECT *, (floor(obs_t / 86400)::BIGINT % 4)::INT AS i FROM r) SELECT 'urn:ngsi-ld:TrafficLight:' || node_id || '-' || direction AS id, upper(CASE WHEN direction IN ('North', 'South') THEN ['green', 'yellow', 'red', 'red'][i + 1] ELSE ['red', 'red', 'green', 'yellow'][i + 1] END) AS current_status,
['NS_GREEN', 'NS_YELLOW', 'EW_GREEN', 'EW_YELLOW'][i + 1] AS current_phase, CASE WHEN pcu_equivalent >= 35 THEN 60 ELSE 42 END::INT AS green_s, 3::INT AS yellow_s, CASE WHEN pcu_equivalent >= 35 THEN 60 ELSE 42 END::INT AS red_s, 'FIXED_TIME' AS timing_mode, 'OK' AS working_state, node_name || ' ' || upper(direction) || 'BOUND' AS name, 'urn:ngsi-ld:Intersection:' || node_id AS ref_intersection, obs_t AS simulation_time, run_id FROM c JOIN nn USING (node_id)""")
def light_entities(spark, sf_dir):
    return E.flatten_light(entity_docs(spark, sf_dir))


@query(f"""{V}, {NODE_SQL}, {INCIDENT_SQL} SELECT 'urn:ngsi-ld:Camera:' || node_id AS id, vehicle_count::INT AS vehicle_count, average_speed_kmh AS average_speed, 1.0::DOUBLE AS confidence, ic.node_id IS NOT NULL AS incident_detected, 'urn:ngsi-ld:Intersection:' || node_id AS ref_intersection, obs_t AS simulation_time, run_id FROM nr LEFT JOIN ic USING (run_id, node_id, obs_t)""")
def camera_entities(spark, sf_dir):
    return E.flatten_camera(entity_docs(spark, sf_dir))


@query(f"""{V}, c AS (SELECT node_id, obs_t, count(*) AS n FROM r GROUP BY ALL) SELECT node_id, obs_t, n AS sensors, n AS lights, 10 - 2 * (4 - n) AS entities FROM c""")
def entity_fan_out(spark, sf_dir):
    e = entity_docs(spark, sf_dir)
    node = F.substring(X.from_urn(F.col("id")), 1, 1)
    kind = lambda t: F.count_if(F.col("type") == t)
    return e.groupBy(node.alias("node_id"), F.col("sim_t").alias("obs_t")).agg(kind("VehicleSensor").alias("sensors"), kind("TrafficLight").alias("lights"), F.count(F.lit(1)).alias("entities"))


@query("""WITH e AS (SELECT event_id, event_id % 3 AS m, json_extract_string(props, '$.k') AS k, user_id, event_type FROM events)
SELECT event_id, CASE WHEN m = 2 THEN NULL ELSE k END AS k_text, CASE WHEN m = 0 THEN k::DOUBLE END AS k_number, CASE WHEN m = 1 THEN user_id % 2 = 0 END AS flag, CASE WHEN m = 0 THEN event_type ELSE event_type || ',' || user_id END AS refs FROM e""")
def entity_flatten(spark, sf_dir):
    """A document an event: its attribute is a number, a text or missing, its flag a boolean or a text, its reference one or two."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, m, u = F.get_json_object("props", "$.k"), F.col("event_id") % 3, F.col("user_id").cast("string")
    n = F.when(m == 0, F.concat(F.lit('"n": {"type": "Property", "value": '), k, F.lit("}, "))).when(m == 1, F.concat(F.lit('"n": {"type": "Property", "value": "'), k, F.lit('"}, '))).otherwise("")
    flag = F.when(m == 1, F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")).otherwise('"true"')
    refs = F.when(m == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.concat(F.lit('["'), "event_type", F.lit('", "'), u, F.lit('"]')))
    doc = F.concat(F.lit("{"), n, F.lit('"f": {"type": "Property", "value": '), flag, F.lit('}, "r": {"type": "Relationship", "object": '), refs, F.lit("}}"))
    c = F.col("doc")
    return e.select("event_id", doc.alias("doc")).select("event_id", X.attr(c, "n").alias("k_text"), X.number_attr(c, "n").alias("k_number"), X.bool_attr(c, "f").alias("flag"), F.array_join(X.refs_attr(c, "r"), ",").alias("refs"))


@query("""SELECT c_custkey, 'urn:ngsi-ld:VehicleSensor:' || c_name AS urn, c_name AS back, regexp_replace(c_name || '_2', '_[^_]*$', '') AS edge, lower(c_mktsegment) AS segment FROM customer""")
def urn_roundtrip(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    u = X.to_urn("VehicleSensor", F.col("c_name"))
    return c.select("c_custkey", u.alias("urn"), X.from_urn(u).alias("back"), X.lane_edge(F.concat("c_name", F.lit("_2"))).alias("edge"), F.lower("c_mktsegment").alias("segment"))


@query("""WITH d AS (SELECT event_id % 997 AS id, event_id % 3 AS run, event_id % 5 AS t FROM events) SELECT DISTINCT id, run, t FROM d""")
def dedup_notifications(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("event_id") % 997).alias("id"), (F.col("event_id") % 3).alias("run"), (F.col("event_id") % 5).alias("t")).dropDuplicates(["run", "id", "t"])


@query("""WITH p AS (SELECT o_orderkey AS parent, o_orderstatus AS run_id, o_orderpriority AS scenario, o_totalprice AS t FROM orders),
c AS (SELECT l_orderkey AS parent, l_linenumber::VARCHAR AS child, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS run_id, l_quantity FROM lineitem),
i AS (SELECT p.parent, CASE WHEN c.child IS NULL THEN [] WHEN c.run_id IS NULL THEN [c.child || ': missing simulation metadata'] ELSE list_filter([CASE WHEN c.run_id <> p.run_id THEN c.child || ': run' END, CASE WHEN l_quantity > 45 THEN c.child || ': simulationTime' END], lambda x: x IS NOT NULL) END AS i FROM p LEFT JOIN c USING (parent))
SELECT parent, CASE WHEN sum(len(i)) > 0 THEN array_to_string(list_sort(flatten(list(i))), '|') END AS issues FROM i GROUP BY parent""")
def consistency_issues(spark, sf_dir):
    o, l = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = o.select(F.col("o_orderkey").alias("parent"), F.col("o_orderstatus").alias("run_id"), F.lit("s").alias("scenario"), F.lit(0.0).alias("sim_t"))
    c = l.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("string").alias("child"), F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("run_id"), F.lit("s").alias("scenario"), F.when(F.col("l_quantity") > 45, F.lit(1.0)).otherwise(F.lit(0.0)).alias("sim_t"))
    return Q.sibling_issues(p, c).select("parent", F.array_join("issues", "|").alias("issues"))


@query("""SELECT event_id, rule FROM (SELECT event_id, unnest([CASE WHEN NOT value >= 1 THEN 'value_low' END, CASE WHEN NOT lower(event_type) IN ('click', 'view', 'purchase') THEN 'type_enum' END, CASE WHEN NOT json_extract_string(props, '$.k')::INT BETWEEN 5 AND 95 THEN 'k_range' END]) AS rule FROM events) WHERE rule IS NOT NULL""")
def quality_violations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return Q.violations(e, "event_id", {"value_low": F.col("value") >= 1, "type_enum": Q.one_of(F.col("event_type"), ("CLICK", "View", "purchase")), "k_range": k.between(5, 95)})


@query("""WITH h AS (SELECT event_id, ('0x' || substr(md5('42:' || event_type || ':' || event_id), 1, 8))::BIGINT AS h FROM events), r AS (SELECT event_id, (h % 10000) / 10000 AS r, ((h // 10000) % 10000) / 10000 AS r2 FROM h)
SELECT event_id, r::DOUBLE AS r, r2::DOUBLE AS r2, CASE WHEN r <= 0.85 THEN 'motorcycle' WHEN r <= 0.97 THEN 'car' WHEN r <= 0.99 THEN 'bus' ELSE 'truck' END AS vtype FROM r""")
def od_pick(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    r, r2 = X.stable_draws("42", F.col("event_type"), F.col("event_id"))
    return e.select("event_id", r.alias("r"), r2.alias("r2"), X.stable_pick(r, P.CLASS_WEIGHTS).alias("vtype"))


@query("""WITH a AS (SELECT DISTINCT o_custkey * 100000 + l_suppkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey), r AS (SELECT DISTINCT c_custkey * 100000 + s_suppkey AS v FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT v AS value, 'missing' AS problem FROM (SELECT v FROM r EXCEPT SELECT v FROM a) UNION ALL SELECT v, 'unexpected' FROM (SELECT v FROM a EXCEPT SELECT v FROM r)""")
def anti_required(spark, sf_dir):
    """Suppliers that customers have against those of their own nation, that they should have; of all customers and line items."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    had = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey"))
    suppliers = t("supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    return Q.owned_gate(had, t("customer"), suppliers, "c_nationkey", "c_custkey", "s_suppkey", 100000)


@query("""SELECT node_id AS area, count(*) AS checks, CASE WHEN bool_or(s = 'FAIL') THEN 'FAIL' WHEN bool_or(s = 'WARNING') THEN 'WARNING' WHEN bool_or(s = 'NOT_CHECKED') THEN 'NOT_CHECKED' ELSE 'PASS' END AS status FROM (SELECT user_id AS node_id, CASE WHEN value > 95 THEN 'FAIL' WHEN value > 80 THEN 'WARNING' WHEN value < 2 THEN 'NOT_CHECKED' ELSE 'PASS' END AS s FROM events) GROUP BY ALL""")
def health_rollup(spark, sf_dir):
    v = F.col("value")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("area"), F.when(v > 95, "FAIL").when(v > 80, "WARNING").when(v < 2, "NOT_CHECKED").otherwise("PASS").alias("status"))
    return Q.health(e)


@query("""SELECT o_custkey % 50 AS run_id, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey)) AS hash FROM orders GROUP BY 1""")
def content_hashes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 50).alias("run_id"), "o_orderkey")
    return H.ordered_hash(o, ["run_id"], ["o_orderkey"], "o_orderkey")


@query("""WITH k AS (SELECT DISTINCT o_custkey % 50 AS run_id, o_orderkey AS k FROM orders), p AS (SELECT run_id, k // 4096 AS part, sha256(string_agg(k::VARCHAR, chr(10) ORDER BY k)) AS h FROM k GROUP BY ALL)
SELECT run_id, sha256(string_agg(h, chr(10) ORDER BY part)) AS hash FROM p GROUP BY run_id""")
def content_tree_hashes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 50).alias("run_id"), "o_orderkey")
    return H.tree_hash(o, ["run_id"], "o_orderkey")


@query("""WITH e AS (SELECT event_id, event_id % 7 AS m, event_type, user_id, value FROM events) SELECT event_id, CASE WHEN m = 0 THEN 'bad' WHEN m = 1 THEN 'empty' ELSE 'good' END AS kind, CASE WHEN m > 1 THEN event_type END AS id, CASE WHEN m > 1 THEN value END AS q FROM e
UNION ALL SELECT event_id, 'good', 'u' || user_id, NULL FROM e WHERE m > 3""")
def notification_rows(spark, sf_dir):
    """A notification an event: broken, empty, of one entity, or of two."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.col("event_id") % 7
    one = F.concat(F.lit('{"id":"'), "event_type", F.lit('","type":"Camera","q":{"value":'), F.col("value").cast("string"), F.lit("}}"))
    two = F.when(m > 3, F.concat(F.lit(',{"id":"u'), F.col("user_id").cast("string"), F.lit('","type":"Camera"}'))).otherwise("")
    data = F.when(m == 1, "[]").otherwise(F.concat(F.lit("["), one, two, F.lit("]")))
    raw = F.when(m == 0, F.concat(F.lit("{broken "), "event_id")).otherwise(F.concat(F.lit('{"id":"'), "event_id", F.lit('","type":"Notification","subscriptionId":"s","notifiedAt":"t","data":'), data, F.lit("}")))
    parsed = files.notifications(e.select(raw.alias("raw")))
    key = F.coalesce(F.col("notification_id"), F.regexp_extract("bad", r"(\d+)", 1)).cast("bigint")
    kinds = F.when(F.col("bad").isNotNull(), "bad").when(F.col("doc").isNull(), "empty").otherwise("good")
    return parsed.select(key.alias("event_id"), kinds.alias("kind"), F.get_json_object("doc", "$.id").alias("id"), X.number_attr(F.col("doc"), "q").alias("q"))

"""The traffic queries over the ``events`` adapter, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway import params as P
from tideway.functions import metrics as M
from tideway.operators import context as C
from tideway.operators import history as H
from tideway.operators import observation as O
from tideway.operators import trips as T
from tideway.operators.scans import sized
from tideway.sources.events import detector_obs, second_series, vehicle_obs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY, WINDOW = 86400.0, 45000.0  # readings of the adapter are about an hour apart: windows are a thousand times as long


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The adapter in SQL: v as vehicle_obs, s its first sightings with PCU, r the roll-up.
V = """WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, epoch_us(ts) / 1000000.0 - 1704067200 AS sim_t FROM events),
v AS (SELECT 'run-events' AS run_id, substr('ABCD', (user_id % 4)::INT + 1, 1) AS node_id, ['North', 'South', 'East', 'West'][(event_id % 4)::INT + 1] AS direction,
  sim_t::DOUBLE AS sim_t, (floor(sim_t / 86400.0) * 86400.0)::DOUBLE AS obs_t, event_id, user_id::VARCHAR AS vehicle_id,
  CASE event_type WHEN 'click' THEN 'motorcycle' WHEN 'view' THEN 'car' WHEN 'purchase' THEN 'bus' WHEN 'signup' THEN 'truck' ELSE 'unknown_vtype' END AS vtype,
  CASE event_type WHEN 'click' THEN 2.0::DOUBLE WHEN 'view' THEN 4.5 WHEN 'purchase' THEN 12.0 WHEN 'signup' THEN 7.1 ELSE 5.0 END AS length_m,
  k % 3 AS lane_index, k, 472.8::DOUBLE AS lane_length_m, 472.8::DOUBLE * k / 100 AS lane_pos_m, value / 20 AS speed_ms, value AS q FROM e),
s AS (SELECT *, CASE vtype WHEN 'motorcycle' THEN 0.24::DOUBLE WHEN 'car' THEN 1.0 WHEN 'bus' THEN 2.5 WHEN 'truck' THEN 2.5 ELSE 1.0 END AS pcu FROM v
  QUALIFY row_number() OVER (PARTITION BY run_id, node_id, direction, obs_t, vehicle_id ORDER BY lane_index, event_id) = 1),
r AS (SELECT run_id, node_id, direction, obs_t, count(*) AS vehicle_count, round_even(sum(round(pcu * 100)::BIGINT)::DOUBLE / 100.0, 2) AS pcu_equivalent,
  coalesce(round_even(avg(speed_ms * 3.6) FILTER (speed_ms >= 0.1), 1), 0) AS average_speed_kmh, count(*) FILTER (speed_ms < 0.1) AS waiting_vehicle_count,
  count(*) FILTER (lane_index = 2) AS left_count, count(*) FILTER (lane_index = 1) AS straight_count, count(*) FILTER (lane_index = 0) AS right_count FROM s GROUP BY ALL)
"""
G = "run_id, node_id, direction, obs_t"
STATE = "CASE WHEN pcu_equivalent >= 55 OR queue_length_m > 70 THEN 'OVERSATURATED' WHEN pcu_equivalent >= 35 OR queue_length_m > 40 THEN 'CONGESTED' WHEN pcu_equivalent >= 15 OR queue_length_m > 15 THEN 'BUSY' WHEN pcu_equivalent >= 5 THEN 'STABLE' ELSE 'FREE_FLOW' END"
QUEUE = f"""qm AS (SELECT {G}, count(*) FILTER (speed_ms < 0.1) AS waiting, round_even(coalesce(sum(length_m + 1.5) FILTER (speed_ms < 0.1 AND lane_index = 2), 0), 1) AS queue_left,
  round_even(coalesce(sum(length_m + 1.5) FILTER (speed_ms < 0.1 AND lane_index = 1), 0), 1) AS queue_straight, round_even(coalesce(sum(length_m + 1.5) FILTER (speed_ms < 0.1 AND lane_index = 0), 0), 1) AS queue_right FROM s GROUP BY ALL),
qq AS (SELECT *, greatest(queue_left, queue_straight, queue_right) AS queue_length_m FROM qm)"""
LOAD = "CASE WHEN {x} >= 0 AND {x} < {a} THEN 'LOW' WHEN {x} >= {a} AND {x} < {b} THEN 'MEDIUM' ELSE 'HIGH' END"
STATUS = "CASE {x} WHEN 'LOW' THEN 'LIGHT' WHEN 'HIGH' THEN 'HEAVY' ELSE 'MODERATE' END"
DIRECTION_LOAD, NODE_LOAD = LOAD.format(x="pcu_equivalent", a=15, b=35), LOAD.format(x="pcu_equivalent", a=50, b=140)


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_pcu(O.first_sightings(vehicle_obs(spark, sf_dir)), P.pcu(spark))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.direction_rollup(seen(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seen(spark, sf_dir)
    j = O.direction_rollup(s).join(O.queue_by_movement(s).select(*O.GRAIN, "queue_length_m"), O.GRAIN)
    return j.withColumn("state", M.traffic_state(F.col("pcu_equivalent"), F.col("queue_length_m")))


@query(f"{V} SELECT *, {DIRECTION_LOAD} AS load_class, {STATUS.format(x=DIRECTION_LOAD)} AS traffic_status FROM r")
def direction_rollup(spark, sf_dir):
    r = rollup(spark, sf_dir).withColumn("load_class", M.load_class(F.col("pcu_equivalent")))
    return r.withColumn("traffic_status", M.traffic_status(F.col("load_class")))


@query(f"{V} SELECT {G}, vtype, round_even(count(*) / sum(count(*)) OVER (PARTITION BY {G}), 4) AS share FROM s GROUP BY {G}, vtype")
def class_composition(spark, sf_dir):
    return O.class_composition(seen(spark, sf_dir))


@query(f"{V} SELECT {G}, {DIRECTION_LOAD} AS load_class, {STATUS.format(x=DIRECTION_LOAD)} AS traffic_status, {STATUS.format(x=DIRECTION_LOAD)} IN ('HEAVY', 'CONGESTED') AS frequent_congestion FROM r")
def load_class(spark, sf_dir):
    c = M.load_class(F.col("pcu_equivalent"))
    return rollup(spark, sf_dir).select(*O.GRAIN, c.alias("load_class"), M.traffic_status(c).alias("traffic_status"), M.frequent_congestion(M.traffic_status(c)).alias("frequent_congestion"))


@query(f"{V}, {QUEUE} SELECT {G}, pcu_equivalent, queue_length_m, {STATE} AS state FROM r JOIN qq USING ({G})")
def traffic_state(spark, sf_dir):
    return states(spark, sf_dir).select(*O.GRAIN, "pcu_equivalent", "queue_length_m", "state")


@query(f"{V}, {QUEUE} SELECT {G}, queue_left, queue_straight, queue_right, waiting, queue_length_m, CASE WHEN waiting > 0 AND round_even(queue_length_m / 7.5, 2) <= 0 THEN waiting ELSE round_even(queue_length_m / 7.5, 2) END AS queue_vehicles FROM qq")
def queue_by_movement(spark, sf_dir):
    return O.queue_by_movement(seen(spark, sf_dir))


#: Half-even tenths of a sum of hundredths.
TENTH = "({x} // 10 + CASE WHEN {x} % 10 > 5 OR {x} % 10 = 5 AND ({x} // 10) % 2 = 1 THEN 1 ELSE 0 END) / 10.0::DOUBLE"


@query(f"""{V}, {QUEUE}, c AS (SELECT {G}, coalesce(sum(round(q * 100)::BIGINT) FILTER (lane_index = 2), 0)::BIGINT AS l, coalesce(sum(round(q * 100)::BIGINT) FILTER (lane_index = 1), 0)::BIGINT AS s, coalesce(sum(round(q * 100)::BIGINT) FILTER (lane_index = 0), 0)::BIGINT AS r FROM v GROUP BY ALL),
d AS (SELECT {G}, {TENTH.format(x='l')} AS l, {TENTH.format(x='s')} AS s, {TENTH.format(x='r')} AS r FROM c)
SELECT {G}, greatest(l, s, r) > 0 AS from_detectors, CASE WHEN greatest(l, s, r) > 0 THEN l ELSE queue_left END AS queue_left, CASE WHEN greatest(l, s, r) > 0 THEN s ELSE queue_straight END AS queue_straight, CASE WHEN greatest(l, s, r) > 0 THEN r ELSE queue_right END AS queue_right FROM d JOIN qq USING ({G})""")
def detector_queue(spark, sf_dir):
    return O.detector_queue(detector_obs(spark, sf_dir), O.queue_by_movement(seen(spark, sf_dir)))


MIXED = "CASE WHEN vtype = 'motorcycle' THEN (length_m + 0.5) / 2.5 ELSE length_m + 1.5 END"


@query(f"{V} SELECT {G}, round_even(coalesce(sum({MIXED}) FILTER (speed_ms < 0.1), 0), 1) AS queue_length_m, round_even(least(100.0, sum({MIXED})), 1) AS occupancy_pct FROM s GROUP BY ALL")
def mixed_queue_legacy(spark, sf_dir):
    return O.mixed_queue(seen(spark, sf_dir))


@query(f"{V} SELECT {G}, round_even(avg(greatest(0, least(100, CASE WHEN k / 40.0::DOUBLE <= 1 THEN k / 40.0::DOUBLE * 100 ELSE k / 40.0::DOUBLE END))), 1) AS occupancy_pct FROM v GROUP BY ALL")
def occupancy(spark, sf_dir):
    return O.occupancy(detector_obs(spark, sf_dir))


RATIO = "CASE WHEN k / 40.0::DOUBLE > 1 THEN k / 40.0::DOUBLE / 100 ELSE k / 40.0::DOUBLE END"


@query(f"{V} SELECT run_id, node_id, obs_t, round_even(avg({RATIO}), 3) AS pressure, bool_or({RATIO} >= 0.85) AS edge_full FROM v GROUP BY ALL")
def outbound_pressure(spark, sf_dir):
    return O.outbound_pressure(detector_obs(spark, sf_dir))


@query(f"{V}, d AS (SELECT {G}, avg({RATIO}) AS e FROM v GROUP BY ALL) SELECT run_id, node_id, obs_t, round_even(max(e), 3) AS pressure, bool_or(e >= 0.85) AS edge_full FROM d GROUP BY ALL")
def outbound_pressure_lane(spark, sf_dir):
    return O.outbound_pressure_by_lane(detector_obs(spark, sf_dir))


@query(f"""{V}, p AS (SELECT run_id, node_id, obs_t, avg({RATIO}) AS x, bool_or({RATIO} >= 0.85) AS f FROM v GROUP BY ALL)
SELECT run_id, node_id, obs_t, f AS spillback_active, NOT f AND round_even(x, 3) >= 0.7 AS spillback_risk, f AS box_blocked FROM p""")
def phenomena(spark, sf_dir):
    p = O.outbound_pressure(detector_obs(spark, sf_dir))
    flags = M.phenomena(F.col("pressure"), F.col("edge_full"), F.lit(False), F.col("edge_full"))
    return p.select("run_id", "node_id", "obs_t", *[c.alias(n) for n, c in flags.items()])


@query(f"""{V}, l AS (SELECT {G}, lane_index, coalesce(sum(length_m + 1.5) FILTER (speed_ms < 0.1), 0) AS jam, count(*) FILTER (speed_ms < 0.1) AS h, max(lane_length_m) AS len, sum(round(pcu * 100)::BIGINT) AS p FROM s GROUP BY ALL)
SELECT {G}, round_even(max(jam), 1) AS full_link_jam_m, sum(h)::BIGINT AS halting_count, round_even(sum(len / 7.5), 2) AS nominal_storage, round_even(max(greatest(0, least(1, jam / len))), 4) AS utilisation,
round_even(greatest(0, least(1, sum(p)::DOUBLE / 100.0 / sum(len / 7.5))), 4) AS utilisation_pcu FROM l GROUP BY {G}""")
def full_link_storage(spark, sf_dir):
    return O.full_link_storage(seen(spark, sf_dir))


@query(f"{V} SELECT {G}, round_even(pcu_equivalent / 470.0 * 1000, 3) AS density_pcu_km, round_even(greatest(0, 50.0::DOUBLE * (1 - greatest(0, least(1, pcu_equivalent / 470.0 * 1000 / 200.0)))), 1) AS theoretical_speed_kmh FROM r")
def greenshields(spark, sf_dir):
    d = M.density_pcu_km(F.col("pcu_equivalent"), F.lit(470.0))
    return rollup(spark, sf_dir).select(*O.GRAIN, F.bround(d, 3).alias("density_pcu_km"), F.bround(M.greenshields(d), 1).alias("theoretical_speed_kmh"))


COLOR = "CASE WHEN direction IN ('North', 'South') THEN ['green', 'yellow', 'red', 'red'][i + 1] ELSE ['red', 'red', 'green', 'yellow'][i + 1] END"


@query(f"""{V}, c AS (SELECT *, {COLOR} AS color FROM (SELECT *, (floor(obs_t / 86400)::BIGINT % 4)::INT AS i FROM r))
SELECT {G}, color, CASE WHEN color <> 'green' THEN waiting_vehicle_count ELSE 0 END AS red_phase, CASE WHEN color = 'green' THEN waiting_vehicle_count ELSE 0 END AS congestion, CASE WHEN waiting_vehicle_count > 0 THEN CASE WHEN color = 'green' THEN 'CONGESTION' ELSE 'RED_PHASE' END END AS dominant_waiting_reason FROM c""")
def waiting_reason(spark, sf_dir):
    r = rollup(spark, sf_dir).withColumn("phase_index", (F.floor(F.col("obs_t") / DAY) % 4).cast("int"))
    return O.waiting_reasons(r, P.phases(spark))


@query(f"""{V}, f AS (SELECT {G}, vtype, lane_pos_m / lane_length_m >= 0.8 AS front, count(*) OVER w AS n, count(*) FILTER (lane_pos_m / lane_length_m >= 0.8) OVER w AS nf, row_number() OVER (PARTITION BY {G} ORDER BY lane_index DESC, event_id DESC) AS rn FROM s WINDOW w AS (PARTITION BY {G}))
SELECT {G}, round_even(count(*) FILTER (vtype = 'motorcycle') * 100.0::DOUBLE / count(*), 1) AS moto_front_pct FROM f WHERE (nf > 0 AND front) OR (nf = 0 AND rn <= greatest(1, n // 5)) GROUP BY {G}""")
def moto_front_share(spark, sf_dir):
    return O.moto_front_share(seen(spark, sf_dir))


@query(f"""{V} SELECT run_id, node_id, obs_t, count(*) FILTER (lane_pos_m / lane_length_m >= 0.85 AND floor(obs_t / 86400)::BIGINT % 2 = 1) AS yellow_commitment FROM s GROUP BY ALL""")
def yellow_commitment(spark, sf_dir):
    phase = F.element_at(F.array(*[F.lit(p) for p in P.PHASES]), (F.floor(F.col("obs_t") / DAY) % 4 + 1).cast("int"))
    return O.yellow_commitment(seen(spark, sf_dir), phase)


@query(f"""{V}, b AS (SELECT run_id, node_id, obs_t, bool_or({RATIO} >= 0.85) AS f FROM v GROUP BY ALL), n AS (SELECT run_id, node_id, obs_t, count(*) FILTER (lane_pos_m / lane_length_m >= 0.9 AND speed_ms < 0.1) AS n FROM s GROUP BY ALL)
SELECT run_id, node_id, obs_t, CASE WHEN f THEN n ELSE 0 END AS blocked_at_entry FROM n JOIN b USING (run_id, node_id, obs_t)""")
def blocked_at_entry(spark, sf_dir):
    boxes = O.outbound_pressure(detector_obs(spark, sf_dir)).select("run_id", "node_id", "obs_t", F.col("edge_full").alias("box_blocked"))
    return O.blocked_at_entry(seen(spark, sf_dir), boxes)


@query(f"""{V}, t AS (SELECT run_id, obs_t, row_number() OVER w AS i, obs_t - lag(obs_t) OVER w AS dt FROM (SELECT DISTINCT run_id, obs_t FROM s) WINDOW w AS (PARTITION BY run_id ORDER BY obs_t)),
n AS (SELECT a.*, t.dt FROM s a JOIN t USING (run_id, obs_t) WHERE NOT EXISTS (SELECT 1 FROM s b JOIN t u USING (run_id, obs_t) WHERE b.node_id = a.node_id AND b.direction = a.direction AND b.vehicle_id = a.vehicle_id AND u.i = t.i - 1))
SELECT {G}, count(*) AS new_vehicles, round_even(sum(round(pcu * 100)::BIGINT)::DOUBLE / 100.0 / max(dt) * 3600, 3) AS arrival_pcu_per_h FROM n WHERE dt IS NOT NULL GROUP BY ALL""")
def arrival_rate(spark, sf_dir):
    return O.arrival_rate(O.arrivals(seen(spark, sf_dir)))


@query(f"""{V} SELECT event_id, lag(vehicle_id) OVER w AS ahead, round_even(lag(lane_pos_m - length_m) OVER w - lane_pos_m, 2) AS gap_m FROM v WINDOW w AS (PARTITION BY {G}, lane_index ORDER BY lane_pos_m DESC, event_id)""")
def vehicle_ahead(spark, sf_dir):
    return O.vehicles_ahead(vehicle_obs(spark, sf_dir)).select("event_id", "ahead", "gap_m")


KIND = "CASE event_type WHEN 'signup' THEN 'DEPART' WHEN 'purchase' THEN 'ARRIVE' ELSE 'SEEN' END"


@query(f"""WITH k AS (SELECT user_id::VARCHAR AS vehicle_id, {KIND} AS kind, (epoch_us(ts) / 1000000.0 - 1704067200)::DOUBLE AS t FROM events),
g AS (SELECT vehicle_id, coalesce(min(t) FILTER (kind = 'DEPART'), min(t) FILTER (kind = 'SEEN')) AS d, max(t) FILTER (kind = 'ARRIVE') AS a FROM k GROUP BY ALL)
SELECT 'run-events' AS run_id, vehicle_id, round_even(d, 2) AS depart_s, round_even(a, 2) AS arrive_s, round_even(a - d, 2) AS travel_s FROM g WHERE a IS NOT NULL""")
def trip_times(spark, sf_dir):
    kind = F.when(F.col("vtype") == "truck", "DEPART").when(F.col("vtype") == "bus", "ARRIVE").otherwise("SEEN")
    return T.trips(vehicle_obs(spark, sf_dir).select("run_id", "vehicle_id", kind.alias("kind"), "sim_t"))


@query(f"""{V}, w AS (SELECT *, lead(sim_t) OVER o - sim_t AS dt, speed_ms < 0.1 AS st, coalesce(lag(speed_ms < 0.1) OVER o, false) AS was FROM v WINDOW o AS (PARTITION BY vehicle_id ORDER BY sim_t, event_id))
SELECT run_id, vehicle_id, count(*) AS readings, round_even(max(sim_t) - min(sim_t), 2) AS travel_s, round_even(coalesce(sum(dt) FILTER (st), 0), 2) AS waiting_s, count(*) FILTER (st AND NOT was) AS stop_count,
round_even(coalesce(sum(speed_ms * dt), 0) / greatest(max(sim_t) - min(sim_t), 0.001) * 3.6, 1) AS mean_speed_kmh FROM w GROUP BY run_id, vehicle_id""")
def trip_statistics(spark, sf_dir):
    return T.trip_statistics(vehicle_obs(spark, sf_dir))


@query(f"""{V}, f AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction, vehicle_id ORDER BY sim_t, event_id) AS rn FROM v WHERE lane_pos_m >= 0.92 * lane_length_m),
c AS (SELECT *, (floor(obs_t / 86400)::BIGINT % 4)::INT AS i FROM f WHERE rn = 1) SELECT run_id, node_id, count(*) AS passed, round_even(count(*) FILTER (({COLOR}) = 'green')::DOUBLE / count(*), 4) AS green_share FROM c GROUP BY ALL""")
def arrival_on_green(spark, sf_dir):
    obs = vehicle_obs(spark, sf_dir)
    days = obs.select("node_id", "obs_t").distinct().withColumn("phase_index", (F.floor(F.col("obs_t") / DAY) % 4).cast("int"))
    return T.arrival_on_green(obs, days.join(F.broadcast(P.phases(spark)), "phase_index").select("node_id", "direction", "obs_t", "color"))


SERIES = ["run_id", "node_id", "direction"]
RANGE = "PARTITION BY node_id, direction ORDER BY sim_t RANGE BETWEEN 45000 PRECEDING AND CURRENT ROW"


@query(f"""{V} SELECT event_id, round_even(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE (arg_max(q, sim_t) OVER w - arg_min(q, sim_t) OVER w) / greatest(0.001, max(sim_t) OVER w - min(sim_t) OVER w) END, 6) + 0.0 AS slope FROM v WINDOW w AS ({RANGE})""")
def queue_slope(spark, sf_dir):
    o = vehicle_obs(spark, sf_dir).select(*SERIES, "sim_t", "event_id", "q")
    return H.recent(o, SERIES, window=WINDOW, slope="q").select("event_id", F.bround("slope", 6).alias("slope"))


@query(f"{V} SELECT event_id, round_even(avg(q) OVER ({RANGE}), 7) AS mean_q FROM v")
def mean_occupancy(spark, sf_dir):
    o = vehicle_obs(spark, sf_dir).select(*SERIES, "sim_t", "event_id", "q")
    return H.recent(o, SERIES, window=WINDOW, mean="q").select("event_id", F.bround("mean", 7).alias("mean_q"))


@query(f"""{V}, l AS (SELECT event_id, list_transform(list_sort(list({{'t': sim_t, 'e': event_id, 'q': q}}) OVER ({RANGE})), lambda x: x.q) AS xs FROM v),
h AS (SELECT event_id, len(xs) AS n, list_avg(xs[1:len(xs) // 2]) AS a, list_avg(xs[len(xs) // 2 + 1:]) AS b FROM l)
SELECT event_id, round_even(CASE WHEN n >= 4 AND a > 0.001 THEN least(1, greatest(0, b - a) / greatest(a, 1)) END, 6) AS drop_ratio FROM h""")
def discharge_drop(spark, sf_dir):
    o = vehicle_obs(spark, sf_dir).select(*SERIES, "sim_t", "event_id", "q")
    return H.discharge_drop(o, SERIES, "q", window=WINDOW).select("event_id", F.bround("drop_ratio", 6).alias("drop_ratio"))


Q_STATE = "CASE WHEN {x} > 70 THEN 'OVERSATURATED' WHEN {x} > 40 THEN 'CONGESTED' WHEN {x} > 15 THEN 'BUSY' WHEN {x} > 8 THEN 'STABLE' ELSE 'FREE_FLOW' END"
IS_BAD, IS_GOOD = "IN ('BUSY', 'CONGESTED', 'OVERSATURATED')", "IN ('FREE_FLOW', 'STABLE')"


@query(f"""WITH RECURSIVE b AS (SELECT event_id % 40 AS series, (event_id // 40)::DOUBLE AS t, event_id, {Q_STATE.format(x='value')} AS raw FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, event_id) AS rn FROM b),
h AS (SELECT series, t, event_id, raw, rn, raw AS hs, t AS since, NULL::DOUBLE AS rec, raw AS state FROM n WHERE rn = 1
UNION ALL SELECT series, t, event_id, raw, rn, CASE WHEN NOT held OR done THEN raw ELSE hs END, CASE WHEN NOT held OR done THEN t ELSE since END,
  CASE WHEN recovering THEN CASE WHEN rec0 IS NULL THEN t WHEN done THEN NULL ELSE rec0 END WHEN raw <> hs AND raw {IS_BAD} THEN NULL ELSE rec0 END,
  CASE WHEN recovering THEN CASE WHEN done THEN raw ELSE hs END WHEN held THEN hs ELSE raw END
FROM (SELECT *, recovering AND rec0 IS NOT NULL AND t - rec0 >= 12 AS done FROM (SELECT n.series, n.t, n.event_id, n.raw, n.rn, h.hs, h.since, n.raw <> h.hs AND n.t - h.since < 8 AS held,
  h.hs {IS_BAD} AND n.raw {IS_GOOD} AS recovering, CASE WHEN n.raw <> h.hs AND n.t - h.since >= 8 THEN NULL ELSE h.rec END AS rec0 FROM n JOIN h ON n.series = h.series AND n.rn = h.rn + 1)))
SELECT series, t, event_id, raw, state FROM h""")
def hysteresis(spark, sf_dir):
    s = second_series(spark, sf_dir)
    return H.hysteresis(s.select("series", "t", "event_id", F.expr(Q_STATE.format(x="q")).alias("raw")), ["series"])


@query(f"{V} SELECT node_id, direction, floor(sim_t / 86400)::BIGINT AS bucket, arg_min(q, (sim_t, event_id)) AS first_value, arg_max(q, (sim_t, event_id)) AS last_value FROM v GROUP BY ALL")
def cadence_sample(spark, sf_dir):
    return H.cadence_buckets(vehicle_obs(spark, sf_dir), ["node_id", "direction"], "sim_t", DAY, "q")


@query(f"""WITH RECURSIVE v AS (SELECT substr('ABCD', (user_id % 4)::INT + 1, 1) AS node_id, event_id, (epoch_us(ts) / 1000000.0 - 1704067200)::DOUBLE AS sim_t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY sim_t, event_id) AS rn FROM v),
k AS (SELECT node_id, event_id, sim_t, rn, sim_t AS last, true AS kept FROM n WHERE rn = 1
UNION ALL SELECT n.node_id, n.event_id, n.sim_t, n.rn, CASE WHEN n.sim_t - k.last >= 3600 THEN n.sim_t ELSE k.last END, n.sim_t - k.last >= 3600 FROM n JOIN k ON n.node_id = k.node_id AND n.rn = k.rn + 1)
SELECT node_id, event_id, sim_t FROM k WHERE kept""")
def cadence_gate(spark, sf_dir):
    return H.cadence(vehicle_obs(spark, sf_dir).select("node_id", "event_id", "sim_t"), ["node_id"], "sim_t", 3600.0)


@query(f"{V} SELECT * FROM (SELECT vehicle_id, event_id FROM v QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY sim_t DESC, event_id DESC) <= 5)")
def topk_retention(spark, sf_dir):
    return T.last_rows(vehicle_obs(spark, sf_dir).select("vehicle_id", "event_id", "sim_t"), ["vehicle_id"], [F.desc("sim_t"), F.desc("event_id")], 5).select("vehicle_id", "event_id")


@query(f"{V} SELECT event_id FROM (SELECT event_id FROM v QUALIFY row_number() OVER (PARTITION BY node_id, direction ORDER BY sim_t DESC, event_id DESC) <= 120)")
def bounded_history(spark, sf_dir):
    o = vehicle_obs(spark, sf_dir).select("node_id", "direction", "sim_t", "event_id")
    return H.bounded_history(o, ["node_id", "direction"], [F.desc("sim_t"), F.desc("event_id")]).select("event_id")


@query(f"{V}, g AS (SELECT vehicle_id, node_id, lead(sim_t) OVER (PARTITION BY vehicle_id ORDER BY sim_t, event_id) - sim_t AS dt, direction FROM v) SELECT vehicle_id, direction, round_even(coalesce(sum(dt), 0), 2) AS seconds FROM g GROUP BY ALL")
def segment_times(spark, sf_dir):
    return H.segment_times(vehicle_obs(spark, sf_dir), ["vehicle_id"], "direction", "sim_t")


NODE_SQL = f"""nt AS (SELECT run_id, node_id, obs_t, sum(vehicle_count)::BIGINT AS vehicle_count, round_even(sum(round(pcu_equivalent * 100)::BIGINT)::DOUBLE / 100.0, 2) AS pcu_equivalent,
sum(round(average_speed_kmh * 10)::BIGINT) FILTER (average_speed_kmh > 0)::BIGINT AS t, count(*) FILTER (average_speed_kmh > 0) AS n FROM r GROUP BY ALL),
nr AS (SELECT * EXCLUDE (t, n), coalesce((t // n + CASE WHEN 2 * (t % n) > n OR 2 * (t % n) = n AND (t // n) % 2 = 1 THEN 1 ELSE 0 END) / 10.0::DOUBLE, 0) AS average_speed_kmh FROM nt)"""


@query(f"{V}, {NODE_SQL} SELECT *, {NODE_LOAD} AS load_class, {STATUS.format(x=NODE_LOAD)} AS traffic_status FROM nr")
def node_rollup(spark, sf_dir):
    return C.node_rollup(rollup(spark, sf_dir))


RANK = "list_position(['FREE_FLOW', 'STABLE', 'BUSY', 'CONGESTED', 'OVERSATURATED'], state)"
NODE_STATE = f"st AS (SELECT {G}, {STATE} AS state, vehicle_count FROM r JOIN qq USING ({G})), ns AS (SELECT run_id, node_id, obs_t, arg_max(state, {RANK}) AS state FROM st GROUP BY ALL)"


@query(f"{V}, {QUEUE}, {NODE_STATE} SELECT * FROM ns")
def node_state(spark, sf_dir):
    return C.node_state(states(spark, sf_dir))


@query(f"{V}, {QUEUE}, {NODE_STATE}, w AS (SELECT run_id, node_id, obs_t, state, sum(vehicle_count) AS w FROM st GROUP BY ALL) SELECT run_id, node_id, obs_t, arg_max(state, (w, {RANK})) AS state FROM w GROUP BY ALL")
def node_state_weighted(spark, sf_dir):
    return C.node_state_weighted(states(spark, sf_dir), "vehicle_count")


@query(f"{V}, {QUEUE}, {NODE_STATE} SELECT run_id, obs_t, count(*) AS nodes, count(*) FILTER (state IN ('CONGESTED', 'OVERSATURATED')) AS congested_nodes, count(*) FILTER (state = 'FREE_FLOW') AS free_nodes FROM ns GROUP BY ALL")
def network_summary(spark, sf_dir):
    return C.network_summary(C.node_state(states(spark, sf_dir)))


LINKS_SQL = "lk(link, up, dn, up_direction) AS (VALUES " + ", ".join(f"('{a}', '{c}', '{d}', '{e}')" for a, _, c, d, e, _ in P.LINKS) + ")"
SLOPED = f"""sl AS (SELECT *, CASE WHEN count(*) OVER w < 2 THEN 0 ELSE (arg_max(q, sim_t) OVER w - arg_min(q, sim_t) OVER w) / greatest(0.001, max(sim_t) OVER w - min(sim_t) OVER w) END AS slope FROM v WINDOW w AS ({RANGE})),
ls AS (SELECT run_id, link, up, dn, sim_t, event_id, q, slope FROM sl JOIN lk ON node_id = up AND direction = up_direction)"""


OCCUPANCY = "greatest(0, least(100, CASE WHEN k / 41.0::DOUBLE <= 1 THEN k / 41.0::DOUBLE * 100 ELSE k / 41.0::DOUBLE END)) / 100"


def with_occupancy(obs: DataFrame) -> DataFrame:
    return obs.withColumn("occupancy", M.occupancy_percent(F.col("k") / F.lit(41.0)) / 100)


@query(f"{V}, {LINKS_SQL}, {SLOPED} SELECT ls.run_id, link, up, dn, ls.sim_t, event_id, ls.q, {OCCUPANCY} AS occupancy, round_even(slope, 6) + 0.0 AS slope FROM ls JOIN (SELECT event_id, k FROM v) USING (event_id)")
def link_states(spark, sf_dir):
    return C.link_states(with_occupancy(vehicle_obs(spark, sf_dir)), P.links(spark), WINDOW).withColumn("slope", F.bround("slope", 6))


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays of the adapter: every truck with q over 95 starts one at its node, for k hours, without end for k over 90."""
    names = list(P.OVERLAY_PRIORITY)
    o = vehicle_obs(spark, sf_dir).filter("vtype = 'truck' AND q > 95")
    place = (F.col("k") % len(names) + 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), place)
    prio = F.element_at(F.array(*[F.lit(P.OVERLAY_PRIORITY[n]) for n in names]), place)
    end = F.when(F.col("k") <= 90, F.col("sim_t") + F.col("k") * 3600.0)
    return o.select("run_id", F.col("event_id").alias("overlay_id"), kind.alias("overlay_type"), "node_id", F.col("sim_t").alias("created_at_s"), end.alias("expires_at_s"), prio.alias("priority"))


OVERLAYS = f"""ov AS (SELECT run_id, event_id AS overlay_id, {list(P.OVERLAY_PRIORITY)}[(k % 5)::INT + 1] AS overlay_type, {list(P.OVERLAY_PRIORITY.values())}[(k % 5)::INT + 1] AS priority, node_id, sim_t AS created_at_s, CASE WHEN k <= 90 THEN sim_t + k * 3600.0 END AS expires_at_s FROM v WHERE vtype = 'truck' AND q > 95)"""


@query(f"""{V}, {OVERLAYS}, t AS (SELECT DISTINCT run_id, obs_t AS t FROM v) SELECT t.run_id, t, overlay_id, overlay_type, node_id, created_at_s, expires_at_s, priority FROM t JOIN ov ON ov.run_id = t.run_id AND created_at_s <= t AND (expires_at_s IS NULL OR t < expires_at_s)""")
def overlay_active(spark, sf_dir):
    times = vehicle_obs(spark, sf_dir).select("run_id", F.col("obs_t").alias("t")).distinct()
    return C.active_overlays(overlays(spark, sf_dir), times)


@query(f"""{V}, {OVERLAYS}, t AS (SELECT DISTINCT run_id, node_id, obs_t AS t FROM v), a AS (SELECT t.run_id, ov.node_id, t, overlay_type FROM (SELECT DISTINCT run_id, t FROM t) t JOIN ov ON created_at_s <= t AND (expires_at_s IS NULL OR t < expires_at_s)),
f AS (SELECT run_id, node_id, t, bool_or(overlay_type IN ('accident', 'blocked_intersection')) AS i, bool_or(overlay_type = 'downstream_restriction') AS d, bool_or(overlay_type = 'emergency') AS e FROM a GROUP BY ALL)
SELECT run_id, node_id, t, coalesce(i, false) AS incident_active, coalesce(d, false) AS downstream_restriction_active, coalesce(e, false) AS emergency_preemption_active FROM t LEFT JOIN f USING (run_id, node_id, t)""")
def operational_flags(spark, sf_dir):
    nodes = vehicle_obs(spark, sf_dir).select("run_id", "node_id", F.col("obs_t").alias("t")).distinct()
    return C.operational_flags(nodes, C.active_overlays(overlays(spark, sf_dir), nodes.select("run_id", "t").distinct()))


#: The adapter for queries with a recursive part.
VR = V.replace("WITH e", "WITH RECURSIVE e", 1)
RAW_STATE = STATE.replace("queue_length_m", "q")
#: Each reading's state held over time, as the hysteresis holds it: hs.
HELD = f"""hb AS (SELECT v.run_id, v.node_id, v.direction, sim_t AS t, event_id, {RAW_STATE} AS raw FROM v JOIN r USING ({G})),
hn AS (SELECT *, row_number() OVER (PARTITION BY run_id, node_id, direction ORDER BY t, event_id) AS rn FROM hb),
hs AS (SELECT *, raw AS hs, t AS since, NULL::DOUBLE AS rec, raw AS state FROM hn WHERE rn = 1
  UNION ALL SELECT run_id, node_id, direction, t, event_id, raw, rn, CASE WHEN NOT held OR done THEN raw ELSE hs END, CASE WHEN NOT held OR done THEN t ELSE since END,
    CASE WHEN recovering THEN CASE WHEN rec0 IS NULL THEN t WHEN done THEN NULL ELSE rec0 END WHEN raw <> hs AND raw {IS_BAD} THEN NULL ELSE rec0 END,
    CASE WHEN recovering THEN CASE WHEN done THEN raw ELSE hs END WHEN held THEN hs ELSE raw END
  FROM (SELECT *, recovering AND rec0 IS NOT NULL AND t - rec0 >= 12000 AS done FROM (SELECT n.*, h.hs, h.since, n.raw <> h.hs AND n.t - h.since < 8000 AS held, h.hs {IS_BAD} AND n.raw {IS_GOOD} AS recovering,
    CASE WHEN n.raw <> h.hs AND n.t - h.since >= 8000 THEN NULL ELSE h.rec END AS rec0 FROM hn n JOIN hs h ON n.run_id = h.run_id AND n.node_id = h.node_id AND n.direction = h.direction AND n.rn = h.rn + 1)))"""
CAUSES = f"""p AS (SELECT run_id, node_id, obs_t, bool_or({RATIO} >= 0.85) AS full_edge FROM v GROUP BY ALL),
{HELD},
h AS (SELECT v.*, {OCCUPANCY} AS occ, hs.state IN ('CONGESTED', 'OVERSATURATED') AS bad, full_edge FROM v JOIN hs USING (event_id) JOIN p ON p.run_id = v.run_id AND p.node_id = v.node_id AND p.obs_t = v.obs_t),
w AS (SELECT *, CASE WHEN count(*) OVER w < 2 THEN 0 ELSE (arg_max(q, sim_t) OVER w - arg_min(q, sim_t) OVER w) / greatest(0.001, max(sim_t) OVER w - min(sim_t) OVER w) END AS slope,
  avg(occ) OVER w AS mo, list_transform(list_sort(list({{'t': sim_t, 'e': event_id, 'q': q}}) OVER w), lambda x: x.q) AS xs FROM h WINDOW w AS ({RANGE})),
d AS (SELECT *, len(xs) AS n, list_avg(xs[1:len(xs) // 2]) AS a, list_avg(xs[len(xs) // 2 + 1:]) AS b FROM w),
cs AS (SELECT d.run_id, overlay_id, link, ov.node_id AS source_node, up AS affected_node, event_id,
  CASE WHEN overlay_type = 'downstream_restriction' THEN 'DOWNSTREAM_RESTRICTION' ELSE 'DOWNSTREAM_BLOCKAGE' END AS cause_type, created_at_s AS observed_from_s, sim_t AS observed_to_s,
  round_even(slope, 4) + 0.0 AS queue_slope_m_per_s, round_even(mo, 4) AS occupancy, round_even(CASE WHEN n >= 4 AND a > 0.001 THEN least(1, greatest(0, b - a) / greatest(a, 1)) END, 4) AS discharge_drop_ratio,
  q AS queue_length_m, 45000.0::DOUBLE AS window_s, 1.0::DOUBLE AS confidence, 'RULE_BASED' AS method
  FROM d JOIN lk ON d.node_id = up AND d.direction = up_direction JOIN ov ON ov.node_id = dn
  WHERE overlay_type IN ('downstream_restriction', 'accident', 'blocked_intersection') AND sim_t - created_at_s BETWEEN 5000 AND 120000 AND (slope > 0.05 OR bad OR full_edge))"""


def held_states(spark: SparkSession, sf_dir: str, links: DataFrame) -> DataFrame:
    """The readings at the upstream ends of links with the state that the hysteresis holds, in the adapter's time, a thousand times as long."""
    ends = links.select(F.col("up").alias("node_id"), F.col("up_direction").alias("direction")).distinct()
    obs = vehicle_obs(spark, sf_dir).join(sized(ends), ["node_id", "direction"], "left_semi")
    r = O.direction_rollup(O.with_pcu(O.first_sightings(obs), P.pcu(spark))).select(*O.GRAIN, "pcu_equivalent")
    j = obs.select(*O.GRAIN, "sim_t", "event_id", "q", "k").join(r, O.GRAIN)
    return H.hysteresis(j.withColumn("raw", M.traffic_state(F.col("pcu_equivalent"), F.col("q"))), ["run_id", "node_id", "direction"], t="sim_t", hold=8000.0, recovery=12000.0)


#: Window and ages of causes, in the adapter's time.
AGES = (WINDOW, 5000.0, 120000.0)


def cause_history(spark: SparkSession, sf_dir: str, links: DataFrame) -> DataFrame:
    full = O.outbound_pressure(detector_obs(spark, sf_dir)).select("run_id", "node_id", "obs_t", F.col("edge_full").alias("spillback_active"))
    return with_occupancy(held_states(spark, sf_dir, links)).join(full, ["run_id", "node_id", "obs_t"])


def causes(spark: SparkSession, sf_dir: str, link: str | None = None) -> DataFrame:
    """All causes, or those of one link, whose readings alone are then read on."""
    links = C.links_named(P.links(spark), link)
    return C.probable_causes(overlays(spark, sf_dir), links, cause_history(spark, sf_dir, links), *AGES)


def cause_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings that have causes, with their number, first and last, and the day of observation."""
    links = P.links(spark)
    c = C.cause_readings(overlays(spark, sf_dir), links, cause_history(spark, sf_dir, links), *AGES)
    return c.withColumn("obs_t", F.floor(F.col("sim_t") / DAY) * DAY)


def first_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, node_id, obs_t, cause_type, cause_node, cause_detected_at): the first cause of each node and observation."""
    first = F.min(F.struct("sim_t", "event_id", "first.*"))
    c = cause_readings(spark, sf_dir).groupBy("run_id", F.col("affected_node").alias("node_id"), "obs_t").agg(first.alias("c"))
    return c.select("run_id", "node_id", "obs_t", "c.cause_type", F.col("c.source_node").alias("cause_node"), F.col("c.sim_t").alias("cause_detected_at"))


FIRST_CAUSES = "fc AS (SELECT run_id, affected_node AS node_id, floor(observed_to_s / 86400) * 86400 AS obs_t, arg_min(cause_type, (observed_to_s, event_id, overlay_id)) AS cause_type, arg_min(source_node, (observed_to_s, event_id, overlay_id)) AS cause_node, min(observed_to_s) AS cause_detected_at FROM cs GROUP BY ALL)"


@query(f"{VR}, {OVERLAYS}, {LINKS_SQL}, {CAUSES} SELECT * FROM cs")
def probable_cause(spark, sf_dir):
    return causes(spark, sf_dir)


@query(f"""{VR}, {QUEUE}, {NODE_STATE}, {OVERLAYS}, {LINKS_SQL}, {CAUSES}, n AS (SELECT run_id, obs_t, count(*) FILTER (state IN ('CONGESTED', 'OVERSATURATED')) AS nodes_congested, count(*) FILTER (full_edge) AS nodes_spillback FROM ns JOIN p USING (run_id, node_id, obs_t) GROUP BY ALL),
o AS (SELECT t.run_id, t.obs_t, count(*) AS active_overlays FROM (SELECT DISTINCT run_id, obs_t FROM v) t JOIN ov ON created_at_s <= obs_t AND (expires_at_s IS NULL OR obs_t < expires_at_s) GROUP BY ALL),
c AS (SELECT run_id, floor(observed_to_s / 86400) * 86400 AS obs_t, count(*) AS probable_cause_count FROM cs GROUP BY ALL)
SELECT run_id, obs_t, nodes_congested, nodes_spillback, coalesce(active_overlays, 0) AS active_overlays, coalesce(probable_cause_count, 0) AS probable_cause_count FROM n LEFT JOIN o USING (run_id, obs_t) LEFT JOIN c USING (run_id, obs_t)""")
def context_summary(spark, sf_dir):
    full = O.outbound_pressure(detector_obs(spark, sf_dir)).select("run_id", "node_id", "obs_t", F.col("edge_full").alias("spillback_active"))
    nodes = C.node_state(states(spark, sf_dir)).join(full, ["run_id", "node_id", "obs_t"])
    times = vehicle_obs(spark, sf_dir).select("run_id", F.col("obs_t").alias("t")).distinct()
    active = C.active_overlays(overlays(spark, sf_dir), times).withColumnRenamed("t", "obs_t")
    return C.context_summary(nodes, active, cause_readings(spark, sf_dir))


@query(f"""{V}, p AS (SELECT (event_id % 300)::VARCHAR AS lane_id, k % 5 AS priority, event_id AS seq, CASE WHEN k % 2 = 0 THEN speed_ms END AS speed_ms, CASE WHEN k % 3 = 0 THEN k % 4 = 0 END AS closed FROM v),
b AS (SELECT range::VARCHAR AS lane_id FROM range(400)) SELECT lane_id, greatest(0.5, coalesce(arg_max(speed_ms, (priority, seq)) FILTER (speed_ms IS NOT NULL), 13.9))::DOUBLE AS speed_ms, coalesce(arg_max(closed, (priority, seq)) FILTER (closed IS NOT NULL), false) AS closed FROM b LEFT JOIN p USING (lane_id) GROUP BY lane_id""")
def effective_lane(spark, sf_dir):
    k = F.col("k")
    p = vehicle_obs(spark, sf_dir).select((F.col("event_id") % 300).cast("string").alias("lane_id"), (k % 5).alias("priority"), F.col("event_id").alias("seq"), F.when(k % 2 == 0, F.col("speed_ms")).alias("speed_ms"), F.when(k % 3 == 0, k % 4 == 0).alias("closed"))
    base = spark.range(400).select(F.col("id").cast("string").alias("lane_id"), F.lit(13.9).alias("speed_ms"), F.lit(False).alias("closed"))
    return C.effective_lanes(base, p)


@query(f"{V} SELECT vehicle_id, arg_max(event_id, (sim_t, event_id)) AS event_id, arg_max(q, (sim_t, event_id)) AS q FROM v GROUP BY ALL")
def latest_entity(spark, sf_dir):
    return C.latest(vehicle_obs(spark, sf_dir).select("vehicle_id", "event_id", "sim_t", "q"), "vehicle_id", ["sim_t", "event_id"]).drop("sim_t")


@query(f"""{V}, p AS (SELECT vehicle_id, sim_t, event_id, CASE WHEN k % 2 = 0 THEN q END AS even_q, CASE WHEN k % 7 = 0 THEN direction END AS sevens FROM v)
SELECT vehicle_id, arg_max(even_q, (sim_t, event_id)) FILTER (even_q IS NOT NULL) AS even_q, arg_max(sevens, (sim_t, event_id)) FILTER (sevens IS NOT NULL) AS sevens FROM p GROUP BY ALL""")
def patch_merge(spark, sf_dir):
    o = vehicle_obs(spark, sf_dir).select("vehicle_id", "sim_t", "event_id", F.when(F.col("k") % 2 == 0, F.col("q")).alias("even_q"), F.when(F.col("k") % 7 == 0, F.col("direction")).alias("sevens"))
    return C.patch_merge(o, "vehicle_id", ["sim_t", "event_id"], ["even_q", "sevens"])


@query(f"{V} SELECT run_id, node_id, obs_t, arg_min(direction, list_position(['North', 'South', 'East', 'West'], direction)) AS direction FROM s WHERE vtype = 'bus' GROUP BY ALL")
def preemption(spark, sf_dir):
    order = F.array_position(F.array(*[F.lit(d) for d in P.DIRECTIONS]), F.col("direction"))
    return C.preemption(seen(spark, sf_dir), order, ("bus",))


@query(f"""{V}, t AS (SELECT event_id, (sim_t % 1000)::DOUBLE AS t, (event_id % 90)::DOUBLE AS o, least(120, greatest(10, k + 15)) AS g, k, q, speed_ms * 3.6 AS own, length_m FROM v), x AS (SELECT *, (t + o) % (2 * (g + 3))::DOUBLE AS x FROM t)
SELECT event_id, CASE WHEN x < g THEN 'NS_GREEN' WHEN x < g + 3 THEN 'NS_YELLOW' WHEN x < 2 * g + 3 THEN 'EW_GREEN' ELSE 'EW_YELLOW' END AS phase,
round_even(CASE WHEN q <= 50 THEN 1 WHEN t < 45 THEN 0.3::DOUBLE + 0.7::DOUBLE * t / 45 WHEN t < 255 THEN 1 WHEN t < 300 THEN 1 - 0.7::DOUBLE * (t - 255) / 45 ELSE 0.3 END, 4)::DOUBLE AS multiplier,
round_even(greatest(0, (42 - t / 10) / 42), 4) AS ideal_green,
round_even(CASE WHEN k % 2 = 0 THEN greatest(0, 50 * (1 - greatest(0, least(1, q / 200)))) ELSE 0 END, 4)::DOUBLE AS speed_kmh FROM x""")
def signal_functions(spark, sf_dir):
    """Each vehicle's phase under a green time of its own, the demand at its second of a peak, and what its signal lets it do."""
    v = vehicle_obs(spark, sf_dir)
    t = F.pmod(F.col("sim_t"), F.lit(1000.0))
    phase = M.phase_at(t, (F.col("event_id") % 90).cast("double"), F.col("k") + 15)
    more = M.spawn_multiplier(t, peak=F.col("q") > 50)
    return v.select("event_id", phase.alias("phase"), F.bround(more, 4).alias("multiplier"), F.bround(M.ideal_arrival_on_green(t / 10), 4).alias("ideal_green"), F.bround(M.effective_kmh(F.col("q"), F.col("k") % 2 == 0), 4).alias("speed_kmh"))

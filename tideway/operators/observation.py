"""Per-approach measures of one observation: counts, PCU, speed, queues, occupancy, storage, composition, arrivals.

Input rows are ``vehicle_obs``; the grain of results is (run_id, node_id, direction, obs_t). All measures of a grain are
grouped aggregates with map-side partial sums; dimension tables are a few rows and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideway.functions import metrics as M
from tideway.operators.scans import sized
from tideway.params import MODEL

GRAIN = ["run_id", "node_id", "direction", "obs_t"]


def first_sightings(obs: DataFrame, order: tuple[str, ...] = ("lane_index", "event_id")) -> DataFrame:
    """One row for each vehicle of an approach: that of the first lane in scan order."""
    rest = [c for c in obs.columns if c not in [*GRAIN, "vehicle_id"]]
    picked = obs.groupBy(*GRAIN, "vehicle_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*GRAIN, "vehicle_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def with_pcu(obs: DataFrame, pcu: DataFrame, fallback: float = MODEL.pcu_fallback) -> DataFrame:
    """Adds pcu by vtype; an unknown type counts as ``fallback``."""
    return obs.join(sized(pcu), "vtype", "left").withColumn("pcu", F.coalesce("pcu", F.lit(fallback)))


def unknown_types(obs: DataFrame, pcu: DataFrame) -> DataFrame:
    """The strict mode of ``with_pcu``: types without a value, which a caller may refuse."""
    return obs.select("vtype").distinct().join(sized(pcu), "vtype", "left_anti")


def movement_of_lane(lane: Column) -> Column:
    return F.when(lane == 0, "right").when(lane == 2, "left").otherwise("straight")


def with_movement(obs: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds movement from the route (array of edges) and ``edge``: the step that follows the approach edge, else the step
    after ``route_index``, else straight. An approach edge with a successor is final, whether the table knows it or not."""
    at = F.array_position("route", F.col("edge"))
    has = (at > 0) & (at < F.size("route"))
    own, other = F.try_element_at("route", (at + 1).cast("int")), F.try_element_at("route", F.col("route_index") + 2)
    here = F.try_element_at("route", F.col("route_index") + 1)
    keyed = obs.withColumn("_from", F.when(has, F.col("edge")).otherwise(here)).withColumn("_to", F.when(has, own).otherwise(other))
    t = sized(turns.select(F.col("from_edge").alias("_from"), F.col("to_edge").alias("_to"), "movement"))
    return keyed.join(t, ["_from", "_to"], "left").withColumn("movement", F.coalesce("movement", F.lit("straight"))).drop("_from", "_to")


def on_approaches(obs: DataFrame, approaches: DataFrame) -> DataFrame:
    """Rows on approach lanes, with node, signal, direction and lane index; other lanes go."""
    return obs.join(sized(approaches), "lane_id")


def direction_rollup(seen: DataFrame, halting: float = MODEL.halting_ms) -> DataFrame:
    """Counts, PCU, mean speed of moving vehicles, waiting and movement counts of rows with pcu and lane_index."""
    move = movement_of_lane(F.col("lane_index"))
    speed = F.when(F.col("speed_ms") >= halting, F.col("speed_ms") * 3.6)
    return seen.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("vehicle_count"),
        F.bround(F.sum(F.round(F.col("pcu") * 100).cast("long")) / F.lit(100.0), 2).alias("pcu_equivalent"),
        F.coalesce(F.bround(F.avg(speed), 1), F.lit(0.0)).alias("average_speed_kmh"),
        F.count_if(F.col("speed_ms") < halting).alias("waiting_vehicle_count"),
        F.count_if(move == "left").alias("left_count"),
        F.count_if(move == "straight").alias("straight_count"),
        F.count_if(move == "right").alias("right_count"),
    )


def class_composition(seen: DataFrame) -> DataFrame:
    """Share of each type at its grain, four digits, half-even; the quotient of whole numbers is rounded, so that ties are ties."""
    n = seen.groupBy(*GRAIN, "vtype").agg(F.count(F.lit(1)).alias("n"))
    return n.select(*GRAIN, "vtype", (F.bround(F.col("n") * 10000 / F.sum("n").over(Window.partitionBy(*GRAIN)), 0) / 10000).alias("share"))


def composition_map(seen: DataFrame) -> DataFrame:
    """The same as one sorted map a grain."""
    return class_composition(seen).groupBy(*GRAIN).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("vtype", "share")))).alias("composition"))


def queue_by_movement(seen: DataFrame, halting: float = MODEL.halting_ms, gap: float = MODEL.gap_m) -> DataFrame:
    """Queue lengths of halting vehicles by movement, their maximum, and the queue in vehicles."""
    move = movement_of_lane(F.col("lane_index"))
    own = lambda m: F.bround(F.coalesce(F.sum(F.when((F.col("speed_ms") < halting) & (move == m), F.col("length_m") + gap)), F.lit(0.0)), 1)
    q = seen.groupBy(*GRAIN).agg(own("left").alias("queue_left"), own("straight").alias("queue_straight"), own("right").alias("queue_right"), F.count_if(F.col("speed_ms") < halting).alias("waiting"))
    q = q.withColumn("queue_length_m", F.greatest("queue_left", "queue_straight", "queue_right"))
    return q.withColumn("queue_vehicles", M.queue_vehicles(F.col("queue_length_m"), F.col("waiting")))


def detector_queue(det: DataFrame, vehicle_queue: DataFrame) -> DataFrame:
    """Jam lengths by movement from detectors; where none of them is positive the vehicles' queue is used as a whole."""
    move = movement_of_lane(F.col("lane_index"))
    own = lambda m: F.coalesce(F.bround(F.sum(F.when(move == m, F.round(F.col("jam_length_m") * 100).cast("long"))) / F.lit(100.0), 1), F.lit(0.0))
    d = det.groupBy(*GRAIN).agg(own("left").alias("d_left"), own("straight").alias("d_straight"), own("right").alias("d_right"))
    use = F.greatest("d_left", "d_straight", "d_right") > 0
    pick = [F.when(use, F.col(f"d_{m}")).otherwise(F.coalesce(F.col(f"queue_{m}"), F.lit(0.0))).alias(f"queue_{m}") for m in ("left", "straight", "right")]
    joined = d.join(vehicle_queue.select(*GRAIN, "queue_left", "queue_straight", "queue_right"), GRAIN, "full")
    return joined.select(*GRAIN, *pick, F.coalesce(use, F.lit(False)).alias("from_detectors"))


def mixed_queue(seen: DataFrame, halting: float = MODEL.halting_ms) -> DataFrame:
    """Legacy queue and occupancy: motorcycles stand 2.5 abreast with a gap of 0.5 m."""
    moto = F.col("vtype") == "motorcycle"
    space = F.when(moto, (F.col("length_m") + 0.5) / 2.5).otherwise(F.col("length_m") + 1.5)
    return seen.groupBy(*GRAIN).agg(
        F.bround(F.coalesce(F.sum(F.when(F.col("speed_ms") < halting, space)), F.lit(0.0)), 1).alias("queue_length_m"),
        F.bround(F.least(F.lit(100.0), F.sum(space) / 100 * 100), 1).alias("occupancy_pct"),
    )


def occupancy(det: DataFrame, unit: str = "auto") -> DataFrame:
    return det.groupBy(*GRAIN).agg(F.bround(F.avg(M.occupancy_percent(F.col("occupancy_raw"), unit)), 1).alias("occupancy_pct"))


def occupancy_with_fallback(det: DataFrame, lane: DataFrame, signal: str = "node_id") -> DataFrame:
    """Detector occupancy where a signal has any detector reading at the time, lane occupancy elsewhere."""
    have = det.select("run_id", signal, "obs_t").distinct().withColumn("_have", F.lit(True))
    return occupancy(det).unionByName(occupancy(lane.join(have, ["run_id", signal, "obs_t"], "left_anti")))


def outbound_pressure(det: DataFrame, full: float = MODEL.spill_pressure) -> DataFrame:
    """Mean ratio of all outbound detectors of a node, and whether any is full."""
    r = M.pressure_ratio(F.col("occupancy_raw"))
    return det.groupBy("run_id", "node_id", "obs_t").agg(F.bround(F.avg(r), 3).alias("pressure"), F.bool_or(r >= full).alias("edge_full"))


def outbound_pressure_by_lane(det: DataFrame, full: float = MODEL.spill_pressure) -> DataFrame:
    """Mean over the lanes of each outgoing edge (here: direction), then the largest edge."""
    edge = det.groupBy("run_id", "node_id", "obs_t", "direction").agg(F.avg(M.pressure_ratio(F.col("occupancy_raw"))).alias("e"))
    return edge.groupBy("run_id", "node_id", "obs_t").agg(F.bround(F.max("e"), 3).alias("pressure"), F.bool_or(F.col("e") >= full).alias("edge_full"))


def legacy_spillback(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Largest PCU ratio over a node's outgoing edges (run_id, node_id, obs_t, length_m, pcu); ``blocked`` (same keys, n) counts vehicles stopped at entries and exits."""
    ratio = F.col("pcu") / (F.col("length_m") * 200 / 1000)
    e = edges.filter("length_m > 0").groupBy("run_id", "node_id", "obs_t").agg(F.max(ratio).alias("pressure"), F.bool_or(ratio >= 1.0).alias("edge_full"))
    b = blocked.groupBy("run_id", "node_id", "obs_t").agg(F.sum("n").alias("n"))
    return e.join(b, ["run_id", "node_id", "obs_t"], "left").select("run_id", "node_id", "obs_t", F.bround("pressure", 3).alias("pressure"), "edge_full", (F.col("edge_full") | (F.coalesce("n", F.lit(0)) > 0)).alias("spillback"))


def full_link_storage(seen: DataFrame, halting: float = MODEL.halting_ms, gap: float = MODEL.gap_m, space: float = MODEL.storage_m) -> DataFrame:
    """Jam, storage and utilisation over whole lanes, then over the approach."""
    stop = F.col("speed_ms") < halting
    lane = seen.groupBy(*GRAIN, "lane_index").agg(F.coalesce(F.sum(F.when(stop, F.col("length_m") + gap)), F.lit(0.0)).alias("jam"), F.count_if(stop).alias("halting"), F.max("lane_length_m").alias("len"), F.sum(F.round(F.col("pcu") * 100).cast("long")).alias("p"))
    a = lane.groupBy(*GRAIN).agg(F.max("jam").alias("jam"), F.sum("halting").alias("halting_count"), F.sum(F.col("len") / space).alias("st"), F.max(M.storage_utilisation(F.col("jam"), F.col("len"))).alias("u"), F.sum("p").alias("p"))
    return a.select(*GRAIN, F.bround("jam", 1).alias("full_link_jam_m"), "halting_count", F.bround("st", 2).alias("nominal_storage"), F.bround("u", 4).alias("utilisation"), F.bround(M.storage_utilisation_pcu(F.col("p") / F.lit(100.0), F.col("st")), 4).alias("utilisation_pcu"))


def waiting_reasons(rollup: DataFrame, colors: DataFrame) -> DataFrame:
    """All waiting vehicles wait for the signal on red or yellow, for congestion on green; ties go to RED_PHASE.

    An unknown phase index counts as green for North and South.
    """
    w, red = F.col("waiting_vehicle_count"), F.col("color").isin("red", "yellow")
    default = F.when(F.col("direction").isin("North", "South"), "green").otherwise("red")
    j = rollup.join(colors, ["phase_index", "direction"], "left").withColumn("color", F.coalesce("color", default))
    return j.select(*GRAIN, "color", F.when(red, w).otherwise(0).cast("long").alias("red_phase"), F.when(~red, w).otherwise(0).cast("long").alias("congestion"), F.when(w > 0, F.when(red, "RED_PHASE").otherwise("CONGESTION")).alias("dominant_waiting_reason"))


def moto_front_share(seen: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Share of motorcycles in the front zone; without a vehicle there, among the last fifth (one at least) in scan order."""
    w = Window.partitionBy(*GRAIN)
    front = M.position_ratio_at_least(F.col("lane_pos_m"), F.col("lane_length_m"), ratio)
    r = seen.select(*GRAIN, "vtype", front.alias("front"), F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(w.orderBy(F.col("lane_index").desc(), F.col("event_id").desc())).alias("rn"), F.count_if(front).over(w).alias("nf"))
    zone = r.filter("(nf > 0 AND front) OR (nf = 0 AND rn <= greatest(1, n div 5))")
    return zone.groupBy(*GRAIN).agg(F.bround(F.count_if(F.col("vtype") == "motorcycle") * F.lit(100.0) / F.count(F.lit(1)), 1).alias("moto_front_pct"))


def yellow_commitment(seen: DataFrame, phase: Column, ratio: float = 0.85) -> DataFrame:
    """Vehicles beyond ``ratio`` of their lane while the phase is a yellow one, over all directions of a node."""
    near = M.position_ratio_at_least(F.col("lane_pos_m"), F.col("lane_length_m"), ratio)
    return seen.groupBy("run_id", "node_id", "obs_t").agg(F.count_if(near & phase.contains("YELLOW")).alias("yellow_commitment"))


def blocked_at_entry(seen: DataFrame, boxes: DataFrame, ratio: float = 0.9, halting: float = MODEL.halting_ms) -> DataFrame:
    """Halting vehicles at the stop line of nodes whose box is blocked (run_id, node_id, obs_t, box_blocked); 0 elsewhere."""
    near = M.position_ratio_at_least(F.col("lane_pos_m"), F.col("lane_length_m"), ratio) & (F.col("speed_ms") < halting)
    n = seen.groupBy("run_id", "node_id", "obs_t").agg(F.count_if(near).alias("n"))
    return n.join(boxes, ["run_id", "node_id", "obs_t"], "left").select("run_id", "node_id", "obs_t", F.when(F.coalesce("box_blocked", F.lit(False)), F.col("n")).otherwise(0).cast("long").alias("blocked_at_entry"))


def arrivals(seen: DataFrame) -> DataFrame:
    """Vehicles that were not on the approach at the run's observation before: rows of ``seen`` with obs_seq and dt.

    Observations are numbered by dense_rank over the run's times; the table of times has a row an observation.
    """
    times = seen.select("run_id", "obs_t").distinct()
    w = Window.partitionBy("run_id").orderBy("obs_t")
    seq = times.select("run_id", "obs_t", F.row_number().over(w).alias("obs_seq"), (F.col("obs_t") - F.lag("obs_t").over(w)).alias("dt"))
    v = Window.partitionBy("run_id", "node_id", "direction", "vehicle_id").orderBy("obs_seq")
    r = seen.join(seq, ["run_id", "obs_t"]).withColumn("_last", F.lag("obs_seq").over(v))
    return r.filter("_last IS NULL OR _last <> obs_seq - 1").drop("_last")


def arrival_rate(new: DataFrame) -> DataFrame:
    """PCU of new vehicles a second, over the time since the observation before; none for the first."""
    p = F.sum(F.round(F.col("pcu") * 100).cast("long")) / F.lit(100.0)
    return new.filter("dt IS NOT NULL").groupBy(*GRAIN).agg(F.count(F.lit(1)).alias("new_vehicles"), F.bround(p / F.max("dt") * 3600, 3).alias("arrival_pcu_per_h"))


def per_second(per_hour: Column) -> Column:
    """A rate of three digits an hour as one of six digits a second, half-even; a quotient of whole numbers, so that ties are ties."""
    return F.bround(F.round(per_hour * 1000) * 5 / 18, 0) / 1000000


def vehicles_ahead(obs: DataFrame) -> DataFrame:
    """Adds the vehicle ahead in the lane and the gap to its rear."""
    w = Window.partitionBy("run_id", "node_id", "direction", "lane_index", "obs_t").orderBy(F.col("lane_pos_m").desc(), "event_id")
    return obs.withColumn("ahead", F.lag("vehicle_id").over(w)).withColumn("gap_m", F.bround(F.lag(F.col("lane_pos_m") - F.col("length_m")).over(w) - F.col("lane_pos_m"), 2))


def active_vehicles(rows: DataFrame, states: tuple[str, ...] | None = None) -> DataFrame:
    """Vehicles that have not left the network, or those in one of ``states``."""
    return rows.filter(F.col("state").isin(*states) if states else F.col("state") != "EXITED_NETWORK")


def legacy_speed(rows: DataFrame) -> DataFrame:
    """Mean speed of moving, congested and exit-blocked vehicles, slow ones too."""
    return active_vehicles(rows, ("MOVING", "CONGESTED", "BLOCKED_AT_EXIT")).groupBy(*GRAIN).agg(F.bround(F.avg(F.col("speed_ms") * 3.6), 1).alias("legacy_speed_kmh"))


def vehicle_totals(*parts: DataFrame) -> DataFrame:
    """Vehicles of a run over intersections and edges."""
    both = parts[0].select("run_id", "vehicle_id")
    for p in parts[1:]:
        both = both.union(p.select("run_id", "vehicle_id"))
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("vehicles"))


def snapshot_flags(pressures: DataFrame, threshold: float = MODEL.spill_pressure) -> DataFrame:
    """Spillback and box flags of a snapshot: an edge is full, or pressure reaches the threshold."""
    return pressures.withColumn("flagged", F.col("edge_full") | (F.col("pressure") >= threshold))


def signal_state(readings: DataFrame, names: DataFrame) -> DataFrame:
    """Phase name and whole seconds left of (…, phase_index, next_switch_s, sim_t); an unknown index is NS_GREEN."""
    j = readings.join(names.select("phase_index", "phase").distinct(), "phase_index", "left")
    return j.withColumn("phase", F.coalesce("phase", F.lit("NS_GREEN"))).withColumn("remaining_s", F.greatest(F.lit(0), (F.col("next_switch_s") - F.col("sim_t")).cast("int")))


def movement_by_sides(entry: Column, leave: Column) -> Column:
    """Movement from the sides a vehicle enters and leaves by, clockwise; back the way it came is straight."""
    order = F.array(*[F.lit(d) for d in ("North", "West", "South", "East")])
    turn = F.pmod(F.array_position(order, leave) - F.array_position(order, entry), F.lit(4))
    return F.when(turn == 1, "right").when(turn == 3, "left").otherwise("straight")


#: Nodes that allow a right turn on red, and the direction that it must give way to.
RIGHT_ON_RED, GIVES_WAY = ("A", "C"), {"North": "East", "East": "South", "South": "West", "West": "North"}


def free_right_turns(turns: DataFrame, vehicles: DataFrame, green: DataFrame, nodes: tuple[str, ...] = RIGHT_ON_RED, near: float = 0.95) -> DataFrame:
    """Right turns on red (run_id, node_id, obs_t, direction, ...) that may go: the node allows it and nothing comes.

    Something comes where the one direction that the turn gives way to is green (``green``: node_id, obs_t, direction) and a
    straight vehicle of it (``vehicles``: movement, ratio, state) moves, freely or in congestion, at ``near`` of its lane or
    beyond. A turn from no known direction gives way to none.
    """
    gives_way = F.element_at(F.create_map(*[F.lit(x) for pair in GIVES_WAY.items() for x in pair]), F.col("direction"))
    close = vehicles.filter((F.col("movement") == "straight") & (F.col("ratio") >= near) & F.col("state").isin("MOVING", "CONGESTED"))
    coming = close.join(green, ["node_id", "obs_t", "direction"], "left_semi").select("run_id", "node_id", "obs_t", F.col("direction").alias("_way")).distinct()
    allowed = turns.filter(F.col("node_id").isin(*nodes)).withColumn("_way", gives_way)
    return allowed.join(coming, ["run_id", "node_id", "obs_t", "_way"], "left_anti").drop("_way")

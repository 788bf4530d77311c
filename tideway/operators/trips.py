"""Trips: departures, arrivals, travel, waiting, stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trips(events: DataFrame) -> DataFrame:
    """Trip of each vehicle from (run_id, vehicle_id, kind, sim_t): a first sighting stands for a missing departure; no arrival or departure gives null travel."""
    at = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("sim_t")))
    t = events.groupBy("run_id", "vehicle_id").agg(at("DEPART", F.min).alias("d"), at("SEEN", F.min).alias("s"), at("ARRIVE", F.max).alias("arrive_s"))
    t = t.filter("arrive_s IS NOT NULL").withColumn("depart_s", F.coalesce("d", "s"))
    return t.select("run_id", "vehicle_id", F.bround("depart_s", 2).alias("depart_s"), F.bround("arrive_s", 2).alias("arrive_s"), F.bround(F.col("arrive_s") - F.col("depart_s"), 2).alias("travel_s"))


def trip_statistics(obs: DataFrame, halting: float = 0.1) -> DataFrame:
    """Travel, waiting, stops, distance and mean speed of each vehicle's readings, in one window and one aggregate over the same key."""
    w = Window.partitionBy("run_id", "vehicle_id").orderBy("sim_t", "event_id")
    stop = F.col("speed_ms") < halting
    r = obs.withColumn("_dt", F.lead("sim_t").over(w) - F.col("sim_t")).withColumn("_stop", stop).withColumn("_was", F.coalesce(F.lag(stop).over(w), F.lit(False)))
    g = r.groupBy("run_id", "vehicle_id").agg(
        F.count(F.lit(1)).alias("readings"),
        F.bround(F.max("sim_t") - F.min("sim_t"), 2).alias("travel_s"),
        F.bround(F.coalesce(F.sum(F.when(F.col("_stop"), F.col("_dt"))), F.lit(0.0)), 2).alias("waiting_s"),
        F.count_if(F.col("_stop") & ~F.col("_was")).alias("stop_count"),
        F.sum(F.col("speed_ms") * F.col("_dt")).alias("_m"),
        (F.max("sim_t") - F.min("sim_t")).alias("_s"),
    )
    return g.select("run_id", "vehicle_id", "readings", "travel_s", "waiting_s", "stop_count", F.bround(F.coalesce("_m", F.lit(0.0)) / F.greatest(F.col("_s"), F.lit(0.001)) * 3.6, 1).alias("mean_speed_kmh"))


def waiting_statistics(trip: DataFrame) -> DataFrame:
    return trip.groupBy("run_id").agg(F.coalesce(F.bround(F.avg("waiting_s"), 2), F.lit(0.0)).alias("mean_waiting_s"), F.coalesce(F.bround(F.max("waiting_s"), 2), F.lit(0.0)).alias("max_waiting_s"))


def last_rows(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """Bounded retention: the last ``most`` rows of each key (a feature, not a sample)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")


def tail(rows: DataFrame, order: list, most: int = 50) -> DataFrame:
    """The last ``most`` rows in order: a top-k of each partition, merged."""
    return rows.orderBy(*order).limit(most)


def arrival_on_green(obs: DataFrame, colors: DataFrame, ratio: float = 0.92) -> DataFrame:
    """Share of vehicles whose first reading beyond ``ratio`` of the lane meets green (colors: node_id, direction, obs_t, color)."""
    near = obs.filter(F.col("lane_pos_m") >= ratio * F.col("lane_length_m"))
    first = near.groupBy("run_id", "node_id", "direction", "vehicle_id").agg(F.min_by("obs_t", F.struct("sim_t", "event_id")).alias("obs_t"))
    j = first.join(colors, ["node_id", "direction", "obs_t"])
    return j.groupBy("run_id", "node_id").agg(F.count(F.lit(1)).alias("passed"), F.bround(F.count_if(F.col("color") == "green") / F.count(F.lit(1)), 4).alias("green_share"))


def trip_records(readings: DataFrame, keys: list[str], t: str = "sim_t", tie: str = "event_id") -> DataFrame:
    """A record of each trip (``keys``) from its readings (node_id, lane_pos_m, state, time).

    total_travel_time_sec from the first reading to the last; total_waiting_time_sec and segment_travel_times (by node, a
    map) by the state and node that a reading opens until the next; distance_traveled_m by advances within a node, a
    lane's start counting where the node changes; stop_count by entries into WAITING; intersections_visited in order of
    first visit; average_speed_kmh. Times are summed in microseconds and lengths in millimetres, so that sums do not
    depend on their order. Readings without a time are left out; a trip of one reading has no time, distance or speed.
    """
    w = Window.partitionBy(*keys).orderBy(t, tie)
    micros = lambda x: F.round(x * 1_000_000).cast("long")
    mm = F.round(F.col("lane_pos_m") * 1000).cast("long")
    before = F.lag(F.struct("node_id", mm.alias("mm"), "state")).over(w)
    r = readings.filter(F.col(t).isNotNull()).withColumns({"_us": micros(F.lead(t).over(w)) - micros(F.col(t)), "_mm": mm, "_before": before})
    moved = F.when(F.col("_before").isNull(), 0).when(F.col("_before.node_id").eqNullSafe(F.col("node_id")), F.greatest(F.lit(0), F.col("_mm") - F.col("_before.mm"))).otherwise(F.col("_mm"))
    waiting = F.col("state") == "WAITING"
    stops = waiting & ~F.coalesce(F.col("_before.state") == "WAITING", F.lit(False))
    by_node = r.groupBy(*keys, "node_id").agg(F.sum("_us").alias("us"), F.min(F.struct(t, tie)).alias("first"), F.sum(moved).alias("mm"), F.sum(F.when(waiting, F.col("_us"))).alias("waited"), F.count_if(stops).alias("stops"))
    visits = F.transform(F.sort_array(F.collect_list(F.struct("first", "node_id"))), lambda x: x["node_id"])  # a row a node of the trip
    seconds = F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_id", F.bround(F.coalesce("us", F.lit(0)) / 1_000_000, 2)))))
    known = by_node.groupBy(*keys).agg(F.sum("us").alias("us"), F.sum("waited").alias("waited"), F.sum("mm").alias("mm"), F.sum("stops").alias("stop_count"), visits.alias("intersections_visited"), seconds.alias("segment_travel_times"))
    us = F.coalesce("us", F.lit(0))
    speed = F.when(us > 0, F.bround(F.col("mm") / us * 3600, 1)).otherwise(F.lit(0.0))
    return known.select(*keys, F.bround(us / 1_000_000, 1).alias("total_travel_time_sec"), F.bround(F.coalesce("waited", F.lit(0)) / 1_000_000, 1).alias("total_waiting_time_sec"), F.bround(F.col("mm") / 1000, 1).alias("distance_traveled_m"), "stop_count", "intersections_visited", "segment_travel_times", speed.alias("average_speed_kmh"))

"""Demand and layout generators of the road network; ``graph`` has its paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideway import params as P


def demand_targets(spark: SparkSession) -> DataFrame:
    """(profile, source, target_vph) of the road network."""
    return spark.createDataFrame([(p, s, v) for p, targets in P.DEMAND.items() for s, v in targets.items()], "profile string, source string, target_vph int")


def demand_deltas(targets: DataFrame, baseline: int = 200) -> DataFrame:
    """Vehicles an hour that each profile adds to each source's baseline, and the seconds between insertions; never negative."""
    d = targets.select("profile", "source", "target_vph").withColumn("delta_vph", F.greatest(F.lit(0), F.col("target_vph") - baseline))
    return d.withColumn("interval_s", F.when(F.col("delta_vph") > 0, F.bround(F.lit(3600.0) / F.col("delta_vph"), 4)))


def insertions_due(deltas: DataFrame, horizon_s: float) -> DataFrame:
    """Insertions by the end of a horizon when none fails: one each interval. ``scans.token_bucket`` has those that fail."""
    return deltas.select("profile", "source", F.when(F.col("delta_vph") > 0, F.floor(F.lit(horizon_s) * F.col("delta_vph") / 3600)).otherwise(0).cast("long").alias("due"))


def flow_split(totals: DataFrame) -> DataFrame:
    """(source, total, vtype, vph) of (source, total): half-even parts, the drift to motorcycles, at least one of each special class.

    What is rounded is one row's business, so no row meets another.
    """
    classes = [(k, w, False) for k, w in P.CLASS_WEIGHTS.items()] + [(k, w, True) for k, w in P.SPECIAL_SHARES.items()]
    part = lambda w: F.bround(F.col("total") * w, 0).cast("int")
    drift = F.bround("total", 0).cast("int") - sum((part(w) for _, w, special in classes if not special), F.lit(0))
    vph = lambda k, w, special: F.greatest(F.lit(1), part(w)) if special else F.greatest(F.lit(0), part(w) + (drift if k == "motorcycle" else 0))
    each = F.array(*[F.struct(F.lit(k).alias("vtype"), vph(k, w, special).cast("int").alias("vph")) for k, w, special in classes])
    return totals.select("source", "total", F.inline(each))


def route_table(sources: DataFrame, diagonals: DataFrame, diagonal: float = 40.0) -> DataFrame:
    """All flows: every trunk source (source, from_edge, to_edge, total) by class, and the diagonals (flow, from_edge, to_edge, vtype), which share ``diagonal``."""
    split = flow_split(sources.select(F.struct("source", "from_edge", "to_edge").alias("source"), F.col("total").cast("double").alias("total"))).filter("vph > 0")
    flows = split.select(F.concat_ws("_", "source.source", "vtype").alias("flow"), "vtype", "source.from_edge", "source.to_edge", "vph")
    share = max(1, round(diagonal / max(1, diagonals.count())))
    return flows.unionByName(diagonals.select("flow", "vtype", "from_edge", "to_edge", F.lit(share).alias("vph")))


def destination_intervals(weights: DataFrame, profile: list[str], nodes: list[str], least: int = 100, absent: int = 500, parts: int = 64) -> DataFrame:
    """(profile, source, dest, lo, hi, total, part): where the running weight of each destination of a source lies, a row for each part of [0, 1) that it meets.

    ``weights``: (profile, source, dest, weight) in ten-thousandths, one row a pair at most; pairs without one weigh ``absent``,
    none weighs under ``least``, and a source's own node is no destination. ``nodes`` is the road network's list of
    boundary nodes; destinations stand in its order.
    """
    known = weights.filter(F.col("source").isin(*nodes) & F.col("dest").isin(*nodes) & F.col("weight").isNotNull())
    sources = known.select(*profile).distinct().withColumn("source", F.explode(F.array(*[F.lit(n) for n in nodes])))
    pairs = sources.select("*", F.posexplode(F.array(*[F.lit(n) for n in nodes])).alias("place", "dest"))
    weighed = pairs.filter("dest <> source").join(known, [*profile, "source", "dest"], "left").withColumn("w", F.greatest(F.lit(least), F.coalesce("weight", F.lit(absent))).cast("long"))
    own = Window.partitionBy(*profile, "source")  # a row for each node of the network
    summed = weighed.withColumns({"hi": F.sum("w").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(own)}).withColumn("lo", F.col("hi") - F.col("w"))
    part = lambda x: F.least(F.lit(parts - 1), F.floor(F.col(x) * parts / F.col("total"))).cast("int")
    return summed.select(*profile, "source", "dest", "lo", "hi", "total", F.explode(F.sequence(part("lo"), part("hi"))).alias("part"))


def weighted_destinations(trips: DataFrame, weights: DataFrame, profile: list[str], nodes: list[str], internal: list[str], branch: str, draw: str, inside: int = 1500, parts: int = 64) -> DataFrame:
    """``trips`` (profile, source, two draws of 0 to 9999) with ``dest``: an internal node for ``inside`` of the branch draws, else a boundary node by weight.

    The weights of a source are intervals of the second draw, met by an interval join: draws and intervals are cut into
    ``parts``, so a trip meets the one or two intervals of its part, and a source of many trips is spread over all parts.
    Trips of unknown sources, profiles or draws outside get no boundary destination.
    """
    at = F.floor(F.col(draw) * parts / 10000).cast("int")
    near = destination_intervals(weights, profile, nodes, parts=parts).select(*[F.col(c).alias(f"_{c}") for c in (*profile, "source", "dest", "lo", "hi", "total", "part")])
    same = (F.col("source") == F.col("_source")) & (at == F.col("_part")) & (F.col(draw) * F.col("_total") >= F.col("_lo") * 10000) & (F.col(draw) * F.col("_total") < F.col("_hi") * 10000)
    for c in profile:
        same = same & (F.col(c) == F.col(f"_{c}"))
    chosen = F.get(F.array(*[F.lit(n) for n in internal]), F.floor(F.col(branch) * len(internal) / inside).cast("int"))
    stays = F.col(branch) < inside
    outside = trips.filter(~F.coalesce(stays, F.lit(False))).join(near, same, "left").select(*trips.columns, F.col("_dest").alias("dest"))
    return trips.filter(stays).withColumn("dest", chosen).unionByName(outside)


def detector_layout(approaches: DataFrame, offset: float = 20.0, cover: float = 100.0, out_pos: float = 5.0, out_len: float = 30.0) -> DataFrame:
    """Detectors of all approach lanes (tls_id, direction, edge, lane_id, lane_index, length_m): a loop (E1) and an area (E2) on the approach, an area on the exit (E2OUT)."""
    code, length = F.substring("direction", 1, 1), F.col("length_m")
    back = F.concat(F.substring("edge", 3, 2), F.substring("edge", 1, 2))  # the way back of an approach leaves the node
    start = F.greatest(F.lit(0.1), length - cover)
    row = lambda name, kind, lane, pos, end: F.struct(name.alias("detector_id"), F.lit(kind).alias("kind"), lane.alias("lane_id"), pos.cast("double").alias("pos_m"), end.cast("double").alias("end_m"))
    one = row(F.concat_ws("_", F.lit("E1"), "tls_id", code, "lane_index"), "E1", F.col("lane_id"), F.greatest(F.lit(0.1), length - offset), F.lit(None))
    two = row(F.concat_ws("_", F.lit("E2"), "tls_id", code, "lane_index"), "E2", F.col("lane_id"), start, start + F.least(F.lit(cover), F.greatest(F.lit(1.0), length - start)))
    out = row(F.concat_ws("_", F.lit("E2OUT"), "tls_id", back, "lane_index"), "E2OUT", F.concat_ws("_", back, "lane_index"), F.lit(out_pos), F.lit(out_pos + out_len))
    return approaches.select(F.inline(F.array(one, two, out)))


def detectors_xml(layout: DataFrame) -> DataFrame:
    """One XML element a detector."""
    loop = F.format_string('<inductionLoop id="%s" lane="%s" pos="%.2f" freq="1" file="NUL"/>', "detector_id", "lane_id", "pos_m")
    area = F.format_string('<laneAreaDetector id="%s" lane="%s" pos="%.2f" endPos="%.2f" freq="1" file="NUL"/>', "detector_id", "lane_id", "pos_m", "end_m")
    return layout.select(F.when(F.col("kind") == "E1", loop).otherwise(area).alias("value"))


def routes_xml(flows: DataFrame, end_s: float = 3600.0) -> DataFrame:
    """One XML flow element for each flow (flow, vtype, from_edge, to_edge, vph), over ``end_s`` seconds."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return flows.select(F.format_string(f'<flow id="%s" type="%s" from="%s" to="%s" begin="0" end="{end_s:g}" vehsPerHour="%d" departLane="best" departSpeed="max"/>', escaped("flow"), escaped("vtype"), escaped("from_edge"), escaped("to_edge"), "vph").alias("value"))


def scenario_effects(spark: SparkSession) -> DataFrame:
    """What a scenario command sets: a demand profile, an overlay, or both."""
    rows = [("normal", "normal", None), ("morning_peak", "morning_peak", None), ("evening_peak", "evening_peak", None), ("oversaturated", "oversaturated", None), ("rain", "normal", "heavy_rain"), ("accident", None, "accident"), ("blocked_intersection", None, "blocked_intersection"), ("downstream_restriction", None, "downstream_restriction"), ("emergency", None, "emergency")]
    return spark.createDataFrame(rows, "scenario string, profile string, overlay_type string")


def approach_signals(approaches: DataFrame) -> DataFrame:
    """The signal of each approach edge; the first by name where several have it."""
    return approaches.groupBy("edge").agg(F.min("tls_id").alias("tls_id"))


def edge_lookups(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, length, found) of each different pair: the edge from one node to the next, and whether there is one; a pair without is an error of whoever asks, not of the job."""
    asked = pairs.select("src", "dst").distinct()
    return asked.join(edges.groupBy("src", "dst").agg(F.min("length").alias("length")), ["src", "dst"], "left").withColumn("found", F.col("length").isNotNull())


def nested_connections(connections: DataFrame) -> DataFrame:
    """Connections (tls_id, approach, from_lane, to_edge, link_index) of each signal and approach, in order; a null index is -1."""
    c = F.struct(F.coalesce("link_index", F.lit(-1)).alias("link_index"), "from_lane", "to_edge")
    return connections.groupBy("tls_id", "approach").agg(F.sort_array(F.collect_list(c)).alias("connections"))  # an approach has a few


def lane_length_sets(lanes: DataFrame) -> DataFrame:
    """Distinct lane lengths, two digits, of internal and external edges, in order."""
    return lanes.groupBy(F.col("edge").startswith(":").alias("internal")).agg(F.sort_array(F.collect_set(F.bround("length_m", 2))).alias("lengths"))

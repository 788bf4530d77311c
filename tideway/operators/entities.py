"""NGSI-LD entities: building them from snapshots, flattening them, and the aggregate of an intersection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import text as X
from tideway.params import BOUND

CONTEXT = ["run_id", "scenario", "sim_t"]


def prop(value: Column) -> Column:
    """A property; null stays out of the document."""
    return F.when(value.isNotNull(), F.struct(F.lit("Property").alias("type"), value.alias("value")))


def moment(value: Column) -> Column:
    """A property that holds a date-time."""
    return prop(F.when(value.isNotNull(), F.struct(F.lit("DateTime").alias("@type"), value.alias("@value"))))


def rel(target: Column) -> Column:
    return F.when(target.isNotNull(), F.struct(F.lit("Relationship").alias("type"), target.alias("object")))


def geo(lng: Column, lat: Column) -> Column:
    return F.struct(F.lit("GeoProperty").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")).alias("value"))


def bound(direction: Column) -> Column:
    out = F
    for d, b in BOUND.items():
        out = out.when(direction == d, b)
    return out.otherwise("OFF")


def _entity(rows: DataFrame, kind: str, name: Column, fields: dict[str, Column]) -> DataFrame:
    run = {"simulationRunId": prop(F.col("run_id")), "scenarioId": prop(F.col("scenario")), "simulationTime": prop(F.col("sim_t"))}
    doc = F.struct(X.to_urn(kind, name).alias("id"), F.lit(kind).alias("type"), *[c.alias(k) for k, c in {**fields, **run}.items()])
    return rows.select(X.to_urn(kind, name).alias("id"), F.lit(kind).alias("type"), *CONTEXT, F.to_json(doc).alias("doc"))


def given(rows: DataFrame, fields: dict[str, tuple[str, Column]]) -> dict[str, Column]:
    """The fields (name: (column, property)) whose column the rows have."""
    return {k: v for k, (c, v) in fields.items() if c in rows.columns}


def place(rows: DataFrame, name: Column) -> dict[str, Column]:
    """Name and location of rows with a street name and coordinates."""
    return given(rows, {"name": ("node_name", prop(name)), "location": ("lng", geo(F.col("lng"), F.col("lat")) if "lng" in rows.columns else F.lit(None))})


def vehicle_sensors(directions: DataFrame) -> DataFrame:
    """A sensor for each direction of a node, with what the snapshot says of it; measures that it lacks stay out."""
    b, n = bound(F.col("direction")), F.col("node_id")
    plain = {"leftTurnCount": "left_count", "straightCount": "straight_count", "rightTurnCount": "right_count", "queueLength": "queue_length_m", "queueStraight": "queue_straight", "queueLeft": "queue_left", "queueRight": "queue_right", "occupancyRate": "occupancy_pct"}
    plain |= {"arrivalRatePcuPerSec": "arrival_pcu_per_s", "theoreticalSpeed": "theoretical_speed_kmh", "dominantWaitingReason": "dominant_waiting_reason", "waitingReasonCounts": "waiting_reason_counts", "vehicleClassComposition": "composition"}
    plain |= {"derivedTrafficState": "state", "spillbackRisk": "spillback_risk", "operationalState": "operational_state"}
    more = given(directions, {k: (c, prop(F.col(c))) for k, c in plain.items()} | {"dateObserved": ("observed_at", moment(F.col("observed_at")))})
    return _entity(directions, "VehicleSensor", F.concat_ws(":", "node_id", b), {
        **place(directions, F.concat_ws(" ", "node_name", b, F.lit("approach")) if "node_name" in directions.columns else F.lit(None)), **more,
        "sensorType": prop(F.lit("VIRTUAL")), "refCamera": rel(X.to_urn("Camera", n)), "refTrafficLight": rel(X.to_urn("TrafficLight", F.concat_ws("-", n, "direction"))),
        "trafficDirection": prop(b), "sensorStatus": prop(F.lit("OK")), "refIntersection": rel(X.to_urn("Intersection", F.col("node_id"))),
        "vehicleCount": prop(F.col("vehicle_count")), "pcuEquivalent": prop(F.col("pcu_equivalent")), "averageSpeed": prop(F.col("average_speed_kmh")),
        "waitingVehicleCount": prop(F.col("waiting_vehicle_count")), "trafficStatus": prop(F.col("traffic_status")),
    })


def traffic_lights(directions: DataFrame, green: int = 42, yellow: int = 3) -> DataFrame:
    """A light for each direction; a duration of 0 or null takes the default."""
    or_default = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(d))
    red = F.coalesce(F.nullif(F.col("red_s"), F.lit(0)), or_default("green_s", green)) if "red_s" in directions.columns else or_default("green_s", green)
    return _entity(directions, "TrafficLight", F.concat_ws("-", "node_id", "direction"), {
        **place(directions, F.concat_ws(" ", "node_name", bound(F.col("direction"))) if "node_name" in directions.columns else F.lit(None)),
        "timingMode": prop(F.lit("FIXED_TIME")), "workingState": prop(F.lit("OK")), "redDurationCurrent": prop(red), "refCamera": rel(X.to_urn("Camera", F.col("node_id"))),
        "currentStatus": prop(F.when(F.lower("color").isin("green", "yellow", "red"), F.upper("color")).otherwise("OFF")), "currentPhase": prop(F.col("phase")), "trafficDirection": prop(bound(F.col("direction"))),
        "greenDurationCurrent": prop(or_default("green_s", green)), "yellowDuration": prop(or_default("yellow_s", yellow)), "refIntersection": rel(X.to_urn("Intersection", F.col("node_id"))),
    })


def cameras(nodes: DataFrame) -> DataFrame:
    return _entity(nodes, "Camera", F.col("node_id"), {
        "trafficDirection": prop(F.lit("ALL_DIRECTIONS")), "vehicleCount": prop(F.col("vehicle_count")), "averageSpeed": prop(F.col("average_speed_kmh")),
        "trafficStatus": prop(F.col("traffic_status")), "confidence": prop(F.lit(1.0)), "incidentDetected": prop(F.coalesce(F.col("incident"), F.lit(False))),
        "refIntersection": rel(X.to_urn("Intersection", F.col("node_id"))),
    })


def intersections(nodes: DataFrame) -> DataFrame:
    """The node itself, with its children's ids and its first cause, if any."""
    n = F.col("node_id")
    ids = lambda kind, sep, names: F.transform(F.array(*[F.lit(x) for x in names]), lambda d: F.concat(F.lit(f"urn:ngsi-ld:{kind}:"), n, F.lit(sep), d))
    plain = {"hasSpillback": "spillback_active", "isBoxBlocked": "box_blocked", "currentPhase": "phase", "causeDetectedAt": "cause_detected_at"}
    more = given(nodes, {k: (c, prop(F.col(c))) for k, c in plain.items()}) | given(nodes, {"affectedBy": ("cause_node", rel(X.to_urn("Intersection", F.col("cause_node"))) if "cause_node" in nodes.columns else F.lit(None))})
    return _entity(nodes, "Intersection", n, {
        **place(nodes, F.col("node_name") if "node_name" in nodes.columns else F.lit(None)), **more,
        "intersectionStatus": prop(F.lit("ACTIVE")), "hasActiveIncident": prop(F.coalesce(F.col("incident"), F.lit(False))), "numberOfApproaches": prop(F.lit(4)), "overallTrafficStatus": prop(F.col("traffic_status")),
        "frequentCongestion": prop(F.col("traffic_status").isin("HEAVY", "CONGESTED")), "totalVehicleCount": prop(F.col("vehicle_count")), "derivedTrafficState": prop(F.col("state")),
        "refTrafficLights": rel(ids("TrafficLight", "-", BOUND)), "refVehicleSensors": rel(ids("VehicleSensor", ":", BOUND.values())),
        "refCameras": rel(F.array(X.to_urn("Camera", n))), "probableCauseType": prop(F.col("cause_type")),
    })


def fan_out(nodes: DataFrame, directions: DataFrame) -> DataFrame:
    """The ten entities of each node snapshot: one intersection, one camera, four lights, four sensors."""
    return intersections(nodes).unionByName(cameras(nodes)).unionByName(traffic_lights(directions)).unionByName(vehicle_sensors(directions))


def attributes_only(doc: Column) -> Column:
    """An entity document without id and type: what an update of its attributes sends. No object: null."""
    d = F.from_json(doc, "map<string, variant>")
    return F.to_json(F.map_filter(d, lambda k, v: ~k.isin("id", "type")))


def of_type(docs: DataFrame, doc: Column, kind: str) -> DataFrame:
    """Documents of one type; where the rows say it in a column, Spark drops the others before any JSON is made or read."""
    return docs.filter((F.col("type") if "type" in docs.columns else F.get_json_object(doc, "$.type")) == kind)


def flatten_sensor(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """A flat row of each VehicleSensor document; wrong JSON kinds are null."""
    d = F.col(doc)
    return of_type(docs, d, "VehicleSensor").select(
        F.get_json_object(d, "$.id").alias("id"), X.from_urn(F.get_json_object(d, "$.id")).alias("sensor"), X.attr(d, "trafficDirection").alias("traffic_direction"),
        X.number_attr(d, "vehicleCount", "int").alias("vehicle_count"), X.number_attr(d, "pcuEquivalent").alias("pcu_equivalent"), X.number_attr(d, "averageSpeed").alias("average_speed"),
        X.number_attr(d, "waitingVehicleCount", "int").alias("waiting_vehicle_count"), X.attr(d, "trafficStatus").alias("traffic_status"), X.attr(d, "name").alias("name"),
        *[X.number_attr(d, a, "int").alias(c) for a, c in (("leftTurnCount", "left_count"), ("straightCount", "straight_count"), ("rightTurnCount", "right_count"))],
        *[X.number_attr(d, a).alias(c) for a, c in (("queueLength", "queue_length"), ("queueStraight", "queue_straight"), ("queueLeft", "queue_left"), ("queueRight", "queue_right"), ("occupancyRate", "occupancy_rate"), ("theoreticalSpeed", "theoretical_speed"))],
        X.number_attr(d, "arrivalRatePcuPerSec").alias("arrival_rate"), X.attr(d, "dominantWaitingReason").alias("dominant_waiting_reason"), X.map_attr(d, "waitingReasonCounts", "int").alias("waiting_reason_counts"), X.map_attr(d, "vehicleClassComposition").alias("composition"),
        X.attr(d, "operationalState").alias("operational_state"), X.time_attr(d, "dateObserved").alias("date_observed"),
        X.attr(d, "derivedTrafficState").alias("state"), X.bool_attr(d, "spillbackRisk").alias("spillback_risk"), F.get_json_object(d, "$.location.value.coordinates[1]").cast("double").alias("latitude"),
        F.get_json_object(d, "$.refTrafficLight.object").alias("ref_light"), F.get_json_object(d, "$.refCamera.object").alias("ref_camera"),
        F.get_json_object(d, "$.refIntersection.object").alias("ref_intersection"), X.number_attr(d, "simulationTime").alias("simulation_time"), X.attr(d, "simulationRunId").alias("run_id"),
    )


def flatten_intersection(docs: DataFrame, doc: str = "doc") -> DataFrame:
    d = F.col(doc)
    return of_type(docs, d, "Intersection").select(
        F.get_json_object(d, "$.id").alias("id"), X.attr(d, "overallTrafficStatus").alias("overall_traffic_status"), X.number_attr(d, "totalVehicleCount", "int").alias("total_vehicle_count"),
        X.bool_attr(d, "frequentCongestion").alias("frequent_congestion"), X.refs_attr(d, "refTrafficLights").alias("lights"), X.refs_attr(d, "refVehicleSensors").alias("sensors"), X.refs_attr(d, "refCameras").alias("cameras"),
        X.attr(d, "name").alias("name"), X.attr(d, "currentPhase").alias("phase"), X.bool_attr(d, "hasSpillback").alias("has_spillback"), X.bool_attr(d, "isBoxBlocked").alias("is_box_blocked"), X.bool_attr(d, "hasActiveIncident").alias("has_active_incident"),
        X.attr(d, "derivedTrafficState").alias("state"), X.attr(d, "probableCauseType").alias("cause_type"), F.get_json_object(d, "$.affectedBy.object").alias("affected_by"), X.number_attr(d, "causeDetectedAt").alias("cause_detected_at"), X.number_attr(d, "simulationTime").alias("simulation_time"), X.attr(d, "simulationRunId").alias("run_id"),
    )


def flatten_light(docs: DataFrame, doc: str = "doc") -> DataFrame:
    d = F.col(doc)
    return of_type(docs, d, "TrafficLight").select(
        F.get_json_object(d, "$.id").alias("id"), X.attr(d, "currentStatus").alias("current_status"), X.attr(d, "currentPhase").alias("current_phase"), X.number_attr(d, "greenDurationCurrent", "int").alias("green_s"),
        X.number_attr(d, "yellowDuration", "int").alias("yellow_s"), X.number_attr(d, "redDurationCurrent", "int").alias("red_s"), X.attr(d, "timingMode").alias("timing_mode"), X.attr(d, "workingState").alias("working_state"), X.attr(d, "name").alias("name"), F.get_json_object(d, "$.refIntersection.object").alias("ref_intersection"), X.number_attr(d, "simulationTime").alias("simulation_time"), X.attr(d, "simulationRunId").alias("run_id"),
    )


def flatten_camera(docs: DataFrame, doc: str = "doc") -> DataFrame:
    d = F.col(doc)
    return of_type(docs, d, "Camera").select(
        F.get_json_object(d, "$.id").alias("id"), X.number_attr(d, "vehicleCount", "int").alias("vehicle_count"), X.number_attr(d, "averageSpeed").alias("average_speed"), X.number_attr(d, "confidence").alias("confidence"),
        X.bool_attr(d, "incidentDetected").alias("incident_detected"), F.get_json_object(d, "$.refIntersection.object").alias("ref_intersection"), X.number_attr(d, "simulationTime").alias("simulation_time"), X.attr(d, "simulationRunId").alias("run_id"),
    )


def intersection_aggregate(crossings: DataFrame, children: DataFrame) -> DataFrame:
    """Each intersection with the children that its references name, and how many it lacks (strict readers want none)."""
    refs = crossings.select(F.col("id").alias("parent"), F.explode(F.concat("lights", "sensors", "cameras")).alias("ref"))
    j = refs.join(children.select(F.col("id").alias("ref"), "doc"), "ref", "left")
    return j.groupBy("parent").agg(F.sort_array(F.collect_list(F.when(F.col("doc").isNotNull(), F.struct("ref", "doc")))).alias("children"), F.count_if(F.col("doc").isNull()).alias("missing"))


def by_id(entities: DataFrame, kind: str, name: str) -> DataFrame:
    """Point read by short id or URN."""
    return entities.filter(F.col("id") == X.to_urn(kind, F.lit(name)))


def by_type(entities: DataFrame, kind: str, most: int = 1000) -> DataFrame:
    """All of a type up to the read limit of the interface, by id."""
    return entities.filter(F.col("type") == kind).orderBy("id").limit(most)

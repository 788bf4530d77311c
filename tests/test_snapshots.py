"""Hand-made rows of gates, trips, overlays and snapshots: nulls, repeats, empty tables."""

from pyspark.sql import functions as F

from tideway import params as P
from tideway.operators import entities as E
from tideway.operators import observation as O
from tideway.operators import overlays as L
from tideway.operators import quality as Q
from tideway.operators import trips as T


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_free_right_turns(spark):
    """At A the turn from North gives way to East: only to its green, its straight traffic, close and moving. B allows none."""
    turns = spark.createDataFrame([("r", n, 0.0, d, k) for k, (n, d) in enumerate([("A", "North"), ("A", "East"), ("B", "North"), ("C", "North"), ("C", "West"), ("A", None)])], "run_id string, node_id string, obs_t double, direction string, k int")
    v = lambda n, d, move="straight", ratio=0.96, state="MOVING": ("r", n, 0.0, d, move, ratio, state)
    cars = [v("A", "East"), v("A", "South", "left"), v("A", "South", ratio=0.9), v("A", "South", state="WAITING"), v("C", "East"), v("C", "North", state="CONGESTED")]
    vehicles = spark.createDataFrame(cars, "run_id string, node_id string, obs_t double, direction string, movement string, ratio double, state string")
    green = spark.createDataFrame([("A", 0.0, "East"), ("A", 0.0, "South"), ("C", 0.0, "North")], "node_id string, obs_t double, direction string")
    assert sorted(r.k for r in O.free_right_turns(turns, vehicles, green).collect()) == [1, 3, 5]
    assert sorted(r.k for r in O.free_right_turns(turns, vehicles.limit(0), green).collect()) == [0, 1, 3, 4, 5]


def test_requested_overlays(spark):
    asked = [
        (1, "accident", "A", "East", "incoming_approach", None, None), (2, "accident", "A", "West", "downstream_exit", None, None), (3, "accident", "C", None, None, None, None), (4, "heavy_rain", "A", "North", None, None, None),
        (5, "heavy_rain", "D", "North", None, None, None), (6, "emergency", "B", "North", None, "J1J2", None), (7, "accident", "B", "North", None, None, ["X_2"]), (8, "fog", "A", "North", None, None, None), (9, "accident", None, "North", None, None, None), (10, "accident", "A", "North", "up", None, None),
        (11, "accident", "A", "North", "downstream_exit", None, None),
    ]
    df = spark.createDataFrame(asked, "k int, overlay_type string, node_id string, direction string, role string, target_edge string, target_lanes array<string>")
    got = {r.k: (r.edge, r.lanes, r.error) for r in L.requested_overlays(df, P.links(spark), P.approaches(spark)).collect()}
    three = lambda *edges: [f"{e}_{i}" for e in edges for i in range(3)]
    assert got == {
        1: ("J2J1", three("J2J1"), None), 2: ("J1J2", three("J1J2"), None), 3: ("N1J3", three("N1J3"), None), 4: (None, three("J1J3", "J3J1"), None), 5: (None, three("J3J4", "J4J3"), None),
        6: ("J1J2", three("J1J2"), None), 7: ("X", ["X_2"], None), 8: (None, None, "type"), 9: (None, None, "node"), 10: (None, None, "role"), 11: ("J1S1", three("J1S1"), None),
    }


def test_emergency_status(spark):
    inserted = spark.createDataFrame([("r", "v1", "A", 5.0), ("r", "v2", "A", 5.0), ("r", "v3", "B", 25.0), ("r", "v4", "A", 99.0)], "run_id string, vehicle_id string, node_id string, inserted_s double")
    s = [("v1", "C", True, 10.0), ("v1", "A", True, 20.0), ("v1", "A", True, 40.0), ("v2", "A", False, 10.0), ("v2", "A", True, 30.0), ("v3", "B", True, 10.0), ("v3", "B", None, 30.0), ("v3", "B", False, 40.0)]
    sightings = spark.createDataFrame([("r", *x) for x in s], "run_id string, vehicle_id string, node_id string, on_approach boolean, tick_s double")
    ticks = spark.createDataFrame([("r", float(t)) for t in (10, 20, 30, 40)], "run_id string, tick_s double")
    got = rows(L.emergency_status(inserted, sightings, ticks))
    # v1 is seen before it is lost at 30, v2 is lost at 20 before it is near, v3 is never near after its insertion, v4 comes after the last look
    assert got == {("r", "v1", "A", 5.0, True, True, 30.0), ("r", "v2", "A", 5.0, False, True, 20.0), ("r", "v3", "B", 25.0, False, False, None), ("r", "v4", "A", 99.0, False, False, None)}


def test_trip_records(spark):
    r = [("a", 1, 0.0, "X", 10.0, "MOVING"), ("a", 2, 2.5, "X", 60.0, "WAITING"), ("a", 3, 4.0, "X", 55.0, "WAITING"), ("a", 4, 10.0, "Y", 20.0, "MOVING"), ("a", 5, 10.0, "X", 5.0, "WAITING"), ("b", 6, 1.0, "X", 5.0, "WAITING"), ("b", 7, None, "X", 5.0, "WAITING")]
    df = spark.createDataFrame(r, "vehicle_id string, event_id long, sim_t double, node_id string, lane_pos_m double, state string")
    got = {x.vehicle_id: tuple(x)[1:] for x in T.trip_records(df, ["vehicle_id"]).collect()}
    assert got == {"a": (10.0, 7.5, 75.0, 2, ["X", "Y"], {"X": 10.0, "Y": 0.0}, 27.0), "b": (0.0, 0.0, 0.0, 1, ["X"], {"X": 0.0}, 0.0)}
    assert T.trip_records(df.limit(0), ["vehicle_id"]).collect() == []


def test_network_and_spacing_gates(spark):
    lanes = [("n", "e1", True, "l1", 460.0, 15.0), ("n", "e1", True, "l2", 470.0, 14.0), ("n", "e9", False, "l3", 200.0, 15.0), ("m", "e1", False, "l4", 300.0, 15.0)]
    df = spark.createDataFrame(lanes, "network string, edge string, internal boolean, lane_id string, length_m double, speed_ms double")
    need = spark.createDataFrame([("n", "e1"), ("n", "e2"), ("m", "e1")], "network string, edge string")
    assert rows(Q.network_gate(df, need, 15.0)) == {("n", "missing_edge", "e2", None), ("n", "unexpected_edge", "e9", None), ("n", "speed", "l2", 14.0), ("n", "length_external", None, 200.0), ("n", "free_flow_external", None, 13.33), ("m", "no_internal", None, None)}
    nodes = spark.createDataFrame([("n", "J1", 0.0, 0.0), ("n", "J2", 500.0, 3.0), ("n", "W1", -299.0, 0.0)], "network string, node string, x double, y double")
    pairs = [("J1", "J2", 500.0, None), ("J1", "W1", -300.0, None), ("J1", "J3", None, 500.0)]
    assert rows(Q.spacing_gate(nodes, pairs)) == {("n", "spacing", "J1-W1", -299.0, 0.0), ("n", "missing", "J1-J3", None, None)}


def test_attributes_only(spark):
    docs = ['{"id":"x","type":"Camera","a":{"value":[1,null]},"b":"é"}', '{"id":"x"}', None, "{broken"]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, doc string")
    assert {r.k: r.b for r in df.select("k", E.attributes_only(F.col("doc")).alias("b")).collect()} == {0: '{"a":{"value":[1,null]},"b":"é"}', 1: "{}", 2: None, 3: None}


def test_node_snapshots_without_overlays_and_causes(spark):
    nodes = spark.createDataFrame([("r", "A", 0.0, "STABLE", True, None, False)], "run_id string, node_id string, obs_t double, state string, spillback_active boolean, spillback_risk boolean, box_blocked boolean")
    sides = spark.createDataFrame([("r", "A", 0.0, "North", "BUSY", 16.0, 2.0)], "run_id string, node_id string, obs_t double, direction string, state string, queue_length_m double, pcu_equivalent double")
    active = spark.createDataFrame([], "run_id string, node_id string, obs_t double, overlay_id long, overlay_type string")
    causes = spark.createDataFrame([], "run_id string, node_id string, obs_t double, cause_type string, source_node string, observed_to_s double, event_id long, overlay_id long")
    (s,) = L.node_snapshots(nodes, sides, active, causes).collect()
    assert (s.directions["North"].traffic_state, s.aggregate_traffic_state, tuple(s.derived_phenomena), tuple(s.operational_state), s.active_overlay_ids, s.probable_causes) == ("BUSY", "STABLE", (True, False, False), (False, False, False), [], [])

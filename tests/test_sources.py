"""File sources and sinks, retention and gates on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tideway import params as P
from tideway.operators import network as N
from tideway.operators import observation as O
from tideway.operators import quality as Q
from tideway.operators import trips as T
from tideway.sources import files
from tideway.streaming import flows


def test_parameters(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    tree = {"gap": {"value": 1.5, "unit": "m", "source_type": "measured", "calibrated": True}, "demand": {"peak": {"value": None}, "low": {"value": 0, "unit": "vph"}}, "note": "none"}
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(tree))
    read = files.parameters(str(tmp_path / "p.yaml"))
    assert read == tree
    assert {tuple(r) for r in files.parameter_rows(spark, read).collect()} == {("gap", "1.5", "m", "measured", True), ("demand.peak", "None", None, None, None), ("demand.low", "0", "vph", None, None)}


def test_catalog_and_samples(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"edges": [{"id": "e1", "numLanes": 3}], "name": "ü"}, indent=1))
    (row,) = files.catalog(spark, str(tmp_path / "c.json")).collect()
    assert (row.name, row.edges[0].id, row.edges[0].numLanes) == ("ü", "e1", 3)
    (tmp_path / "s.csv").write_text("a;b\n1;x y\n;z\n")
    assert [tuple(r) for r in files.samples(spark, str(tmp_path / "s.csv")).collect()] == [("1", "x y"), (None, "z")]


def test_subscription(spark):
    docs = ['{"id":"1","type":"Camera","simulationTime":{"value":2.5},"simulationRunId":{"value":"r"}}', '{"id":"2","type":"Truck"}', "{broken", None]
    got = files.subscribed(spark.createDataFrame([(d,) for d in docs], "doc string")).collect()
    assert [(r.id, r.type, r.sim_t, r.run_id) for r in got] == [("1", "Camera", 2.5, "r")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "A", 2.0), ("r1", "A", 1.0), ("r2", "B", None)], "run_id string, node_id string, sim_t double")
    for _ in range(2):
        files.append_log(rows, str(tmp_path / "log"))
        files.store(rows, str(tmp_path / "store"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.count() == 6 and back.filter("run_id = 'r1' AND node_id = 'A'").count() == 4
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.is_dir()) == ["run_id=r1", "run_id=r2"]


def test_tail_and_programs(spark):
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("k"))
    assert [r.id for r in T.tail(rows, [F.desc("k"), F.desc("id")], 3).collect()] == [195, 188, 181]
    programs = spark.createDataFrame([("J1", [42, 3]), ("J2", [42, 4]), ("J3", [42])], "tls_id string, durations array<int>")
    assert {r.tls_id for r in Q.program_gate(programs, [42, 3]).collect()} == {"J2", "J3"}


def test_scenarios(spark):
    known = {r.scenario: (r.profile, r.overlay_type) for r in N.scenario_effects(spark).collect()}
    assert known["rain"] == ("normal", "heavy_rain") and known["accident"] == (None, "accident")
    assert {p for p, _ in known.values() if p} == set(P.DEMAND) and {o for _, o in known.values() if o} == set(P.OVERLAY_PRIORITY)


def test_unknown_types_count_as_a_car(spark):
    seen = spark.createDataFrame([("bus",), ("spaceship",), (None,)], "vtype string")
    assert {r.vtype: r.pcu for r in O.with_pcu(seen, P.pcu(spark)).collect()} == {"bus": 2.5, "spaceship": 1.0, None: 1.0}


def test_latest_state_stream(spark, tmp_path):
    schema = "id string, sim_t double, q double"
    for part in ([("a", 1.0, 5.0), ("b", 1.0, 6.0)], [("a", 3.0, 7.0)], [("a", 2.0, 9.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flows.latest_state(stream, "id", "sim_t").writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.id: (r.r.sim_t, r.r.q) for r in spark.table("latest").collect()} == {"a": (3.0, 7.0), "b": (1.0, 6.0)}


def test_arrival_stream(spark, tmp_path):
    schema = "run_id string, node_id string, direction string, sim_t double, pcu double"
    for part in ([("r", "A", "North", 0.1, 1.0), ("r", "A", "North", 0.9, 2.0)], [("r", "A", "North", 1.5, 1.0)], [("r", "A", "North", 60.0, 1.0)], [("r", "A", "North", 90.0, 1.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = flows.arrival_buckets(stream).writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {int(r.window.start.timestamp()) - flows.ORIGIN: (r.arrivals, r.pcu) for r in spark.table("arrived").collect()}
    assert got[0] == (2, 3.0) and got[1] == (1, 1.0)


def test_network_files(spark, tmp_path):
    """Detectors and flows as XML elements that a parser reads back."""
    import xml.etree.ElementTree as ET

    a = P.approaches(spark).withColumn("length_m", F.lit(470.0))
    layout = N.detector_layout(a)
    elements = [ET.fromstring(r.value) for r in N.detectors_xml(layout).collect()]
    assert len(elements) == 3 * a.count() and {e.tag for e in elements} == {"inductionLoop", "laneAreaDetector"}
    loop = next(e for e in elements if e.get("id") == "E1_J1_N_0")
    assert (loop.get("lane"), loop.get("pos")) == ("J3J1_0", "450.00")
    sources = spark.createDataFrame([(*s, 200.0) for s in P.SOURCES], "source string, from_edge string, to_edge string, total double")
    flows_ = N.route_table(sources, spark.createDataFrame(P.DIAGONALS, "flow string, from_edge string, to_edge string, vtype string"))
    xml = [ET.fromstring(r.value) for r in N.routes_xml(flows_).collect()]
    total = sum(float(e.get("vehsPerHour")) for e in xml if e.get("id").startswith("ns_w_") and e.get("type") in P.CLASS_WEIGHTS)
    assert total == 200 and len({e.get("id") for e in xml}) == len(xml) == flows_.count()


def test_strict_types_and_counted_broadcasts(spark):
    from tideway.operators.scans import sized

    seen = spark.createDataFrame([("bus",), ("spaceship",), ("spaceship",), ("car",)], "vtype string")
    assert [r.vtype for r in O.unknown_types(seen, P.pcu(spark)).collect()] == ["spaceship"]
    plan = lambda most: spark.range(1000).join(sized(spark.range(10), most), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(10) and "broadcast" not in plan(9)

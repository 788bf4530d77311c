"""Streams over several micro-batches and restarts."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tideway.sources.notifications import NotificationSource
from tideway.streaming import flows, stateful

ARRIVALS = "run_id string, node_id string, direction string, sim_t double, pcu double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark, path, batches, schema):
    """A stream with a micro-batch for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return flows.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), delay="0 seconds")


def output(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name).collect()


def test_arrivals_carry_over(spark, tmp_path):
    """An empty second, arrivals for a later second, a late row, and an approach that is forgotten."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        a = lambda t, pcu=1.0, d="North": ("r", "A", d, t, pcu)
        batches = [[a(0.2), a(0.9, 2.0), a(2.5), a(0.1, None, "South")], [a(2.7, 0.5), a(4.1)], [a(1.5), a(4.2, 3.0)], [a(9.0)], [a(30.0), a(30.0, 1.0, "South")], [a(31.0, 1.0, "West")]]
        got = output(spark, stateful.carried_arrivals(source(spark, str(tmp_path / "in"), batches, ARRIVALS), idle=5), "carried", tmp_path)
        north = sorted((r.bucket, r.arrivals, r.pcu) for r in got if r.direction == "North")
        # the row of 1.5 s came when the watermark stood at 4.1; after 5 empty seconds nothing is told until the next arrival
        assert north[:10] == [(0, 2, 3.0), (1, 0, 0.0), (2, 2, 1.5), (3, 0, 0.0), (4, 2, 4.0), (5, 0, 0.0), (6, 0, 0.0), (7, 0, 0.0), (8, 0, 0.0), (9, 1, 1.0)]
        assert north[10:15] == [(k, 0, 0.0) for k in range(10, 15)]
        assert north[15:] == [(30, 1, 1.0)]
        assert sorted((r.bucket, r.arrivals, r.pcu) for r in got if r.direction == "South" and r.bucket < 10)[0] == (0, 1, 0.0)
        assert len({(r.direction, r.bucket) for r in got}) == len(got)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_siblings_get_a_second_look(spark, tmp_path):
    schema = "run_id string, id string, refs array<string>, sim_t double"
    p = lambda t: ("r", "I", ["c1", "c2", "c3", "c1"], t)
    parents = source(spark, str(tmp_path / "p"), [[p(10.0)], [p(20.0)], [p(90.0)], [p(200.0)], [p(300.0)]], schema)
    c = lambda k, t: ("r", k, None, t)
    # c2 of 10.0 comes a batch later; c3 has no own row at 10.0 but a newer one within the delay, and none at all at 20.0
    children = source(spark, str(tmp_path / "c"), [[c("c1", 10.0)], [c("c2", 10.0), c("c3", 10.5), c("c3", 10.8), c("c1", 20.0), c("c2", 20.0)], [c("c1", 90.0)], [c("c1", 200.0)], [c("c1", 300.0)]], schema)
    got = output(spark, stateful.sibling_reads(parents, children.drop("refs"), "1 second"), "looks", tmp_path)
    at = {(int(r.sim_ts.timestamp()) - flows.ORIGIN, r.child): (r.look, None if r.child_ts is None else r.child_ts.timestamp() - flows.ORIGIN) for r in got}
    assert {k: v for k, v in at.items() if k[0] < 90} == {(10, "c1"): (1, 10.0), (10, "c2"): (1, 10.0), (10, "c3"): (2, 10.5), (20, "c1"): (1, 20.0), (20, "c2"): (1, 20.0), (20, "c3"): (None, None)}


def notification(n, *entities):
    return json.dumps({"id": f"n{n}", "type": "Notification", "subscriptionId": "s", "notifiedAt": "t", "data": list(entities)})


def entity(k, kind, t=1.5):
    return {"id": k, "type": kind, "simulationTime": {"type": "Property", "value": t}, "simulationRunId": {"type": "Property", "value": {"@type": "x", "@value": "r"}}}


@pytest.fixture(scope="module")
def registered(spark):
    spark.dataSource.register(NotificationSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    (folder / f".{name}").write_text("\n".join(lines))
    os.rename(folder / f".{name}", folder / name)


BODIES = [notification(1, entity("a", "Camera"), entity("b", "VehicleSensor", 2)), "{broken", "", notification(2), '{"type": "Other", "data": []}', notification(3, "no entity", entity("é", "Intersection", "late"), entity("x", "Camera", True))]


def test_notification_source(registered, tmp_path):
    put(tmp_path / "in", "001.json", *BODIES)
    put(tmp_path / "in", "002.json", notification(4, entity("d", "Camera", None)))
    put(tmp_path / "in", "003.tmp", "unfinished")
    read = registered.read.format("notifications").option("partitionBytes", "1").load(str(tmp_path / "in"))
    assert read.rdd.getNumPartitions() == 2
    rows = {(r.file, r.line, r.id, r.type, r.run_id, r.sim_t, r.bad) for r in read.collect()}
    assert rows == {
        ("001.json", 0, "a", "Camera", "r", 1.5, None), ("001.json", 0, "b", "VehicleSensor", "r", 2.0, None), ("001.json", 1, None, None, None, None, "{broken"),
        ("001.json", 4, None, None, None, None, '{"type": "Other", "data": []}'), ("001.json", 5, None, None, None, None, '"no entity"'),
        ("001.json", 5, "é", "Intersection", "r", None, None), ("001.json", 5, "x", "Camera", "r", None, None), ("002.json", 0, "d", "Camera", "r", None, None),
    }
    cameras = read.filter("type = 'Camera'")
    assert sorted(r.id for r in cameras.collect()) == ["a", "d", "x"]
    assert "= Camera" not in cameras._jdf.queryExecution().executedPlan().toString()  # the source has taken it over
    both = read.filter(F.col("type").isin("Camera", "Intersection")).filter("id <> 'a'")
    assert sorted(r.id for r in both.collect()) == ["d", "x", "é"]
    assert json.loads(read.filter("id = 'é'").first().doc)["id"] == "é"


def test_notification_stream_restarts(registered, tmp_path):
    def run():
        rows = registered.readStream.format("notifications").option("types", "Camera,VehicleSensor").load(str(tmp_path / "in"))
        q = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
        return sorted((r.file, r.id) for r in registered.read.parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "in", "001.json", *BODIES)
    assert run() == [("001.json", "a"), ("001.json", "b"), ("001.json", "x")]
    assert len(run()) == 3
    put(tmp_path / "in", "002.json", notification(9, entity("z", "Camera")))
    assert run() == [("001.json", "a"), ("001.json", "b"), ("001.json", "x"), ("002.json", "z")]


def test_a_restart_neither_loses_nor_doubles(spark, tmp_path):
    root, schema = str(tmp_path / "root"), "k long"
    rows = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k in range(3):
        spark.createDataFrame([(k,), (10 + k,)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    good = stateful.run_writer(root, "r1")

    def dies(batch, batch_id):
        good(batch, batch_id)
        if batch_id == 1:  # written, but Spark has not noted it
            raise RuntimeError("killed")

    q = stateful.start_run(rows(), root, "r1", dies)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(120)
    assert sorted(r.k for r in stateful.run_rows(spark, root).collect()) == [0, 1, 10, 11]
    assert stateful.start_run(rows(), root, "r1").awaitTermination(120)
    assert sorted(r.k for r in stateful.run_rows(spark, root).collect()) == [0, 1, 2, 10, 11, 12]
    assert stateful.start_run(rows(), root, "r2").awaitTermination(120)
    both = stateful.run_rows(spark, root).groupBy("run").agg(F.sort_array(F.collect_list("k")).alias("k")).collect()
    assert {r.run: r.k for r in both} == {"r1": [0, 1, 2, 10, 11, 12], "r2": [0, 1, 2, 10, 11, 12]}

"""Streaming forms over several micro-batches, against rows counted by hand."""

import time

from pyspark.sql import functions as F

from tideway.operators import history as H
from tideway.streaming import flows

SCHEMA = "run_id string, id string, event_id long, sim_t double, q double, type string"


def source(spark, path, batches):
    """A stream with a micro-batch for each list of rows."""
    for rows in batches:
        spark.createDataFrame([("r", k, e, t, q, kind) for k, e, t, q, kind in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return flows.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))


def output(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


READINGS = [[("a", 1, 0.0, 1.0, "x"), ("a", 2, 4.0, 3.0, "x"), ("b", 3, 1.0, 9.0, "x")], [("a", 4, 10.0, 7.0, "x"), ("b", 5, 2.0, 9.0, "x")], [("a", 6, 50.0, 2.0, "x"), ("a", 7, 50.0, 4.0, "x")]]


def test_cadence_equals_batch(spark, tmp_path):
    got = output(spark, flows.cadence_stream(source(spark, str(tmp_path / "in"), READINGS), ["id"], 5.0), "cadence", tmp_path)
    batch = H.cadence(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), ["id"], "sim_t", 5.0)
    assert sorted(r["event_id"] for r in got) == sorted(r["event_id"] for r in batch.collect()) == [1, 3, 4, 6]


def test_hysteresis_lets_idle_keys_go(spark, tmp_path):
    """The held class bridges a short gap; after ``idle`` seconds of the watermark the key starts anew with its own class."""
    r = lambda k, e, t, raw: (k, e, t, 0.0, raw)
    batches = [[r("a", 1, 0.0, "CONGESTED"), r("b", 2, 0.0, "CONGESTED")], [r("a", 3, 3.0, "STABLE"), r("x", 4, 500.0, "STABLE")], [r("x", 5, 501.0, "STABLE")], [r("b", 6, 502.0, "STABLE"), r("a", 7, 503.0, "STABLE")]]
    rows = source(spark, str(tmp_path / "in"), batches).withColumnRenamed("type", "raw").withColumn("t", F.col("sim_t"))
    got = output(spark, flows.hysteresis_stream(rows, ["id"], idle=60.0), "idle", tmp_path)
    assert {(x["id"], x["t"]): x["state"] for x in got} == {("a", 0.0): "CONGESTED", ("b", 0.0): "CONGESTED", ("a", 3.0): "CONGESTED", ("x", 500.0): "STABLE", ("x", 501.0): "STABLE", ("b", 502.0): "STABLE", ("a", 503.0): "STABLE"}
    kept = output(spark, flows.hysteresis_stream(rows, ["id"]), "kept", tmp_path / "again")
    assert {(x["id"], x["t"]): x["state"] for x in kept}["b", 502.0] == "CONGESTED"


def test_sliding_history(spark, tmp_path):
    got = output(spark, flows.sliding_history(source(spark, str(tmp_path / "in"), READINGS), ["id"], 45.0, 3), "history", tmp_path)
    assert {r["event_id"]: (r["points"], round(r["slope"], 4), round(r["mean_q"], 4)) for r in got} == {
        1: (1, 0.0, 1.0), 2: (2, 0.5, 2.0), 3: (1, 0.0, 9.0), 4: (3, 0.6, 3.6667), 5: (2, 0.0, 9.0), 6: (2, -0.125, 4.5), 7: (3, -0.075, 4.3333)}


def test_sibling_sets(spark, tmp_path):
    batches = [[("a", 1, 0.0, 0.0, "Camera"), ("b", 2, 0.0, 0.0, "TrafficLight"), ("a", 3, 1.0, 0.0, "Camera")], [("a", 4, 100.0, 0.0, "Camera")], [("a", 5, 200.0, 0.0, "Camera")]]
    got = output(spark, flows.sibling_sets(source(spark, str(tmp_path / "in"), batches), ("Camera", "TrafficLight")), "siblings", tmp_path)
    at = {int(r["sim_ts"].timestamp()) - flows.ORIGIN: (r["types"], r["entities"], r["complete"]) for r in got}
    assert (at[0], at[1]) == ((["Camera", "TrafficLight"], 2, True), (["Camera"], 1, False))


def test_late_rows_are_counted(spark, tmp_path):
    late = flows.LateRows()
    spark.streams.addListener(late)
    try:
        # a batch tells late rows by the watermark that the batch before it ran with
        batches = [[("a", 1, 0.0, 0.0, "x")], [("a", 2, 100.0, 0.0, "x")], [("a", 5, 102.0, 0.0, "x")], [("a", 3, 1.0, 0.0, "x"), ("a", 4, 101.0, 0.0, "x")]]
        got = output(spark, flows.deduplicated(source(spark, str(tmp_path / "in"), batches)), "late", tmp_path)
        assert sorted(r["event_id"] for r in got) == [1, 2, 4, 5]
        end = time.monotonic() + 20
        while late.dropped.get("late", 0) < 1 and time.monotonic() < end:
            time.sleep(0.2)
        assert late.dropped["late"] == 1
    finally:
        spark.streams.removeListener(late)


def test_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, v double")
    flows.quarantined(rows, str(tmp_path / "good"), str(tmp_path / "bad"), F.col("v") > 0)
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [2, 3]


def test_hashes_of_several_batches(spark):
    import hashlib

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = spark.createDataFrame([(k, n) for n in (5, 1, 9, 4, 7, 12) for k in ("x", "y", None)], "k string, n long")
        got = {r["k"]: r["hash"] for r in H.ordered_hash(rows, ["k"], ["n"], "n").collect()}
        want = hashlib.sha256(b"1\n4\n5\n7\n9\n12").hexdigest()
        assert got == {"x": want, "y": want, None: want}
        assert H.ordered_hash(rows.limit(0), ["k"], ["n"], "n").count() == 0
        parts = [hashlib.sha256(x).hexdigest() for x in (b"1\n4\n5\n7", b"9\n12")]
        tree = {r["k"]: r["hash"] for r in H.tree_hash(rows.union(rows), ["k"], "n", 8).collect()}
        assert tree["x"] == hashlib.sha256("\n".join(parts).encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)

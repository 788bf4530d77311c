"""Trailing windows and the causes counted over them: against plain loops, and where a window holds a whole history."""

import random
import time

from pyspark.sql import functions as F

from tideway.operators import context as C
from tideway.operators import history as H

READINGS = "key string, sim_t double, event_id long, q double"


def plain(rows, window):
    """event_id -> (slope, mean, drop)."""
    out = {}
    for key, t, e, _ in rows:
        frame = sorted((u, i, q) for k, u, i, q in rows if k == key and (u is None) == (t is None) and (t is None or t - window <= u <= t))
        mean = lambda part: sum(part) / len(part) if part else None
        q = [x for _, _, x in frame]
        a, b = mean([x for x in q[: len(q) // 2] if x is not None]), mean([x for x in q[len(q) // 2 :] if x is not None])
        drop = min(1, max(0, b - a) / max(a, 1)) if len(q) >= 4 and a is not None and a > 1e-3 and b is not None else None
        out[e] = (mean([x for x in q if x is not None]) or 0.0, drop)
    return out


def test_recent_windows(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None] + [k * 5.0 for k in range(-6, 40)] + [17.25, 33.1]), e, draw.choice([None] + [k / 4 for k in range(400)])) for e in range(300)]
    rows = [r if r[1] is not None else (f"null{r[2]}", None, r[2], r[3]) for r in rows]
    df = spark.createDataFrame(rows, READINGS)
    want = plain(rows, 30.0)
    got = {r.event_id: (r["mean"], r["drop"]) for r in H.discharge_drop(H.recent(df, ["key"], window=30.0, mean="q"), ["key"], "q", window=30.0, out="drop").collect()}
    assert got.keys() == want.keys()
    for e, (mean, drop) in want.items():
        assert abs(got[e][0] - mean) < 1e-9
        assert got[e][1] is None if drop is None else abs(got[e][1] - drop) < 1e-9


def test_slope_over_ties_and_bucket_ends(spark):
    rows = [("a", 0.0, 1, 5.0), ("a", 0.0, 2, 3.0), ("a", 30.0, 3, 9.0), ("a", 30.0, 4, 12.0), ("a", 30.000001, 5, 1.0), ("a", 90.0, 6, 7.0)]
    got = {r.event_id: r.slope for r in H.recent(spark.createDataFrame(rows, READINGS), ["key"], window=30.0, slope="q").collect()}
    assert {e: round(x, 6) for e, x in got.items()} == {1: 2000.0, 2: 2000.0, 3: 0.3, 4: 0.3, 5: -8000.0, 6: 0.0}


def test_a_window_of_a_whole_history(spark):
    """100,000 readings in one window: a cost of readings times window would be 5,000,000,000 steps for each measure."""
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("key"), (F.col("id") / 10.0).alias("sim_t"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("q"))
    start = time.time()
    rows = H.discharge_drop(H.recent(df, ["key"], window=1e5, slope="q", mean="q"), ["key"], "q", window=1e5, out="drop")
    last = rows.filter(F.col("event_id") == n - 1).collect()[0]
    assert (round(last.slope, 9), last["mean"]) == (10.0, (n - 1) / 2)
    assert abs(last["drop"] - 1.0) < 1e-9 and rows.count() == n
    assert time.time() - start < 60


def test_cause_readings_count_what_probable_causes_lists(spark):
    draw = random.Random(5)
    overlays = spark.createDataFrame([("r", k, draw.choice(["accident", "downstream_restriction", "heavy_rain"]), draw.choice("BC"), draw.choice([None, float(draw.randrange(200))])) for k in range(80)], "run_id string, overlay_id long, overlay_type string, node_id string, created_at_s double")
    links = spark.createDataFrame([("AB", "A", "B", "East"), ("AC", "A", "C", "East"), ("BC", "B", "C", "North")], "link string, up string, dn string, up_direction string")
    history = spark.createDataFrame([("r", draw.choice("ABD"), draw.choice(["East", "North"]), float(draw.randrange(260)), e, float(draw.randrange(90)), 0.5, draw.choice(["BUSY", "CONGESTED"]), False) for e in range(200)], "run_id string, node_id string, direction string, sim_t double, event_id long, q double, occupancy double, state string, spillback_active boolean")
    args = (20.0, 5.0, 60.0)
    listed = C.probable_causes(overlays, links, history, *args).collect()
    pairs = {}
    for r in listed:
        pairs.setdefault((r.link, r.event_id), []).append((r.overlay_id, r.cause_type, r.source_node))
    read = C.cause_readings(overlays, links, history, *args)
    assert pairs and {(r.link, r.event_id): (r.n, tuple(r["first"]), tuple(r["last"])) for r in read.collect()} == {k: (len(v), min(v), max(v)) for k, v in pairs.items()}
    first = C.first_causes(overlays, links, read, ["run_id", "affected_node"], 7, *args[1:]).collect()
    for node in "AB":
        told = sorted((r.observed_to_s, r.event_id, r.overlay_id) for r in listed if r.affected_node == node)
        assert sorted((r.sim_t, r.event_id, r.overlay_id) for r in first if r.affected_node == node)[:7] == told[:7]


def test_pairs_of_small_inputs_keep_their_partitions(spark):
    """3,000 overlays of one link in one bucket of time (lists of 1,024 at most) and 40 readings: few bytes in, 58,520 pairs out, by as many tasks as are set."""
    overlays = spark.range(3000).select(F.lit("r").alias("run_id"), F.col("id").alias("overlay_id"), F.lit("accident").alias("overlay_type"), F.lit("B").alias("node_id"), (F.col("id") / 300.0).alias("created_at_s"))
    links = spark.createDataFrame([("AB", "A", "B", "East")], "link string, up string, dn string, up_direction string")
    history = spark.range(40).select(F.lit("r").alias("run_id"), F.lit("A").alias("node_id"), F.lit("East").alias("direction"), (F.col("id") / 2.0).alias("sim_t"), F.col("id").alias("event_id"), F.lit(1.0).alias("q"), F.lit(0.5).alias("occupancy"), F.lit("CONGESTED").alias("state"), F.lit(False).alias("spillback_active"))
    pairs = C.probable_causes(overlays, links, history, 20.0, 5.0, 60.0)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {(e, o) for e in range(40) for o in range(3000) if 5.0 <= e / 2.0 - o / 300.0 <= 60.0}
    got = [(r.event_id, r.overlay_id) for r in pairs.select("event_id", "overlay_id").collect()]
    assert len(got) == len(want) and set(got) == want

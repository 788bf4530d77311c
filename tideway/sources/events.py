"""Adapter: the ``events`` table as vehicle, detector and series observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200


def vehicle_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    sim_t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) - EPOCH
    kinds = {"click": ("motorcycle", 2.0), "view": ("car", 4.5), "purchase": ("bus", 12.0), "signup": ("truck", 7.1)}
    vtype, length = F, F
    for name, (kind, metres) in kinds.items():
        vtype, length = vtype.when(F.col("event_type") == name, kind), length.when(F.col("event_type") == name, F.lit(metres))
    direction = F.element_at(F.array(*[F.lit(d) for d in ("North", "South", "East", "West")]), (F.col("event_id") % 4 + 1).cast("int"))
    base = e.select(
        F.lit("run-events").alias("run_id"),
        F.substring(F.lit("ABCD"), (F.col("user_id") % 4).cast("int") + 1, F.lit(1)).alias("node_id"),
        direction.alias("direction"), sim_t.alias("sim_t"), "event_id", F.col("user_id").cast("string").alias("vehicle_id"),
        vtype.otherwise("unknown_vtype").alias("vtype"), length.otherwise(F.lit(5.0)).alias("length_m"), (k % 3).alias("lane_index"), k.alias("k"),
        F.lit(472.8).alias("lane_length_m"), (F.lit(472.8) * k / 100).alias("lane_pos_m"), (F.col("value") / 20).alias("speed_ms"), F.col("value").alias("q"),
    )
    return base.withColumn("obs_t", F.floor(F.col("sim_t") / 86400.0) * F.lit(86400.0))


def detector_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector readings: jam length = q, raw occupancy = k / 40."""
    return vehicle_obs(spark, sf_dir).select("run_id", "node_id", "direction", "obs_t", "lane_index", "event_id", F.col("q").alias("jam_length_m"), (F.col("k") / F.lit(40.0)).alias("occupancy_raw"))


def second_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty series at one reading a second: (series, t, event_id, q)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 40).alias("series"), F.expr("cast(event_id div 40 as double)").alias("t"), "event_id", F.col("value").alias("q"))

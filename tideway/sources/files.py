"""File sources and sinks: notifications, catalogs, road networks, parameters, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "id string, type string, subscriptionId string, notifiedAt string, data array<string>"
TYPES = ("Intersection", "TrafficLight", "VehicleSensor", "Camera")


def notifications(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Entities of notification envelopes: one row each; an envelope that does not parse keeps its raw text and one row."""
    e = F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE"})
    parsed = raw.withColumn("_e", e)
    return parsed.select(F.col("_e.id").alias("notification_id"), F.col("_e.notifiedAt").alias("notified_at"), F.explode_outer("_e.data").alias("doc"), F.when(F.col("_e.id").isNull(), F.col(column)).alias("bad"))


def subscribed(entities: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Entities of the subscribed types, with id, type and time read from the document."""
    d = entities.filter("doc IS NOT NULL").select("*", F.get_json_object("doc", "$.id").alias("id"), F.get_json_object("doc", "$.type").alias("type"), F.get_json_object("doc", "$.simulationTime.value").cast("double").alias("sim_t"), F.get_json_object("doc", "$.simulationRunId.value").alias("run_id"))
    return d.filter(F.col("type").isin(*types))


def envelope_violations(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Envelopes that lack a required field, are of another type or have no data."""
    e = F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE"})
    rules = [F.when(F.coalesce(e["type"], F.lit("")) != "Notification", F.lit("type")), F.when(e["id"].isNull(), F.lit("id")), F.when(e["subscriptionId"].isNull(), F.lit("subscriptionId")), F.when(e["notifiedAt"].isNull(), F.lit("notifiedAt")), F.when(F.coalesce(F.size(e["data"]), F.lit(0)) < 1, F.lit("data"))]
    return raw.select(column, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule"))


def road_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges and connections of a network XML, without internal ones."""
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_id string, _from string, _to string, _function string, lane array<struct<_id string, _length double, _speed double>>").load(path)
    joins = spark.read.format("xml").option("rowTag", "connection").schema("_from string, _to string, _fromLane int, _toLane int, _dir string, _tl string, _linkIndex int").load(path)
    outer = edges.filter((F.coalesce("_function", F.lit("")) != "internal") & ~F.col("_id").startswith(":"))
    order = [F.coalesce("_tl", F.lit("")), F.coalesce("_linkIndex", F.lit(-1)), "_from", "_to"]
    return outer.orderBy("_id"), joins.filter(~F.col("_from").startswith(":")).orderBy(*order)


def lane_lengths(lines: DataFrame, column: str = "value") -> DataFrame:
    """(lane_id, length_m) of every lane element in XML text, by pattern."""
    pattern = F.lit(r'<lane id="([^"]+)"[^>]*length="([0-9.]+)"')
    pairs = F.arrays_zip(F.regexp_extract_all(column, pattern, F.lit(1)).alias("lane_id"), F.regexp_extract_all(column, pattern, F.lit(2)).alias("length_m"))
    return lines.select(F.explode(pairs).alias("p")).select("p.lane_id", F.col("p.length_m").cast("double").alias("length_m"))


def parameters(path: str) -> dict:
    """A YAML parameter file, on the driver."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def parameter_rows(spark: SparkSession, tree: dict) -> DataFrame:
    """(key, value, unit, source_type, calibrated) of every leaf that has a value."""
    out = []

    def walk(node, key: str) -> None:
        if isinstance(node, dict):
            if "value" in node:
                out.append((key, str(node["value"]), node.get("unit"), node.get("source_type"), node.get("calibrated")))
            for k, v in node.items():
                walk(v, f"{key}.{k}" if key else str(k))

    walk(tree, "")
    return spark.createDataFrame(out, "key string, value string, unit string, source_type string, calibrated boolean")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def samples(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    return spark.read.csv(path, sep=separator, header=True)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    rows.write.mode("append").json(path)


def store(rows: DataFrame, path: str) -> None:
    """Parquet by run and node, rows of a file in time order: statistics serve as the indexes."""
    rows.sortWithinPartitions("run_id", "node_id", "sim_t").write.partitionBy("run_id", "node_id").mode("append").parquet(path)

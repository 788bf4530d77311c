"""Streams whose state outlives a micro-batch: arrivals by second with empty seconds, siblings that come late, and a sink that a restart cannot double."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideway.streaming.flows import ORIGIN


class ArrivalBuckets(StatefulProcessor):
    """Counts of an approach by bucket: open buckets in a map, the next one to close in a value, and a timer at its end."""

    def __init__(self, seconds: int, idle: int) -> None:
        self.seconds, self.idle = seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "bucket long, quiet long")
        self.open = handle.getMapState("open", "bucket long", "arrivals long, pcu double")

    def _ends(self, bucket: int) -> int:
        return (ORIGIN + (bucket + 1) * self.seconds) * 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for bucket, own in part.groupby((part["sim_t"] // self.seconds).astype("int64")):
                n, pcu = self.open.getValue((bucket,)) if self.open.containsKey((bucket,)) else (0, 0.0)
                self.open.updateValue((bucket,), (n + len(own), pcu + float(own["pcu"].sum())))
                first = bucket if first is None else min(first, bucket)
        if first is None:
            return
        if not self.next.exists():
            self.next.update((first, 0))
            self.handle.registerTimer(self._ends(first))
        elif first < self.next.get()[0]:
            # rows that the watermark let pass into a bucket before the first one seen
            self.handle.deleteTimer(self._ends(self.next.get()[0]))
            self.next.update((first, 0))
            self.handle.registerTimer(self._ends(first))
        return
        yield  # an iterator without rows

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket, quiet = self.next.get()
        closed, now = [], timerValues.getCurrentWatermarkInMs()
        while self._ends(bucket) <= now and quiet < self.idle:
            n, pcu = (0, 0.0)
            if self.open.containsKey((bucket,)):
                n, pcu = self.open.getValue((bucket,))
                self.open.removeKey((bucket,))
            quiet = 0 if n else quiet + 1
            closed.append((*key, bucket, n, pcu))
            bucket += 1
        waiting = min((k[0] for k in self.open.keys()), default=None)
        if quiet >= self.idle and waiting is None:
            self.next.clear()
        else:
            if quiet >= self.idle:
                bucket, quiet = waiting, 0
            self.next.update((bucket, quiet))
            self.handle.registerTimer(max(self._ends(bucket), now + 1))
        yield pd.DataFrame(closed, columns=["run_id", "node_id", "direction", "bucket", "arrivals", "pcu"])

    def close(self) -> None:
        pass


def carried_arrivals(rows: DataFrame, seconds: int = 1, idle: int = 60) -> DataFrame:
    """(run_id, node_id, direction, bucket, arrivals, pcu) of (run_id, node_id, direction, sim_t, pcu, sim_ts): the arrival rate of each approach, bucket by bucket.

    A bucket is told once the watermark has passed its end, and after an approach's first arrival so is every empty one, as
    the rate falls to 0 then; after ``idle`` empty buckets in a row the approach is forgotten until its next arrival.
    Arrivals for buckets to come wait in state from batch to batch; rows behind the watermark are dropped. For append mode
    with the RocksDB state store.
    """
    read = rows.select("run_id", "node_id", "direction", "sim_t", F.coalesce("pcu", F.lit(0.0)).alias("pcu"), "sim_ts")
    return read.groupBy("run_id", "node_id", "direction").transformWithStateInPandas(ArrivalBuckets(seconds, idle), "run_id string, node_id string, direction string, bucket long, arrivals long, pcu double", "append", "EventTime")


def sibling_reads(parents: DataFrame, children: DataFrame, delay: str = "1 second") -> DataFrame:
    """(run_id, parent, child, sim_ts, child_ts, look) of each child that a parent's snapshot names.

    ``parents``: run_id, id, refs (ids of children), sim_ts; ``children``: run_id, id, sim_ts; both with watermarks. A child of
    the parent's own time is met at the first look (1). One whose first newer time comes within ``delay`` is met at the
    second (2), as a reader who looks again would see it. A child is called missing (look null) only when both watermarks
    have passed the delay. The join keeps each side's rows for that long; its results are then put together by child.
    """
    asked = parents.select(F.col("run_id").alias("_run"), F.col("id").alias("parent"), F.explode(F.array_distinct("refs")).alias("child"), F.col("sim_ts"))
    seen = children.select("run_id", "id", F.col("sim_ts").alias("child_ts"))
    near = (F.col("_run") == F.col("run_id")) & (F.col("child") == F.col("id")) & (F.col("child_ts") >= F.col("sim_ts")) & (F.col("child_ts") <= F.col("sim_ts") + F.expr(f"INTERVAL {delay}"))
    both = asked.join(seen, near, "left_outer")
    met = both.groupBy("_run", "parent", "child", "sim_ts").agg(F.min("child_ts").alias("child_ts"))
    look = F.when(F.col("child_ts") == F.col("sim_ts"), 1).when(F.col("child_ts").isNotNull(), 2)
    return met.select(F.col("_run").alias("run_id"), "parent", "child", "sim_ts", "child_ts", look.alias("look"))


def run_writer(root: str, run_id: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch of a run is one folder, so a batch that comes again after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/run={run_id}/batch={batch_id}")

    return write


def start_run(rows: DataFrame, root: str, run_id: str, write: Callable[[DataFrame, int], None] | None = None):
    """Start, or start again, the query of one run: its own checkpoint, and rows under ``root``/rows/run=.../batch=....

    The same run id goes on where its checkpoint ends, without lost or doubled rows; a new one is a new run over all input.
    """
    sink = rows.writeStream.foreachBatch(write or run_writer(root, run_id)).option("checkpointLocation", f"{root}/checkpoints/{run_id}")
    return sink.queryName(f"run-{run_id}").trigger(availableNow=True).start()


def run_rows(spark, root: str) -> DataFrame:
    """All rows of all runs, with columns run and batch."""
    return spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")

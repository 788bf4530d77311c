"""Streaming forms: event time from simulation time, deduplication, latest state, arrivals, keyed state machines."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideway.operators.history import hysteresis_step
from tideway.params import MODEL

#: Start of event time: epoch 0 would count as late.
ORIGIN = 1704067200


def with_event_time(rows: DataFrame, t: str = "sim_t", delay: str = "10 seconds") -> DataFrame:
    """Adds sim_ts and its watermark; wall-clock columns are never used."""
    return rows.withColumn("sim_ts", F.timestamp_micros(((F.col(t) + ORIGIN) * 1_000_000).cast("bigint"))).withWatermark("sim_ts", delay)


def deduplicated(rows: DataFrame, keys: tuple[str, ...] = ("run_id", "id", "sim_t")) -> DataFrame:
    """Idempotent delivery: one row of each (run, entity, time); state goes with the watermark."""
    return rows.dropDuplicatesWithinWatermark(list(keys))


def latest_state(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Current row of each entity, for update mode."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))


def arrival_buckets(rows: DataFrame, seconds: int = 1) -> DataFrame:
    """Arrivals by tumbling bucket of event time."""
    return rows.groupBy(F.window("sim_ts", f"{seconds} seconds"), "run_id", "node_id", "direction").agg(F.count(F.lit(1)).alias("arrivals"), F.sum("pcu").alias("pcu"))


def hysteresis_stream(rows: DataFrame, keys: list[str], hold: float = MODEL.hold_s, recovery: float = MODEL.recovery_s, idle: float | None = None) -> DataFrame:
    """The hysteresis of ``operators.history`` with its state kept by key: (keys, t, raw) -> (keys, t, raw, state).

    Rows of a micro-batch are put in time order; a row older than the state's time is passed with the held class. With
    ``idle`` (rows then have sim_ts and its watermark) a key's state goes once the watermark is that many seconds past
    its last reading, and a key that comes back starts anew; without it the state of every key stays.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", t double, raw string, state string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get if state.exists else None
        s, last = (None, None) if kept is None else ((kept[0], kept[1], None if kept[2] < 0 else kept[2]), kept[3])
        rows_ = sorted((t, raw) for b in batches for t, raw in zip(b["t"], b["raw"], strict=True))
        out = []
        for t, raw in rows_:
            if last is not None and t < last:
                out.append((*key, t, raw, s[0]))
                continue
            s, value = hysteresis_step(s, t, raw, hold, recovery)
            last = t
            out.append((*key, t, raw, value))
        if s is not None:
            state.update((s[0], float(s[1]), -1.0 if s[2] is None else float(s[2]), float(last)))
            if idle is not None:
                _expires(state, last, idle)
        yield pd.DataFrame(out, columns=[*keys, "t", "raw", "state"])

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "held string, since double, rec double, last double", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout)


def trip_stream(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Trips as vehicles arrive, from (run_id, vehicle_id, kind, sim_t, sim_ts): departures wait in state until the watermark has left them behind by ``idle``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        depart, seen = state.get if state.exists else (-1.0, -1.0)
        out, last = [], 0
        for t, kind, ts in sorted((t, k, ts) for b in batches for t, k, ts in zip(b["sim_t"], b["kind"], b["sim_ts"], strict=True)):
            last = max(last, int(ts.timestamp() * 1000))
            if kind == "DEPART" and depart < 0:
                depart = t
            elif kind == "SEEN" and seen < 0:
                seen = t
            elif kind == "ARRIVE":
                start = depart if depart >= 0 else seen
                out.append((*key, None if start < 0 else start, t, None if start < 0 else round(t - start, 2)))
                depart = seen = -1.0
        if depart < 0 and seen < 0:
            if state.exists:
                state.remove()
        else:
            state.update((float(depart), float(seen)))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["run_id", "vehicle_id", "depart_s", "arrive_s", "travel_s"])

    return events.groupBy("run_id", "vehicle_id").applyInPandasWithState(run, "run_id string, vehicle_id string, depart_s double, arrive_s double, travel_s double", "depart double, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def _expires(state: GroupState, t: float, seconds: float) -> None:
    """Lets a key's state go once the watermark is ``seconds`` past time ``t``."""
    state.setTimeoutTimestamp(max(int((t + ORIGIN + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)


def cadence_stream(rows: DataFrame, keys: list[str], interval: float) -> DataFrame:
    """The rows (keys, event_id, sim_t) of (keys, event_id, sim_t, sim_ts) that come ``interval`` or more after the last
    one kept, as ``operators.history.cadence`` keeps them; a row older than that one is dropped.

    State goes when the watermark has passed the interval: the next row would be kept in any case.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for t, e in sorted((t, e) for b in batches for t, e in zip(b["sim_t"], b["event_id"], strict=True)):
            if last is None or t - last >= interval:
                last = t
                out.append((*key, e, t))
        state.update((float(last),))
        _expires(state, last, interval)
        yield pd.DataFrame(out, columns=[*keys, "event_id", "sim_t"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", event_id {kinds['event_id']}, sim_t double"
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_history(rows: DataFrame, keys: list[str], window: float = MODEL.window_s, most: int = 120) -> DataFrame:
    """(keys, event_id, sim_t, points, slope, mean_q) at each row of (keys, event_id, sim_t, q, sim_ts), over the key's
    last ``window`` seconds and at most ``most`` points; the slope of one point is 0.

    State is that history and goes when the watermark has passed it. Rows of a micro-batch are put in time order; one
    that is older than what is held is put in its place if the window still reaches it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out = json.loads(state.get[0]) if state.exists else [], []
        for t, e, q in sorted((float(t), int(e), float(q)) for b in batches for t, e, q in zip(b["sim_t"], b["event_id"], b["q"], strict=True)):
            bisect.insort(held, [t, e, q])
            held = [p for p in held if p[0] >= held[-1][0] - window][-most:]
            seen = [p for p in held if p[:2] <= [t, e]]
            if not seen:
                out.append((*key, e, t, 0, 0.0, None))
                continue
            slope = (seen[-1][2] - seen[0][2]) / max(1e-3, seen[-1][0] - seen[0][0]) if len(seen) > 1 else 0.0
            out.append((*key, e, t, len(seen), slope, sum(p[2] for p in seen) / len(seen)))
        state.update((json.dumps(held),))
        _expires(state, held[-1][0], window)
        yield pd.DataFrame(out, columns=[*keys, "event_id", "sim_t", "points", "slope", "mean_q"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", event_id long, sim_t double, points int, slope double, mean_q double"
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def sibling_sets(rows: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Entities of (run_id, type, sim_ts) of one time together, once the watermark has passed it: the types that came,
    and whether none of ``expected`` lacks. For append mode."""
    types = F.sort_array(F.collect_set("type"))  # a few types, however many entities
    sets = rows.groupBy("run_id", "sim_ts").agg(types.alias("types"), F.count(F.lit(1)).alias("entities"))
    return sets.withColumn("complete", F.size(F.array_except(F.array(*[F.lit(x) for x in expected]), "types")) == 0)


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks have dropped, by the name of the query; add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[p.name] = self.dropped.get(p.name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def quarantined(batch: DataFrame, good: str, bad: str, ok) -> None:
    """For foreachBatch: rows that hold go to one table, the others to another, and the batch goes on; it is made once."""
    held = batch.persist()
    try:
        held.filter(F.coalesce(ok, F.lit(False))).write.mode("append").parquet(good)
        held.filter(~F.coalesce(ok, F.lit(False))).write.mode("append").parquet(bad)
    finally:
        held.unpersist()

"""Histories: range windows, and ordered folds that run in one pass over sorted partitions with constant state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideway.operators.scans import ranged, written
from tideway.params import MODEL

BAD, GOOD = ("BUSY", "CONGESTED", "OVERSATURATED"), ("FREE_FLOW", "STABLE")


def micros(t: Column) -> Column:
    """Seconds in whole microseconds."""
    return F.round(t * 1_000_000).cast("long")


def trailing(events: DataFrame, keys: list[str], window: float, totals: dict[str, Callable]) -> DataFrame:
    """The asking rows (``_row``) of ``events`` with aggregates of their key's data in [_at - window, _at], ends included.

    ``events``: keys, ``_at`` (whole microseconds), ``_row`` (a struct, null for data) and a column for each of ``totals``
    (column -> aggregate; null for askers). Time is cut into buckets as long as the window, so a frame is the end of one
    bucket and the beginning of the next: two running aggregates, ``{c}_early`` of the bucket before and ``{c}_late`` of
    the own one. A row costs the same however many its window has, and a task holds a key's bucket, never its history.
    ``_bucket`` is the own bucket's first microsecond. Null keys are a key; rows without a time meet only each other.
    """
    length = round(window * 1_000_000)
    wide = F.lit(max(1, length)).cast("long")
    asks, at = F.col("_row").isNotNull(), F.col("_at")
    place = Window.partitionBy(*keys, "_bucket")
    own = events.withColumn("_bucket", at - F.pmod(at, wide))
    late = own.withColumns({f"{c}_late": F.when(asks, f(c).over(place.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))) for c, f in totals.items()})
    late = late.filter(asks | at.isNotNull())  # rows without a time have no bucket before theirs
    back = late.withColumns({"_bucket": F.when(asks, F.col("_bucket") - wide).otherwise(F.col("_bucket")), "_at": F.when(asks, at - F.lit(length)).otherwise(at)})
    early = {f"{c}_early": f(c).over(place.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)) for c, f in totals.items()}
    found = back.withColumns(early).filter(asks)
    return found.select("_row", (F.col("_bucket") + wide).alias("_bucket"), *[f"{c}_{side}" for c in totals for side in ("early", "late")])


def both_sides(c: str) -> Column:
    """A sum or count over the whole frame; null as such an aggregate over nothing is."""
    return F.coalesce(F.col(f"{c}_early") + F.col(f"{c}_late"), f"{c}_early", f"{c}_late")


def _self_asking(rows: DataFrame, keys: list[str], t: str, inputs: dict[str, Column]) -> DataFrame:
    """Events of ``trailing`` of which each row is data and asker; the input is read once."""
    one = rows.withColumns({"_at": micros(F.col(t)), "_data": F.explode(F.array(F.lit(True), F.lit(False)))})
    return one.select(*keys, "_at", F.when(~F.col("_data"), F.struct(*rows.columns)).alias("_row"), *[F.when(F.col("_data"), x).alias(c) for c, x in inputs.items()])


def recent(rows: DataFrame, keys: list[str], t: str = "sim_t", window: float = MODEL.window_s, slope: str | None = None, mean: str | None = None) -> DataFrame:
    """Adds ``slope`` of one column and ``mean`` of one, as asked for, over each row's last ``window`` seconds, ends included.

    The slope is that from the first point to the last, 0 for one point; rows of equal time share a frame. Means are of
    sums of 18 decimal places, so that they do not depend on the order of rows; values that do not fit are added as they are.
    """
    inputs, totals = {}, {}
    if slope:
        ends = F.struct(F.col(t).alias("t"), F.col(slope).alias("q"))
        inputs |= {"_n": F.lit(1), "_first": ends, "_last": ends}
        totals |= {"_n": F.count, "_first": F.min, "_last": F.max}
    if mean:
        exact = F.col(mean).cast("double").try_cast("decimal(28, 18)")
        inputs |= {"_count": F.col(mean), "_exact": exact, "_loose": F.when(exact.isNull(), F.col(mean).cast("double"))}
        totals |= {"_count": F.count, "_exact": F.sum, "_loose": F.sum}
    found = trailing(_self_asking(rows, keys, t, inputs), keys, window, totals)
    out = {}
    if slope:
        first, last = F.coalesce("_first_early", "_first_late"), F.coalesce("_last_late", "_last_early")
        out["slope"] = F.when(both_sides("_n") < 2, F.lit(0.0)).otherwise((last["q"] - first["q"]) / F.greatest(F.lit(1e-3), last["t"] - first["t"]))
    if mean:
        total = F.coalesce(both_sides("_exact").cast("double") + both_sides("_loose"), both_sides("_exact").cast("double"), both_sides("_loose"))
        out["mean"] = F.coalesce(F.try_divide(total, both_sides("_count")), F.lit(0.0))
    return found.select("_row.*", *[x.alias(c) for c, x in out.items()])


def bounded_history(series: DataFrame, keys: list[str], order: list, most: int = 120) -> DataFrame:
    """The last ``most`` rows of each key."""
    return series.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")


def discharge_drop(rows: DataFrame, keys: list[str], value: str, t: str = "sim_t", tie: str = "event_id", window: float = MODEL.window_s, out: str = "drop_ratio") -> DataFrame:
    """Adds the growth of the later half of the window over the earlier, within 0 to 1; null for under 4 points or an early mean near 0.

    The window is the end of one bucket and the beginning of the next, as in ``trailing``. Its middle is looked up there by
    number: of the rows of the own bucket from its start, or of the bucket before from its end (negative numbers). So a row
    costs the same however many readings its window has, and no key's history meets in one task. Sums are decimals of nine
    places, so that no digit goes with a difference; null values count as points but not in means.
    """
    kind = "decimal(24, 9)"
    inputs = {"_n": F.lit(1), "_sum": F.col(value).cast(kind), "_known": F.col(value)}
    found = trailing(_self_asking(rows, keys, t, inputs), keys, window, {"_n": F.count, "_sum": F.sum, "_known": F.count})
    base = written(found, "windows")  # also counted into places
    row = lambda c: F.col(f"_row.{c}")
    bucket = Window.partitionBy(*[row(k) for k in keys], "_bucket")
    part = row(value).cast(kind)
    sides = []
    for sign, order in ((1, [row(t), row(tie)]), (-1, [row(t).desc(), row(tie).desc()])):
        w = bucket.orderBy(*order)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        sides.append(F.struct((F.row_number().over(w) * sign).alias("at"), F.sum(part).over(so_far).alias("sum"), F.count(part).over(so_far).alias("known")))
    counted = base.select(*[row(k).alias(f"_key_{k}") for k in keys], F.col("_bucket").alias("_in"), F.array(*sides).alias("_sides"))
    places = counted.select(*[f"_key_{k}" for k in keys], "_in", F.inline("_sides")).select(*[f"_key_{k}" for k in keys], "_in", F.col("at").alias("_at"), F.col("sum").alias("_mid"), F.col("known").alias("_mid_known"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("decimal(36, 9)")
    n, before = both_sides("_n"), F.coalesce("_n_early", F.lit(0))
    place = F.floor(n / 2).cast("long") - before
    step = F.lit(max(1, round(window * 1_000_000))).cast("long")
    asked = base.withColumns({"_place": place, "_looked": F.when(place < 0, F.col("_bucket") - step).otherwise(F.col("_bucket"))})
    same = (F.col("_looked").eqNullSafe(F.col("_in"))) & (F.col("_place") == F.col("_at"))
    for k in keys:
        same = same & row(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = asked.join(places.hint("merge"), same, "left")  # as many as the rows, however small their file looks
    # from the end, a place's sum is of the rows of the later half that lie in the bucket before
    behind = lambda c, mid: F.when(F.col("_place") < 0, -F.coalesce(mid, F.lit(0))).otherwise(F.coalesce(mid, F.lit(0))) + F.coalesce(F.col(f"{c}_early"), F.lit(0))
    early_sum, early_known = behind("_sum", "_mid"), behind("_known", "_mid_known")
    late_sum, late_known = zero(both_sides("_sum")) - early_sum, both_sides("_known") - early_known
    early, late = F.try_divide(early_sum.cast("double"), early_known), F.try_divide(late_sum.cast("double"), late_known)
    drop = F.when(n >= 4, F.when(early > 1e-3, F.least(F.lit(1.0), F.greatest(F.lit(0.0), late - early) / F.greatest(early, F.lit(1.0)))))
    return joined.select("_row.*", drop.alias(out))


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """Runs ``step(state, row) -> (state, value)`` over the rows of each key in order; a null value drops the row.

    Rows are dealt by key and sorted, and a task carries one state from row to row and batch to batch, so a key's
    history is never gathered. ``out`` is "name type" of the added column.
    """
    name = out.split()[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            values = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != now:
                    now, state = key, start()
                state, value = step(state, row)
                values.append(value)
            yield pdf.assign(**{name: values}).dropna(subset=[name])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def ordered_hash(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, hash): SHA-256 of each key's values in order, one a line.

    A task feeds the hash batch by batch from sorted rows, so no key's values are ever gathered. The hash of one key is
    sequential: see ``tree_hash`` for keys of many rows. Null keys are a key; null values are empty lines.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in batches:
            done = []
            for key, part in pdf.groupby("_k", sort=False):
                text = "\n".join(part["_v"])
                if key == now:
                    digest.update(("\n" + text).encode())
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(text.encode())
            yield pd.DataFrame(done, columns=["_k", "hash"], dtype=object)
        if now is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["_k", "hash"], dtype=object)

    places = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    read = rows.select(F.to_json(F.struct(*keys)).alias("_k"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_v"), *places)
    dealt = read.repartition("_k").sortWithinPartitions("_k", *[f"_o{i}" for i in range(len(order))]).select("_k", "_v")
    hashed = dealt.mapInPandas(run, "_k string, hash string")
    return hashed.select(F.from_json("_k", ", ".join(f"`{k}` {kinds[k]}" for k in keys)).alias("_k"), "hash").select("_k.*", "hash")


def tree_hash(rows: DataFrame, keys: list[str], number: str, width: int = 4096) -> DataFrame:
    """(keys, hash): SHA-256 of the hashes of each key's ranges of ``width`` distinct numbers, in order.

    A range is hashed by itself, so one key of many rows is spread; null numbers are left out.
    """
    part = (F.col(number) - F.pmod(F.col(number), F.lit(width))).alias("_part")
    ranges = rows.select(*keys, number).filter(F.col(number).isNotNull()).distinct().groupBy(*keys, part).agg(F.sort_array(F.collect_list(number)).alias("n"))  # at most ``width`` numbers
    hashed = ranges.select(*keys, "_part", F.sha2(F.array_join(F.transform("n", lambda x: x.cast("string")), "\n"), 256).alias("h"))
    return ordered_hash(hashed, keys, ["_part"], "h")


def hysteresis(df: DataFrame, keys: list[str], t: str = "t", raw: str = "raw", tie: str = "event_id", hold: float = MODEL.hold_s, recovery: float = MODEL.recovery_s, mode: str = "reference") -> DataFrame:
    """Adds ``state``: the raw class held for ``hold`` seconds before it changes, and recovery held back.

    In mode "reference" a hold that has run out also ends a recovery, on the tick after; "strict" waits ``recovery``.
    """
    return ordered_fold(df, keys, [t, tie], lambda: None, lambda s, r: hysteresis_step(s, getattr(r, t), getattr(r, raw), hold, recovery, mode), "state string")


def hysteresis_step(s: tuple | None, t: float, raw: str, hold: float, recovery: float, mode: str = "reference") -> tuple[tuple, str]:
    """State (held class, since, recovery since) and reading -> new state and output."""
    if s is None:
        return (raw, t, None), raw
    held, since, rec = s
    recovering = held in BAD and raw in GOOD
    now, out = (held, since), held
    if raw == held:
        now, out = (raw, t), raw
    elif t - since >= hold and not (mode == "strict" and recovering):
        now, out, rec = (raw, t), raw, None
    if recovering:
        if rec is None:
            rec, out = t, held
        elif t - rec < recovery:
            out = held
        else:
            now, out, rec = (raw, t), raw, None
    elif raw != held and raw in BAD:
        rec = None
    return (*now, rec), out


def _next_row(t: np.ndarray, last: np.ndarray, interval: float) -> np.ndarray:
    """Place of the first of the sorted times with ``t - last >= interval``, the difference rounded as the rule's own; len(t) if none is."""
    at = np.searchsorted(t, last + interval)
    while True:
        back = (at > 0) & (t[np.maximum(at - 1, 0)] - last >= interval)
        on = (at < len(t)) & (t[np.minimum(at, len(t) - 1)] - last < interval)
        if not (back.any() or on.any()):
            return at
        at = at - back + (on & ~back)


def _chain_ends(t: np.ndarray, interval: float) -> np.ndarray:
    """For each of the sorted times the last one kept in this block if it is kept: pointers to the next kept, doubled."""
    jump = np.minimum(_next_row(t, t, interval), len(t))
    jump = np.where(jump < len(t), jump, np.arange(len(t)))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return t[jump]


def _plain(columns: dict) -> pd.DataFrame:
    """Rows with their key as plain objects: chunked strings have no place in a struct of Arrow."""
    return pd.DataFrame(columns).astype({"_k": object})


def cadence(df: DataFrame, keys: list[str], t: str, interval: float, tie: str = "event_id") -> DataFrame:
    """Rows at least ``interval`` after the last one kept of their key; the first always (a greedy gap filter).

    Rows are dealt by ranges of (key, time). A key inside one range is filtered in one ordered pass. A key over several
    ranges, of which there are fewer than ranges, is a chain of blocks: each block tells at which times a chain through it
    can end, each such end is looked up in the block where the chain goes on (its next kept row), and the ends that the
    key's first row leads to are found by doubling those pointers, in about log2(blocks) rounds. Each block then keeps the
    chain from its own entry. So no key's history meets in one task. Rows without a time are never kept; of rows of one
    time only the first by ``tie`` can be; null keys are a key; an interval of 0 or less keeps all rows with a time.
    """
    timed = df.filter(F.col(t).isNotNull())
    if interval <= 0:
        return timed
    table = ranged(timed.withColumns({"_k": F.to_json(F.struct(*keys)), "_t": F.col(t).cast("double")}), [*keys, "_t", tie], "series")
    by_key = F.sort_array(F.collect_list(F.struct("pid", "_end")))  # an entry a range
    blocks = table.groupBy("_k", "pid").agg(F.max("_t").alias("_end")).groupBy("_k").agg(by_key.alias("_blocks")).filter(F.size("_blocks") > 1)
    spread = written(blocks, "spread")
    alone = table.join(F.broadcast(spread.select("_k")), "_k", "left_anti").drop("pid", "_k")

    def step(last, row):
        return (row.cadence_t, True) if last is None or row.cadence_t - last >= interval else (last, None)

    kept = ordered_fold(alone.withColumnRenamed("_t", "cadence_t"), keys, ["cadence_t", tie], lambda: None, step, "kept boolean").drop("kept", "cadence_t")
    if not spread.limit(1).count():
        return kept
    times = written(table.join(F.broadcast(spread.select("_k", F.col("_blocks")[0]["pid"].alias("_first"))), "_k").select("_k", "pid", "_first", "_t"), "times")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        last = _chain_ends(np.sort(pdf["_t"].to_numpy()), interval)
        first = pdf["pid"].iloc[0] == pdf["_first"].iloc[0]
        found = np.unique(last)
        return _plain({"_k": pdf["_k"].iloc[0], "pid": pdf["pid"].iloc[0], "last": found, "root": first & (found == last[0])})

    out = times.groupBy("_k", "pid").applyInPandas(ends, "_k string, pid int, last double, root boolean")
    goes_on = F.filter("_blocks", lambda b: (b["pid"] > F.col("pid")) & (b["_end"] - F.col("last") >= interval))
    links = out.join(F.broadcast(spread), "_k").select("_k", "last", "root", F.get(goes_on, F.lit(0))["pid"].alias("to"))
    links = written(links.groupBy("_k", "last").agg(F.max("root").alias("root"), F.max("to").alias("to")), "ends")

    def entries(ends_: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(ends_) or not len(block):
            return _plain({"_k": [], "last": [], "pid": [], "entry": [], "next": []})
        t_ = np.sort(block["_t"].to_numpy())
        at = _next_row(t_, ends_["last"].to_numpy(), interval)
        return _plain({"_k": ends_["_k"], "last": ends_["last"], "pid": ends_["to"], "entry": t_[at], "next": _chain_ends(t_, interval)[at]})

    asked = links.filter("to IS NOT NULL").groupBy("_k", "to")
    pointers = written(asked.cogroup(times.groupBy("_k", "pid")).applyInPandas(entries, "_k string, last double, pid int, entry double, next double"), "pointers")
    reached, jump = links.filter("root").select("_k", "last"), pointers.select("_k", "last", "next")
    while jump.limit(1).count():
        reached = written(reached.unionByName(reached.join(jump, ["_k", "last"]).select("_k", F.col("next").alias("last"))).distinct(), "reached")
        far = jump.select("_k", F.col("last").alias("next"), F.col("next").alias("after"))
        jump = written(jump.join(far, ["_k", "next"]).select("_k", "last", F.col("after").alias("next")), "jump")

    def follow(entry: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        t_, kept_ = np.sort(block["_t"].to_numpy()), []
        at = int(np.searchsorted(t_, entry["entry"].iloc[0])) if len(entry) else len(t_)
        after = _next_row(t_, t_, interval)
        while at < len(t_):
            kept_.append(t_[at])
            at = int(after[at])
        return _plain({"_k": block["_k"].iloc[0] if kept_ else [], "pid": block["pid"].iloc[0] if kept_ else [], "_t": kept_})

    starts = times.filter("pid = _first").groupBy("_k", "pid").agg(F.min("_t").alias("entry"))
    into = pointers.join(reached, ["_k", "last"]).select("_k", "pid", "entry").unionByName(starts).distinct()
    chosen = into.groupBy("_k", "pid").cogroup(times.groupBy("_k", "pid")).applyInPandas(follow, "_k string, pid int, _t double")
    first = F.row_number().over(Window.partitionBy("_k", "pid", "_t").orderBy(tie))
    spanning = table.join(chosen, ["_k", "pid", "_t"]).withColumn("_n", first).filter("_n = 1").select(*df.columns)
    return kept.select(*df.columns).unionByName(spanning)


def cadence_buckets(df: DataFrame, keys: list[str], t: str, interval: float, value: str, tie: str = "event_id") -> DataFrame:
    """First and last value of each bucket of ``interval`` seconds: the cadence of regular series, without a fold."""
    b = F.floor(F.col(t) / interval).cast("long").alias("bucket")
    return df.groupBy(*keys, b).agg(F.min_by(value, F.struct(t, tie)).alias("first_value"), F.max_by(value, F.struct(t, tie)).alias("last_value"))


def rising_edges(df: DataFrame, keys: list[str], order: list, flag: Column) -> DataFrame:
    """How often the flag turns on in each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_on", flag).withColumn("_was", F.coalesce(F.lag(flag).over(w), F.lit(False)))
    return marked.groupBy(*keys).agg(F.count_if(F.col("_on") & ~F.col("_was")).alias("stops"))


def segment_times(df: DataFrame, keys: list[str], context: str, t: str, tie: str = "event_id") -> DataFrame:
    """Time spent in each context until the next reading, two digits."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    return df.withColumn("_dt", F.lead(t).over(w) - F.col(t)).groupBy(*keys, context).agg(F.bround(F.coalesce(F.sum("_dt"), F.lit(0.0)), 2).alias("seconds"))

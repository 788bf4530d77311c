"""Scans over ordered rows that no single task sees whole: rows are dealt by range, ranges are summed up, and what stands before a range is carried in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; one of our own in local mode only, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tideway-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads cost no recomputation and survive a lost executor."""
    path = f"{shared_root(df.sparkSession)}/tideway/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tideway_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.tideway_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sized(table: DataFrame, most: int = 100_000) -> DataFrame:
    """``table`` with a broadcast hint if it has ``most`` rows at most, which are counted up to there; else, or of a stream, as it is."""
    return F.broadcast(table) if not table.isStreaming and table.limit(most + 1).count() <= most else table


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in ranges of ``order``; column ``pid`` is the range's number, and all of range i sorts before range i + 1."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()), name)


def _same(keys: list[str]) -> Column:
    same = F.col("pid") == F.col("_pid")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return same


def scan(table: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[Callable, str, Callable]]) -> DataFrame:
    """Inclusive running aggregates of a table of ``ranged`` by ``keys`` (its leading order), added as columns.

    ``totals``: column -> (aggregate such as F.sum or F.min, input column, how two of its values combine, such as
    addition or F.least). The aggregate of a range is one row for each key in it; those few rows are scanned by key, so
    a key may fill any number of ranges. Null keys are a key; null inputs are skipped, a running value starts null.
    """
    parts = table.groupBy(*keys, "pid").agg(*[f(v).alias(f"_{c}") for c, (f, v, _) in totals.items()])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("pid").alias("_pid"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[f(f"_{c}").over(earlier).alias(f"_{c}") for c, (f, _, _) in totals.items()])
    inside = Window.partitionBy("pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = table.select("*", *[f(v).over(inside).alias(c) for c, (f, v, _) in totals.items()])
    joined = rows.join(before, _same(keys), "left")
    both = {c: F.when(F.col(c).isNull(), F.col(f"_{c}")).when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(combine(F.col(c), F.col(f"_{c}"))) for c, (_, _, combine) in totals.items()}
    return joined.withColumns(both).drop("_pid", *[f"_key_{k}" for k in keys], *[f"_{c}" for c in totals])


def plus(a: Column, b: Column) -> Column:
    return a + b


SUM, LEAST = (F.sum, plus), (F.min, F.least)


def total(kind: tuple[Callable, Callable], column: str) -> tuple[Callable, str, Callable]:
    """An entry of ``scan``'s totals."""
    return kind[0], column, kind[1]


def most_open(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, most, at): how many intervals [start, end) of a key are open at once at most, and the first time they are.

    A sweep: +1 at each start and -1 at each end, summed by time first, then ranges of (key, time) with carried sums; the
    maximum of the ranges' maxima needs no key in one task. An interval without a start, or that ends by its start, is
    never open; one without an end stays open. Keys without an open interval have no row.
    """
    real = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    steps = real.select(*keys, F.inline(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("step")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("step"))))).filter("t IS NOT NULL")
    by_time = ranged(steps.groupBy(*keys, "t").agg(F.sum("step").alias("step")), [*keys, "t"], "sweep")
    swept = scan(by_time, keys, ["t"], {"open": total(SUM, "step")})
    number = F.unix_micros(F.col("t").cast("timestamp")) if dict(by_time.dtypes)["t"] in ("date", "timestamp", "timestamp_ntz") else F.col("t")
    best = F.max_by("t", F.struct("open", -number))
    return swept.groupBy(*keys).agg(F.max("open").alias("most"), best.alias("at"))


def token_bucket(ticks: DataFrame, keys: list[str], t: str, due: str, slots: str, most: int = 40, attempts: int = 6) -> DataFrame:
    """Adds served, scheduled, pending and failed of a source whose insertions fall due over time and may fail.

    ``due``: insertions due up to and with the tick, never falling; ``slots``: insertions that succeed in the tick before one
    fails. A tick schedules what is due while fewer than ``most`` wait, then tries up to ``attempts`` and stops at the first
    failure. So with s(i) served up to tick i, s(i) = min(due(i), s(i-1) + c(i)), c the slots up to ``attempts``: additions
    with a ceiling, whose composition is again one. With C the running sum of c, s = C + min(0, running min of due - C),
    which is two scans over ranges of a source's ticks. Null ``due`` and ``slots`` count as 0; ties of ``t`` are one order each
    by due and slots.
    """
    c = F.least(F.lit(attempts), F.greatest(F.lit(0), F.coalesce(F.col(slots), F.lit(0)))).cast("long")
    table = ranged(ticks.withColumn("_due", F.coalesce(F.col(due), F.lit(0)).cast("long")).withColumn("_c", c), [*keys, t, "_due", "_c"], "ticks")
    order = [t, "_due", "_c"]
    summed = written(scan(table, keys, order, {"_sum": total(SUM, "_c")}).withColumn("_room", F.col("_due") - F.col("_sum")), "room")
    swept = scan(summed, keys, order, {"_low": total(LEAST, "_room")})
    served = F.col("_sum") + F.least(F.lit(0), F.col("_low"))
    done = written(swept.withColumn("total_served", served.cast("long")), "served")
    # what was served before a tick: by the row before in its range, else by the ranges before
    parts = done.groupBy(*keys, "pid").agg(F.max("total_served").alias("_m"))
    before = parts.select(F.col("pid").alias("_pid"), *[F.col(k).alias(f"_key_{k}") for k in keys], F.max("_m").over(Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = done.withColumn("_last", F.lag("total_served").over(Window.partitionBy("pid", *keys).orderBy(*order))).join(before, _same(keys), "left")
    was = F.coalesce("_last", "_before", F.lit(0))
    waiting = F.least(F.lit(most), F.col("_due") - was)
    now = F.col("total_served") - was
    out = rows.withColumns({"served": now, "pending": waiting - now, "total_scheduled": was + waiting, "failed": F.when((now < waiting) & (now < attempts), 1).otherwise(0)})
    return out.select(*ticks.columns, "served", "pending", "failed", "total_served", "total_scheduled")

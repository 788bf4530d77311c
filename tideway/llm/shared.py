"""Helpers that the corpus operators share: intermediate tables, ranged prefix sums, word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The word pattern of every word-based operator: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode, where driver and tasks are one machine, a
    folder of our own is made where that is unset; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tideway-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives a lost executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tideway_path = path
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_root(spark)}/tideway/{name}-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, value: str, place: str, folder: str, between: str = "\n") -> None:
    """Plain files of binary values, each value followed by ``between``, in a folder ``place``=... for each value of that string column.

    Spark's text writer copies the bytes as they are, commits whole tasks, and writes to any store that Spark knows. Rows of
    a task that share a place must stand together.
    """
    raw = rows.select(F.col(value).cast("string").alias("value"), place)
    raw.write.option("lineSep", between).partitionBy(place).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all files below a folder of ``write_files``, one row each."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now instead of at the driver's next collection.

    For the few places where an operator has just written a table and will shuffle as much again. The first collection
    frees the query, the second what it held; nothing waits.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "tideway_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str = "text"):
    """The text column, null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ranged(df: DataFrame, order: list, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` range-partitioned by ``order`` and written, with column ``pid``: all of pid i sorts before pid i + 1."""
    n = partitions(df.sparkSession)
    return materialize(df.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()), name, codec)


def below_hash(rows: DataFrame, shares: dict[str, float], many: int) -> DataFrame:
    """(g, at, t): for each group of ``shares`` its ``many`` first rows (g, k, t) by (k, t), of those whose uniform hash k is in the lower share."""
    ends = [(g, (1 << 63) - 1 if share >= 1 else int(share * (1 << 64)) - (1 << 63)) for g, share in shares.items()]
    near = rows.join(F.broadcast(rows.sparkSession.createDataFrame(ends, "g string, last long")), "g").filter("k <= last")
    at = F.row_number().over(Window.partitionBy("g").orderBy("k", "t"))
    return near.withColumn("at", at).filter(F.col("at") <= many).select("g", "at", "t")


def least_hashed(rows: DataFrame, counts: dict[str, int], many: int) -> dict[str, list[str]]:
    """For each group of ``counts`` (group: its number of rows), column t of its ``many`` first rows (g, k, t) by (k, t).

    k is a uniform hash, so rows above the hash that twice as many lie below in the mean are dropped where they are read:
    what is shuffled and collected does not grow with the table or its partitions. A group whose hashes tie, as those of
    null ids do, may have too few rows below; it is read again in full, and each task passes on its ``many`` first.
    """

    def first(shares: dict[str, float]) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {g: [] for g in shares}
        for r in below_hash(rows, shares, many).orderBy("g", "at").collect():  # many a group
            found[r["g"]].append(r["t"])
        return found

    if not counts:
        return {}
    found = first({g: 2 * many / max(1, n) for g, n in counts.items()})
    short = {g: 1.0 for g, n in counts.items() if len(found[g]) < min(many, n)}
    return {**found, **first(short)} if short else found


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the one row that ``table`` has of each key; its column ``uses`` says how many of the ``total`` rows have that key.

    A key of more than an even share of the rows is spread over as many salts as it has shares. Such keys are fewer than
    the shuffle has partitions, whatever the table, so their list may be broadcast. Null keys meet nothing.
    """
    share = max(1, total // partitions(rows.sparkSession))
    salts = F.ceil(F.col("uses") / share).cast("int")
    hot = table.filter(F.col("uses") > share).select(*keys, salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("uses")
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt")


def prefix_sums(table: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` over a table of ``ranged``.

    Totals per (pid, group) are one small row each; their running sums are added to sums inside each range partition,
    so neither a hot group nor the whole table ever meets in one task. Null group values are groups of their own.
    """
    totals = table.groupBy("pid", *group).agg(F.sum(value).alias("_part"))
    before = F.coalesce(F.sum("_part").over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("pid", *[F.col(g).alias(f"_{g}") for g in group], before.alias("_start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = table.withColumn("_inside", inside)
    on = [rows["pid"] == starts["pid"]] + [rows[g].eqNullSafe(starts[f"_{g}"]) for g in group]
    joined = rows.join(starts, on, "left").drop(starts["pid"])
    return joined.withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside", *[f"_{g}" for g in group])


# ---------------------------------------------------------------------------------------------------------------------
# Words of a block of texts as 64-bit hashes, without a Python loop over words.

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_WHITE = b" \t\n\v\f\r"


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte at each of the first PLACES places of a word.
PLACES = 64
_AT = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _RADIX)


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 bytes; A-Z count as a-z if ``lower``.

    A word's hash is the mixed sum of one random-looking number for each pair of byte and place, so no word is a linear
    image of another.
    """
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = _LOWER[b]
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(size.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    values = _AT[(place & (PLACES - 1)) << 8 | b[~space]]
    with np.errstate(over="ignore"):
        if size.max() > PLACES:
            far = np.flatnonzero(place >= PLACES)
            values[far] = mix(values[far] ^ mix((place[far] // PLACES).astype(np.uint64)))
        return mix(np.add.reduceat(values, first) + size.astype(np.uint64)), start, end


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h = mix(h * _RADIX + words[k : len(words) - n + 1 + k])
    return h


def blocks(texts: list[bytes], most: int = 1 << 20):
    """Cut a batch into runs (first, last) of texts of about ``most`` bytes; a longer text is a run by itself."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text.

    A text of fewer than ``n`` words has its whole word sequence as its one shingle; one without words has none.
    """
    sets = []
    for a, b in blocks(texts):
        part = texts[a:b]
        words, start, _ = word_hashes(b"\n".join(part))
        every = shingle_hashes(words, n)
        bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in part])).tolist()
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            own = every[first : last - n + 1] if last - first >= n else shingle_hashes(words[first:last], max(1, last - first))
            own = np.sort(own)
            if len(own) > 1:
                new = np.empty(len(own), bool)
                new[0] = True
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
            sets.append(own)
    return sets


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch whose ``column`` has about ``most`` bytes; a longer value stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size)
    first = 0
    while first < len(size):
        base = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, base + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def exact_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text as numbers that stand for the words themselves, within one call.

    A-Z count as a-z. A text of fewer than ``n`` words has its whole sequence as its one shingle, a negative number.
    """
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string()))))
    bounds = split.offsets.to_numpy()
    coded = pc.dictionary_encode(split.values)
    word, kinds = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    run, span = word, kinds
    for k in range(1, n):
        if span > (1 << 62) // kinds:
            seen, run = np.unique(run, return_inverse=True)
            span = max(1, len(seen))
        run, span = run[: max(0, len(run) - 1)] * kinds + word[k:], span * kinds
    short: dict = {}
    sets = []
    for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(run[a : b - n + 1]))
        elif not t.strip(_WHITE):
            sets.append(run[:0])
        else:
            sets.append(np.array([short.setdefault(tuple(word[a:b].tolist()), -1 - len(short))], np.int64))
    return sets


def text_bytes(column) -> list[bytes]:
    """Values of an Arrow string column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]

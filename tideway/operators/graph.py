"""Paths over a table of edges (src, dst, length): contraction, then rounds over a frontier, each linear in the edges that leave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.operators.scans import discard, written


#: A task that adds the labels of all sources to edges has about so many, however large the table.
EDGES_A_TASK = 100_000


def _known(edges: DataFrame) -> DataFrame:
    """The shortest edge of each pair of different nodes; edges without an end or a length, and loops, lead nowhere."""
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL AND length IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.min("length").alias("length"))


def _graph(edges: DataFrame) -> DataFrame:
    """``_known`` edges, written; a negative or zero length is an error, as rounds might never end or a path meet itself."""
    graph = written(_known(edges), "edges")
    if graph.filter("length <= 0").limit(1).count():
        raise ValueError("edges need lengths over 0")
    return graph


def _best(steps: DataFrame) -> DataFrame:
    """The least (length, via) of each pair."""
    return steps.groupBy("src", "dst").agg(F.min(F.struct("length", "via")).alias("best")).select("src", "dst", "best.length", "best.via")


def _outside(rows: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """``rows`` whose ``end`` is none of ``nodes`` (node)."""
    return rows.join(nodes.select(F.col("node").alias("_node")), F.col(end) == F.col("_node"), "left_anti")


def path_labels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, length, via): the length of the shortest path from each of ``sources`` (src) to each node that it reaches, and the node before the last.

    Of paths of equal length the smallest ``via`` stands. Lengths are over 0, anything else is an error.
    """
    graph = _graph(edges)
    labels = _labels(graph, sources)
    discard(graph)
    return labels


def _labels(graph: DataFrame, sources: DataFrame) -> DataFrame:
    """``path_labels`` over edges as ``_known`` makes them.

    Nodes with one way in (``_past_inlets``) and then those with at most one way out (``_past_fringe``) are contracted, so
    that rounds run over what is left; edges to contracted nodes are met once, when the lengths before them are final.
    Sources are never contracted. Fractions are not contracted, as their sums depend on the order.
    """
    start = written(sources.filter("src IS NOT NULL").select("src").distinct(), "sources")
    kind = dict(graph.dtypes)["length"]
    plain = graph.withColumn("via", F.col("src"))
    if kind in ("float", "double"):
        return _rounds(plain, start, kind)
    inlets, past = _past_inlets(graph, start, kind)
    core, short, fringe = _past_fringe(past, start, kind)
    inner = _rounds(short, start, kind)
    outer = written(_fringe_labels(inner, fringe, start.count(), kind), "fringe")
    known = inner.unionByName(outer)
    behind = inlets.select(F.col("src").alias("via"), F.col("dst").alias("to"), F.col("length").alias("more"))
    last = known.drop("via").join(behind, F.col("dst") == F.col("via")).select("src", F.col("to").alias("dst"), (F.col("length") + F.col("more")).cast(kind).alias("length"), "via")
    out = known.unionByName(written(last, "inlets"))
    discard(inlets, past, core, short, start)
    return out


def _past_inlets(graph: DataFrame, start: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Inlets as their edges, and the edges (with ``via``, the node before the last) that lead past them.

    An inlet has one node before it, which is none itself; all paths to it come from there.
    """
    single = graph.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("node")
    single = written(_outside(single, start.select(F.col("src").alias("node")), "node"), "single")
    inlets = written(_outside(graph.join(single, F.col("dst") == F.col("node")).drop("node"), single, "src"), "inlets")
    before = inlets.select(F.col("src").alias("_before"), F.col("dst").alias("_inlet"), F.col("length").alias("_more"))
    onward = _outside(graph, inlets.select(F.col("dst").alias("node")), "dst").join(before, F.col("src") == F.col("_inlet"), "left")
    length = (F.col("length") + F.coalesce("_more", F.lit(0).cast(kind))).cast(kind).alias("length")
    past = onward.select(F.coalesce("_before", "src").alias("src"), "dst", length, F.col("src").alias("via")).filter("src <> dst")
    past = written(_best(past), "past")
    discard(single)
    return inlets, past


def _past_fringe(past: DataFrame, start: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes of the core, the edges between them and past the fringe, and the edges to the fringe.

    A fringe node has at most one node after it, which is neither a fringe node nor could be one.
    """
    busy = past.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    kept = written(busy.union(start).distinct(), "kept")
    chained = _outside(_outside(past, kept, "src"), kept, "dst").select(F.col("src").alias("node"))
    core = written(kept.union(chained).distinct(), "core")
    fringe = _outside(past, core, "dst")
    leave = _outside(past, core, "src").select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("length").alias("_more"), F.col("via").alias("_via"))
    through = fringe.join(leave, F.col("dst") == F.col("_at")).select("src", F.col("_to").alias("dst"), (F.col("length") + F.col("_more")).cast(kind).alias("length"), F.col("_via").alias("via")).filter("src <> dst")
    both = core.select(F.col("node").alias("_core"))
    inside = past.join(both, F.col("dst") == F.col("_core"), "left_semi").join(both, F.col("src") == F.col("_core"), "left_semi")
    short = written(_best(inside.unionByName(through)), "short")
    discard(kept)
    return core, short, fringe


def _fringe_labels(inner: DataFrame, fringe: DataFrame, n_sources: int, kind: str) -> DataFrame:
    """Labels of the nodes that ``fringe`` leads to.

    An edge is left out if another edge to the same node gives every source a smaller label: what the farthest source has
    by the one is then less than what the nearest has by the other.
    """
    extent = inner.groupBy(F.col("dst").alias("at")).agg(F.min("length").alias("least"), F.when(F.count(F.lit(1)) == n_sources, F.max("length")).alias("most"))
    parts = max(int(fringe.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + fringe.count() // EDGES_A_TASK)
    near = fringe.repartition(parts, "dst").join(extent, F.col("src") == F.col("at")).drop("at")
    label = lambda c: F.struct((F.col("length") + F.col(c)).cast(kind).alias("length"), "via")
    bounds = near.filter("most IS NOT NULL").groupBy(F.col("dst").alias("_to")).agg(F.min(label("most")).alias("bound"))
    useful = near.join(bounds, F.col("dst") == F.col("_to"), "left").filter(F.col("bound").isNull() | (label("least") <= F.col("bound"))).select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("length").alias("more"), F.col("via").alias("by"))
    steps = useful.join(inner.drop("via"), F.col("at") == F.col("dst")).select("src", F.col("to").alias("dst"), (F.col("length") + F.col("more")).cast(kind).alias("length"), F.col("by").alias("via"))
    return _best(steps)


def _rounds(graph: DataFrame, start: DataFrame, kind: str) -> DataFrame:
    """Labels over edges (src, dst, length, via), by label correcting.

    A round takes the edges that leave nodes whose length fell in the round before, keeps one best (length, via) a pair,
    and ends where no length falls.
    """
    node = dict(graph.dtypes)["src"]
    labels = written(start.select("src", F.col("src").alias("dst"), F.lit(0).cast(kind).alias("length"), F.lit(None).cast(node).alias("via"), F.lit(True).alias("fell")), "labels")
    while True:
        front = labels.filter("fell").select(F.col("src").alias("from"), F.col("dst").alias("at"), F.col("length").alias("so_far"))
        steps = front.join(graph, F.col("at") == F.col("src")).select(F.col("from").alias("src"), "dst", (F.col("so_far") + F.col("length")).cast(kind).alias("length"), "via")
        tried = steps.groupBy("src", "dst").agg(F.min(F.struct("length", "via")).alias("label"), F.lit(False).alias("old"))
        had = labels.select("src", "dst", F.struct("length", "via").alias("label"), F.lit(True).alias("old"))
        # one row of either kind a pair, so a group has two rows at most
        both = had.unionByName(tried).groupBy("src", "dst").agg(F.min("label").alias("best"), F.min(F.when(F.col("old"), F.col("label.length"))).alias("was"))
        better = written(both.select("src", "dst", "best.length", "best.via", (F.col("was").isNull() | (F.col("best.length") < F.col("was"))).alias("fell")), "labels")
        discard(labels)
        labels = better
        if not labels.filter("fell").limit(1).count():
            return labels.drop("fell")


def routes(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, length, path) of each different pair of ``pairs``: the nodes of its shortest path by ``path_labels``.

    The pairs of a level are the source and the node before the last of those of the level above, each once, so paths that
    share a beginning are followed back together; from the last level up each path is the one before it and its end. A pair
    without a path has the source alone and no length, as has a pair of one node, with length 0. Pairs with a null end are
    left out.
    """
    asked = pairs.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    at = labels.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "length", "via")
    levels = []
    while True:
        # below the first level every pair has a label, so a small level need not move the labels
        met = asked.join(at, (F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")), "inner" if levels else "left")
        levels.append(written(met.drop("_src", "_dst"), "level"))
        asked = written(levels[-1].filter("via IS NOT NULL").select("src", F.col("via").alias("dst")).distinct(), "before")
        if not asked.limit(1).count():
            break
    ends = F.when(F.col("length").isNull(), F.array("src")).otherwise(F.array("dst"))
    out = levels[-1].select("src", "dst", "length", ends.alias("path"))
    for k in range(len(levels) - 2, -1, -1):
        before = out.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("path").alias("_path"))
        longer = levels[k].join(before, (F.col("src") == F.col("_src")) & (F.col("via") == F.col("_dst")))
        out = levels[k].filter("via IS NULL").select("src", "dst", "length", ends.alias("path")).unionByName(longer.select("src", "dst", "length", F.concat("_path", F.array("dst")).alias("path")))
        out = written(out, "paths") if k else out
    return out


def shortest_routes(edges: DataFrame, pairs: DataFrame, avoid: Column | str | int | None = None) -> DataFrame:
    """(src, dst, length, path) of each different pair.

    ``avoid``: a node that no path may pass; pairs that begin or end there, and pairs that only it connects, take the
    shortest path of the whole graph.
    """
    graph = _graph(edges)
    asked = written(pairs.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "asked")
    if avoid is None:
        out = routes(_labels(graph, asked), asked)
        discard(graph)
        return out
    around = graph.filter((F.col("src") != avoid) & (F.col("dst") != avoid))
    free = asked.filter((F.col("src") != avoid) & (F.col("dst") != avoid))
    detours = written(routes(_labels(around, free), free), "detours")
    plain = written(detours.filter("length IS NULL").select("src", "dst").unionByName(asked.filter((F.col("src") == avoid) | (F.col("dst") == avoid))), "plain")
    found = detours.filter("length IS NOT NULL")
    if plain.limit(1).count():
        found = found.unionByName(routes(_labels(graph, plain), plain))
    discard(graph)
    return found


def reachable_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst): every node that a path from one of ``sources`` (src) meets, the source itself left out.

    Path labels of whole lengths 0: a pair falls once, when it is first found.
    """
    graph = written(_known(edges).select("src", "dst", F.lit(0).alias("length")), "edges")
    labels = _labels(graph, sources)
    discard(graph)
    return labels.select("src", "dst").filter("src <> dst")

"""Queries over graphs, trips and demand that are made of the trade tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway import params as P
from tideway.functions import text as X
from tideway.operators import catalogs as K
from tideway.operators import context as C
from tideway.operators import graph as N
from tideway.operators import history as H
from tideway.operators import network as R
from tideway.operators import scans as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Graph: nation -> its suppliers -> the customers that they deliver to -> the customers' nations, with whole lengths over 0.


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier, customer, quantity) of every line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey", "l_quantity")


def _trade_edges(spark: SparkSession, sf_dir: str, goods: DataFrame) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    worth = lambda c: (F.lit(1) + F.floor(F.abs(c) / 1000)).cast("long")
    out = table(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"), worth("s_acctbal").alias("length"))
    to = goods.select(name("s", "l_suppkey").alias("src"), name("c", "o_custkey").alias("dst"), F.floor("l_quantity").cast("long").alias("length"))
    home = table(spark, sf_dir, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey"), worth("c_acctbal"))
    return out.union(to).union(home)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade_edges(spark, sf_dir, trades(spark, sf_dir).groupBy("l_suppkey", "o_custkey").agg(F.min("l_quantity").alias("l_quantity")))


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges, one for each line item, and pairs from the nation of each supplier to each customer that a supplier of that nation delivers to."""
    goods = S.written(trades(spark, sf_dir), "trades")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = goods.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "o_custkey").distinct()
    named = pairs.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    return _trade_edges(spark, sf_dir, goods), named


TRADES = """e AS MATERIALIZED (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst, (1 + floor(abs(s_acctbal) / 1000))::BIGINT AS length FROM supplier
  UNION ALL SELECT 's' || l_suppkey, 'c' || o_custkey, floor(min(l_quantity))::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, (1 + floor(abs(c_acctbal) / 1000))::BIGINT FROM customer),
asked AS MATERIALIZED (SELECT DISTINCT 'n' || s_nationkey AS src, 'c' || o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def labels_sql(name: str, edges: str) -> str:
    """Lengths by a recursive table with keys, then the least node before the last on any shortest path, then the paths."""
    return f"""{name}(src, dst, length) USING KEY (src, dst) AS (
  SELECT DISTINCT src, src, 0::BIGINT FROM asked
  UNION SELECT d.src, e.dst, min(d.length + e.length) FROM {name} d JOIN {edges} e ON e.src = d.dst LEFT JOIN recurring.{name} k ON k.src = d.src AND k.dst = e.dst
    WHERE k.length IS NULL OR d.length + e.length < k.length GROUP BY d.src, e.dst),
{name}_via AS MATERIALIZED (SELECT d.src, d.dst, any_value(d.length) AS length, min(e.src) AS via FROM {name} d JOIN {edges} e ON e.dst = d.dst JOIN {name} b ON b.src = d.src AND b.dst = e.src AND b.length + e.length = d.length GROUP BY d.src, d.dst),
{name}_path(src, dst, length, prev, path) AS (SELECT a.src, a.dst, v.length, v.via, v.via || '>' || a.dst FROM asked a JOIN {name}_via v ON v.src = a.src AND v.dst = a.dst
  UNION ALL SELECT p.src, p.dst, p.length, v.via, v.via || '>' || p.path FROM {name}_path p JOIN {name}_via v ON v.src = p.src AND v.dst = p.prev)"""


@query(f"WITH RECURSIVE {TRADES}, {labels_sql('d', 'e')} SELECT src, dst, length, path AS route FROM d_path WHERE prev = src")
def shortest_path(spark, sf_dir):
    return N.shortest_routes(*trade_graph(spark, sf_dir)).select("src", "dst", "length", F.array_join("path", ">").alias("route"))


#: A node that exists at every scale.
CLOSED = "s7"


@query(f"""WITH RECURSIVE {TRADES}, open AS MATERIALIZED (SELECT * FROM e WHERE src <> '{CLOSED}' AND dst <> '{CLOSED}'), {labels_sql('d', 'e')}, {labels_sql('o', 'open')}
SELECT src, dst, coalesce(o.length, d.length) AS length, coalesce(o.path, d.path) AS route FROM (SELECT * FROM d_path WHERE prev = src) d LEFT JOIN (SELECT * FROM o_path WHERE prev = src) o USING (src, dst)""")
def route_avoiding(spark, sf_dir):
    return N.shortest_routes(*trade_graph(spark, sf_dir), CLOSED).select("src", "dst", "length", F.array_join("path", ">").alias("route"))


@query(f"""WITH RECURSIVE {TRADES}, r(src, dst) AS (SELECT DISTINCT src, src FROM asked UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r WHERE src <> dst""")
def reachable(spark, sf_dir):
    return N.reachable_from(*trade_graph(spark, sf_dir))


# Trips: a line item is pending from its order's date to its shipping.


@query("""WITH i AS (SELECT l_returnflag AS flag, o_orderdate AS a, l_shipdate AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate),
s AS (SELECT flag, a AS t, 1 AS step FROM i UNION ALL SELECT flag, b, -1 FROM i),
o AS (SELECT flag, t, sum(sum(step)) OVER (PARTITION BY flag ORDER BY t) AS open FROM s GROUP BY flag, t)
SELECT flag, max(open)::BIGINT AS most, arg_max(t, (open, -epoch_us(t))) AS at FROM o GROUP BY flag""")
def max_pending(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), "l_shipdate")
    trips = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.most_open(trips, ["flag"], "o_orderdate", "l_shipdate")


# Demand: a day of orders is a tick of its priority, an order in it that is done frees a slot, and insertions fall due evenly.

TICKS = """t AS (SELECT o_orderpriority AS source, o_orderdate::DATE AS day, count(*) FILTER (o_orderstatus = 'F') AS slots, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT source, min(day) AS first, 1 + sum(n) // (2 * (max(day) - min(day) + 1)) AS rate FROM t GROUP BY source),
k AS (SELECT source, day, slots, ((day - first + 1) * rate)::BIGINT AS due, row_number() OVER (PARTITION BY source ORDER BY day) AS nth FROM t JOIN r USING (source))"""


@query(f"""WITH RECURSIVE {TICKS}, f AS (SELECT source, day, nth, least(due, least(6, slots)) AS total_served, 0::BIGINT AS was, due, slots FROM k WHERE nth = 1
  UNION ALL SELECT k.source, k.day, k.nth, least(k.due, f.total_served + least(6, k.slots)), f.total_served, k.due, k.slots FROM f JOIN k ON k.source = f.source AND k.nth = f.nth + 1)
SELECT source, day, due, slots, total_served - was AS served, least(40, due - was) - (total_served - was) AS pending, (total_served - was < least(40, due - was) AND total_served - was < 6)::INT AS failed, total_served, was + least(40, due - was) AS total_scheduled FROM f""")
def token_bucket(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    days = o.groupBy("source", "day").agg(F.count_if(F.col("o_orderstatus") == "F").alias("slots"), F.count(F.lit(1)).alias("n"))
    span = F.date_diff(F.max("day"), F.min("day")) + 1
    rates = days.groupBy("source").agg(F.min("day").alias("first"), (1 + F.floor(F.sum("n") / (2 * span))).alias("rate"))
    ticks = days.join(rates, "source").select("source", "day", ((F.date_diff("day", "first") + 1) * F.col("rate")).cast("long").alias("due"), "slots")
    return S.token_bucket(ticks, ["source"], "day", "due", "slots")


# One key: every event of the table belongs to one series, so its history fills all ranges.


@query("""WITH RECURSIVE n AS (SELECT event_id, (epoch_us(ts) / 1000000.0 - 1704067200)::DOUBLE AS sim_t, row_number() OVER (ORDER BY ts, event_id) AS nth FROM events),
k AS (SELECT event_id, sim_t, nth, sim_t AS last, true AS kept FROM n WHERE nth = 1
  UNION ALL SELECT n.event_id, n.sim_t, n.nth, CASE WHEN n.sim_t - k.last >= 1800 THEN n.sim_t ELSE k.last END, n.sim_t - k.last >= 1800 FROM k JOIN n ON n.nth = k.nth + 1)
SELECT event_id, sim_t FROM k WHERE kept""")
def cadence_one_key(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) - 1704067200
    e = table(spark, sf_dir, "events").select(F.lit("all").alias("series"), "event_id", t.alias("sim_t"))
    return H.cadence(e, ["series"], "sim_t", 1800.0).select("event_id", "sim_t")


# Destinations: an order is a trip from its customer's nation; the trade of a priority weighs its destinations.

NATIONS, INSIDE = [str(k) for k in range(25)], ["A", "B", "C", "D"]


@query("""WITH t AS (SELECT o_orderkey AS trip, o_orderpriority AS profile, c_nationkey::VARCHAR AS source FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT *, ('0x' || substr(md5('42:' || source || ':' || trip), 1, 8))::BIGINT AS h FROM t), d AS (SELECT trip, profile, source, h % 10000 AS branch, (h // 10000) % 10000 AS draw FROM h),
n AS (SELECT profile, source, s_nationkey::VARCHAR AS dest, count(*) AS n FROM t JOIN lineitem ON l_orderkey = trip JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
w AS (SELECT profile, source, dest, n * 10000 // sum(n) OVER (PARTITION BY profile, source) AS weight FROM n),
p AS (SELECT a.profile, b.node::VARCHAR AS source, c.node::VARCHAR AS dest, c.node AS place FROM (SELECT DISTINCT profile FROM w) a, (SELECT range AS node FROM range(25)) b, (SELECT range AS node FROM range(25)) c WHERE b.node <> c.node),
k AS (SELECT *, greatest(100, coalesce(weight, 500))::BIGINT AS w FROM p LEFT JOIN w USING (profile, source, dest)),
i AS (SELECT profile, source, dest, sum(w) OVER (PARTITION BY profile, source ORDER BY place) - w AS lo, sum(w) OVER (PARTITION BY profile, source ORDER BY place) AS hi, sum(w) OVER (PARTITION BY profile, source) AS total FROM k)
SELECT trip, d.profile, d.source, CASE WHEN branch < 1500 THEN ['A', 'B', 'C', 'D'][branch * 4 // 1500 + 1] ELSE dest END AS dest
FROM d LEFT JOIN i ON branch >= 1500 AND d.profile = i.profile AND d.source = i.source AND draw * total >= lo * 10000 AND draw * total < hi * 10000""")
def weighted_destination(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("source"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.col("o_orderpriority").alias("profile"), "o_custkey")
    trips = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("trip", "profile", "source")
    r, r2 = X.stable_draws("42", F.col("source"), F.col("trip"))
    whole = lambda x: F.round(x * 10000).cast("long")
    drawn = trips.withColumns({"branch": whole(r), "draw": whole(r2)})
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("dest"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = trips.join(lines, F.col("l_orderkey") == F.col("trip")).groupBy("profile", "source", "dest").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("profile", "source").agg(F.sum("n").alias("total"))
    weights = counts.join(totals, ["profile", "source"]).select("profile", "source", "dest", F.expr("n * 10000 div total").alias("weight"))
    return R.weighted_destinations(drawn, weights, ["profile"], NATIONS, INSIDE, "branch", "draw").select("trip", "profile", "source", "dest")


# Catalogs: an order is a road network whose line items are its edges, wrong where its line items say so.

CATALOG = {
    "approaches": [("T1", "North", "L1"), ("T1", "South", "L2"), ("T2", "East", "L3")],
    "outgoing": [("T1", "L1"), ("T2", "L4")],
    "links": [("K1", "L1"), ("K2", "L2")],
    "nodes": {"A": "T1", "B": "T2"},
}


def order_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, doc). An order of priority 5-LOW lacks a part, one in progress has another node map, one of under 50,000 another
    hash; line 2 returned means a link to another edge, line 1 no link; line 3 returned a movement from elsewhere, open none."""
    lines = table(spark, sf_dir, "lineitem")
    edge = F.struct(F.format_string("S%d", "l_suppkey").alias("from"), F.format_string("L%d", "l_linenumber").alias("id"), F.floor("l_quantity").cast("int").alias("numLanes"), F.format_string("P%d", "l_partkey").alias("to"))
    join = F.struct(F.lit("s").alias("dir"), F.format_string("L%d", "l_linenumber").alias("from"), F.lit(0).alias("fromLane"), F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")).alias("linkIndex"), F.col("l_linestatus").alias("tl"), F.lit("X").alias("to"), F.lit(1).alias("toLane"), F.lit(None).cast("string").alias("via"))
    flag = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_returnflag")))
    by_id = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), c.alias("row")))), lambda x: x["row"])  # noqa: E731  an order has seven lines at most
    nets = lines.groupBy("l_orderkey").agg(by_id(edge).alias("edges"), by_id(join).alias("connections"), flag(1).alias("f1"), flag(2).alias("f2"), flag(3).alias("f3"))
    o = table(spark, sf_dir, "orders").join(nets, F.col("o_orderkey") == F.col("l_orderkey"))
    second = F.when(F.col("o_orderstatus") == "P", "T9").otherwise("T2")
    nodes = F.create_map(F.lit("A"), F.lit("T1"), F.lit("B"), second)
    # written by hand, so that the operator's own canonical form is compared with another one
    edge_text = F.array_join(F.transform("edges", lambda e: F.format_string('{"from":"%s","id":"%s","numLanes":%d,"to":"%s"}', e["from"], e["id"], e["numLanes"], e["to"])), ",")
    join_text = F.array_join(F.transform("connections", lambda c: F.format_string('{"dir":"s","from":"%s","fromLane":0,"linkIndex":%s,"tl":"%s","to":"X","toLane":1,"via":null}', c["from"], F.coalesce(c["linkIndex"].cast("string"), F.lit("null")), c["tl"])), ",")
    canonical = F.format_string('{"connections":[%s],"edges":[%s],"node_to_tls":{"A":"T1","B":"%s"}}', join_text, edge_text, second)
    link = lambda e: F.struct(F.lit(e).alias("edge") if isinstance(e, str) else e.alias("edge"))
    links = F.map_filter(F.create_map(F.lit("K1"), link("L1"), F.lit("K2"), link(F.when(F.col("f2") == "R", "L9").otherwise("L2"))), lambda k, v: (k != "K1") | F.coalesce(F.col("f1") != "R", F.lit(True)))
    move = lambda *edges: F.array(*[F.struct(F.lit(e).alias("from")) for e in edges])
    third = F.when(F.col("f3") == "R", move("L3", "L7")).when(F.col("f3") == "N", F.array().cast("array<struct<from: string>>")).otherwise(move("L3"))
    moves = F.create_map(F.lit("T1"), F.create_map(F.lit("North"), move("L1"), F.lit("South"), move("L2", "L2")), F.lit("T2"), F.map_filter(F.create_map(F.lit("East"), third), lambda k, v: F.col("f3").isNotNull()))
    body = F.struct(F.when(F.col("o_totalprice") < 50000, "other").otherwise(F.sha2(canonical, 256)).alias("topology_hash"), nodes.alias("node_to_tls"), F.col("edges"), F.col("connections"), links.alias("inter_node_links"), moves.alias("movements_by_approach"), F.create_map(F.lit("T1"), F.lit("x")).alias("approach_edges"), F.when(F.col("o_orderpriority") != "5-LOW", F.array(F.lit("L1"))).alias("outgoing_edges"))
    return o.select("o_orderkey", F.to_json(body).alias("doc"))


@query("""WITH l AS (SELECT l_orderkey AS k, list('L' || l_linenumber) AS ids, max(l_returnflag) FILTER (l_linenumber = 1) AS f1, max(l_returnflag) FILTER (l_linenumber = 2) AS f2, max(l_returnflag) FILTER (l_linenumber = 3) AS f3,
  string_agg('{"from":"S' || l_suppkey || '","id":"L' || l_linenumber || '","numLanes":' || floor(l_quantity)::INT || ',"to":"P' || l_partkey || '"}', ',' ORDER BY l_linenumber, 'S' || l_suppkey, floor(l_quantity), 'P' || l_partkey) AS e,
  string_agg('{"dir":"s","from":"L' || l_linenumber || '","fromLane":0,"linkIndex":' || CASE WHEN l_returnflag = 'A' THEN l_linenumber::VARCHAR ELSE 'null' END || ',"tl":"' || l_linestatus || '","to":"X","toLane":1,"via":null}', ',' ORDER BY l_linenumber, l_returnflag = 'A', l_linestatus) AS c
  FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, l.*, sha256('{"connections":[' || c || '],"edges":[' || e || '],"node_to_tls":{"A":"T1","B":"' || CASE WHEN o_orderstatus = 'P' THEN 'T9' ELSE 'T2' END || '"}}') AS hash FROM orders JOIN l ON o_orderkey = k),
g AS (SELECT * FROM o WHERE o_orderpriority <> '5-LOW'),
x(rule, subject, edge) AS (VALUES ('approach_edge', 'T1/North', 'L1'), ('approach_edge', 'T1/South', 'L2'), ('approach_edge', 'T2/East', 'L3'), ('outgoing_edge', 'T1', 'L1'), ('outgoing_edge', 'T2', 'L4'), ('link_not_in_net', 'K1', 'L1'), ('link_not_in_net', 'K2', 'L2'))
SELECT o_orderkey, 'missing_key' AS rule, 'outgoing_edges' AS subject, NULL AS detail FROM o WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT o_orderkey, 'hash', NULL, hash FROM g WHERE o_totalprice < 50000
UNION ALL SELECT o_orderkey, 'nodes', NULL, NULL FROM g WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, rule, subject, edge FROM g JOIN x ON NOT list_contains(ids, edge)
UNION ALL SELECT o_orderkey, 'link_missing', 'K1', NULL FROM g WHERE f1 = 'R'
UNION ALL SELECT o_orderkey, 'link_edge', 'K2', 'L9' FROM g WHERE f2 = 'R'
UNION ALL SELECT o_orderkey, 'movements_missing', 'T2/East', NULL FROM g WHERE f3 IS NULL
UNION ALL SELECT o_orderkey, 'movements_empty', 'T2/East', NULL FROM g WHERE f3 = 'N'
UNION ALL SELECT o_orderkey, 'movement_from', 'T2/East', 'L7' FROM g WHERE f3 = 'R'""")
def catalog_errors(spark, sf_dir):
    return K.catalog_errors(order_catalogs(spark, sf_dir), "o_orderkey", **CATALOG)


# What the network's generators make of the trade tables.


@query(f"WITH {TRADES} SELECT src, dst, length FROM e WHERE src = 'n7' OR dst = 'n7'")
def node_links(spark, sf_dir):
    edges = trade_edges(spark, sf_dir).select(F.col("src").alias("up"), F.col("dst").alias("dn"), "length")
    return C.node_links(edges, "n7").select(F.col("up").alias("src"), F.col("dn").alias("dst"), "length")


@query("SELECT 'P' || l_partkey AS edge, min('S' || l_suppkey) AS tls_id FROM lineitem GROUP BY ALL")
def edge_signals(spark, sf_dir):
    return R.approach_signals(table(spark, sf_dir, "lineitem").select(F.format_string("P%d", "l_partkey").alias("edge"), F.format_string("S%d", "l_suppkey").alias("tls_id")))


@query(f"WITH {TRADES}, p AS (SELECT DISTINCT 'c' || o_custkey AS src, 'n' || (o_orderkey % 25) AS dst FROM orders), m AS (SELECT src, dst, min(length) AS length FROM e GROUP BY ALL) SELECT src, dst, length, length IS NOT NULL AS found FROM p LEFT JOIN m USING (src, dst)")
def edge_lookup(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.format_string("c%d", "o_custkey").alias("src"), F.format_string("n%d", F.col("o_orderkey") % 25).alias("dst"))
    return R.edge_lookups(trade_edges(spark, sf_dir), pairs)


TARGETS = "d AS (SELECT o_orderpriority AS profile, c_nationkey::VARCHAR AS source, count(*) AS target_vph FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def order_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each priority and nation, as its demand."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("o_orderpriority").alias("profile"), F.col("c_nationkey").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("target_vph"))


@query(f"WITH {TARGETS} SELECT profile, source, target_vph, greatest(0, target_vph - 110) AS delta_vph, round_even(3600.0::DOUBLE / nullif(greatest(0, target_vph - 110), 0), 4) AS interval_s FROM d")
def demand_delta(spark, sf_dir):
    return R.demand_deltas(order_targets(spark, sf_dir), 110)


@query(f"WITH {TARGETS} SELECT profile, source, floor(900 * greatest(0, target_vph - 110) / 3600)::BIGINT AS due FROM d")
def insertions_due(spark, sf_dir):
    return R.insertions_due(R.demand_deltas(order_targets(spark, sf_dir), 110), 900.0)


CLASSES = "c(vtype, w, sp) AS (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE, {s})" for s, m in (("false", P.CLASS_WEIGHTS), ("true", P.SPECIAL_SHARES)) for k, w in m.items()) + ")"
SPLIT = f"""{CLASSES}, t AS (SELECT o_custkey AS source, round_even(sum(o_totalprice) / 1000, 1)::DOUBLE AS total FROM orders GROUP BY ALL), p AS (SELECT *, round_even(total * w, 0)::INT AS part FROM t, c),
k AS (SELECT source, sum(part) AS core FROM p WHERE NOT sp GROUP BY source),
f AS (SELECT source, total, vtype, (CASE WHEN sp THEN greatest(1, part) ELSE greatest(0, part + CASE WHEN vtype = 'motorcycle' THEN round_even(total, 0)::INT - core ELSE 0 END) END)::INT AS vph FROM p JOIN k USING (source))"""


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worth of each customer's orders, in thousands, as the flow of its source."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.bround(F.sum("o_totalprice") / 1000, 1).alias("total"))


@query(f"WITH {SPLIT} SELECT source, total, vtype, vph FROM f")
def flow_split(spark, sf_dir):
    return R.flow_split(order_totals(spark, sf_dir))


@query(f"WITH {SPLIT}, di(flow, a, b, vtype) AS (VALUES " + ", ".join(str(x) for x in P.DIAGONALS) + """)
SELECT source || '_' || vtype AS flow, vtype, 'C' || source AS from_edge, 'N' || c_nationkey AS to_edge, vph FROM f JOIN customer ON source = c_custkey WHERE vph > 0 UNION ALL SELECT flow, vtype, a, b, 5 FROM di""")
def route_table(spark, sf_dir):
    ends = table(spark, sf_dir, "customer").select("c_custkey", F.format_string("C%d", "c_custkey").alias("from_edge"), F.format_string("N%d", "c_nationkey").alias("to_edge"))
    sources = order_totals(spark, sf_dir).join(ends, F.col("source") == F.col("c_custkey")).drop("c_custkey")
    return R.route_table(sources, spark.createDataFrame(P.DIAGONALS, "flow string, from_edge string, to_edge string, vtype string"))


@query("""WITH a AS (SELECT 'T' || l_suppkey AS tls, ['N', 'S', 'E', 'W'][l_linenumber % 4 + 1] AS d, lpad((l_partkey % 100)::VARCHAR, 2, '0') || lpad((l_suppkey % 100)::VARCHAR, 2, '0') AS e, l_linenumber % 3 AS i, l_quantity * 20 AS m FROM lineitem),
b AS (SELECT *, substr(e, 3, 2) || substr(e, 1, 2) AS o, greatest(0.1, m - 100) AS start FROM a)
SELECT 'E1_' || tls || '_' || d || '_' || i AS detector_id, 'E1' AS kind, e || '_' || i AS lane_id, greatest(0.1, m - 20)::DOUBLE AS pos_m, NULL::DOUBLE AS end_m FROM b
UNION ALL SELECT 'E2_' || tls || '_' || d || '_' || i, 'E2', e || '_' || i, start, start + least(100, greatest(1, m - start)) FROM b
UNION ALL SELECT 'E2OUT_' || tls || '_' || o || '_' || i, 'E2OUT', o || '_' || i, 5.0, 35.0 FROM b""")
def detector_layout(spark, sf_dir):
    two = lambda c: F.lpad((F.col(c) % 100).cast("string"), 2, "0")
    edge = F.concat(two("l_partkey"), two("l_suppkey"))
    side = F.element_at(F.array(*[F.lit(d) for d in ("North", "South", "East", "West")]), F.col("l_linenumber") % 4 + 1)
    a = table(spark, sf_dir, "lineitem").select(F.format_string("T%d", "l_suppkey").alias("tls_id"), side.alias("direction"), edge.alias("edge"), (F.col("l_linenumber") % 3).alias("lane_index"), (F.col("l_quantity") * 20).alias("length_m"))
    return R.detector_layout(a.withColumn("lane_id", F.concat_ws("_", "edge", "lane_index")))

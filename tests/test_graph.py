"""Graphs, sweeps and demand against plain Python: hot keys over several ranges, ties, nulls, repeated rows, empty tables."""

import heapq
import random
from collections import Counter, defaultdict

import pytest

from tideway import params as P
from tideway.operators import graph as G
from tideway.operators import history as H
from tideway.operators import scans as S


def dijkstra(edges, source):
    near = defaultdict(dict)
    for a, b, m in edges:
        if None not in (a, b, m) and a != b:
            near[a][b] = min(m, near[a].get(b, m))
    best, via, heap = {source: 0}, {}, [(0, source)]
    while heap:
        d, a = heapq.heappop(heap)
        if d > best[a]:
            continue
        for b, m in near[a].items():
            if d + m < best.get(b, d + m + 1):
                best[b] = d + m
                heapq.heappush(heap, (d + m, b))
    for b in best:  # of equally short ways the least node before the last
        ways = [a for a in best if b in near[a] and best[a] + near[a][b] == best[b]]
        via[b] = min(ways, default=None)
    return best, via


def plain_route(edges, src, dst):
    best, via = dijkstra(edges, src)
    if dst not in best:
        return None, [src]
    path, at = [dst], via[dst] if dst != src else None
    while at is not None:
        path.insert(0, at)
        at = via[at] if at != src else None
    return best[dst], path


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.randrange(1, 9)) for _ in range(110)]
    edges += [("hub", f"n{k}", 3) for k in range(40)] + [(f"n{k}", "hub", 4) for k in range(0, 40, 2)] + [(f"c{k}", f"c{k + 1}", 1) for k in range(9)]
    edges += edges[:5] + [(None, "n1", 1), ("n1", None, 1), ("n1", "n2", None), ("n3", "n3", 1), ("lone", "lone", 2)]
    return edges, spark.createDataFrame(edges, "src string, dst string, length long")


def test_shortest_routes(spark, graph):
    edges, df = graph
    rng = random.Random(7)
    nodes = sorted({x for a, b, _ in edges for x in (a, b) if x})
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)] + [("c0", "c9"), ("c9", "c0"), ("n1", "n1"), ("nowhere", "n1")]
    asked = spark.createDataFrame(pairs + pairs[:3] + [(None, "n1"), ("n1", None)], "src string, dst string")
    got = {(r.src, r.dst): (r.length, r.path) for r in G.shortest_routes(df, asked).collect()}
    assert got == {p: plain_route(edges, *p) for p in pairs}
    around = [e for e in edges if "hub" not in e[:2]]

    def detour(p):
        length, path = plain_route(around, *p) if "hub" not in p else (None, None)
        return (length, path) if length is not None else plain_route(edges, *p)

    got = {(r.src, r.dst): (r.length, r.path) for r in G.shortest_routes(df, asked, "hub").collect()}
    assert got == {p: detour(p) for p in pairs}
    assert any(plain_route(edges, *p)[0] is not None and "hub" in plain_route(edges, *p)[1] and "hub" not in detour(p)[1] for p in pairs)


def test_reachable(spark, graph):
    edges, df = graph
    sources = ["n0", "c0", "c8", "hub", "lone", "nowhere"]
    got = Counter((r.src, r.dst) for r in G.reachable_from(df, spark.createDataFrame([(s,) for s in sources + [None, "n0"]], "src string")).collect())
    assert got == Counter((s, b) for s in sources for b in dijkstra(edges, s)[0] if b != s)


def test_contracted_paths(spark, monkeypatch):
    """Few sources: rounds see the hubs alone, whatever hangs on them; chains, cycles and dead ends of single ways, equal lengths."""
    rng = random.Random(11)
    hubs, inlets, fringe = [f"h{k}" for k in range(3)], [f"i{k}" for k in range(12)], [f"f{k}" for k in range(60)]
    layers = [(hubs[k % 3], i, rng.randrange(1, 4)) for k, i in enumerate(inlets)] + [(i, f, rng.randrange(1, 6)) for i in inlets for f in fringe if rng.random() < 0.4] + [(f, rng.choice(hubs), rng.randrange(1, 3)) for f in fringe]
    odd = [("h0", "x0", 2), *((f"x{k}", f"x{k + 1}", 1) for k in range(3)), ("x3", "h2", 1), ("x2", "y", 1), ("y", "x2", 1), ("f1", "z", 1), ("i2", "z", 9), ("q", "r", 1), ("r", "q", 1), ("h1", "q", 5), ("t", "h0", 1)]
    seen, rounds = [], G._rounds
    monkeypatch.setattr(G, "_rounds", lambda graph, start, kind: seen.append(graph.count()) or rounds(graph, start, kind))
    for edges, most in ((layers, 6), (layers + odd, None)):
        df = spark.createDataFrame(edges, "src string, dst string, length long")
        nodes = sorted({x for a, b, _ in edges for x in (a, b)})
        pairs = [(a, b) for a in [*hubs, "t"] for b in nodes]
        got = {(r.src, r.dst): (r.length, r.path) for r in G.shortest_routes(df, spark.createDataFrame(pairs, "src string, dst string")).collect()}
        assert got == {p: plain_route(edges, *p) for p in pairs}
        reached = Counter((r.src, r.dst) for r in G.reachable_from(df, spark.createDataFrame([(h,) for h in hubs], "src string")).collect())
        assert reached == Counter((h, b) for h in hubs for b in dijkstra(edges, h)[0] if b != h)
        assert most is None or max(seen) <= most


def test_graph_edge_cases(spark):
    none = spark.createDataFrame([], "src string, dst string, length double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "src string, dst string")
    assert {(r.src, r.dst, r.length, tuple(r.path)) for r in G.shortest_routes(none, pairs).collect()} == {("a", "b", None, ("a",)), ("a", "a", 0.0, ("a",))}
    assert G.shortest_routes(none, pairs.limit(0)).collect() == [] == G.reachable_from(none, pairs).collect()
    with pytest.raises(ValueError):
        G.path_labels(spark.createDataFrame([("a", "b", 0.0)], none.schema), pairs)


def test_road_graph(spark):
    """The road network's own nodes, with a closed one in the middle."""
    roads = [(a, b, float(m)) for a, b, m in P.ROADS]
    df = spark.createDataFrame(roads, "src string, dst string, length double")
    nodes = sorted({a for a, _, _ in roads})
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "src string, dst string")
    assert {(r.src, r.dst): (r.length, r.path) for r in G.shortest_routes(df, pairs).collect()} == {(a, b): plain_route(roads, a, b) for a in nodes for b in nodes}


def test_most_open(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), s := rng.randrange(60), rng.choice([None, s - 1, s, s + 1, s + rng.randrange(1, 30)])) for _ in range(400)] + [("b", None, 4), ("c", 3, 3)]
    want = {}
    for key in {r[0] for r in rows}:
        own = [(a, b) for k, a, b in rows if k == key and a is not None and (b is None or b > a)]
        at = {t: sum(a <= t and (b is None or t < b) for a, b in own) for t in {x for i in own for x in i if x is not None}}
        if own:
            want[key] = (max(at.values()), min(t for t, n in at.items() if n == max(at.values())))
    df = spark.createDataFrame(rows, "k string, a long, b long")
    assert {r.k: (r.most, r["at"]) for r in S.most_open(df, ["k"], "a", "b").collect()} == want
    (whole,) = S.most_open(df.filter("k = 'hot'"), [], "a", "b").collect()
    assert (whole.most, whole["at"]) == want["hot"]
    assert S.most_open(df.limit(0), ["k"], "a", "b").collect() == []


def test_token_bucket(spark):
    """Against the loop: schedule while fewer wait, drain until a failure or the last attempt."""
    rng = random.Random(9)
    rows, want = [], Counter()
    for key, n in (("hot", 300), ("cold", 5), (None, 40), ("dry", 30)):
        due, scheduled, pending, served = 0, 0, 0, 0
        for t in range(n):
            due += rng.choice([0, 0, 1, 3, 60 if rng.random() < 0.02 else 2])
            slots = 0 if key == "dry" else rng.choice([0, 1, 2, 5, 6, 9])
            while scheduled < due and pending < 40:
                scheduled, pending = scheduled + 1, pending + 1
            done = attempts = failed = 0
            while pending and attempts < 6:
                attempts += 1
                if done >= slots:
                    failed = 1
                    break
                done, pending, served = done + 1, pending - 1, served + 1
            rows.append((key, t, due, slots))
            want[key, t, due, slots, done, pending, failed, served, scheduled] += 1
    df = spark.createDataFrame(rows, "k string, t long, due long, slots long").repartition(3)
    assert Counter(tuple(r) for r in S.token_bucket(df, ["k"], "t", "due", "slots").collect()) == want
    assert S.token_bucket(df.limit(0), ["k"], "t", "due", "slots").collect() == []


@pytest.mark.parametrize("interval", [0.5, 7.0, 400.0, 5000.0])
def test_cadence_over_many_ranges(spark, interval):
    """A hot key over all ranges, intervals from under a row's gap to the whole series, ties and nulls."""
    rng = random.Random(interval)
    rows = [("hot", k, round(rng.random() * 1000, 1), None) for k in range(500)] + [("hot", 900 + k, 500.0, "x") for k in range(60)]
    rows += [(key, 2000 + 10 * j + k, float(k * j), "y") for j, key in enumerate(["a", "b", None]) for k in range(6)] + [("hot", 3000, None, "z"), ("c", 3001, None, "z")]
    want = set()
    for key in {r[0] for r in rows}:
        last = None
        for _, e, t, _ in sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: (r[2], r[1])):
            if last is None or t - last >= interval:
                last = t
                want.add((key, e))
    df = spark.createDataFrame(rows, "key string, event_id long, sim_t double, _x string").repartition(5)
    got = H.cadence(df, ["key"], "sim_t", interval)
    assert got.columns == df.columns
    assert Counter((r.key, r.event_id) for r in got.collect()) == Counter(want)


def test_weighted_destinations(spark):
    """Against a walk over the running weights; absent pairs, the floor, unknown sources and profiles, the internal branch."""
    from tideway.operators import network as R

    rng = random.Random(4)
    nodes, inside = ["a", "b", "c", "d", "e"], ["X", "Y", "Z"]
    weights = {("p", s, d): rng.choice([0, 5, 99, 2500, 7000]) for s in nodes for d in nodes if s != d and rng.random() < 0.6}
    trips = [(k, rng.choice(["p", "p", "q"]), rng.choice([*nodes, "nowhere", None]), rng.choice([0, 499, 500, 1499, 1500, 9999]), rng.choice([0, 9999, rng.randrange(10000)])) for k in range(600)]
    want = {}
    for k, p, s, branch, draw in trips:
        if branch < 1500:
            want[k] = inside[branch * 3 // 1500]
            continue
        others = [d for d in nodes if d != s]
        w = [max(100, weights.get((p, s, d), 500)) for d in others]
        want[k] = next(d for i, d in enumerate(others) if draw * sum(w) < 10000 * sum(w[: i + 1])) if s in nodes and p == "p" else None
    df = spark.createDataFrame(trips, "trip long, profile string, source string, branch long, draw long")
    table = spark.createDataFrame([(*k, w) for k, w in weights.items()] + [("p", "a", "nowhere", 9000), ("p", "a", None, 1)], "profile string, source string, dest string, weight long")
    got = R.weighted_destinations(df, table, ["profile"], nodes, inside, "branch", "draw")
    assert {r.trip: r.dest for r in got.collect()} == want and got.count() == len(trips)
    assert R.weighted_destinations(df.limit(0), table, ["profile"], nodes, inside, "branch", "draw").collect() == []


def test_catalog_errors(spark):
    """A right catalog, one that breaks every rule, and documents that are none."""
    import hashlib
    import json

    from tideway.operators import catalogs as K

    want = {"approaches": [("T1", "North", "e1"), ("T1", "South", "e2")], "outgoing": [("T1", "e3")], "links": [("K", "e1")], "nodes": {"A": "T1"}}
    edges = [{"id": k, "from": "x", "to": "ü", "numLanes": 2} for k in ("e1", "e2", "e3")]
    joins = [{"from": "e1", "to": "e3", "fromLane": 0, "toLane": 1, "via": None, "tl": 'T"1', "linkIndex": None, "dir": ""}]

    def catalog(**changed):
        body = {"node_to_tls": {"A": "T1"}, "edges": edges, "connections": joins, "inter_node_links": {"K": {"edge": "e1"}}, "movements_by_approach": {"T1": {"North": [{"from": "e1"}], "South": [{"from": "e2"}]}}, "approach_edges": {}, "outgoing_edges": {}} | changed
        canonical = json.dumps({k: body[k] for k in ("connections", "edges", "node_to_tls")}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return {"topology_hash": hashlib.sha256(canonical.encode()).hexdigest()} | body

    wrong = catalog(node_to_tls={"B": "T1", "A": "T2"}, edges=edges[1:2], inter_node_links={"K": {"edge": "e9"}}, movements_by_approach={"T1": {"North": [], "South": [{"from": "e2"}, {"from": "e7"}]}}) | {"topology_hash": "?"}
    missing = catalog(inter_node_links={}, movements_by_approach={})
    del missing["movements_by_approach"]
    docs = {"right": json.dumps(catalog()), "shuffled": json.dumps(catalog(node_to_tls={"A": "T1"}), indent=1, sort_keys=True), "wrong": json.dumps(wrong), "missing": json.dumps(missing), "no link": json.dumps(catalog(inter_node_links={}, movements_by_approach={"T1": {"South": [{"from": "e2"}]}})), "none": None, "text": "{broken", "list": "[]", "kinds": json.dumps({k: 7 for k in K.REQUIRED})}
    df = spark.createDataFrame(list(docs.items()), "name string, doc string")
    got = {}
    for r in K.catalog_errors(df, "name", **want).collect():
        got.setdefault(r.name, set()).add((r.rule, r.subject, r.detail))
    lacks = {("missing_key", k, None) for k in K.REQUIRED}
    assert got["none"] == got["text"] == got["list"] == lacks
    assert got["missing"] == {("missing_key", "movements_by_approach", None)}
    assert got["no link"] == {("link_missing", "K", None), ("movements_missing", "T1/North", None)}
    right = hashlib.sha256(json.dumps({"connections": joins, "edges": edges[1:2], "node_to_tls": {"A": "T2", "B": "T1"}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got["wrong"] == {("hash", None, right), ("nodes", None, None), ("approach_edge", "T1/North", "e1"), ("outgoing_edge", "T1", "e3"), ("link_not_in_net", "K", "e1"), ("link_edge", "K", "e9"), ("movements_empty", "T1/North", None), ("movement_from", "T1/South", "e7")}
    assert {x[0] for x in got["kinds"]} == {"hash", "nodes", "approach_edge", "outgoing_edge", "link_not_in_net", "link_missing", "movements_missing"}
    assert set(got) == {"none", "text", "list", "missing", "no link", "wrong", "kinds"}


def test_catalogs_that_lack_a_part_are_not_parsed(spark):
    """Of such a document only the lacking parts are said, so none of its parts is read; a whole one is."""
    import json

    from tideway.operators import catalogs as K

    whole = {k: {} for k in K.REQUIRED} | {"topology_hash": "h", "edges": [], "connections": []}
    df = spark.createDataFrame([(json.dumps(whole),), (json.dumps({k: v for k, v in whole.items() if k != "outgoing_edges"}),)], "doc string")
    full, lacks = sorted(K.opened(df).collect(), key=lambda r: len(r.absent))
    assert full.absent == [] and [full[k] for k in K.PARTS] == ["h", {}, [], [], {}, {}]
    assert lacks.absent == ["outgoing_edges"] and [lacks[k] for k in K.PARTS] == [None] * len(K.PARTS)

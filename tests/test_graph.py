"""Graph operators on a fixture graph; cycles and k-hop against brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from quarry.operators import cycles as C
from quarry.operators import graph as G

# self-loop s; 2-cycle a<->b; 3-cycle c->d->e->c; 4-cycle f->g->h->i->f;
# hub: five nodes import "hub"; fan: imports ten nodes; both: in 5 and out 10
EDGES = ([("s", "s"), ("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"),
          ("f", "g"), ("g", "h"), ("h", "i"), ("i", "f")]
         + [(f"u{k}", "hub") for k in range(5)]
         + [("fan", f"t{k}") for k in range(10)]
         + [(f"v{k}", "both") for k in range(5)] + [("both", f"w{k}") for k in range(10)])


def brute_cycles(edges, max_len):
    adj = {}
    for s, d in edges:
        adj.setdefault(s, set()).add(d)
    nodes = sorted(set(itertools.chain(*edges)))
    out = set()

    def dfs(start, path):
        last = path[-1]
        for nx in adj.get(last, ()):
            if nx == start:
                out.add(tuple(path))
            elif nx > start and nx not in path and len(path) < max_len:
                dfs(start, path + [nx])
    for n in nodes:
        dfs(n, [n])
    return out


@pytest.fixture(scope="module")
def g(spark):
    e = spark.createDataFrame([("r", s, d) for s, d in EDGES], "repo string, src string, dst string")
    ids = sorted(set(itertools.chain(*EDGES)))
    n = spark.createDataFrame([("r", i, f"pkg/{i}.py") for i in ids], "repo string, id string, path string")
    return n, e


@pytest.mark.parametrize("max_len", [1, 4])
def test_cycles_match_brute_force(spark, g, max_len):
    _, e = g
    got = {tuple(r.nodes) for r in G.simple_cycles(e, max_len).collect()}
    assert got == brute_cycles(EDGES, max_len)


def test_all_cycles_of_a_ring_with_chords_and_tails(spark):
    ring = [(f"n{k}", f"n{(k + 1) % 9}") for k in range(9)]
    edges = (ring + [("n2", "n6"), ("n7", "n1"), ("n5", "n5"), ("n8", "n4"), ("n0", "x0"), ("z0", "n3")]
             + [(f"x{k}", f"x{k + 1}") for k in range(6)] + [("y1", "x1"), ("x2", "y2")])
    found = G.simple_cycles(spark.createDataFrame([("r", *e) for e in edges], "repo string, src string, dst string")).collect()
    assert {tuple(r.nodes) for r in found} == brute_cycles(edges, 99) and max(r.length for r in found) == 9
    assert [r.rank for r in sorted(found, key=lambda r: (r.length, r.cycle))] == list(range(1, len(found) + 1))


def spread(edges, repo="r"):
    return [(repo, s, d) for s, d in edges]


def component_of(n, chords, tails=()):
    """A ring of ``n`` nodes with short chords: one component with many cycles."""
    name = lambda k: f"n{k % n:03d}"
    return [(name(k), name(k + 1)) for k in range(n)] + [(name(a), name(b)) for a, b in chords] + list(tails)


@pytest.mark.parametrize("task_edges, small_edges, cells", [(20_000, 60, 1 << 20), (20_000, 5, 40), (300, 60, 1 << 20), (30, 5, 400), (2, 2, 1)])
def test_cycles_of_a_component_of_200_nodes(spark, monkeypatch, task_edges, small_edges, cells):
    for name, value in (("TASK_EDGES", task_edges), ("SMALL_EDGES", small_edges), ("PIECE_CELLS", cells)):
        monkeypatch.setattr(C, name, value)
    wide = component_of(200, [(20 * k, 20 * k + 7) for k in range(8)] + [(150, 20), (77, 70)], [("n003", "x"), ("y", "n004"), ("n005", "n005")])
    small = component_of(6, [(0, 3), (4, 2), (2, 0)]) + [("q1", "q2"), ("q2", "q1")]
    # a path-growing round per node would be slow here, so the whole ring is left out of that case
    graphs = {"wide": wide, "small": small} if task_edges > 2 else {"small": small}
    rows = [r for name, e in graphs.items() for r in spread(e * 2, name)]
    df = spark.createDataFrame(rows + [("small", "a", None)], "repo string, src string, dst string").repartition(4)
    got = [(r.repo, tuple(r.nodes)) for r in C.cycle_nodes(df).collect()]
    want = {(name, c) for name, e in graphs.items() for c in brute_cycles(e, 999)}
    assert len(got) == len(set(got)) and set(got) == want
    short = {(r.repo, tuple(r.nodes)) for r in C.cycle_nodes(df, 5).collect()}
    assert short == {c for c in want if len(c[1]) <= 5}


def test_components_by_joins_are_the_strong_ones(spark):
    import random
    rng = random.Random(2)
    edges = {(f"v{rng.randrange(60):02d}", f"v{rng.randrange(60):02d}") for _ in range(85)}
    edges = [(a, b) for a, b in edges if a != b]
    graph = {}
    for a, b in edges:
        graph.setdefault(a, []).append(b)
    reach = {v: C._reached(graph, v, "") for v in {x for e in edges for x in e}}
    want = {(a, b): max(w for w in reach[a] if a in reach[w]) for a, b in edges if a in reach[b]}
    got = C.component_edges(spark.createDataFrame(spread(edges), "repo string, src string, dst string")).collect()
    assert {(r.src, r.dst): r.part for r in got} == want and want
    assert {frozenset(p) for p in C.strong_parts(graph)} == {frozenset(w for w in reach[a] if a in reach[w]) for a, _ in want}


def test_a_hub_of_100000_edges(spark):
    hub = spark.range(100_000).selectExpr("'r' AS repo", "concat('u', id) AS src", "'hub' AS dst")
    ring = spark.createDataFrame(spread([("hub", "u7"), ("hub", "z"), ("z", "u8")]), "repo string, src string, dst string")
    edges = hub.unionByName(ring)
    assert {tuple(r.nodes) for r in C.cycle_nodes(edges).collect()} == {("hub", "u7"), ("hub", "z", "u8")}
    nodes = edges.selectExpr("repo", "src AS id").union(edges.selectExpr("repo", "dst")).distinct().withColumn("path", F.col("id"))
    deg = G.degrees(nodes, edges)
    top = G.hotspots(deg, 5, 10).collect()
    assert [(r.id, r.in_degree, r.type, r["rank"]) for r in top] == [("hub", 100_000, "hub", 1)]


def test_no_edges_no_cycles(spark):
    assert G.simple_cycles(spark.createDataFrame([], "repo string, src string, dst string")).count() == 0


def test_cycle_rendering(spark, g):
    _, e = g
    rows = {r.cycle: (r.length, r.severity) for r in G.simple_cycles(e, 4).collect()}
    assert rows["s -> s"] == (1, "critical")
    assert rows["c -> d -> e -> c"] == (3, "critical")
    assert rows["f -> g -> h -> i -> f"] == (4, "warning")


def test_degrees_and_invariants(spark, g):
    n, e = g
    d = {r.id: r for r in G.degrees(n, e).collect()}
    assert sum(r.in_degree for r in d.values()) == sum(r.out_degree for r in d.values()) == len(EDGES)
    assert (d["hub"].in_degree, d["fan"].out_degree) == (5, 10)
    assert d["both"].centrality == pytest.approx(15 / len(d))
    hot = {r.id: r.type for r in G.hotspots(G.degrees(n, e)).collect()}
    assert hot == {"hub": "hub", "fan": "bottleneck", "both": "hub"}


def test_graph_metrics(spark, g):
    n, e = g
    m = G.graph_metrics(G.degrees(n, e)).collect()[0]
    k = n.count()
    avg = len(EDGES) / k
    assert m.coupling == pytest.approx(2 * avg) and m.cohesion == pytest.approx(1 / (avg + 1))
    assert m.stability == pytest.approx(avg / (2 * avg + 1)) and m.max_dependencies == 10


def brute_khop(edges, focus, depth):
    und = {}
    for s, d in edges:
        und.setdefault(s, set()).add(d)
        und.setdefault(d, set()).add(s)
    seen, frontier = {focus: 0}, [focus]
    for h in range(1, depth + 1):
        nxt = []
        for x in frontier:
            for y in und.get(x, ()):
                if y not in seen:
                    seen[y] = h
                    nxt.append(y)
        frontier = nxt
    return seen


@pytest.mark.parametrize("focus,depth", [("hub", 1), ("both", 2), ("f", 2), ("s", 3)])
def test_k_hop(spark, g, focus, depth):
    n, e = g
    foci = spark.createDataFrame([("r", focus)], "repo string, focus string")
    kept, sub = G.k_hop(n, e, foci, depth)
    exp = brute_khop(EDGES, focus, depth)
    assert {r.id: r.hop for r in kept.collect()} == exp
    assert {(r.src, r.dst) for r in sub.collect()} == {(s, d) for s, d in EDGES if s in exp and d in exp}


def test_k_hop_unknown_focus_keeps_graph(spark, g):
    n, e = g
    foci = spark.createDataFrame([("r", "nope")], "repo string, focus string")
    kept, sub = G.k_hop(n, e, foci, 2)
    assert kept.count() == n.count() and sub.count() == len(EDGES)


def test_local_imports_and_edges(spark):
    files = spark.createDataFrame([("r", p) for p in ["a/b.py", "a/__init__.py", "c/__init__.py", "d.py", "bad.py"]],
                                  "repo string, path string")
    imports = spark.createDataFrame(
        [("r", "d.py", m) for m in ["a.b", "a", "c", "pandas.x", "zz", "", "d"]] + [("r", "bad.py", "a.b")],
        "repo string, path string, module string")
    local = {r.module for r in G.local_imports(imports, files).collect()}
    assert local == {"a.b", "a", "c", "d"}
    parsed = files.where("path != 'bad.py'")
    e = {(r.src, r.dst) for r in G.build_edges(G.local_imports(imports, files), parsed, guard_files=files).collect()}
    assert e == {("d", "a.b"), ("d", "a"), ("d", "c"), ("d", "d")}  # self edge kept, bad.py not parsed


def test_classify_path(spark):
    cases = {"tests/x.py": "test", "utils/h.py": "utility", "app/models.py": "model",
             "api/v.py": "api", "svc/service.py": "service", "p/__init__.py": "package", "x.py": "module"}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.t for r in df.select("path", G.classify_path("path").alias("t")).collect()} == cases


def test_walks_in_tasks_are_those_by_joins(spark, monkeypatch):
    import random
    rng = random.Random(3)
    edges, nodes, foci = [], [], []
    for k in range(12):
        ids = [f"v{j:02d}" for j in range(rng.choice([1, 4, 15, 40]))]
        edges += [(f"r{k}", rng.choice([*ids, "out", None]), rng.choice([*ids, None])) for _ in range(len(ids) + 3)] * 2
        nodes += [(f"r{k}", v) for v in ids]
        foci += [(f"r{k}", f) for f in rng.choice([["v00"], ["v00", "v02"], ["nope"], [None], []])]
    n = spark.createDataFrame([*nodes, (None, "v00"), ("alone", "x")], "repo string, id string")
    e = spark.createDataFrame([*edges, (None, "v00", "v01"), ("nodeless", "a", "b")], "repo string, src string, dst string")
    f = spark.createDataFrame([*foci, (None, "v00"), ("nodeless", "a")], "repo string, focus string")
    for depth in (0, 1, 3):
        rows = lambda pair: [sorted(map(str, df.collect())) for df in pair]
        want = rows(G._hops_by_joins(n, e, f, depth, True))
        assert rows(G._hops_in_tasks(n, e, f, depth)) == want and len(want[0]) > 100
        for most, groups in ((20_000, 1 << 16), (30, 1 << 16), (30, 2), (0, 1)):  # none, some and all graphs beyond a task
            monkeypatch.setattr(G, "TASK_ROWS", most)
            monkeypatch.setattr(G, "SIZE_GROUPS", groups)
            assert rows(G.k_hop(n, e, f, depth)) == want


def test_k_hop_exchanges_its_input_once_whatever_the_depth(spark, g):
    n, e = g
    kept, sub = G.k_hop(n, e, spark.createDataFrame([("r", "hub")], "repo string, focus string"), 4)
    for df in (kept, sub):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_edges_of_the_tables_are_exchanged_once_and_kept_as_columns(spark):
    from quarry.plans.tables import succession_edges
    from quarry.session import cut_lineage, written
    edges = succession_edges(spark, "/root/testdata/sf0.001")
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert written(edges).schema == edges.schema
    assert sorted(written(edges).collect()) == sorted(cut_lineage(edges).collect())

"""Dependency graph (E1-E10) as DataFrames.

``edges(repo, src, dst)`` and ``nodes(repo, id, path)``. Iterative
operators (cycles, k-hop) are loops that end when the frontier is empty or
nothing changes; every round's frontier is written to the reliable checkpoint
folder so the plan stays small and a lost executor only repeats one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage, ship_package, written
from .cycles import cycle_nodes
from .findings import Rule, findings
from .prefix import split_rank
from .prefixes import starting_with

# Module-name prefixes treated as external packages.
EXTERNAL_PREFIXES = ["pandas", "numpy", "sklearn", "matplotlib", "seaborn",
                     "fastapi", "django", "flask", "pytest", "unittest"]


def local_imports(imports: DataFrame, files: DataFrame,
                  external_prefixes: list[str] = EXTERNAL_PREFIXES,
                  suffix: str = ".py") -> DataFrame:
    """Imports whose module is non-empty, not external, and exists in the
    repo as ``a/b.py`` or ``a/b/__init__.py`` (any file of ``files``, parsed
    or not). Relative imports are looked up as if absolute.

    Existence is a left-semi join on (repo, module key), not a per-import
    file-system probe.
    """
    m = F.col("module")
    ext = F.lit(False)
    for p in external_prefixes:
        ext = ext | m.startswith(p)
    cand = imports.where(m.isNotNull() & (m != "") & ~ext)
    keys = (files.where(F.col("path").endswith(suffix))
            .select("repo", T.module_key("path", suffix).alias("module")).distinct())
    return cand.join(keys, ["repo", "module"], "left_semi")


def build_edges(local: DataFrame, modules: DataFrame, suffix: str = ".py",
                guard_files: DataFrame | None = None) -> DataFrame:
    """Distinct ``(repo, src, dst)`` from each parsed importer to each
    local module it imports. Self-edges are kept.

    The original tool's guard (the target starts with the module name of some
    scanned file) is applied when ``guard_files`` is given, by one sort of
    targets and names (:func:`quarry.operators.prefixes.starting_with`).
    """
    e = (local.join(modules.select("repo", "path"), ["repo", "path"], "left_semi")
         .select("repo", T.module_key("path", suffix).alias("src"), F.col("module").alias("dst"))
         .distinct())
    if guard_files is None:
        return e
    e = written(e)  # the sort of targets and the edges that it lets through read it
    names = guard_files.select("repo", T.module_key("path", suffix).alias("prefix"))
    ok = starting_with(e.select("repo", "dst"), names, "repo", "dst", "prefix")
    return e.join(ok, ["repo", "dst"], "left_semi")


def graph_nodes(modules: DataFrame, edges: DataFrame, suffix: str = ".py") -> DataFrame:
    """Parsed modules (id = module key, with their path) plus edge targets
    that are not parsed files (path = id)."""
    parsed = (modules.select("repo", T.module_key("path", suffix).alias("id"), "path",
                             T.path_sort_key("path").alias("k"))
              .groupBy("repo", "id").agg(F.max_by("path", "k").alias("path")))
    targets = edges.select("repo", F.col("dst").alias("id")).distinct()
    extra = targets.join(parsed, ["repo", "id"], "left_anti").select("repo", "id", F.col("id").alias("path"))
    return parsed.unionByName(extra)


def classify_path(c) -> F.Column:
    """First substring hit on the lower-cased path."""
    x = F.lower(T.as_col(c))
    return (F.when(x.contains("test"), "test")
            .when(x.contains("util") | x.contains("helper"), "utility")
            .when(x.contains("model"), "model")
            .when(x.contains("view") | x.contains("api"), "api")
            .when(x.contains("service"), "service")
            .when(x.contains("__init__"), "package")
            .otherwise("module"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in/out degree per node, node class, centrality = (in+out)/max(1,n).

    Nodes, out-ends and in-ends are tagged and rolled up with one
    ``groupBy(repo, id)``; the per-repo node count is a one-row-per-repo
    table joined on ``repo``.
    """
    u = (nodes.select("repo", "id", "path", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("n"))
         .unionByName(edges.select("repo", F.col("src").alias("id"), F.lit(None).cast("string").alias("path"),
                                   F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("n")))
         .unionByName(edges.select("repo", F.col("dst").alias("id"), F.lit(None).cast("string").alias("path"),
                                   F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("n"))))
    d = (u.groupBy("repo", "id")
         .agg(F.max("path").alias("path"), F.sum("i").cast("long").alias("in_degree"),
              F.sum("o").cast("long").alias("out_degree"), F.sum("n").alias("is_node"))
         .where(F.col("is_node") > 0))
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n_nodes"))
    return d.join(n, "repo").select(
        "repo", "id", "path", classify_path("path").alias("type"), "in_degree", "out_degree",
        ((F.col("in_degree") + F.col("out_degree")) /
         F.greatest(F.lit(1), F.col("n_nodes"))).alias("centrality"))


def graph_metrics(deg: DataFrame) -> DataFrame:
    """E5: per repo averages of in/out degree and the derived ratios."""
    g = deg.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_modules"),
        F.avg("in_degree").alias("avg_in"), F.avg("out_degree").alias("avg_out"),
        F.greatest(F.max("in_degree"), F.max("out_degree")).alias("max_dependencies"))
    ai, ao = F.col("avg_in"), F.col("avg_out")
    return g.select("repo", "total_modules",
                    ((ai + ao) / 2).alias("avg_dependencies"), "max_dependencies",
                    (ai + ao).alias("coupling"), (1 / (ao + 1)).alias("cohesion"),
                    (ao / (ai + ao + 1)).alias("stability"))


def hotspots(deg: DataFrame, hub_in: int = 5, bottleneck_out: int = 10) -> DataFrame:
    """Hubs (in >= hub_in), else bottlenecks (out >= bottleneck_out);
    ``rank`` is by centrality of three decimals, descending, then id. (The original tool's third class needs
    the first condition and is never reached.)"""
    t = (F.when(F.col("in_degree") >= hub_in, "hub")
         .when(F.col("out_degree") >= bottleneck_out, "bottleneck"))
    hot = (deg.select("repo", "id", "in_degree", "out_degree", "centrality", t.alias("type"))
           .where(F.col("type").isNotNull()))
    return split_rank(hot, ["repo"], [F.round("centrality", 3).desc(), F.col("id")])


def simple_cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """Every elementary cycle, or with ``max_len`` those of at most that many nodes.

    Output: ``(repo, cycle, nodes, length, severity, rank)`` where ``cycle``
    is ``a -> b -> a``, from its smallest node, and ``rank`` counts a repo's
    cycles by length, then text. The number of cycles itself can be
    exponential in the edges. Where only a count is needed,
    :func:`quarry.operators.cycles.cycle_nodes` is enough.
    """
    length = F.size("nodes")
    found = cycle_nodes(edges, max_len).select(
        "repo",
        F.array_join(F.concat("nodes", F.slice("nodes", 1, 1)), " -> ").alias("cycle"),
        "nodes", length.alias("length"),
        F.when(length <= 3, "critical").otherwise("warning").alias("severity"))
    return split_rank(found, ["repo"], [F.col("length"), F.col("cycle")])


#: Edges and nodes of a graph that one task walks as a whole at most.
TASK_ROWS = 20_000
#: Groups of graphs, by a hash, whose rows are counted before any graph's are.
SIZE_GROUPS = 1 << 16
#: Rows handed on at once by a walk.
RUN_ROWS = 10_000


def _large_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """``(repo)`` of the graphs beyond ``TASK_ROWS``; None without any.

    A graph is no larger than its group, so graphs are only counted in groups
    that are large.
    """
    rows = (nodes.select("repo").unionByName(edges.select("repo")).where(F.col("repo").isNotNull())
            .withColumn("grp", F.pmod(F.xxhash64("repo"), F.lit(SIZE_GROUPS))))
    groups = cut_lineage(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_ROWS).select("grp"))
    if groups.isEmpty():
        return None
    large = cut_lineage(rows.join(groups, "grp", "left_semi").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") > TASK_ROWS).select("repo"))
    return None if large.isEmpty() else large


def _near(edges: list[tuple]) -> dict:
    """Neighbours of each node, both ways. A null end leads nowhere."""
    near: dict = {}
    for a, b in edges:
        if a is not None:
            near.setdefault(a, []).append(b)
        if b is not None:
            near.setdefault(b, []).append(a)
    return near


def _hops(near: dict, starts: list, depth: int) -> list[tuple]:
    """``(id, hop)`` within ``depth`` hops of the starts."""
    seen, found, frontier = set(starts), [(v, 0) for v in starts], set(starts)
    for hop in range(1, depth + 1):
        frontier = {w for v in frontier for w in near.get(v, ()) if w not in seen}
        if not frontier:
            break
        found += [(w, hop) for w in frontier]
        frontier.discard(None)
        seen |= frontier
    return found


def _walk(depth: int, want_edges: bool):
    """Walks each graph of a stream sorted by repo, ``(repo, kind, a, b)`` of edges (0), nodes (1) and foci (2)."""
    columns = ("repo", "src", "dst") if want_edges else ("repo", "id", "hop")
    types = [pa.string(), pa.string(), pa.string() if want_edges else pa.int32()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), types)], list(columns))

    def one(repo, edges, nodes, foci):
        at = set(nodes)
        starts = [f for f in foci if f in at and f is not None] if repo is not None else []
        if starts:
            kept = _hops(_near(edges), starts, depth)
            at = {v for v, _ in kept}
        else:  # no focus: the whole graph
            kept = [(v, None) for v in nodes]
        if not want_edges:
            return [(repo, *k) for k in kept]
        at.discard(None)
        return [(repo, *e) for e in edges if e[0] in at and e[1] in at] if repo is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, open_repo, held = [], None, ([], [], [])
        for batch in batches:
            for repo, kind, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if repo != open_repo:
                    rows += one(open_repo, *held)
                    open_repo, held = repo, ([], [], [])
                    if len(rows) >= RUN_ROWS:
                        yield out(rows)
                        rows = []
                held[kind].append(a if kind else (a, b))
        rows += one(open_repo, *held)
        yield out(rows)
    return run


def _hops_in_tasks(nodes: DataFrame, edges: DataFrame, foci: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """:func:`k_hop` of graphs that each fit a task, many to a task: one exchange, whatever the depth."""
    ship_package(nodes.sparkSession)
    none = F.lit(None).cast("string").alias("b")
    rows = (edges.select("repo", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
            .unionByName(nodes.select("repo", F.lit(1).alias("kind"), F.col("id").alias("a"), none))
            .unionByName(foci.select("repo", F.lit(2).alias("kind"), F.col("focus").alias("a"), none))
            # by a hash: an exchange by the repo itself is left out where the parts of the union have one, and they
            # need not lie together then
            .repartition(F.xxhash64("repo")).sortWithinPartitions("repo"))
    return (rows.mapInArrow(_walk(depth, False), "repo string, id string, hop int"),
            rows.mapInArrow(_walk(depth, True), "repo string, src string, dst string"))


def _hops_by_joins(nodes: DataFrame, edges: DataFrame, foci: DataFrame, depth: int,
                   checkpoint: bool) -> tuple[DataFrame, DataFrame]:
    """:func:`k_hop` of graphs of any size.

    Breadth-first: each round joins the frontier to the undirected edge
    list. A neighbour of a node at hop h is at h - 1, h or h + 1, so an
    anti-join with the last two levels leaves the new ones.
    """
    und = (edges.select("repo", F.col("src").alias("id"), F.col("dst").alias("nb"))
           .unionByName(edges.select("repo", F.col("dst").alias("id"), F.col("src").alias("nb")))
           .distinct())
    if checkpoint:
        und = cut_lineage(und)
    start = (foci.select("repo", F.col("focus").alias("id"))
             .join(nodes.select("repo", "id"), ["repo", "id"], "left_semi")
             .withColumn("hop", F.lit(0)))
    visited = start
    frontier = start
    last_two = start.select("repo", "id")
    for h in range(1, depth + 1):
        nxt = (frontier.join(und, ["repo", "id"]).select("repo", F.col("nb").alias("id")).distinct()
               .join(last_two, ["repo", "id"], "left_anti")
               .withColumn("hop", F.lit(h)))
        if checkpoint:
            nxt = cut_lineage(nxt)
            if nxt.isEmpty():  # checkpointed: a cheap look, and no more rounds
                break
        visited = visited.unionByName(nxt)
        last_two = frontier.select("repo", "id").unionByName(nxt.select("repo", "id"))
        frontier = nxt
    found = visited.select("repo").distinct()
    whole = (nodes.join(found, "repo", "left_anti").select("repo", "id", F.lit(None).cast("int").alias("hop")))
    kept = visited.unionByName(whole)
    ke = kept.select("repo", "id")
    sub = (edges.join(ke.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi")
           .join(ke.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi"))
    return kept, sub.select("repo", "src", "dst")


def k_hop(nodes: DataFrame, edges: DataFrame, foci: DataFrame, depth: int = 5,
          checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` undirected hops of each repo's focus and
    the induced edges. A repo whose focus is not a node keeps its whole
    graph (``hop`` null). ``foci(repo, focus)``.

    Graphs of up to ``TASK_ROWS`` edges and nodes are walked many to a task,
    larger ones by a join for each hop. Both inputs are read more than once,
    so they should be written.
    """
    large = _large_graphs(nodes, edges)
    if large is None:
        return _hops_in_tasks(nodes, edges, foci, depth)
    small, wide = ([df.join(large, "repo", how) for df in (nodes, edges, foci)] for how in ("left_anti", "left_semi"))
    return tuple(a.unionByName(b) for a, b in zip(_hops_in_tasks(*small, depth), _hops_by_joins(*wide, depth, checkpoint)))


def graph_summary(deg: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Modules, edges, edges per module, cycle count per repo."""
    n = deg.groupBy("repo").agg(F.count(F.lit(1)).alias("total_modules"))
    m = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("total_dependencies"))
    c = cycles.groupBy("repo").agg(F.count(F.lit(1)).alias("circular_count"))
    out = n.join(m, "repo", "left").join(c, "repo", "left").na.fill(0, ["total_dependencies", "circular_count"])
    return out.withColumn("average_dependencies",
                          F.col("total_dependencies") / F.greatest(F.lit(1), F.col("total_modules")))


# Fixed value: the coupling above which a repo is reported.
MAX_COUPLING = 10


def findings_deps(summary: DataFrame, metrics: DataFrame, hot: DataFrame, max_coupling: float = MAX_COUPLING) -> DataFrame:
    """Cycles, coupling above ``max_coupling``, bottlenecks; else ``ok``."""
    rules = [Rule("circular_dependencies", "circular_count", ">", 0),
             Rule("high_coupling", "coupling", ">", max_coupling),
             Rule("bottlenecks", "n_bottlenecks", ">", 0)]
    b = hot.where(F.col("type") == "bottleneck").groupBy("repo").agg(F.count(F.lit(1)).alias("n_bottlenecks"))
    s = (summary.join(metrics.select("repo", "coupling"), "repo", "left")
         .join(b, "repo", "left").na.fill(0, ["n_bottlenecks"]))
    return findings(s, "deps", rules)

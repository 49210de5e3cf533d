"""Elementary cycles (E7) by strongly connected components.

Graphs that fit a task go to one, many to a task: a stream of edges sorted by
graph is cut into components, and the cycles of each are enumerated. Graphs
beyond that are first cut into components by joins. A component of more than
a few edges is dealt out by start nodes, because its cycles can be many times
its edges; one that does not fit a task at all keeps its edges in the table,
and paths grow along them by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

#: Edges of a graph, or of a component, that one task takes as a whole at most.
TASK_EDGES = 20_000
#: Edges of a component whose cycles are enumerated where it was found.
SMALL_EDGES = 60
#: Nodes times edges of what is dealt out as one piece of a larger component.
PIECE_CELLS = 1 << 20
#: Cycles handed on at once.
RUN_CYCLES = 5_000

Graph = dict[int, list[int]]


def _reached(graph: Graph, start: int, least: int) -> set[int]:
    """Nodes from ``least`` on that ``start`` reaches through such nodes."""
    seen, todo = {start}, [start]
    while todo:
        for w in graph.get(todo.pop(), ()):
            if w >= least and w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def _reversed(graph: Graph) -> Graph:
    back: Graph = {}
    for v, targets in graph.items():
        for w in targets:
            back.setdefault(w, []).append(v)
    return back


def strong_parts(graph: Graph) -> list[list[int]]:
    """Strongly connected components of more than one node, by Tarjan's low links without recursion."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    on_stack: set[int] = set()
    parts = []
    for root in graph:
        if root in index:
            continue
        calls = [(root, iter(graph[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        on_stack.add(root)
        while calls:
            v, targets = calls[-1]
            for w in targets:
                if w not in index:
                    index[w] = low[w] = len(index)
                    held.append(w)
                    on_stack.add(w)
                    calls.append((w, iter(graph.get(w, ()))))
                    break
                if w in on_stack:
                    low[v] = min(low[v], index[w])
            else:
                calls.pop()
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[v])
                if low[v] == index[v]:
                    part = [held.pop()]
                    while part[-1] != v:
                        part.append(held.pop())
                    on_stack.difference_update(part)
                    if len(part) > 1:
                        parts.append(part)
    return parts


def cycles_from(graph: Graph, back: Graph, start: int, max_len: int | None = None) -> Iterator[list[int]]:
    """Cycles whose smallest node is ``start``; ``back`` is the graph with its edges turned round.

    A node from which no open path led back to the start is left alone until
    a node on its way there is free again, so no dead end is walked twice.
    With ``max_len`` a path is given up where the shortest way back is too
    long instead.
    """
    part = _reached(graph, start, start) & _reached(back, start, start)
    if len(part) < 2:
        return
    inside = {v: [w for w in graph[v] if w in part] for v in part}
    path = [start]
    if max_len is not None:
        away, level = {start: 0}, [start]
        while level:
            level = [u for v in level for u in back[v] if u in part and u not in away and not away.update({u: away[v] + 1})]
        walks = [iter(inside[start])]
        while walks:
            for w in walks[-1]:
                if w == start:
                    yield list(path)
                elif w not in path and len(path) + away[w] <= max_len:
                    path.append(w)
                    walks.append(iter(inside[w]))
                    break
            else:
                walks.pop()
                path.pop()
        return
    blocked, waiting, led_back = {start}, {}, [False]
    walks = [iter(inside[start])]
    while walks:
        for w in walks[-1]:
            if w == start:
                led_back[-1] = True
                yield list(path)
            elif w not in blocked:
                path.append(w)
                blocked.add(w)
                walks.append(iter(inside[w]))
                led_back.append(False)
                break
        else:
            walks.pop()
            v, found = path.pop(), led_back.pop()
            if found:
                free = [v]
                while free:
                    u = free.pop()
                    if u in blocked:
                        blocked.discard(u)
                        free.extend(waiting.pop(u, ()))
                if led_back:
                    led_back[-1] = True
            else:
                for w in inside[v]:
                    waiting.setdefault(w, set()).add(v)


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, sources, targets) of each graph in a stream sorted by graph."""
    key, src, dst = None, [], []
    for batch in batches:
        for repo, part, s, d in zip(*(c.to_pylist() for c in batch.columns)):
            if (repo, part) != key:
                if src:
                    yield key, src, dst
                key, src, dst = (repo, part), [], []
            src.append(s)
            dst.append(d)
    if src:
        yield key, src, dst


def _pieces_of(src: list[str], dst: list[str], max_len: int | None):
    """Cycles of small components as lists of names, and pieces of larger ones: (names, from, to, start nodes)."""
    if set(src).isdisjoint(dst):
        return
    names = sorted(set(src) | set(dst))
    number = {n: k for k, n in enumerate(names)}
    graph: Graph = {}
    for s, d in zip(src, dst):
        graph.setdefault(number[s], []).append(number[d])
    for part in strong_parts(graph):
        own = set(part)
        part = sorted(part)
        inside = {v: [w for w in graph[v] if w in own] for v in part}
        size = sum(map(len, inside.values()))
        if size <= SMALL_EDGES:
            back = _reversed(inside)
            for start in part:
                for cycle in cycles_from(inside, back, start, max_len):
                    yield [names[v] for v in cycle], None
            continue
        at = {v: k for k, v in enumerate(part)}
        edges = [(at[v], at[w]) for v in part for w in inside[v]]
        step = max(1, PIECE_CELLS // size)
        for first in range(0, len(part), step):
            # a cycle of these starts goes through later nodes only
            here = [(v, w) for v, w in edges if v >= first and w >= first]
            yield None, ([names[v] for v in part[first:]], [v - first for v, _ in here], [w - first for _, w in here],
                         min(step, len(part) - first))


_PIECES = "repo string, nodes array<string>, names array<string>, sources array<int>, targets array<int>, starts int"


def _split(max_len: int | None):
    def out(rows):
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                          ["repo", "nodes", "names", "sources", "targets", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for (repo, _), src, dst in _graphs(batches):
            for cycle, piece in _pieces_of(src, dst, max_len):
                rows.append((repo, cycle, *(piece or (None,) * 4)))
                if piece or len(rows) >= RUN_CYCLES:
                    yield out(rows)
                    rows = []
        yield out(rows)
    return run


def _enumerate(max_len: int | None):
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                           pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["repo", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for k in range(batch.num_rows):
                repo, names, sources, targets, starts = (c[k].as_py() for c in batch.columns)
                graph: Graph = {}
                for v, w in zip(sources, targets):
                    graph.setdefault(v, []).append(w)
                back = _reversed(graph)
                for start in range(starts):
                    if start not in graph or start not in back:
                        continue
                    for cycle in cycles_from(graph, back, start, max_len):
                        rows.append((repo, [names[v] for v in cycle]))
                        if len(rows) >= RUN_CYCLES:
                            yield out(rows)
                            rows = []
        yield out(rows)
    return run


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose source is some edge's target and whose target is some edge's source."""
    targets = e.select("repo", F.col("dst").alias("src")).distinct()
    sources = e.select("repo", F.col("src").alias("dst")).distinct()
    return e.join(targets, ["repo", "src"], "left_semi").join(sources, ["repo", "dst"], "left_semi")


def _reach_labels(e: DataFrame, rounds: int = 4) -> DataFrame:
    """``(repo, id, f, b)``: the largest node that reaches each node, and the largest that it reaches.

    Both are passed on along the edges until none grows; a round is one join
    and one aggregation, ``rounds`` of them run between checkpoints.
    """
    def way(source, target, name):
        return e.select("repo", F.col(source).alias("id"), F.col(target).alias("to"), F.lit(name).alias("way"))
    ends = e.select("repo", F.col("src").alias("id")).unionByName(e.select("repo", F.col("dst").alias("id"))).distinct()
    ways = cut_lineage(way("src", "dst", "down").unionByName(way("dst", "src", "up"))
                       .unionByName(ends.select("repo", "id", F.col("id").alias("to"), F.lit("stay").alias("way"))))
    labels = ways.where("way = 'stay'").select("repo", "id", F.col("id").alias("f"), F.col("id").alias("b"))
    told = {"f": "way <> 'up'", "b": "way <> 'down'"}
    while True:
        for _ in range(rounds):
            said = labels.select("repo", "id", "f", "b").join(ways, ["repo", "id"])
            labels = said.groupBy("repo", F.col("to").alias("id")).agg(
                *[F.max(F.when(F.expr(when), F.col(c))).alias(c) for c, when in told.items()],
                *[F.max(F.when(F.col("way") == "stay", F.col(c))).alias(f"{c}0") for c in told])
        labels = cut_lineage(labels)
        if labels.where("f <> f0 OR b <> b0").isEmpty():  # the last round moved nothing
            return labels.select("repo", "id", "f", "b")


def component_edges(edges: DataFrame) -> DataFrame:
    """``(repo, part, src, dst)``: the edges inside strongly connected components, ``part`` being its largest node.

    Edges between nodes whose labels (:func:`_reach_labels`) differ are on no
    cycle and go; the rest is labelled again until nothing goes. What hangs
    together then has one label for both ways, a node that reaches all and is
    reached by all.
    """
    e = cut_lineage(_trimmed(_trimmed(edges)))
    left, before = e.count(), None
    kept = e.select("repo", F.lit("").alias("part"), "src", "dst")
    while left and left != before:
        labels = _reach_labels(kept.select("repo", "src", "dst"))
        ends = [labels.select("repo", F.col("id").alias(end), F.col("f").alias(f"{end}_f"), F.col("b").alias(f"{end}_b"))
                for end in ("src", "dst")]
        kept = cut_lineage(kept.select("repo", "src", "dst").join(ends[0], ["repo", "src"]).join(ends[1], ["repo", "dst"])
                           .where("src_f = dst_f AND src_b = dst_b").select("repo", F.col("src_f").alias("part"), "src", "dst"))
        before, left = left, kept.count()
    return kept


def _grown(step: DataFrame, max_len: int | None, rounds: int = 3) -> DataFrame:
    """Cycles of components that fit no task: paths that grow by one join a round, from a start through larger nodes."""
    follow = step.select("repo", F.col("src").alias("last"), F.col("dst").alias("nx"))
    paths = cut_lineage(step.where("dst > src").select(
        "repo", F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes")))
    longer, size, out = F.col("nx") > F.col("start"), 2, [paths.select("repo", "nodes").limit(0)]
    while (max_len is None or size <= max_len) and not paths.isEmpty():
        for _ in range(rounds if max_len is None else min(rounds, max_len + 1 - size)):
            # a closed path has no last node: it finds no edge and stays as it is
            paths = (paths.join(follow, ["repo", "last"], "left")
                     .where("last IS NULL OR nx = start OR (nx > start AND NOT array_contains(nodes, nx))")
                     .select("repo", "start", F.when(longer, F.col("nx")).alias("last"),
                             F.when(longer, F.concat("nodes", F.array("nx"))).otherwise(F.col("nodes")).alias("nodes")))
            size += 1
        paths = cut_lineage(paths)
        out.append(paths.where("last IS NULL").select("repo", "nodes"))
        paths = paths.where("last IS NOT NULL")  # no open path left: longer cycles cannot exist
    return reduce(DataFrame.unionByName, out)


def cycle_nodes(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """``(repo, nodes)``: every elementary cycle (of at most ``max_len`` nodes), from its smallest node on.

    ``edges(repo, src, dst)``; repeated edges count once, edges with a null
    end for nothing. The result is written to the checkpoint folder, so
    counts and ranks read the same rows.
    """
    ship_package(edges.sparkSession)
    loops = edges.where("src = dst").select("repo", F.array("src").alias("nodes")).distinct()
    e = cut_lineage(edges.select("repo", "src", "dst").where("src <> dst").distinct())
    sizes = e.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > TASK_EDGES).select("repo"))
    whole, grown = e.select("repo", F.lit("").alias("part"), "src", "dst"), None
    if not large.isEmpty():
        parts = component_edges(e.join(large, "repo", "left_semi"))
        wide = parts.groupBy("repo", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_EDGES)
        wide = cut_lineage(wide.select("repo", "part"))
        whole = whole.join(large, "repo", "left_anti").unionByName(parts.join(wide, ["repo", "part"], "left_anti"))
        if not wide.isEmpty():
            grown = _grown(parts.join(wide, ["repo", "part"], "left_semi").select("repo", "src", "dst"), max_len)
    found = cut_lineage(whole.repartition("repo", "part").sortWithinPartitions("repo", "part")
                        .mapInArrow(_split(max_len), _PIECES))
    pieces = found.where("nodes IS NULL").select("repo", "names", "sources", "targets", "starts")
    out = [loops, found.where("nodes IS NOT NULL").select("repo", "nodes")]
    if not pieces.isEmpty():
        dealt = pieces.repartition(F.col("repo"), F.element_at("names", 1))
        out.append(cut_lineage(dealt.mapInArrow(_enumerate(max_len), "repo string, nodes array<string>")))
    if grown is not None:
        out.append(grown)
    return reduce(DataFrame.unionByName, out)

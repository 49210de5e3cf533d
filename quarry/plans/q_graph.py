"""Dependency-graph queries. Binding: one repo per order; its suppliers are
the files, edges lead from each line item's supplier to the next one's, and a
supplier with a positive balance is a parsed module."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import cut_lineage, written
from . import sql_common as S
from .registry import register
from .tables import order_suppliers, succession_edges, supplier_nodes, table

HUB_IN = 2
BOTTLENECK_OUT = 2
MAX_COUPLING = 2
HOPS = 2


def _edges(spark, d):
    """The succession edges, materialised once per query (several branches
    read them: degrees, cycles, summaries)."""
    return cut_lineage(succession_edges(spark, d))


def _deg(spark, d, edges=None):
    return G.degrees(cut_lineage(supplier_nodes(spark, d)), edges if edges is not None else _edges(spark, d))




def supplier_files(spark, d):
    return order_suppliers(spark, d).select("repo", F.concat("id", F.lit(".py")).alias("path"), "s_acctbal")


def _build(spark, d):
    files = written(supplier_files(spark, d))  # looked up by imports, edges, guard and nodes
    parsed = files.where(F.col("s_acctbal") > 0)
    imports = succession_edges(spark, d).select(
        "repo", F.concat("src", F.lit(".py")).alias("path"), F.col("dst").alias("module"))
    local = G.local_imports(imports, files, external_prefixes=["s1"])
    return G.build_edges(local, parsed, guard_files=files), parsed


SQL_DEG = S.SUCCESSION + r""",
ind AS (SELECT repo, dst AS id, count(*) AS in_degree FROM edges GROUP BY repo, dst),
outd AS (SELECT repo, src AS id, count(*) AS out_degree FROM edges GROUP BY repo, src),
nn AS (SELECT repo, count(*) AS n_nodes FROM snodes GROUP BY repo),
deg AS (
  SELECT s.repo, s.id, s.path,
    CASE WHEN contains(lower(s.path), 'test') THEN 'test'
         WHEN contains(lower(s.path), 'util') OR contains(lower(s.path), 'helper') THEN 'utility'
         WHEN contains(lower(s.path), 'model') THEN 'model'
         WHEN contains(lower(s.path), 'view') OR contains(lower(s.path), 'api') THEN 'api'
         WHEN contains(lower(s.path), 'service') THEN 'service'
         WHEN contains(lower(s.path), '__init__') THEN 'package'
         ELSE 'module' END AS type,
    coalesce(i.in_degree, 0) AS in_degree, coalesce(o.out_degree, 0) AS out_degree,
    (coalesce(i.in_degree, 0) + coalesce(o.out_degree, 0)) / greatest(1, nn.n_nodes) AS centrality
  FROM snodes s LEFT JOIN ind i ON s.repo = i.repo AND s.id = i.id
  LEFT JOIN outd o ON s.repo = o.repo AND s.id = o.id JOIN nn ON s.repo = nn.repo
),
gm AS (
  SELECT repo, count(*) AS total_modules, (avg(in_degree) + avg(out_degree)) / 2 AS avg_dependencies,
         greatest(max(in_degree), max(out_degree)) AS max_dependencies,
         avg(in_degree) + avg(out_degree) AS coupling, 1 / (avg(out_degree) + 1) AS cohesion,
         avg(out_degree) / (avg(in_degree) + avg(out_degree) + 1) AS stability
  FROM deg GROUP BY repo
),
hot AS (
  SELECT repo, id, in_degree, out_degree, centrality,
         CASE WHEN in_degree >= """ + str(HUB_IN) + """ THEN 'hub' ELSE 'bottleneck' END AS type
  FROM deg WHERE in_degree >= """ + str(HUB_IN) + " OR out_degree >= " + str(BOTTLENECK_OUT) + r"""
),
walk(repo, start, last, nodes) AS (
  SELECT repo, src, dst, [src] FROM edges WHERE dst >= src
  UNION ALL
  SELECT w.repo, w.start, e.dst, list_append(w.nodes, w.last)
  FROM walk w JOIN edges e ON w.repo = e.repo AND w.last = e.src
  WHERE w.last <> w.start AND e.dst >= w.start AND NOT list_contains(w.nodes, w.last)
),
cyc AS (SELECT repo, nodes FROM walk WHERE last = start),
gsum AS (
  SELECT n.repo, n.total_modules, coalesce(m.total_dependencies, 0) AS total_dependencies,
         coalesce(c.circular_count, 0) AS circular_count,
         coalesce(m.total_dependencies, 0) / greatest(1, n.total_modules) AS average_dependencies
  FROM (SELECT repo, count(*) AS total_modules FROM deg GROUP BY repo) n
  LEFT JOIN (SELECT repo, count(*) AS total_dependencies FROM edges GROUP BY repo) m ON n.repo = m.repo
  LEFT JOIN (SELECT repo, count(*) AS circular_count FROM cyc GROUP BY repo) c ON n.repo = c.repo
)"""


@register("degrees", "WITH RECURSIVE " + SQL_DEG + "\nSELECT * FROM deg")
def q_degrees(spark, d):
    return _deg(spark, d)


@register("graph_metrics", "WITH RECURSIVE " + SQL_DEG + "\nSELECT * FROM gm")
def q_graph_metrics(spark, d):
    return G.graph_metrics(_deg(spark, d))


@register("hotspots", "WITH RECURSIVE " + SQL_DEG + """
SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(centrality, 3) DESC, id) AS rank FROM hot""")
def q_hotspots(spark, d):
    return G.hotspots(_deg(spark, d), HUB_IN, BOTTLENECK_OUT)


SQL_CYCLES = r"""
SELECT *, row_number() OVER (PARTITION BY repo ORDER BY length, cycle) AS rank FROM (
  SELECT repo, array_to_string(list_concat(nodes, [nodes[1]]), ' -> ') AS cycle,
         CAST(len(nodes) AS INTEGER) AS length,
         CASE WHEN len(nodes) <= 3 THEN 'critical' ELSE 'warning' END AS severity
  FROM cyc WHERE len(nodes) <= {longest})"""


@register("simple_cycles", "WITH RECURSIVE " + SQL_DEG + SQL_CYCLES.format(longest=1000000))
def q_simple_cycles(spark, d):
    return G.simple_cycles(_edges(spark, d)).drop("nodes")


@register("graph_summary", "WITH RECURSIVE " + SQL_DEG + "\nSELECT * FROM gsum")
def q_graph_summary(spark, d):
    e = _edges(spark, d)
    return G.graph_summary(_deg(spark, d, e), e, G.cycle_nodes(e))


@register("findings_deps", "WITH RECURSIVE " + SQL_DEG + r""",
j AS (
  SELECT g.repo, g.circular_count, m.coupling,
         coalesce((SELECT count(*) FROM hot h WHERE h.repo = g.repo AND h.type = 'bottleneck'), 0) AS n_bottlenecks
  FROM gsum g LEFT JOIN gm m ON g.repo = m.repo
),
fired AS (
  SELECT repo, 0 AS rule_ord, 'circular_dependencies' AS rule, CAST(circular_count AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS threshold FROM j WHERE circular_count > 0
  UNION ALL SELECT repo, 1, 'high_coupling', coupling, CAST(2 AS DOUBLE) FROM j WHERE coupling > 2
  UNION ALL SELECT repo, 2, 'bottlenecks', n_bottlenecks, CAST(0 AS DOUBLE) FROM j WHERE n_bottlenecks > 0
)
SELECT repo, 'deps' AS area, rule_ord, rule, value, threshold FROM fired
UNION ALL SELECT repo, 'deps', 3, 'ok', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM j WHERE repo NOT IN (SELECT repo FROM fired)""")
def q_findings_deps(spark, d):
    e = _edges(spark, d)
    deg = cut_lineage(_deg(spark, d, e))  # read by summary, metrics and hotspots
    summ = G.graph_summary(deg, e, G.cycle_nodes(e))
    return G.findings_deps(summ, G.graph_metrics(deg), G.hotspots(deg, HUB_IN, BOTTLENECK_OUT),
                           MAX_COUPLING)


SQL_KHOP = S.SUCCESSION + r""",
foc AS (SELECT repo, min(id) AS focus FROM snodes GROUP BY repo),
und AS (SELECT repo, src AS id, dst AS nb FROM edges UNION SELECT repo, dst AS id, src AS nb FROM edges),
h0 AS (SELECT f.repo, f.focus AS id, 0 AS hop FROM foc f JOIN snodes s ON f.repo = s.repo AND f.focus = s.id),
h1 AS (
  SELECT DISTINCT u.repo, u.nb AS id, 1 AS hop FROM h0 JOIN und u ON h0.repo = u.repo AND h0.id = u.id
  WHERE NOT EXISTS (SELECT 1 FROM h0 x WHERE x.repo = u.repo AND x.id = u.nb)
),
h2 AS (
  SELECT DISTINCT u.repo, u.nb AS id, 2 AS hop FROM h1 JOIN und u ON h1.repo = u.repo AND h1.id = u.id
  WHERE NOT EXISTS (SELECT 1 FROM h0 x WHERE x.repo = u.repo AND x.id = u.nb)
    AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.repo = u.repo AND x.id = u.nb)
),
kept AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""


def _khop(spark, d, hops=HOPS):
    nodes = written(supplier_nodes(spark, d).select("repo", "id"))  # read for foci, sizes and walks
    foci = nodes.groupBy("repo").agg(F.min("id").alias("focus"))
    return G.k_hop(nodes, written(succession_edges(spark, d)), foci, hops)


@register("k_hop", "WITH " + SQL_KHOP + "\nSELECT repo, id, hop FROM kept")
def q_k_hop(spark, d):
    return _khop(spark, d)[0]


@register("k_hop_edges", "WITH " + SQL_KHOP + r""",
near AS MATERIALIZED (SELECT DISTINCT repo, id FROM kept)
SELECT e.repo, e.src, e.dst FROM edges e JOIN near a ON a.repo = e.repo AND a.id = e.src
JOIN near b ON b.repo = e.repo AND b.id = e.dst""")
def q_k_hop_edges(spark, d):
    return _khop(spark, d)[1]


SQL_BUILD = S.SUCCESSION + r""",
sfiles AS (SELECT r.repo, 's' || CAST(r.s_suppkey AS VARCHAR) || '.py' AS path, r.s_acctbal FROM sreg r),
imps AS (SELECT repo, src || '.py' AS path, dst AS module FROM edges),
loc AS (
  SELECT i.* FROM imps i
  WHERE i.module <> '' AND NOT starts_with(i.module, 's1')
    AND EXISTS (SELECT 1 FROM sfiles f WHERE f.repo = i.repo AND regexp_replace(f.path, '\.py$', '') = i.module)
),
be AS (
  SELECT DISTINCT l.repo, regexp_replace(l.path, '\.py$', '') AS src, l.module AS dst FROM loc l
  WHERE EXISTS (SELECT 1 FROM sfiles f WHERE f.repo = l.repo AND f.path = l.path AND f.s_acctbal > 0)
    AND EXISTS (SELECT 1 FROM sfiles f WHERE f.repo = l.repo AND starts_with(l.module, regexp_replace(f.path, '\.py$', '')))
)"""


@register("local_imports", "WITH RECURSIVE " + SQL_BUILD + "\nSELECT repo, path, module FROM loc")
def q_local_imports(spark, d):
    files = supplier_files(spark, d)
    imports = succession_edges(spark, d).select(
        "repo", F.concat("src", F.lit(".py")).alias("path"), F.col("dst").alias("module"))
    return G.local_imports(imports, files, external_prefixes=["s1"]).select("repo", "path", "module")


@register("build_edges", "WITH RECURSIVE " + SQL_BUILD + "\nSELECT repo, src, dst FROM be")
def q_build_edges(spark, d):
    return _build(spark, d)[0].select("repo", "src", "dst")


@register("graph_nodes", "WITH RECURSIVE " + SQL_BUILD + r""",
parsed AS (SELECT repo, regexp_replace(path, '\.py$', '') AS id, path FROM sfiles WHERE s_acctbal > 0)
SELECT repo, id, path FROM parsed
UNION ALL
SELECT DISTINCT b.repo, b.dst AS id, b.dst AS path FROM be b
WHERE NOT EXISTS (SELECT 1 FROM parsed p WHERE p.repo = b.repo AND p.id = b.dst)""")
def q_graph_nodes(spark, d):
    edges, parsed = _build(spark, d)
    return G.graph_nodes(parsed, edges)


@register("classify_path", r"""
SELECT source AS repo, doc_id,
  CASE WHEN contains(lower(text), 'test') THEN 'test'
       WHEN contains(lower(text), 'util') OR contains(lower(text), 'helper') THEN 'utility'
       WHEN contains(lower(text), 'model') THEN 'model'
       WHEN contains(lower(text), 'view') OR contains(lower(text), 'api') THEN 'api'
       WHEN contains(lower(text), 'service') THEN 'service'
       WHEN contains(lower(text), '__init__') THEN 'package'
       ELSE 'module' END AS type
FROM documents""")
def q_classify_path(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("repo"), "doc_id", G.classify_path("text").alias("type"))


@register("simple_cycles_4", "WITH RECURSIVE " + SQL_DEG + SQL_CYCLES.format(longest=4))
def q_simple_cycles_4(spark, d):
    return G.simple_cycles(_edges(spark, d), 4).drop("nodes")


@register("k_hop_3", "WITH " + SQL_KHOP + r""",
h3 AS (
  SELECT DISTINCT u.repo, u.nb AS id, 3 AS hop FROM h2 JOIN und u ON h2.repo = u.repo AND h2.id = u.id
  WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.repo = u.repo AND x.id = u.nb)
)
SELECT repo, id, hop FROM kept UNION ALL SELECT repo, id, hop FROM h3""")
def q_k_hop_3(spark, d):
    return _khop(spark, d, 3)[0]

"""The six reports over a code corpus, composed from the operators.

``Corpus`` holds the scanned ``files`` and the fact tables of one facts-job
run; each report returns a dict of DataFrames (one per section of the
original report), all keyed by ``repo`` (``task_id`` for context).
Nothing is collected: callers write the sections with
:func:`quarry.sources.reports.write_report` or inspect them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import architecture as A
from ..operators import context as CX
from ..operators import conventions as C
from ..operators import coverage as CV
from ..operators import frameworks as FW
from ..operators import graph as G
from ..operators import patterns as P
from ..sources import corpus
from ..session import cut_lineage
from . import facts as FX

# Default excludes of the coverage report (fnmatch dialect).
COVERAGE_EXCLUDE = ["**/test_*.py", "**/*_test.py"]


@dataclass
class Corpus:
    files: DataFrame                      # repo, path, content (scanned, globbed)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    all_paths: DataFrame | None = None    # repo, path of every file on disk (no globs)

    @property
    def parsed(self) -> DataFrame:
        return self.tables["modules"].where("parse_ok")

    def parsed_keys(self) -> DataFrame:
        return self.parsed.select("repo", "path")

    def lines(self) -> DataFrame:
        """Lines of every file. Line rules run on all of them and only their
        (small) hits are restricted to parsed files, so file contents are
        never shuffled for a join."""
        return corpus.line_table(self.files)

    def only_parsed(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.parsed_keys(), ["repo", "path"], "left_semi")


def load_corpus(spark: SparkSession, files: DataFrame, facts_path: str | None = None,
                dedupe: bool = False, files_path: str | None = None) -> Corpus:
    """Run the facts job once over ``files``; with ``facts_path`` the facts
    are written there (partitioned by kind) and every report reads them.

    A scan yields each path once (globs are one predicate), so no
    de-duplication shuffle is needed; ``dedupe`` is for tables that may hold
    repeated ``(repo, path)`` rows."""
    if dedupe:
        files = corpus.dedupe_sorted(files).drop("path_key")
    if files_path:  # one columnar copy: later reads avoid re-opening many small files
        files.write.mode("overwrite").parquet(files_path)
        files = spark.read.parquet(files_path)
    return Corpus(files, FX.facts_from_files(spark, files, facts_path))


def scan(spark: SparkSession, root: str, include=None, exclude=None, repo_level: int = 1,
         facts_path: str | None = None, files_path: str | None = None) -> Corpus:
    """List once, keep every path (import existence is checked against the
    whole tree, as on disk) and read the files that pass the globs."""
    paths = corpus.list_paths(spark, root, repo_level)
    files = corpus.read_listed(spark, root, paths, include, exclude)
    c = load_corpus(spark, files, facts_path, files_path=files_path)
    c.all_paths = paths.select("repo", "path")
    return c


def frameworks(c: Corpus) -> DataFrame:
    """C1-C3 per repo: sorted framework set and project type."""
    ff = FW.match_prefix_dict(c.tables["imports"])
    rf = FW.all_repos_frameworks(c.files, FW.repo_frameworks(ff))
    return rf.join(FW.classify_by_precedence(rf), "repo")


def arch_report(c: Corpus, depth: str = "detailed", min_complexity: int = 0,
                max_detailed_files: int = 50, include_detailed_metrics: bool = True) -> dict[str, DataFrame]:
    t = c.tables
    modules = FX.maintainability(c.parsed, t["blocks"])
    methods = t["classes"].select("repo", "path", F.explode("methods").alias("m"))
    metrics = A.file_metrics(modules, t["blocks"], t["functions"], t["classes"], t["imports"],
                             methods, min_complexity=min_complexity)
    detailed = A.top_files(metrics, max_detailed_files) if include_detailed_metrics \
        else metrics.where(F.lit(False)).withColumn("rank", F.lit(0))
    totals = A.file_totals(modules, t["blocks"])
    layers = A.layer_rollup(c.parsed.select("repo", "path"))
    rm = A.repo_metrics(modules, totals, detailed)
    out = {
        "frameworks": frameworks(c),
        "structure": A.structure_counts(modules, t["classes"], t["functions"]),
        "layers": layers,
        "metrics": rm,
        "detailed_metrics": detailed,
        "findings": A.findings_arch(rm, layers),
        "hot_files": A.hot_files(detailed),
    }
    if depth in ("detailed", "deep"):
        out["top_classes"] = A.first_n_entities(t["classes"], 20)
        out["top_functions"] = A.first_n_entities(t["functions"], 20)
        out["class_edges"] = A.class_edges(out["top_classes"])
    return out


def deps_report(c: Corpus, focus: str | None = None, depth: int = 5, detect_circular: bool = True,
                max_cycle_len: int | None = None, hub_in: int = 5, bottleneck_out: int = 10) -> dict[str, DataFrame]:
    t = c.tables
    local = G.local_imports(t["imports"], c.all_paths if c.all_paths is not None else c.files)
    parsed = c.parsed.select("repo", "path")
    # the graph is read by every section: materialise it once
    edges = cut_lineage(G.build_edges(local, parsed, guard_files=c.files))
    nodes = cut_lineage(G.graph_nodes(parsed, edges))
    if focus:
        foci = nodes.select("repo").distinct().withColumn("focus", F.lit(focus))
        kept, edges = G.k_hop(nodes, edges, foci, depth)
        nodes = nodes.join(kept.select("repo", "id"), ["repo", "id"], "left_semi")
    deg = cut_lineage(G.degrees(nodes, edges))
    cycles = cut_lineage(G.simple_cycles(edges, max_cycle_len)) if detect_circular else \
        edges.sparkSession.createDataFrame([], "repo string, cycle string, nodes array<string>, length int, severity string, rank long")
    metrics = G.graph_metrics(deg)
    hot = G.hotspots(deg, hub_in, bottleneck_out)
    summary = G.graph_summary(deg, edges, cycles)
    return {"nodes": deg, "edges": edges, "cycles": cycles, "metrics": metrics, "hotspots": hot,
            "summary": summary, "findings": G.findings_deps(summary, metrics, hot)}


def patterns_report(c: Corpus, pattern_types: list[str] | None = None) -> dict[str, DataFrame]:
    t = c.tables
    rf = FW.all_repos_frameworks(c.files, FW.repo_frameworks(FW.match_prefix_dict(t["imports"])))
    line_hits = c.only_parsed(P.detect_lines(c.lines(), [P.DATAFRAME, P.ARRAY, P.VISUALIZATION]))
    requires = {"dataframe": P.DATAFRAME.requires, "array": P.ARRAY.requires,
                "visualization": P.VISUALIZATION.requires, "pipeline": P.ML_REQUIRES,
                "model": P.ML_REQUIRES}
    gated = P.gate_by_framework(line_hits, rf, requires).withColumn("name", F.lit(None).cast("string"))
    hits = P.type_filter(gated.unionByName(P.syntax_patterns(t["syntax"], rf)), pattern_types)
    summary = P.pattern_summary(hits)
    anti = P.antipatterns(summary)
    return {"frameworks": rf, "patterns": hits, "summary": summary, "antipatterns": anti,
            "best_practices": P.best_practices(rf, summary),
            "findings": P.findings_patterns(rf, summary)}


def coverage_report(c: Corpus, coverage_records: DataFrame | None = None,
                    policy: CV.GapPolicy = CV.GapPolicy(), priority: str = "all",
                    exclude: list[str] | None = None,
                    coverage_xml: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """``coverage_records(repo, filename, line_no, hits[, line_rate, doc_pos])``
    or ``coverage_xml``: repo -> path of that repo's coverage XML report."""
    excl = COVERAGE_EXCLUDE if exclude is None else exclude
    files = corpus.glob_filter(c.files, ["**/*.py"], excl)
    parsed = files.join(c.parsed.select("repo", "path"), ["repo", "path"], "left_semi")
    if coverage_xml:
        from ..sources.reports import scan_coverage_xml
        for repo, xml_path in coverage_xml.items():
            recs = scan_coverage_xml(files.sparkSession, xml_path, repo=repo)
            coverage_records = recs if coverage_records is None else coverage_records.unionByName(
                recs, allowMissingColumns=True)
    if coverage_records is None:
        coverage_records = files.sparkSession.createDataFrame(
            [], "repo string, filename string, line_no int, hits long")
    joined = CV.join_coverage(parsed, CV.coverage_per_file(coverage_records))
    assessed = CV.assess_files(joined, c.tables["blocks"], policy)
    gaps = CV.gap_functions(CV.gap_filter(assessed, priority), c.tables["blocks"])
    summary = CV.coverage_summary(assessed, gaps, files)
    return {"files": assessed, "gaps": CV.gap_rank(gaps), "summary": summary,
            "findings": CV.findings_coverage(summary, policy.lines_threshold)}


def conventions_report(c: Corpus, severity: str = "warning", autodetect: bool = True,
                       max_line_length: int = 100, type_hints_required: bool = False) -> dict[str, DataFrame]:
    t = c.tables
    v_all = C.violations(
        C.rule_function_name(t["functions"]), C.rule_class_name(t["classes"]),
        C.rule_constant_name(t["constants"]), C.rule_import_grouping(t["imports"]),
        c.only_parsed(C.rule_line_length(c.lines(), max_line_length)),
        C.rule_docstrings(c.parsed, t["classes"], t["functions"]),
        C.rule_return_hint(t["functions"], type_hints_required))
    shown = C.severity_filter(v_all, severity)
    counts = C.violation_counts(v_all, c.files, severity)
    scores = C.consistency(counts)
    out = {"violations": C.first_violations(shown, 100), "counts": counts, "consistency": scores,
           "findings": C.findings_conventions(scores, counts)}
    if autodetect:
        files = c.files.select("repo", "path")
        out["detected"] = (C.infer_convention(t["functions"], files, "function")
                           .unionByName(C.infer_convention(t["classes"], files, "class")))
    return out


def context_report(c: Corpus, tasks: DataFrame, max_tokens: int = 50000,
                   focus_areas: list[str] | None = None, strategy: str = "relevance",
                   include_files: bool = True) -> dict[str, DataFrame]:
    """``tasks(task_id, repo, text)``: each task against the files of its repo."""
    t = c.tables
    rf = FW.all_repos_frameworks(c.files, FW.repo_frameworks(FW.match_prefix_dict(t["imports"])))
    analyzed = cut_lineage(CX.analyze_tasks(tasks, rf))
    # the selection is read by five sections: written once
    selected = cut_lineage(CX.select_within_budget(analyzed, c.files, corpus.modules_from_files(c.files), max_tokens,
                                                   focus_areas, strategy))
    summary = CX.budget_summary(tasks, selected, max_tokens)
    pack = CX.pack_files(selected, c.files, 20, 0.7, include_files)
    keys = pack.select("repo", "path").distinct()
    summaries = (module_summaries(c).join(keys, ["repo", "path"])   # bounded side broadcastable
                 .withColumnRenamed("n_lines", "summary_lines"))
    pack = pack.join(summaries, ["repo", "path"], "left")  # null summary: file does not parse
    return {"tasks": analyzed, "selected": selected, "budget": summary, "files": pack,
            "layers": CX.selected_layers(tasks, selected),
            "findings": CX.findings_context(analyzed, summary)}


def module_summaries(c: Corpus) -> DataFrame:
    """Per-file summary used by context packs: classes, functions, lines,
    imports, docstring presence."""
    t = c.tables
    cnt = lambda df, n: df.groupBy("repo", "path").agg(F.count(F.lit(1)).alias(n))
    return (c.parsed.select("repo", "path", "n_lines", (F.coalesce("docstring", F.lit("")) != "").alias("has_docstring"))
            .join(cnt(t["classes"], "classes"), ["repo", "path"], "left")
            .join(cnt(t["functions"], "functions"), ["repo", "path"], "left")
            .join(cnt(t["imports"], "imports"), ["repo", "path"], "left")
            .na.fill(0, ["classes", "functions", "imports"]))


def path_order(df: DataFrame) -> DataFrame:
    """Sort helper for small outputs (tests, display)."""
    return df.orderBy("repo", T.path_sort_key("path"))

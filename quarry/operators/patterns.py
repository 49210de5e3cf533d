"""Pattern detection.

Line detectors are single projections over the ``lines`` table: a guard
predicate and a ``coalesce(when(contains))`` chain that returns the first
matching token in list order. They stay inside whole-stage codegen (no
lambdas, no Python).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import Rule, findings


@dataclass(frozen=True)
class LineDetector:
    type: str                 # pattern type key (dataframe, array, visualization)
    tokens: list[str]         # first one contained in the line wins
    guards: list[str]         # at least one must be contained in the line
    requires: list[str] = field(default_factory=list)  # any of these frameworks


# The line detectors and the frameworks that enable them.
DATAFRAME = LineDetector("dataframe",
                         ["read_csv", "read_excel", "groupby", "merge", "concat", "pivot", "melt"],
                         ["pd.", "DataFrame"], ["pandas"])
ARRAY = LineDetector("array",
                     ["array", "zeros", "ones", "arange", "linspace", "reshape", "dot"],
                     ["np.", "numpy."], ["numpy"])
VISUALIZATION = LineDetector("visualization",
                             ["plot", "scatter", "hist", "bar", "heatmap", "figure", "subplot"],
                             ["plt.", "sns."], ["matplotlib", "seaborn"])
# pipeline if the line contains "Pipeline", else model if any model call occurs
PIPELINE_TOKEN = "Pipeline"
MODEL_TOKENS = [".fit(", ".predict(", ".transform("]
ML_REQUIRES = ["sklearn"]
API_REQUIRES = ["fastapi", "django", "flask"]

PATTERN_TYPES = ["dataframe", "array", "pipeline", "model", "visualization", "api",
                 "async", "decorator", "context_manager"]
# Public aliases accepted by the type filter (the original tool's public names).
TYPE_ALIASES = {"viz": "visualization", "context": "context_manager"}



def first_token_match(lines: DataFrame, det: LineDetector) -> DataFrame:
    """One hit per line whose guard holds: the first token present."""
    op = T.first_contained("line", det.tokens)
    return (lines.where(T.contains_any("line", det.guards))
            .select("repo", "path", F.col("line_no").alias("line"),
                    F.lit(det.type).alias("type"), op.alias("operation"))
            .where(F.col("operation").isNotNull()))


def ml_usage_lines(lines: DataFrame, pipeline_token: str = PIPELINE_TOKEN,
                      model_tokens: list[str] = MODEL_TOKENS) -> DataFrame:
    """``pipeline`` when the line has the pipeline token, else ``model``
    when it has any model token."""
    ln = F.col("line")
    typ = (F.when(ln.contains(pipeline_token), F.lit("pipeline"))
           .when(T.contains_any(ln, model_tokens), F.lit("model")))
    return (lines.select("repo", "path", F.col("line_no").alias("line"), typ.alias("type"),
                         F.lit(None).cast("string").alias("operation"))
            .where(F.col("type").isNotNull()))


def detect_lines(lines: DataFrame, detectors: list[LineDetector],
                 pipeline_token: str | None = PIPELINE_TOKEN,
                 model_tokens: list[str] | None = MODEL_TOKENS) -> DataFrame:
    """F1-F4 in one pass: every detector is a conditional struct of one
    projection over ``lines``, exploded into hit rows, so the lines are read
    once however many detectors run. Same rows as the union of
    :func:`first_token_match` per detector and :func:`ml_usage_lines`."""
    cands = []
    for det in detectors:
        op = T.first_contained("line", det.tokens)
        cands.append(F.when(T.contains_any("line", det.guards) & op.isNotNull(),
                            F.struct(F.lit(det.type).alias("type"), op.alias("operation"))))
    if pipeline_token is not None:
        ln = F.col("line")
        typ = (F.when(ln.contains(pipeline_token), F.lit("pipeline"))
               .when(T.contains_any(ln, model_tokens or []), F.lit("model")))
        cands.append(F.when(typ.isNotNull(), F.struct(typ.alias("type"),
                                                      F.lit(None).cast("string").alias("operation"))))
    return (lines.select("repo", "path", F.col("line_no").alias("line"),
                         F.explode(F.array_compact(F.array(*cands))).alias("h"))
            .select("repo", "path", "line", "h.type", "h.operation"))


def gate_by_framework(hits: DataFrame, repo_fw: DataFrame,
                      requires: dict[str, list[str]]) -> DataFrame:
    """keep hits of a type only in repos having one of its frameworks.

    ``repo_fw`` is one row per repo (bounded by the number of repos) and is
    joined with a left-semi join on ``repo``; types without a requirement
    always pass.
    """
    terms = []
    for typ, fws in requires.items():
        has = F.lit(False)
        for fw in fws:
            has = has | F.array_contains("frameworks", fw)
        terms.append(F.when(has, F.lit(typ)))
    gate = repo_fw.select("repo", F.explode(F.array_compact(F.array(*terms))).alias("type"))
    gated_types = list(requires)
    free = hits.where(~F.col("type").isin(gated_types))
    gated = hits.where(F.col("type").isin(gated_types)).join(gate, ["repo", "type"], "left_semi")
    return gated.unionByName(free)


def syntax_patterns(syntax: DataFrame, repo_fw: DataFrame | None = None) -> DataFrame:
    """api, async, decorator and context-manager hits from the facts job.

    ``syntax(repo, path, kind, name, function, line, deco_shape, is_async)``
    rows are emitted by :mod:`quarry.plans.facts`.
    """
    s = syntax
    api = s.where((F.col("kind") == "decorator") & (~F.col("is_async"))
                  & F.col("deco_shape").isin("name", "attribute")
                  & F.col("deco_last").isin("get", "post", "put", "delete", "patch"))
    api = api.select("repo", "path", "line", F.lit("api").alias("type"),
                     F.upper("deco_last").alias("operation"), F.col("function").alias("name"))
    if repo_fw is not None:
        api = gate_by_framework(api, repo_fw, {"api": API_REQUIRES})
    asy = s.where(F.col("kind") == "async_def").select(
        "repo", "path", "line", F.lit("async").alias("type"),
        F.lit(None).cast("string").alias("operation"), "name")
    deco = s.where((F.col("kind") == "decorator") & (~F.col("is_async"))
                   & F.col("deco_shape").isin("name", "attribute")
                   & (F.col("name") != "") & ~F.col("name").startswith("app."))
    deco = deco.select("repo", "path", "line", F.lit("decorator").alias("type"),
                       F.col("function").alias("operation"), "name")
    ctx = s.where((F.col("kind") == "with_item") & (F.col("name") != "")).select(
        "repo", "path", "line", F.lit("context_manager").alias("type"),
        F.lit(None).cast("string").alias("operation"), "name")
    return api.unionByName(asy).unionByName(deco).unionByName(ctx)


def type_filter(hits: DataFrame, keep: list[str] | None) -> DataFrame:
    """optional keep-list of pattern types (public aliases mapped)."""
    if not keep:
        return hits
    keys = [TYPE_ALIASES.get(k, k) for k in keep]
    return hits.where(F.col("type").isin(keys))


def pattern_summary(hits: DataFrame) -> DataFrame:
    """F8: count per (repo, type) plus the per-repo total (type ``total``),
    as one grouping-sets aggregation."""
    g = hits.groupingSets([["repo", "type"], ["repo"]], "repo", "type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("type").alias("g"))
    return g.select("repo", F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("type")).alias("type"), "n")


def antipatterns(summary: DataFrame, max_dataframe_ops: int = 50) -> DataFrame:
    """repos with more than ``max_dataframe_ops`` dataframe hits."""
    return (summary.where((F.col("type") == "dataframe") & (F.col("n") > max_dataframe_ops))
            .select("repo", F.lit("excessive-dataframe-operations").alias("antipattern"),
                    F.lit("warning").alias("severity"), F.col("n").alias("count")))


def best_practices(repo_fw: DataFrame, summary: DataFrame) -> DataFrame:
    """pandas -> follows / not-detected; sklearn -> follows / missing."""
    cnt = summary.groupBy("repo").agg(
        F.sum(F.when(F.col("type") == "dataframe", F.col("n")).otherwise(0)).alias("n_df"),
        F.sum(F.when(F.col("type") == "pipeline", F.col("n")).otherwise(0)).alias("n_pipe"))
    j = repo_fw.join(cnt, "repo", "left").na.fill(0, ["n_df", "n_pipe"])
    pandas = F.when(F.array_contains("frameworks", "pandas"), F.struct(
        F.lit("DataFrame Operations").alias("practice"),
        F.when(F.col("n_df") > 0, "follows").otherwise("not-detected").alias("status")))
    sk = F.when(F.array_contains("frameworks", "sklearn"), F.struct(
        F.lit("ML Pipelines").alias("practice"),
        F.when(F.col("n_pipe") > 0, "follows").otherwise("missing").alias("status")))
    return (j.select("repo", F.explode(F.array_compact(F.array(pandas, sk))).alias("bp"))
            .select("repo", "bp.practice", "bp.status"))


# The thresholds of the patterns findings.
PATTERN_RULES = [
    Rule("antipatterns_found", "n_antipatterns", ">", 0),
    Rule("pandas_without_dataframe_ops", "n_df", "==", 0, when="has_pandas"),
    Rule("good_async_use", "n_async", ">", 10),
]


def findings_patterns(repo_fw: DataFrame, summary: DataFrame,
                      max_dataframe_ops: int = 50) -> DataFrame:
    """antipatterns found, pandas without dataframe hits, many async
    functions. One aggregation over the (small) summary gives all counts;
    the antipattern count is F9's condition evaluated inline."""
    t, n = F.col("type"), F.col("n")
    cnt = summary.groupBy("repo").agg(
        F.sum(F.when(t == "dataframe", n).otherwise(0)).alias("n_df"),
        F.sum(F.when(t == "async", n).otherwise(0)).alias("n_async"),
        F.count_if((t == "dataframe") & (n > max_dataframe_ops)).alias("n_antipatterns"))
    s = (repo_fw.join(cnt, "repo", "left")
         .na.fill(0, ["n_df", "n_async", "n_antipatterns"])
         .withColumn("has_pandas", F.array_contains("frameworks", "pandas")))
    return findings(s, "patterns", PATTERN_RULES)

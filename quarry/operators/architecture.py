"""Architecture report (D1-D12): structure, layers, complexity rankings.

Inputs are fact tables keyed by ``(repo, path)``:
``modules(repo, path, n_lines[, mi])``, ``blocks(repo, path, name, kind,
line, complexity)``, entity tables ``(repo, path, seq, name, line)``.
Per-file facts are aggregated on ``(repo, path)`` first (map-side partial
aggregation), so a huge repo never funnels its raw rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import Rule, findings
from .prefix import split_rank


def _count(df: DataFrame | None, name: str) -> DataFrame | None:
    if df is None:
        return None
    return df.groupBy("repo", "path").agg(F.count(F.lit(1)).alias(name))


def structure_counts(modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Modules, classes (all depths), top-level functions, total lines."""
    m = modules.groupBy("repo").agg(F.count(F.lit(1)).alias("n_modules"),
                                    F.sum("n_lines").cast("long").alias("total_lines"))
    c = classes.groupBy("repo").agg(F.count(F.lit(1)).alias("n_classes"))
    f = functions.groupBy("repo").agg(F.count(F.lit(1)).alias("n_functions"))
    return (m.join(c, "repo", "left").join(f, "repo", "left")
            .na.fill(0, ["n_classes", "n_functions"])
            .select("repo", "n_modules", "n_classes", "n_functions", "total_lines"))


def layer_rollup(files: DataFrame, sample: int = 10) -> DataFrame:
    """Per (repo, layer) the module count, the first ``sample`` files in
    path order, and the layer's rank (count desc, then first file)."""
    f = files.select("repo", "path", T.layer_of("path").alias("layer"),
                     T.path_sort_key("path").alias("k"))
    counts = f.groupBy("repo", "layer").agg(F.count(F.lit(1)).alias("module_count"),
                                            F.min("k").alias("first_key"))
    w = Window.partitionBy("repo", "layer").orderBy("k")
    top = f.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
    samp = top.groupBy("repo", "layer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda s: s["path"]).alias("files"))
    wl = Window.partitionBy("repo").orderBy(F.col("module_count").desc(), "first_key")
    return (counts.join(samp, ["repo", "layer"])
            .withColumn("layer_rank", F.row_number().over(wl))
            .select("repo", "layer", "module_count", "files", "layer_rank"))


def file_totals(modules: DataFrame, blocks: DataFrame) -> DataFrame:
    """D3: sum / average / max block complexity per file (0 without blocks)."""
    b = blocks.groupBy("repo", "path").agg(
        F.sum("complexity").cast("long").alias("total_complexity"),
        F.max("complexity").alias("max_complexity"),
        F.count(F.lit(1)).alias("n_blocks"))
    out = (modules.select("repo", "path").join(b, ["repo", "path"], "left")
           .na.fill(0, ["total_complexity", "max_complexity", "n_blocks"]))
    avg = F.when(F.col("n_blocks") > 0, F.col("total_complexity") / F.col("n_blocks")).otherwise(F.lit(0.0))
    return out.withColumn("avg_complexity", avg)


def file_metrics(modules: DataFrame, blocks: DataFrame, functions: DataFrame,
                 classes: DataFrame, imports: DataFrame | None = None,
                 methods: DataFrame | None = None, min_complexity: int = 0) -> DataFrame:
    """Per file lines, complexity, maintainability, functions (+methods),
    classes and imports; files below ``min_complexity`` are dropped.

    All fact tables are tagged and unioned, then rolled up with a single
    ``groupBy(repo, path)`` (partial aggregation map-side): one shuffle
    instead of one join per fact table.
    """
    has_mi = "mi" in modules.columns

    def tag(df, kind, cx=None):
        return df.select("repo", "path", F.lit(kind).alias("k"),
                         (cx if cx is not None else F.lit(0)).cast("long").alias("cx"),
                         F.lit(None).cast("int").alias("n_lines"), F.lit(None).cast("double").alias("mi"))

    parts = [modules.select("repo", "path", F.lit("m").alias("k"), F.lit(0).cast("long").alias("cx"),
                            F.col("n_lines").cast("int").alias("n_lines"),
                            (F.col("mi") if has_mi else F.lit(100.0)).cast("double").alias("mi")),
             tag(blocks, "b", F.col("complexity")), tag(functions, "f"), tag(classes, "c")]
    if methods is not None:
        parts.append(tag(methods, "f"))
    if imports is not None:
        parts.append(tag(imports, "i"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    k = F.col("k")
    g = u.groupBy("repo", "path").agg(
        F.count_if(k == "m").alias("is_module"),
        F.max("n_lines").alias("lines"),
        F.max("mi").alias("maintainability"),
        F.sum(F.when(k == "b", F.col("cx")).otherwise(F.lit(0))).cast("long").alias("complexity"),
        F.count_if(k == "f").alias("functions"),
        F.count_if(k == "c").alias("classes"),
        F.count_if(k == "i").alias("imports"))
    return (g.where((F.col("is_module") > 0) & (F.col("complexity") >= min_complexity))
            .select("repo", "path", "lines", "complexity", "maintainability", "functions",
                    "classes", "imports"))


def top_files(metrics: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most complex files per repo (ties in path order), planned
    as a per-repo WindowGroupLimit; k=0 ranks all of them, with a repo's
    files spread over tasks."""
    order = [F.col("complexity").desc(), T.path_sort_key("path")]
    if not k:
        return split_rank(metrics, ["repo"], order).withColumn("rank", F.col("rank").cast("int"))
    return metrics.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("rank") <= k)


def repo_metrics(modules: DataFrame, totals: DataFrame, detailed: DataFrame) -> DataFrame:
    """Files, lines, total and average complexity per repo; the max is
    over the detailed (filtered, truncated) list as in the original tool."""
    m = modules.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"),
                                    F.sum("n_lines").cast("long").alias("total_lines"))
    t = totals.groupBy("repo").agg(F.sum("total_complexity").cast("long").alias("total_complexity"))
    d = detailed.groupBy("repo").agg(F.max("complexity").alias("max_detailed_complexity"))
    out = (m.join(t, "repo", "left").join(d, "repo", "left")
           .na.fill(0, ["total_complexity", "max_detailed_complexity"]))
    return out.select(
        "repo", "total_files", "total_lines", "total_complexity",
        (F.col("total_complexity") / F.col("total_files")).alias("avg_complexity"),
        (F.col("total_lines") / F.col("total_files")).alias("avg_lines"),
        "max_detailed_complexity")


def complexity_rank(c="complexity"):
    """A <= 5, B <= 10, C <= 20, D <= 30, F above (no E)."""
    x = T.as_col(c)
    return (F.when(x <= 5, "A").when(x <= 10, "B").when(x <= 20, "C")
            .when(x <= 30, "D").otherwise("F"))


def high_complexity(blocks: DataFrame, threshold: int = 10) -> DataFrame:
    """Blocks with complexity >= threshold."""
    return blocks.where(F.col("complexity") >= threshold)


def first_n_entities(entities: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` entities of each repo in file order."""
    w = Window.partitionBy("repo").orderBy(T.path_sort_key("path"), "seq")
    return entities.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def class_edges(classes: DataFrame) -> DataFrame:
    """Inheritance pairs base -> class, without empty and ``object``."""
    e = classes.select("repo", "path", F.col("name").alias("class"), F.explode("bases").alias("base"))
    return e.where((F.col("base") != "") & (F.col("base") != "object"))


def hot_files(detailed: DataFrame, min_complexity: int = 20, n: int = 10) -> DataFrame:
    """Files of the detailed list with complexity >= ``min_complexity``,
    the first ``n`` in list order (the list is already ranked)."""
    h = detailed.where(F.col("complexity") >= min_complexity)
    w = Window.partitionBy("repo").orderBy("rank")
    return h.withColumn("hot_rank", F.row_number().over(w)).where(F.col("hot_rank") <= n)


# The thresholds of the architecture findings.
ARCH_RULES = [
    Rule("very_high_complexity", "max_detailed_complexity", ">", 50),
    Rule("high_average_complexity", "avg_complexity", ">", 15),
    Rule("large_without_layers", "total_files", ">", 100, when="n_layers = 0"),
]


def findings_arch(metrics: DataFrame, layers: DataFrame) -> DataFrame:
    nl = layers.groupBy("repo").agg(F.count(F.lit(1)).alias("n_layers"))
    s = metrics.join(nl, "repo", "left").na.fill(0, ["n_layers"])
    return findings(s, "arch", ARCH_RULES)

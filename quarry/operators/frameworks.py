"""Framework detection (C1-C3): prefix dictionary over import names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Framework -> import-name prefixes (a framework is present in a
# file when some imported module name starts with one of its prefixes).
FRAMEWORK_PREFIXES = {
    "pandas": ["pandas", "pd"],
    "numpy": ["numpy", "np"],
    "sklearn": ["sklearn", "scikit-learn", "scikit_learn"],
    "matplotlib": ["matplotlib", "matplotlib.pyplot", "plt"],
    "seaborn": ["seaborn", "sns"],
    "fastapi": ["fastapi", "FastAPI"],
    "django": ["django"],
    "flask": ["flask", "Flask"],
    "jupyter": ["jupyter", "ipython", "IPython"],
    "tensorflow": ["tensorflow", "tf"],
    "pytorch": ["torch", "pytorch"],
    "scipy": ["scipy"],
    "plotly": ["plotly"],
    "streamlit": ["streamlit", "st"],
}

# Project type by precedence (first rule whose frameworks are
# present wins; otherwise "python").
PROJECT_TYPE_RULES = [
    ("fastapi", ["fastapi"]),
    ("django", ["django"]),
    ("flask", ["flask"]),
    ("data-analysis", ["pandas", "numpy"]),
    ("machine-learning", ["tensorflow", "pytorch"]),
    ("jupyter", ["jupyter"]),
]


def frameworks_of(name, prefixes: dict[str, list[str]] = FRAMEWORK_PREFIXES):
    """Array of frameworks whose prefixes start ``name`` (dictionary order).

    The dictionary is a parameter of bounded size, so this is a projection
    (a ``when`` per framework) evaluated in generated code: no join.
    """
    x = T.as_col(name)
    hits = []
    for fw, toks in prefixes.items():
        cond = F.lit(False)
        for t in toks:
            cond = cond | x.startswith(t)
        hits.append(F.when(cond, F.lit(fw)))
    return F.array_compact(F.array(*hits))


def match_prefix_dict(imports: DataFrame, prefixes=FRAMEWORK_PREFIXES,
                      module_col: str = "module") -> DataFrame:
    """``(repo, path, framework)`` for each framework present in a file.

    The dictionary is applied per import row first (a projection in
    generated code that drops every non-matching name), so only the few
    ``(repo, path, framework)`` hits reach the de-duplicating shuffle, which
    is partially aggregated map-side.
    """
    m = F.col(module_col)
    # most names match nothing: they go before an array is made for them
    known = F.lit(False)
    for token in sorted({t for tokens in prefixes.values() for t in tokens}):
        known = known | m.startswith(token)
    hits = imports.where(m.isNotNull() & (m != "") & known).select(
        "repo", "path", F.explode(frameworks_of(m, prefixes)).alias("framework"))
    return hits.distinct()


def repo_frameworks(file_frameworks: DataFrame) -> DataFrame:
    """Sorted set of frameworks per repo (bounded by the dictionary)."""
    return (file_frameworks.groupBy("repo")
            .agg(F.array_sort(F.collect_set("framework")).alias("frameworks")))


def classify_by_precedence(repo_fw: DataFrame, rules=PROJECT_TYPE_RULES,
                           default: str = "python") -> DataFrame:
    """Project type from the repo's framework set."""
    fw = F.col("frameworks")
    expr = None
    for ptype, names in rules:
        cond = F.lit(False)
        for n in names:
            cond = cond | F.array_contains(fw, n)
        expr = F.when(cond, F.lit(ptype)) if expr is None else expr.when(cond, F.lit(ptype))
    expr = expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)
    return repo_fw.select("repo", expr.alias("project_type"))


def all_repos_frameworks(files: DataFrame, repo_fw: DataFrame) -> DataFrame:
    """Every repo of ``files`` with its (possibly empty) framework set."""
    repos = files.select("repo").distinct()
    return (repos.join(repo_fw, "repo", "left")
            .select("repo", F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks")))

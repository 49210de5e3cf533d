"""Corpus sources: files of many repositories as one table.

``files(repo string, path string, content string)`` is the input of every
report. ``path`` is relative to the repository root and uses ``/``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship_package
from . import ranges

# The default include and exclude globs of a scan.
DEFAULT_INCLUDE = ["**/*.py"]
DEFAULT_EXCLUDE = [
    "**/venv/**",
    "**/.venv/**",
    "**/env/**",
    "**/site-packages/**",
    "**/__pycache__/**",
    "**/build/**",
    "**/dist/**",
    "**/.git/**",
]


def scan_corpus(spark: SparkSession, root: str, include=None, exclude=None,
                repo_level: int = 1, method: str = "listing") -> DataFrame:
    """Read every file below ``root``; ``repo`` is the first ``repo_level``
    folders under ``root``, ``path`` the rest (``/``-separated). With
    ``repo_level=0`` the root is a single project named after its folder.

    Content is decoded as UTF-8; files that are not valid UTF-8 are dropped
    (the original tool skips them). Globs are applied on ``path`` before any
    content is read.

    ``method="listing"`` (default) lists the tree breadth-first with one
    Spark job per folder level (:func:`list_tree`), so a repo holding most of
    the files is spread over many tasks, then reads the selected files in
    tasks packed by their listed sizes. ``method="binaryFile"`` uses
    Spark's file source (listing on the driver) plus :func:`skipped_files`
    for what that source leaves out (names starting with ``_`` or ``.``,
    such as every ``__init__.py``, and empty files).
    """
    if method == "binaryFile":
        return _scan_binary_file(spark, root, include, exclude, repo_level)
    return read_listed(spark, root, list_paths(spark, root, repo_level), include, exclude)


def list_paths(spark: SparkSession, root: str, repo_level: int = 1) -> DataFrame:
    """Every file below ``root`` as ``(repo, path, abs, size)`` (no content)."""
    return _split_repo(list_tree(spark, root), root, repo_level).where(F.col("path") != "")


def read_listed(spark: SparkSession, root: str, paths: DataFrame, include=None,
                exclude=None) -> DataFrame:
    """Contents of the listed files that pass the globs, read in tasks of about
    equal bytes (:func:`quarry.sources.ranges.packed`) and handed on in
    batches of bounded bytes."""
    return ranges.read_files(root, glob_filter(paths, include, exclude))


def scan_lines(spark: SparkSession, root: str, include=None, exclude=None, repo_level: int = 1) -> DataFrame:
    """``line_table`` of the files below ``root``, read by byte ranges: no file is one value."""
    paths = glob_filter(list_paths(spark, root, repo_level), include, exclude)
    return ranges.scan_lines(root, paths)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` as ``(rel, abs, size)``, listed breadth-first:
    each folder level is one Spark job whose tasks list one folder each
    (``pyarrow.fs``: local, HDFS and object stores alike). The folders of
    the next level are the job's output, checkpointed, so the driver only
    loops over levels, never over files."""
    from ..session import cut_lineage
    ship_package(spark)
    _, base = ranges.open_fs(root)
    n = max(1, spark.sparkContext.defaultParallelism * 2)

    def list_level(batches):
        import pandas as pd
        from pyarrow import fs as pafs
        fs2, base2 = ranges.open_fs(root)
        for pdf in batches:
            rows = []
            for d in pdf["dir"]:
                for fi in fs2.get_file_info(pafs.FileSelector(d, recursive=False)):
                    rel = fi.path[len(base2):].lstrip("/")
                    if fi.type == pafs.FileType.Directory:
                        rows.append(("dir", rel, fi.path, 0))
                    elif fi.type == pafs.FileType.File:
                        rows.append(("file", rel, fi.path, int(fi.size or 0)))
            yield pd.DataFrame(rows, columns=["kind", "rel", "abs", "size"])

    schema = "kind string, rel string, abs string, size long"
    frontier = spark.createDataFrame([(base,)], "dir string")
    found = []
    while True:  # until a level has no folders
        level = cut_lineage(frontier.repartition(n).mapInPandas(list_level, schema))
        found.append(level.where(F.col("kind") == "file").select("rel", "abs", "size"))
        frontier = level.where(F.col("kind") == "dir").select(F.col("abs").alias("dir"))
        if frontier.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _split_repo(listed: DataFrame, root: str, repo_level: int) -> DataFrame:
    parts = F.split(F.col("rel"), "/")
    if repo_level == 0:  # the root itself is the one project
        import os
        repo = F.lit(os.path.basename(root.rstrip("/")) or "root")
        relpath = F.col("rel")
    else:
        repo = F.array_join(F.slice(parts, 1, repo_level), "/")
        relpath = F.array_join(F.slice(parts, repo_level + 1, 1 << 20), "/")
    cols = [c for c in listed.columns if c != "rel"]
    return listed.select(repo.alias("repo"), relpath.alias("path"), *cols)


def _scan_binary_file(spark: SparkSession, root: str, include, exclude, repo_level: int) -> DataFrame:
    raw = (spark.read.format("binaryFile")
           .option("recursiveFileLookup", "true")
           .load(root)
           .select("path", "content"))
    rel = F.regexp_replace(F.col("path"), r"^(file:)?/*" + _strip_scheme(root.rstrip("/")) + "/", "")
    files = raw.select(rel.alias("rel"), F.col("content").cast("string").alias("text"),
                       F.expr("is_valid_utf8(cast(content as string))").alias("ok"))
    files = files.where("ok").select("rel", "text").unionByName(skipped_files(spark, root))
    out = _split_repo(files, root, repo_level).withColumnRenamed("text", "content")
    return glob_filter(out.where(F.col("path") != ""), include, exclude)


def _strip_scheme(root: str) -> str:
    import re
    r = root
    for prefix in ("file://", "file:"):
        if r.startswith(prefix):
            r = r[len(prefix):]
    return re.escape(r.lstrip("/"))


def skipped_files(spark: SparkSession, root: str) -> DataFrame:
    """Files that Spark's file sources leave out: any part of the relative
    path starting with ``_`` or ``.``, or zero length. Returns ``(rel, text)``.

    Uses the breadth-first listing (:func:`list_tree`), so a repo holding
    most files is spread over many tasks, and reads only the skipped files.
    """
    listed = list_tree(spark, root)
    skipped = listed.where((F.col("size") == 0) | F.col("rel").rlike(r"(^|/)[_.]"))
    n = max(1, spark.sparkContext.defaultParallelism * 2)

    def read(batches):
        import pandas as pd
        fs2, _ = ranges.open_fs(root)
        for pdf in batches:
            rows = []
            for rel, absp, size in zip(pdf["rel"], pdf["abs"], pdf["size"]):
                data = b""
                if size:
                    with fs2.open_input_stream(absp) as f:
                        data = f.readall()
                try:
                    rows.append((rel, data.decode("utf-8")))
                except UnicodeDecodeError:
                    continue
            yield pd.DataFrame(rows, columns=["rel", "text"])

    return (skipped.repartition(n, F.xxhash64("rel"))
            .mapInPandas(read, "rel string, text string"))


def files_from_table(df: DataFrame, repo, path, content) -> DataFrame:
    """Project any table into the ``files`` shape."""
    return df.select(T.as_col(repo).cast("string").alias("repo"),
                     T.as_col(path).cast("string").alias("path"),
                     T.as_col(content).cast("string").alias("content"))


def glob_filter(files: DataFrame, include=None, exclude=None,
                path_col: str = "path") -> DataFrame:
    """Keep paths matched by some include glob and by no exclude glob.

    Include globs follow ``Path.glob`` (``**`` spans zero or more folders);
    exclude globs follow ``fnmatch`` (``*`` also spans ``/``), so
    ``**/venv/**`` keeps a top-level ``venv/x.py``.
    """
    include = DEFAULT_INCLUDE if include is None else include
    exclude = DEFAULT_EXCLUDE if exclude is None else exclude
    inc = T.matches_any(path_col, [T.pathlib_glob_regex(g) for g in include])
    cond = inc
    if exclude:
        cond = cond & ~T.matches_any(path_col, [T.fnmatch_regex(g) for g in exclude])
    return files.where(cond)


def dedupe_sorted(files: DataFrame) -> DataFrame:
    """Set semantics over overlapping includes plus the path-parts order key.

    The order itself is applied by whichever operator needs it (a global
    sort of a whole corpus is never required)."""
    return (files.dropDuplicates(["repo", "path"])
            .withColumn("path_key", T.path_sort_key("path")))


def with_module_key(files: DataFrame, suffix: str = ".py") -> DataFrame:
    return files.withColumn("module", T.module_key("path", suffix))


def line_table(files: DataFrame) -> DataFrame:
    """``lines(repo, path, line_no, line)`` with str.splitlines() numbering."""
    return files.select(
        "repo", "path",
        F.posexplode(T.splitlines("content")).alias("pos", "line"),
    ).select("repo", "path", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def modules_from_files(files: DataFrame) -> DataFrame:
    """Per-file line counts without exploding lines."""
    return files.select("repo", "path", T.line_count("content").cast("int").alias("n_lines"))

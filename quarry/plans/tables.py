"""Bindings of the driver's test tables to the operators' input shapes.

The test tables hold no source code, so each report is exercised on a
table whose shape matches the operator's input (see README, "Bindings").
Each binding is a plain projection/join over the given tables, so the
work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.prefix import split_rank
from ..sources import corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# documents -> files: repo = source, path = lang/source/<first word>_<doc_id>
# --------------------------------------------------------------------------

def doc_path() -> F.Column:
    word = F.lower(F.regexp_extract(F.col("text"), r"^\p{L}+", 0))
    return F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), word,
                    F.lit("_"), F.col("doc_id").cast("string"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return corpus.files_from_table(d, "source", doc_path(), "text")


def doc_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``modules`` of the document corpus; a document's docstring is present
    when it has a label row (the label's quality as text)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("docstring"))
    return (d.join(lab, "doc_id", "left")
            .select(F.col("source").alias("repo"), doc_path().alias("path"),
                    T.line_count("text").cast("int").alias("n_lines"), "docstring"))


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier-like words of each line: ``(repo, path, line, seq, name)``."""
    lines = corpus.line_table(doc_files(spark, sf_dir))
    w = lines.select("repo", "path", "line_no",
                     F.posexplode(F.regexp_extract_all("line", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
                     .alias("pos", "name"))
    # seq orders words in a file: line first, then position in the line
    return w.select("repo", "path", F.col("line_no").alias("line"),
                    F.struct(F.col("line_no").alias("line"), "pos").alias("seq"), "name")


# --------------------------------------------------------------------------
# pages -> files: repo = host, path = URL path without the leading '/'
# --------------------------------------------------------------------------

URL_REGEX = r"^[a-z]+://([^/?#]+)/?([^?#]*)"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.regexp_extract("url", URL_REGEX, 1).alias("repo"),
                    F.regexp_extract("url", URL_REGEX, 2).alias("path"),
                    F.col("html").alias("content"), "page_id")


# --------------------------------------------------------------------------
# orders/lineitem -> modules/blocks: repo = o_orderpriority,
# path = o_orderstatus/<o_orderkey>.py, block = line item,
# complexity = quantity; functions = status F items, classes = status O items
# --------------------------------------------------------------------------

def order_path() -> F.Column:
    return F.concat(F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".py"))


def order_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("repo"), order_path().alias("path"),
                    F.floor(F.col("o_totalprice") / 1000).cast("int").alias("n_lines"),
                    "o_orderkey")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("repo"), order_path().alias("path"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string"), F.lit("_"),
                 F.col("l_partkey").cast("string"), F.lit("_"),
                 F.col("l_suppkey").cast("string")).alias("name"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_quantity").cast("int").alias("complexity"),
        "l_linestatus", "l_partkey", "l_suppkey")


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).select(
        "repo", "path", "name", F.lit("function").alias("kind"), "line", "complexity")


def order_entities(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    it = order_items(spark, sf_dir).where(F.col("l_linestatus") == status)
    return it.select("repo", "path", F.struct("line", "l_partkey", "l_suppkey").alias("seq"), "name", "line")


# --------------------------------------------------------------------------
# lineitem -> one dependency graph per order: its suppliers are the files, an
# edge leads from each line item's supplier to the next one's
# --------------------------------------------------------------------------

#: Folders of the supplier files, by nation key: one for each node class.
FOLDERS = ["tests", "utils", "models", "views", "services", "lib/__init__", "core"]


def order_repo() -> F.Column:
    return F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))


def succession_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from each line item's supplier to that of the order's next line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    # distinct by the keys, so that the rows stay where the window has put them
    return (li.select("l_orderkey", "l_suppkey", F.lead("l_suppkey").over(w).alias("next"))
            .where(F.col("next").isNotNull()).distinct()
            .select(order_repo().alias("repo"), supplier_id("l_suppkey").alias("src"), supplier_id("next").alias("dst")))


def supplier_id(c) -> F.Column:
    return F.concat(F.lit("s"), T.as_col(c).cast("string"))


def order_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each order, ``(repo, id, s_name, s_nationkey, s_acctbal)``."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    # dealt out by the order alone: neighbours in the table stay together, and their keys compress
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .select(order_repo().alias("repo"), supplier_id("s_suppkey").alias("id"), "s_name", "s_nationkey", "s_acctbal"))


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes with a path: folder/name."""
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.col("s_nationkey") % len(FOLDERS) + 1).cast("int"))
    return order_suppliers(spark, sf_dir).select(
        "repo", "id", F.concat(folder, F.lit("/"), "s_name", F.lit(".py")).alias("path"))


# --------------------------------------------------------------------------
# customer/events -> coverage: file = customer, report lines = events
# --------------------------------------------------------------------------

def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("repo"),
                    F.concat(F.lower("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".py")).alias("path"),
                    "c_custkey")


def customer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage line records: one per event of the customer; covered when
    the event is a purchase or signup. ``line_rate`` is the covered share."""
    files = customer_files(spark, sf_dir)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    hits = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).cast("long")
    rows = e.join(files, e.user_id == files.c_custkey).select(
        "repo", F.col("path").alias("filename"),
        F.col("event_id").cast("int").alias("line_no"), hits.alias("hits"))
    return rows


def customer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a customer file: one per order, complexity = line count of
    the order; the file's total is therefore its number of line items."""
    files = customer_files(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    ob = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    return ob.join(files, ob.o_custkey == files.c_custkey).select(
        "repo", "path", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit("function").alias("kind"), F.col("o_orderkey").cast("int").alias("line"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("int").alias("complexity"))


# --------------------------------------------------------------------------
# conversations -> tasks and import lines
# --------------------------------------------------------------------------

def conversation_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit("chat").alias("repo"),
                    F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".py")).alias("path"),
                    F.col("turn").cast("long").alias("seq"),
                    F.col("text").alias("module"),
                    F.col("turn").cast("int").alias("line"))


def role_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each role's turns of a conversation as the import lines of a file: repo = role, line = number among them."""
    c = table(spark, sf_dir, "conversations")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    return c.select(F.col("role").alias("repo"),
                    F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".py")).alias("path"),
                    F.col("turn").cast("long").alias("seq"), F.col("text").alias("module"), nth.alias("line"))


def conversation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per user turn, ``conv_id:turn``, against one of the document repos, chosen by a hash of its id."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    tasks = c.select(F.concat_ws(":", "conv_id", "turn").alias("task_id"), "text")
    repos = (table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
             .select(F.col("source").alias("repo"), F.lit(0).alias("all")).distinct())
    numbered = split_rank(repos, ["all"], [F.col("repo")], "nth").select("repo", (F.col("nth") - 1).alias("nth"))
    chosen = F.conv(F.substring(F.md5("task_id"), 1, 8), 16, 10).cast("long") % F.lit(max(1, numbered.count()))
    return (tasks.withColumn("nth", chosen).join(numbered, "nth", "left")
            .select("task_id", "repo", "text"))


def doc_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One "function" per document: named by its first word, annotated with
    a return type when the document has a label (the toxic flag as text)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("returns"))
    return (d.join(lab, "doc_id", "left")
            .select(F.col("source").alias("repo"), doc_path().alias("path"), F.col("doc_id").alias("seq"),
                    F.regexp_extract("text", r"^\p{L}+", 0).alias("name"), F.lit(1).alias("line"), "returns"))


def event_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax facts from events (repo = the customer's nation): views are
    async defs, clicks and signups decorators (signups on async defs),
    purchases and errors with-items; the decorator shape follows the event
    value and its name the ``k`` property."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.get_json_object("props", "$.k").cast("int")
    shape = (F.when(F.col("value") < 10, "call").when(F.col("value") < 25, "name").otherwise("attribute"))
    kind = (F.when(F.col("event_type") == "view", "async_def")
            .when(F.col("event_type").isin("click", "signup"), "decorator")
            .when(F.col("event_type").isin("purchase", "error"), "with_item"))
    deco_name = (F.when(shape == "call", F.lit(""))
                 .when(shape == "name", F.when(k < 20, F.lit("get")).otherwise(F.lit("cache")))
                 .otherwise(F.when(k < 50, F.lit("app.route")).otherwise(F.lit("router.post"))))
    deco_last = (F.when(shape == "call", F.lit(""))
                 .when(shape == "name", deco_name)
                 .otherwise(F.when(k < 50, F.lit("route")).otherwise(F.lit("post"))))
    name = (F.when(kind == "decorator", deco_name)
            .when(kind == "with_item", F.when(k < 10, F.lit("")).when(F.col("event_type") == "error", F.lit("lock"))
                  .otherwise(F.lit("open")))
            .otherwise(F.concat(F.lit("h"), F.col("event_id").cast("string"))))
    j = e.join(c, e.user_id == c.c_custkey)
    return (j.where(kind.isNotNull())
            .select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("repo"),
                    F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
                    F.col("event_id").alias("seq"), kind.alias("kind"), name.alias("name"),
                    F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("function"),
                    F.col("event_id").cast("int").alias("line"),
                    (F.col("event_type") == "signup").alias("is_async"),
                    F.when(kind == "decorator", shape).alias("deco_shape"),
                    F.when(kind == "decorator", deco_last).alias("deco_last")))


def nation_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation repo: flask for nations of regions 0 and 1, else none."""
    n = table(spark, sf_dir, "nation")
    fw = F.when(F.col("n_regionkey") <= 1, F.array(F.lit("flask"))).otherwise(F.array().cast("array<string>"))
    return n.select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("repo"),
                    fw.alias("frameworks"))

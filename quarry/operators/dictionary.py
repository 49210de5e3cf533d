"""Dictionaries given as tables: C1, F1-F3 and I2 for any number of tokens.

A dictionary is ``dict(key, token, ord)``. Prefixes are found by looking up
the beginnings of a name of the lengths that the dictionary has. Substrings
are found by an automaton that reads a text once whatever the number of
tokens. A dictionary larger than one task should hold is taken in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..session import cut_lineage, ship_package

#: Tokens, and their characters, of one automaton at most, about; it goes to the tasks with the function that uses it.
PART_TOKENS, PART_CHARS = 100_000, 4_000_000
#: Names whose keys a task remembers at most.
KNOWN_NAMES = 200_000


def literal_dictionary(spark, entries: dict[str, list[str]]) -> DataFrame:
    """``dict(key, token, ord)`` of a literal dictionary, in its order."""
    rows = [(k, t) for k, tokens in entries.items() for t in tokens]
    return spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "key string, token string, ord long")


def match_prefixes(imports: DataFrame, dictionary: DataFrame, module_col: str = "module") -> DataFrame:
    """``(repo, path, framework)`` for each dictionary key that has a token a name of the file starts with.

    Names are looked up in the tasks that read them, in one scan for each
    part of the dictionary; only the keys found for a file are dealt out. An
    empty token is a prefix of every name; null names, empty names and null
    tokens match nothing.
    """
    ship_package(imports.sparkSession)
    m = F.col(module_col)
    named = imports.where(m.isNotNull() & (m != "")).select("repo", "path", m.alias("module"))
    schema = StructType([*named.schema.fields[:2], StructField("framework", StringType())])
    tokens = dictionary.where("token IS NOT NULL").select("token", F.col("key").cast("string").alias("key")).distinct()
    out = None
    for part in _parts(tokens, "key"):
        found = named.mapInArrow(_starts(part), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return named.select("repo", "path", F.lit("").alias("framework")).limit(0)
    return out.distinct()


def _starts(entries: list[tuple[str, str | None]]):
    """Keys of the tokens that names start with: each file's once in a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, keyed = {}, {}
        for token, key in entries:
            keyed.setdefault(token, set()).add(keys.setdefault(key, len(keys)))
        lengths = sorted({len(token) for token in keyed})
        starts = {token[:lengths[0]] for token in keyed}
        every, known = list(keys), {}

        def of(name: str) -> tuple[int, ...]:
            # most names start like no token
            if name[:lengths[0]] not in starts:
                return ()
            if name not in known:
                if len(known) >= KNOWN_NAMES:
                    known.clear()
                hits = (keyed.get(name[:n]) for n in lengths if n <= len(name))
                known[name] = tuple(set().union(*(h for h in hits if h)))
            return known[name]

        for batch in batches:
            repo, path, name = (batch.column(k).dictionary_encode("encode") for k in range(3))
            found = [of(x) for x in name.dictionary.to_pylist()]
            counts = np.array([len(f) for f in found], np.int64)
            flat, first = np.array([k for f in found for k in f], np.int64), np.cumsum(counts) - counts
            row = name.indices.to_numpy()
            file = repo.indices.to_numpy().astype(np.int64) * len(path.dictionary) + path.indices.to_numpy()
            # different (file, name) first, then a row for each key of the name
            pairs = np.unique(file * max(len(found), 1) + row)
            file, row = np.divmod(pairs, max(len(found), 1))
            n = counts[row]
            key = flat[np.repeat(first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            hits = np.unique(np.repeat(file, n) * len(every) + key)
            file, key = np.divmod(hits, len(every))
            repo_at, path_at = np.divmod(file, max(len(path.dictionary), 1))
            yield pa.RecordBatch.from_arrays(
                [repo.dictionary.take(pa.array(repo_at)), path.dictionary.take(pa.array(path_at)),
                 pa.array([every[k] for k in key], pa.string())], ["repo", "path", "framework"])

    return run


def _parts(tokens: DataFrame, value: str) -> Iterator[list[tuple[str, object]]]:
    """(token, value) in parts by a hash of the token."""
    tokens = cut_lineage(tokens.select("token", value))
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).alias("chars")).first()
    n = max(1, -(-size.n // PART_TOKENS), -(-(size.chars or 0) // PART_CHARS))
    for b in range(n if size.n else 0):
        part = [tuple(r) for r in tokens.where(F.pmod(F.xxhash64("token"), F.lit(n)) == b).collect()]
        if part:
            yield part


def _first_places(dictionary: DataFrame) -> DataFrame:
    """``(token, ord)``: each token at its smallest place."""
    return dictionary.where("token <> '' AND ord IS NOT NULL").groupBy("token").agg(F.min("ord").alias("ord"))


def _automaton(tokens: list[tuple[str, int]]):
    import ahocorasick
    out = ahocorasick.Automaton()
    for token, order in tokens:
        out.add_word(token, (order, token))
    out.make_automaton()
    return out


def _find(tokens: list[tuple[str, int]], first_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(tokens)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(0).to_pylist()):
                hits = {value for _, value in automaton.iter(text)} if text else ()
                if hits and first_only:
                    hits = (min(hits),)
                at += [k] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([t for _, t in found], pa.string()),
                 pa.array([o for o, _ in found], pa.int64())], ["text", "token", "ord"])
    return run


def tokens_in(texts: DataFrame, dictionary: DataFrame, text: Column, first_only: bool = False) -> DataFrame:
    """``(text, token, ord)``: the tokens that each different text holds, or the first of them in the dictionary's order.

    ``text`` is an expression over ``texts``. A token that the dictionary has
    several times counts at its first place; null and empty tokens, and null
    texts, give nothing.
    """
    spark = texts.sparkSession
    ship_package(spark)
    each = texts.select(text.alias("text")).where("text IS NOT NULL").distinct()
    out = None
    for part in _parts(_first_places(dictionary), "ord"):
        found = each.mapInArrow(_find(part, first_only), "text string, token string, ord long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "text string, token string, ord long")
    if not first_only:
        return out
    return out.groupBy("text").agg(F.min(F.struct("ord", "token")).alias("f")).select("text", "f.token", "f.ord")


def first_token_table(lines: DataFrame, tokens: DataFrame, guards: DataFrame | None, type_name: str) -> DataFrame:
    """F1-F3 with tables: one hit per line that holds a guard, with the first token by ``ord``."""
    first = tokens_in(lines, tokens, F.col("line"), first_only=True).select(F.col("text").alias("line"), F.col("token").alias("operation"))
    hits = lines.join(first, "line")
    if guards is not None:
        guarded = tokens_in(lines, guards, F.col("line"), first_only=True).select(F.col("text").alias("line"))
        hits = hits.join(guarded, "line", "left_semi")
    return hits.select("repo", "path", F.col("line_no").alias("line"), F.lit(type_name).alias("type"), "operation")


def keywords_table(tasks: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """I2 with a table: every task with the dictionary's tokens that its lower-cased text holds, sorted."""
    lowered = F.lower(T.as_col(text))
    held = tokens_in(tasks, dictionary, lowered).groupBy("text").agg(F.array_sort(F.collect_set("token")).alias("keywords"))
    keyed = tasks.withColumn("_lowered", lowered).join(held.withColumnRenamed("text", "_lowered"), "_lowered", "left")
    return keyed.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))).drop("_lowered")

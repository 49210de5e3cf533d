"""Ranked lexical search by an FP-tree of documents.

Only terms of the items are kept of a document, most frequent first. In that
order documents with the same beginnings share a path of a trie, so they are
range-partitioned by it and each task reads whole subtrees, in order. A task
builds the trie of some thousand neighbours at a time; every node has the
largest tf of each term and the smallest m below it. A score falls with m and
rises with tf, so the two give an upper bound of all scores below. Each item
goes down depth first, best child first, and leaves out subtrees whose bound
is below the worst of its ten; it takes its ten along from trie to trie.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package
from . import wordhash
from .tables import materialise, shuffle_partitions, written

#: Items and their terms that are searched for at once, about; more are taken in several scans.
BLOCK_ITEMS, BLOCK_TERMS = 2000, 200_000
#: Documents and their terms in one trie, documents in a leaf, and cells of a trie's table of maxima.
TREE_DOCS, TREE_TERMS, LEAF_DOCS, TREE_CELLS = 4096, 1 << 18, 32, 1 << 24
#: Terms of a path by which documents are dealt out.
KEY_TERMS = 32
_LOWER = wordhash.ascii_lower_table()
_NO_ID = (1 << 63) - 1


def term_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, terms per row, their hashes) of runs of rows of bounded size."""
    data, offsets = wordhash.buffers(column)
    for a, b in wordhash.row_slices(offsets):
        lo = offsets[a]
        counts, (hashes,) = wordhash.words(data[lo:offsets[b]], offsets[a:b + 1] - lo, wordhash.ALPHANUMERIC, _LOWER)
        yield a, b, counts, hashes


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, counts, hashes in term_hashes(batch.column(1)):
            pairs = np.unique(np.stack([np.repeat(np.arange(a, b), counts), hashes.view(np.int64)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])],
                                             ["item_id", "term"])


def read_items(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """number, item_id, terms: one row per item, its terms those of all rows of its id, once each."""
    kind = items.schema[item].dataType.simpleString()
    pairs = items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).mapInArrow(
        _item_terms, f"item_id {kind}, term bigint")
    held = pairs.distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    return materialise(held.withColumn("number", F.monotonically_increasing_id()), "items")


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _vectors(dictionary: np.ndarray):
    """Rows as (doc_id, n, nth, terms, tfs): terms as places in ``dictionary`` (ascending hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            for a, b, counts, hashes in term_hashes(batch.column(1)):
                at = np.minimum(np.searchsorted(dictionary, hashes), len(dictionary) - 1)
                known = dictionary[at] == hashes
                row = np.repeat(np.arange(b - a), counts)[known]
                pairs, tf = np.unique(row * len(dictionary) + at[known], return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(b - a + 1) * len(dictionary))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(np.arange(nth, nth + b - a)),
                     _lists(offsets, pairs % len(dictionary)), _lists(offsets, tf)], ["doc_id", "n", "nth", "terms", "tfs"])
                nth += b - a
    return run


def _counts(n_terms: int):
    """(-2, number of terms), (-1, documents with a term) and (place, documents that hold it) of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held]), pa.int32()),
                                          pa.array(np.concatenate([[total, docs], df[held]]), pa.int64())], ["term", "count"])
    return run


@dataclass
class Statistics:
    """What scores depend on besides the document: number of documents N and terms L, df by place."""

    docs: int
    terms: int
    df: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * int(d) + 1))) for d in self.df], np.int64)

    @property
    def ranks(self) -> np.ndarray:
        """Of each place its rank by falling df."""
        ranks = np.empty(len(self.df), np.int64)
        ranks[np.argsort(-self.df, kind="stable")] = np.arange(len(self.df))
        return ranks

    def length_parts(self, n: np.ndarray) -> np.ndarray:
        if len(n) and 90 * int(n.max()) * self.docs >= 1 << 63:
            return np.array([10 + 90 * int(x) * self.docs // max(self.terms, 1) for x in n], np.int64)
        return 10 + 90 * n * self.docs // max(self.terms, 1)


def _paths(stats: Statistics):
    """(doc_id, nth, m, path, tfs) with terms as ranks, most frequent first, of documents that hold any."""
    ranks = stats.ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy()
            path, tf = ranks[batch.column(3).flatten().to_numpy()], batch.column(4).flatten().to_numpy()
            order = np.lexsort([path, np.repeat(np.arange(len(sizes)), sizes)])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(stats.length_parts(batch.column(1).to_numpy()), pa.int64()),
                 _lists(offsets, path[order]), _lists(offsets, tf[order])], ["doc_id", "nth", "m", "path", "tfs"])
            yield out.filter(pa.array(sizes > 0))
    return run


def points(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Trie:
    """Documents in the order of their paths, as nodes over neighbouring documents.

    A node's documents share its path; the subtrees below one node that hold
    few documents are leaves, several neighbours in one.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, offsets: np.ndarray, path: np.ndarray, tf: np.ndarray, n_ranks: int):
        self.ids, self.m, self.offsets, self.tf = ids, m, offsets, tf.astype(np.int64)
        terms, self.column = np.unique(path, return_inverse=True)
        self.place = np.full(n_ranks, -1)
        self.place[terms] = np.arange(len(terms))
        shared, leaf_docs = self._shared(path), LEAF_DOCS
        self._split(shared, leaf_docs)
        while len(self.first) * len(terms) > TREE_CELLS and leaf_docs < len(ids):
            leaf_docs *= 2
            self._split(shared, leaf_docs)
        self.tf_max = np.zeros((len(self.first), len(terms)), np.int64)
        self.m_min = np.empty(len(self.first), np.int64)
        owner = np.empty(len(ids), np.int64)
        leaves = [v for v, below in enumerate(self.below) if not below]
        for v in leaves:
            owner[self.first[v]:self.last[v]] = v
            self.m_min[v] = m[self.first[v]:self.last[v]].min()
        np.maximum.at(self.tf_max, (np.repeat(owner, np.diff(offsets)), self.column), self.tf)
        for v in range(len(self.first) - 1, -1, -1):
            if self.below[v]:
                self.tf_max[v] = self.tf_max[self.below[v]].max(axis=0)
                self.m_min[v] = self.m_min[self.below[v]].min()

    def _shared(self, path: np.ndarray) -> np.ndarray:
        """How many first terms each document but the first shares with the one before."""
        start, size = self.offsets[:-1], np.diff(self.offsets)
        shared = np.zeros(len(size), np.int64)
        alive, depth = np.arange(1, len(size)), 0
        while len(alive):
            alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
            alive = alive[path[start[alive] + depth] == path[start[alive - 1] + depth]]
            depth += 1
            shared[alive] = depth
        return shared

    def _split(self, shared: np.ndarray, leaf_docs: int) -> None:
        self.first, self.last, self.below = [], [], []

        def add(first, last):
            self.first.append(first)
            self.last.append(last)
            self.below.append([])
            return len(self.first) - 1

        todo = [add(0, len(self.ids))]
        while todo:
            v = todo.pop()
            first, last = self.first[v], self.last[v]
            if last - first <= leaf_docs:
                continue
            inner = shared[first + 1:last]
            # documents with one path are cut into even leaves
            same = inner.min() == inner.max() and inner.min() >= np.diff(self.offsets[first:last + 1]).max()
            ends = (np.arange(first + leaf_docs, last, leaf_docs) if same
                    else first + 1 + np.flatnonzero(inner == inner.min()))
            at = first
            for k, end in enumerate([*ends, last]):
                following = [*ends, last][k + 1] if k < len(ends) else None
                if following is not None and following - at <= leaf_docs:
                    continue
                child = add(at, int(end))
                self.below[v].append(child)
                todo.append(child)
                at = int(end)

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: list[tuple], top: int) -> None:
        """Put documents of the trie that are among an item's ``top`` into ``best``, a heap of (score, -id)."""
        here = self.place[ranks]
        columns, weights = here[here >= 0], weights[here >= 0]
        if not len(columns):
            return
        bound = points(self.tf_max[:, columns], self.m_min[:, None]) @ weights
        among = np.full(self.tf_max.shape[1], -1)
        among[columns] = np.arange(len(columns))
        stack = [0]
        while stack:
            v = stack.pop()
            if bound[v] <= 0 or len(best) == top and bound[v] < best[0][0]:
                continue
            if self.below[v]:
                stack += sorted(self.below[v], key=bound.__getitem__)
                continue
            first, last = self.first[v], self.last[v]
            lo, hi = self.offsets[first], self.offsets[last]
            which = among[self.column[lo:hi]]
            row = np.repeat(np.arange(last - first), np.diff(self.offsets[first:last + 1]))
            tf = np.zeros((last - first, len(columns)), np.int64)
            tf[row[which >= 0], which[which >= 0]] = self.tf[lo:hi][which >= 0]
            score = points(tf, self.m[first:last, None]) @ weights
            good = score > 0
            if len(best) == top:
                good &= score >= best[0][0]
            for k in np.flatnonzero(good):
                entry = (int(score[k]), -int(self.ids[first + k]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _search(items: list[np.ndarray], numbers: list[int], weight_of_rank: np.ndarray, top: int):
    """A task's best documents of each item (its terms as ranks)."""
    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[Trie]:
        for batch in batches:
            ids, m = batch.column(0).fill_null(_NO_ID).to_numpy(), batch.column(1).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy()
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            path, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            a = 0
            while a < len(ids):
                b = int(np.searchsorted(offsets, offsets[a] + TREE_TERMS, side="right")) - 1
                b = min(max(b, a + 1), a + TREE_DOCS, len(ids))
                lo, hi = offsets[a], offsets[b]
                yield Trie(ids[a:b], m[a:b], offsets[a:b + 1] - lo, path[lo:hi], tf[lo:hi], len(weight_of_rank))
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        for trie in tries(batches):
            for terms, found in zip(items, best):
                trie.search(terms, weight_of_rank[terms], found, top)
        rows = [(n, -e[1] if e[1] != -_NO_ID else None, e[0]) for n, found in zip(numbers, best) for e in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                                         ["number", "doc_id", "score"])
    return run


def _search_block(docs: DataFrame, block: list, top: int) -> DataFrame:
    spark = docs.sparkSession
    terms = [np.array(r.terms, np.int64).view(np.uint64) for r in block]
    dictionary = np.unique(np.concatenate(terms))
    vectors = materialise(docs.mapInArrow(
        _vectors(dictionary), "doc_id bigint, n bigint, nth bigint, terms array<int>, tfs array<int>"), "term-vectors")
    counted = {r.term: r.count_ for r in vectors.select("n", "terms").mapInArrow(
        _counts(len(dictionary)), "term int, count bigint").groupBy("term").agg(F.sum("count").alias("count_")).collect()}
    stats = Statistics(counted.get(-1, 0), counted.get(-2, 0),
                       np.array([counted.get(i, 0) for i in range(len(dictionary))], np.int64))
    paths = vectors.mapInArrow(_paths(stats), "doc_id bigint, nth bigint, m bigint, path array<int>, tfs array<int>")
    # copies share a path, so ids and places in the written table go on dealing
    key = [F.slice("path", 1, KEY_TERMS), F.col("doc_id"), F.col("nth")]
    dealt = (paths.repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions("path", "doc_id")
             .select("doc_id", "m", "path", "tfs"))
    ranks, weights = stats.ranks, np.empty(len(dictionary), np.int64)
    weights[ranks] = stats.weights
    in_ranks = [ranks[np.searchsorted(dictionary, t)] for t in terms]
    return materialise(dealt.mapInArrow(_search(in_ranks, [r.number for r in block], weights, top),
                                        "number bigint, doc_id bigint, score bigint"), "best-of-tasks")


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` terms."""
    whole = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("t")).first()
    n = max(1, -(-whole.n // BLOCK_ITEMS), -(-(whole.t or 0) // BLOCK_TERMS))
    for b in range(n if whole.n else 0):
        held = items.filter(F.pmod(F.xxhash64("number"), F.lit(n)) == b).select("number", "terms").collect()
        if held:
            yield held


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "number bigint, doc_id bigint, score bigint")


@written("ranked")
def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10, text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` rows of ``docs`` with the highest scores above 0 for each item.

    Terms are runs of ASCII letters, digits and characters outside ASCII of
    the whole text, A-Z lower-cased; a null text has none. N is the number of
    documents with a term, L of all terms, n of a document's, df the
    documents that hold a term, tf its places in a document. An item's score
    of a document sums w * ((1000000000 * tf) div (1000 * tf + 8 * m)) over
    the item's different terms, with w = floor(1000 * ln((2N + 2) / (2df + 1)))
    and m = 10 + (90 * n * N) div L. Equal scores go by doc_id, null last.
    Repeated rows are documents of their own and take a rank each; rows of
    one item_id are one item with the terms of all. Items without terms, or
    without a document that holds one, have no rows, nor has an empty table.
    Other columns are not read.
    """
    ship_package(docs.sparkSession)
    listed = read_items(items)
    texts = docs.select("doc_id", F.col(text).alias("text"))
    found = _nothing(docs.sparkSession)
    for block in _blocks(listed):
        found = found.unionByName(_search_block(texts, block, top))
    order = W.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(listed.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")

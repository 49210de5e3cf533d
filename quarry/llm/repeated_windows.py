"""Repeated windows of bytes or words, told apart to their full depth only.

Windows are told apart by their first ``window`` units; groups that are still
equal at that depth are exactly the repeated windows. Sorting all suffixes by
successive digits would deal out a row for every byte, so groups are split by
hashes of larger and larger parts instead, and few windows stand for all:

1. the window's anchor: the smallest hash of its ``gram``-byte substrings. It
   depends on nothing outside the window, so equal windows have equal anchors
   at equal offsets, and neighbouring windows mostly share theirs. Windows
   whose anchor occurs once are done.
2. the whole run of windows of one anchor. If another run is equal, all its
   windows are repeated.
3. cells of neighbouring offsets: if the bytes that a cell's windows have in
   common are unique, none is repeated; if all bytes that they cover occur
   again, all are.
4. the single windows of the cells left.

Of a class that is decided one member goes on, as a partner for the others.
Texts that are equal as a whole are one text from the start.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import wordhash
from .tables import WORD, materialise, shared_path, shuffle_partitions, text_or_empty, written

#: Bytes of an anchor's substring, and offsets in a cell.
GRAM, CELL = 100, 16
#: Window starts that are worked on at once.
RUN = 1 << 19
#: Words of an anchor's substring, where windows are counted in words.
WORD_GRAM = 8
#: Units of a string column: an array of all and the offsets of its rows.
Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours, by running values from both ends of blocks."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, fill, dtype=values.dtype)
    blocks[:len(values)] = values
    blocks = blocks.reshape(-1, width)
    forward = pick.accumulate(blocks, axis=1).reshape(-1)
    backward = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(backward[:n], forward[width - 1:width - 1 + n])


def anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each window start of ``data``, and the hash at each place."""
    hasher = wordhash.SpanHasher(data)
    at = np.arange(len(data) - gram + 1)
    grams = hasher.spans(at, at + gram)
    width = window - gram + 1
    least = _sliding(grams, width, np.minimum, _TOP)
    # a place is an anchor where it is as small as the largest minimum of the windows around it
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = _sliding(around, width, np.maximum, np.uint64(0)) == grams
    places = np.flatnonzero(chosen)
    # of equal hashes the last in the window
    nth = np.cumsum(chosen)[width - 1:] - 1
    wrong = np.flatnonzero(grams[places[nth]] != least)
    while len(wrong):
        nth[wrong] -= 1
        wrong = wrong[grams[places[nth[wrong]]] != least[wrong]]
    return places[nth], grams


def _runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple]:
    """(row, gram, place, first, last, hash of the run): runs of window starts with one anchor; places within the row."""
    for a, b in wordhash.row_slices(offsets, RUN):
        lo, hi = int(offsets[a]), int(offsets[b])
        for at in range(lo, max(lo + 1, hi - window + 1), RUN) if hi - lo > RUN else (lo,):
            part = data[at:min(at + RUN + window - 1, hi)] if hi - lo > RUN else data[lo:hi]
            if len(part) < window:
                continue
            place, grams = anchors(part, window, gram)
            starts = np.arange(len(place))
            row = np.searchsorted(offsets, at + starts, side="right") - 1
            inside = at + starts + window <= offsets[row + 1]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(begins)
            if not len(first):
                continue
            ends = inside.copy()
            ends[:-1] &= ~inside[1:] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            last = np.flatnonzero(ends)
            whole = wordhash.SpanHasher(part, 1).spans(first, last + window)
            move = at - offsets[row[first]]
            yield row[first], grams[place[first]], place[first] + move, first + move, last + move, whole


def _find_runs(window: int, gram: int, units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = units(batch.column(1))
            for row, grams, place, first, last, whole in _runs(data, offsets, window, gram):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(grams.view(np.int64)), pa.array(place),
                     pa.array((place - last).astype(np.int32)), pa.array((place - first).astype(np.int32)),
                     pa.array(whole.view(np.int64))], ["mark", "gram", "place", "near", "far", "whole"])
    return run


def _segments(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of ascending places that lie within ``RUN`` bytes."""
    first = 0
    while first < len(places):
        last = int(np.searchsorted(places, places[first] + RUN, side="left"))
        yield first, last
        first = last


def _find_cells(window: int, gram: int, cell: int, units: Units):
    """Cells of ``cell`` offsets that hold an offset from ``near`` to ``far`` of the listed anchors."""
    furthest = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = units(batch.column(1))
            listed = batch.column(2)
            items, ends = listed.flatten(), np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
            fields = [items.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held: list[tuple] = []
            for r in range(batch.num_rows):
                text = data[offsets[r]:offsets[r + 1]]
                place, near, far, grams = (f[ends[r]:ends[r + 1]] for f in fields)
                low, n = near // cell, far // cell - near // cell + 1
                each = np.repeat(np.arange(len(place)), n)
                number = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                # a run that was cut names its anchor twice; a cell counts once
                keys = np.unique(np.stack([place[each], number, grams[each]], axis=1), axis=0)
                for a, b in _segments(keys[:, 0]):
                    p, c, g = keys[a:b, 0], keys[a:b, 1], keys[a:b, 2]
                    start = max(int(p[0]) - furthest, 0)
                    hasher = wordhash.SpanHasher(text[start:int(p[-1]) + window], 1)
                    last, first = p - c * cell, p - np.minimum(c * cell + cell - 1, furthest)
                    fits = (last >= 0) & (first + window <= len(text))
                    if cell == 1:
                        fits &= (first >= 0) & (last + window <= len(text))
                    p, c, g, first, last = p[fits], c[fits], g[fits], first[fits], last[fits]
                    core = hasher.spans(last - start, first - start + window)
                    full = (first >= 0) & (last + window <= len(text))
                    cover = core.copy()
                    cover[full] = hasher.spans(first[full] - start, last[full] - start + window)
                    held.append((np.full(len(p), r), g, p, c.astype(np.int32), core.view(np.int64),
                                 cover.view(np.int64), full))
            if held:
                row, *rest = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), *map(pa.array, rest)],
                    ["mark", "gram", "place", "cell", "core", "cover", "full"])
    return run


def _cut(window: int, units: Units):
    """What is left of each text without the listed (first, last) window starts' units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = units(batch.column(1))
            listed = batch.column(2)
            items, ends = listed.flatten(), np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
            firsts, lasts = (items.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            removed, spans, kept = [], [], []
            for r in range(batch.num_rows):
                text = data[offsets[r]:offsets[r + 1]]
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, firsts[ends[r]:ends[r + 1]], 1)
                np.add.at(depth, lasts[ends[r]:ends[r + 1]] + window, -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
                ["mark", "n_removed", "n_spans", "kept_sha256"])
    return run


def _decide(rows: DataFrame, group: list[str], member: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that equal another in ``group + member``, and those to look at more closely.

    The latter share ``group`` with a row of another class; of a class of
    equal rows only the first is among them.
    """
    me = F.struct("mark", "place")
    classes = materialise(rows.groupBy(*group, *member).agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("head")), "window-classes")
    several = classes.groupBy(*group).agg(F.count(F.lit(1)).alias("n_classes")).filter("n_classes > 1")
    repeated = rows.join(classes.filter("n > 1").select(*group, *member), group + member, "left_semi")
    heads = classes.join(several, group, "left_semi").select(*group, *member, F.col("head.mark").alias("mark"),
                                                             F.col("head.place").alias("place"))
    return repeated, heads


def _listed(rows: DataFrame, *columns) -> DataFrame:
    return rows.groupBy("mark").agg(F.collect_list(F.struct(*columns)).alias("listed"))


def _covered(texts: DataFrame, window: int, gram: int, cells: tuple[int, ...], units: Units) -> DataFrame:
    """mark, n_removed, n_spans, kept_sha256 of the texts (mark, text) in which a window of ``window`` units is repeated."""
    runs = materialise(texts.select("mark", "text").mapInArrow(
        _find_runs(window, gram, units), "mark binary, gram bigint, place bigint, near int, far int, whole bigint"), "window-runs")
    # written, so that Spark can split the join's large groups
    grams = materialise(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "window-grams")
    shared = materialise(runs.join(grams.select("gram"), "gram", "left_semi"), "window-shared")
    repeated, heads = _decide(shared, ["gram"], ["near", "far", "whole"])
    gone = repeated.select("mark", (F.col("place") - F.col("far")).alias("first"), (F.col("place") - F.col("near")).alias("last"))

    body = texts.select("mark", "text")
    schema = "mark binary, gram bigint, place bigint, cell int, core bigint, cover bigint, full boolean"
    furthest = window - gram
    for size in cells:
        listed = _listed(heads, "place", "near", "far", "gram")
        found = materialise(body.join(listed, "mark").select("mark", "text", "listed").mapInArrow(
            _find_cells(window, gram, size, units), schema), "window-cells")
        # a cell that does not fit into its text is a class of its own
        alone = F.when(~F.col("full"), F.xxhash64("mark", "place")).otherwise(F.lit(0).cast("long"))
        repeated, heads = _decide(found.withColumn("alone", alone), ["gram", "cell", "core"], ["cover", "alone"])
        near, far = F.col("cell") * size, F.least(F.col("cell") * size + size - 1, F.lit(furthest))
        gone = gone.unionByName(repeated.select("mark", (F.col("place") - far).alias("first"), (F.col("place") - near).alias("last")))
        heads = heads.withColumn("near", near.cast("int")).withColumn("far", far.cast("int"))
    return body.join(_listed(gone, "first", "last"), "mark").select("mark", "text", "listed").mapInArrow(
        _cut(window, units), "mark binary, n_removed bigint, n_spans bigint, kept_sha256 string")


@written("passage-results")
def _passages(texts: DataFrame, words: int) -> DataFrame:
    """mark, n_passage_words, n_passages of the texts that share ``words`` words in sequence with any place else."""
    single = _covered(texts, words, min(WORD_GRAM, max(1, words // 4)), (1,), wordhash.word_units).select(
        "mark", F.col("n_removed").alias("n_passage_words"), F.col("n_spans").alias("n_passages"))
    n_words = F.regexp_count("text", F.lit(WORD)).cast("long")
    copied = texts.filter("copies > 1").select("mark", n_words.alias("n_passage_words"), F.lit(1).cast("long").alias("n_passages"))
    return (single.join(texts.filter("copies = 1").select("mark"), "mark", "left_semi")
            .unionByName(copied.filter(F.col("n_passage_words") >= words)))


@written("window-result")
def repeated_windows(docs: DataFrame, window: int = 400, gram: int | None = None, cell: int = CELL,
                     text: str = "text", words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``words`` also
    n_passage_words, n_passages.

    Texts are UTF-8 bytes. Each byte goes that is covered by a ``window``-byte
    string which also starts anywhere else, in the same text or another; all
    strings are judged on the texts as they come. ``n_spans`` counts the
    maximal removed runs. ``n_passage_words`` counts the words covered by
    ``words`` words in sequence that also stand anywhere else, however many
    bytes they are and white space they have between them, ``n_passages``
    their maximal runs; nothing is removed for them. Null and empty texts,
    and texts shorter than the window, lose nothing. Repeated rows are
    documents of their own and so lose all if they are long enough. Ids are
    only passed on, other columns not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    gram = gram or min(GRAM, max(1, window // 4))
    whole = text_or_empty(text)
    sha = F.sha2(whole, 256)
    mark = F.unhex(F.left("text_sha256", F.lit(32)))
    rows = docs.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), sha.alias("text_sha256")).withColumn("mark", mark)
    # each different text once, written in buckets: later joins by mark leave the texts where they are
    least = min(window, 2 * words - 1) if words else window
    distinct = (docs.select(whole.alias("text"), sha.alias("text_sha256")).filter(F.octet_length("text") >= least)
                .groupBy("text_sha256").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
                .select(mark.alias("mark"), "copies", "text"))
    name = f"texts_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    (distinct.repartition(n, "mark").write.bucketBy(n, "mark").option("path", shared_path(spark, "texts"))
     .format("parquet").saveAsTable(name))
    texts = spark.table(name)
    try:
        passages = _passages(texts, words) if words else None
        return _without_repeats(rows, texts, window, gram, cell, passages)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _without_repeats(rows: DataFrame, texts: DataFrame, window: int, gram: int, cell: int, passages: DataFrame | None) -> DataFrame:
    left = _covered(texts, window, gram, (cell, 1), wordhash.buffers)
    copied = texts.filter((F.col("copies") > 1) & (F.octet_length("text") >= window)).select(
        "mark", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"))
    single = left.join(texts.filter("copies = 1").select("mark"), "mark", "left_semi")
    found = single.unionByName(copied)
    counted = ["n_removed", "n_spans"]
    if passages is not None:
        found = found.join(passages, "mark", "full_outer")
        counted += ["n_passage_words", "n_passages"]
    found = materialise(found, "window-results").withColumnRenamed("mark", "of")
    n_removed, n_spans, *more = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counted]
    return rows.join(found, F.col("mark") == F.col("of"), "left").select(
        "doc_id", "n_bytes", n_removed, n_spans, F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"), *more)

"""MinHash near-dedup with min-max hashing.

Each permutation of a document's shingles gives two signature values, its
minimum and its maximum. Bands of the signature propose candidates; every
link is confirmed on the full shingle sets.

Texts with the same words are one class from the start. Links are looked for
in three rounds, and what a round has joined is one component in the next:

1. in the buckets of the first bands every class is compared with the
   bucket's smallest one only;
2. the same in all buckets, where the two are not in one component yet;
3. in each bucket that still holds several components, all members of
   different components are compared, so no link is lost because a bucket's
   first document is not similar enough. Two documents are compared in the
   first bucket they share; of buckets with the same members one is taken.

Comparisons are made in blocks, inside tasks that join components as they go
and return a link only where it joins two. So links grow with the documents,
not with the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import wordhash
from .components import components
from .tables import materialise, text_or_empty, written

#: Values of a band, and the greatest chance that no band of two documents at the threshold is equal.
ROWS, MISS = 6, 1e-6
#: Bands of the first round.
FIRST_BANDS = 8
#: Shingles that a block of one side holds about, when members of a bucket are compared.
BLOCK_SHINGLES = 1 << 17
_LOWER = wordhash.ascii_lower_table()
#: Words whose signatures are computed at once.
RUN_WORDS = 1 << 18


def n_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    bands = math.ceil(math.log(miss) / math.log(1 - threshold ** rows))
    # whole permutations: two values each
    return bands + (bands * rows) % 2


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = wordhash.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[:n] | np.uint64(1), seeds[n:]


def _row_shingles(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row the hashes of its words and of its distinct shingles."""
    data, offsets = wordhash.buffers(column)
    for a, b in wordhash.row_slices(offsets):
        lo = offsets[a]
        counts, (words,) = wordhash.words(data[lo:offsets[b]], offsets[a:b + 1] - lo, lower=_LOWER)
        for part in np.split(words, np.cumsum(counts)[:-1]):
            yield part, wordhash.shingles(part, k)


def min_max_signature(sets: list[np.ndarray], n_permutations: int) -> np.ndarray:
    """Minimum and maximum of each set under each permutation, in one row for each (non-empty) set."""
    mult, add = _permutations(n_permutations)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * n_permutations), np.uint64)
    for j in range(n_permutations):
        # a mixing round: the least and the greatest value of a bare linear map would depend on each other
        h = flat * mult[j] + add[j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[:, 2 * j] = np.minimum.reduceat(h, starts)
        out[:, 2 * j + 1] = np.maximum.reduceat(h, starts)
    return out


def _band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    # band b takes every bands-th value, so a band rarely holds both ends of one permutation
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = wordhash.mix(out * np.uint64(0x9FB21C651E98DF25) + signature[:, r * bands:(r + 1) * bands])
    return out


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, held, size, at = batch.column(0), batch.column(2), [], 0, 0
            for words, distinct in _row_shingles(batch.column(1), k):
                held.append((words, distinct))
                size += len(words)
                if size >= RUN_WORDS:
                    yield out(ids.slice(at, len(held)), marks.slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield out(ids.slice(at, len(held)), marks.slice(at, len(held)), held)

    def out(ids, marks, held):
        filled = [s for _, s in held if len(s)]
        hashes = np.zeros((len(held), bands), np.uint64)
        if filled:
            hashes[[len(s) > 0 for _, s in held]] = _band_hashes(
                min_max_signature(filled, bands * rows // 2), bands, rows)
        offsets = pa.array(np.arange(len(held) + 1) * bands, pa.int32())
        return pa.RecordBatch.from_arrays(
            [ids, marks, pa.array([len(s) for _, s in held], pa.int64()),
             pa.array([hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w, _ in held], pa.binary()),
             pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64).reshape(-1)))],
            ["doc_id", "text_mark", "n_shingles", "words_mark", "bands"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            for _, distinct in _row_shingles(batch.column(1), k):
                held.append(distinct)
                size += len(distinct)
                if size >= RUN_WORDS:
                    yield out(batch.column(0).slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield out(batch.column(0).slice(at, len(held)), held)

    def out(ids, held):
        offsets = pa.array(np.cumsum([0] + [len(s) for s in held]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [ids, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held).view(np.int64)))], ["id", "shingles"])
    return run


def _list_column(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places from ``first[i]`` up to ``last[i]``, one range after the other."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _compare(percent: int):
    """Links that join components of a group: rows of side 0 against those of side 1, rows of side 2 among each other.

    Two rows that share a band before the group's own are left to that band's group.
    """
    def run(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        comp = table["component"].to_numpy().copy()
        band = int(table["band"][0].as_py())
        ends, flat = _list_column(table["shingles"])
        sizes = np.diff(ends)
        at, bands = _list_column(table["bands"])
        bands = bands[at[:-1, None] + np.arange(band)] if band else np.zeros((len(ids), 0), np.int64)
        members = np.flatnonzero(side > 0)
        values = flat[_spread(ends[members], ends[members + 1])]
        order = np.argsort(values, kind="stable")
        values, places = values[order], np.repeat(members, sizes[members])[order]
        found_a, found_b = [], []
        for q in np.flatnonzero(side != 1):
            may = members[members > q] if side[q] == 2 else members
            n = sizes[may]
            may = may[(comp[may] != comp[q]) & (100 * np.minimum(n, sizes[q]) >= percent * np.maximum(n, sizes[q]))]
            if band and len(may):
                may = may[~(bands[may] == bands[q]).any(axis=1)]
            if not len(may):
                continue
            own = flat[ends[q]:ends[q + 1]]
            held = _spread(np.searchsorted(values, own, side="left"), np.searchsorted(values, own, side="right"))
            common = np.bincount(places[held], minlength=len(ids))[may]
            for m in may[100 * common >= percent * (sizes[may] + sizes[q] - common)]:
                if comp[m] != comp[q]:
                    comp[comp == comp[m]] = comp[q]
                    found_a.append(ids[q])
                    found_b.append(ids[m])
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})
    return run


def _confirmed(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``groups`` (grp, block, id, component, side, band, bands) with their shingles, compared group by group."""
    rows = groups.join(sets, "id").select("grp", "block", "side", "id", "component", "band", "bands", "shingles")
    return materialise(rows.groupBy("grp", "block").applyInArrow(_compare(percent), "a bigint, b bigint"), "confirmed")


def _blocks(total):
    return F.ceil(total / F.lit(BLOCK_SHINGLES)).cast("int")


def _dealt(id_column: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(id_column), n).cast("int")


def _star_groups(stars: DataFrame) -> DataFrame:
    """Each hub with its members, dealt to blocks; the hub goes to each block of its own."""
    sizes = stars.groupBy("hub").agg(_blocks(F.sum("n_shingles")).alias("n_blocks"))
    member = stars.join(sizes, "hub").select(
        F.col("hub").alias("grp"), _dealt("id", F.col("n_blocks")).alias("block"), "id", F.lit(1).alias("side"))
    hubs = sizes.select(F.col("hub").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"),
                        F.col("hub").alias("id"), F.lit(0).alias("side"))
    return member.unionByName(hubs).select(
        "*", F.col("id").alias("component"), F.lit(0).alias("band"), F.array().cast("array<bigint>").alias("bands"))


def _rest_groups(meeting: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Buckets of ``meeting`` that hold several components, in pairs of blocks."""
    rows = materialise(meeting.join(labels, "id", "left").select(
        "band", "value", "id", "n_shingles", F.coalesce("component", "id").alias("component")), "bucket-components")
    several = rows.groupBy("band", "value").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("mark"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("mark2"),
        _blocks(F.sum("n_shingles")).alias("n_blocks")).filter("low <> high")
    # the first of the buckets with the same members
    buckets = (several.groupBy("n", "mark", "mark2").agg(F.min(F.struct("band", "value", "n_blocks")).alias("b"))
               .select("b.*", F.monotonically_increasing_id().alias("grp")))
    held = rows.join(materialise(buckets, "rest-buckets"), ["band", "value"]).withColumn("own", _dealt("id", F.col("n_blocks")))
    other = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = other.select("grp", (low * F.col("n_blocks") + high).alias("block"), "id", "component", "band", side.alias("side"))
    return dealt.join(classes.select("id", "bands"), "id")


@written("near-result")
def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_mark (a hash of the text).

    A-Z are lower-cased, words are runs without spaces and the control
    characters 9 to 13. A document's set are its distinct ``words``-word
    shingles, or all its words as one if it has fewer. Documents with
    100 * intersection >= ``percent`` * union are linked; component_id is the
    smallest doc_id that can be reached, and a row is kept if that is its
    own and, of that id's texts in the component, its text has the smallest
    text_mark. Texts that are null or without words have an empty set and are
    linked with nothing; so are rows with a null id, whose component_id is
    null and which are kept. Repeated rows share their result. Rows of one id
    with different texts are linked each by its own text. Other columns are
    not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    bands = n_bands(percent / 100)
    texts = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text_or_empty(text)).alias("text_mark"))
    signed = materialise(texts.mapInArrow(
        _signatures(words, bands, ROWS),
        "doc_id bigint, text_mark bigint, n_shingles bigint, words_mark binary, bands array<bigint>"), "signatures")
    classes = materialise(signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("words_mark").agg(
        F.min(F.struct("doc_id", "text_mark")).alias("first"), F.max("n_shingles").alias("n_shingles"),
        F.min_by("bands", "doc_id").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "classes")
    banded = materialise(classes.select("id", "n_shingles", F.posexplode("bands").alias("band", "value")), "bands")
    buckets = banded.groupBy("band", "value").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    meeting = materialise(banded.join(buckets.drop("n"), ["band", "value"]), "meeting")
    # only documents that met another one need their sets
    met = classes.join(meeting.select("id").distinct(), "id").select("id", "first.doc_id", "first.text_mark")
    sets = materialise(texts.join(met, ["doc_id", "text_mark"]).select("id", "text").mapInArrow(
        _sets(words), "id bigint, shingles array<bigint>").dropDuplicates(["id"]), "shingle-sets")

    stars = meeting.filter("id <> hub").select("hub", "id", "n_shingles", "band")
    early = materialise(stars.filter(F.col("band") < FIRST_BANDS).drop("band").distinct(), "stars")
    links = _confirmed(_star_groups(early), sets, percent)
    labels = components(links)
    of_hub = labels.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    late = materialise(stars.filter(F.col("band") >= FIRST_BANDS).drop("band").distinct().join(early, ["hub", "id"], "left_anti")
                       .join(labels, "id", "left").join(of_hub, "hub", "left")
                       .filter(F.coalesce("component", "id") != F.coalesce("hub_component", "hub"))
                       .select("hub", "id", "n_shingles"), "stars")
    links = links.unionByName(_confirmed(_star_groups(late), sets, percent))
    labels = components(links)
    rest = _confirmed(_rest_groups(meeting.drop("hub"), labels, classes), sets, percent)
    final = components(links.unionByName(rest)).select(F.col("id").alias("class_id"), "component")
    named = (classes.select(F.col("words_mark").alias("mark"), F.col("id").alias("class_id"), "first")
             .join(final, "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    per_class = named.select("mark", "component").join(
        named.groupBy("component").agg(F.min("first").alias("first")), "component").select("mark", "first")
    rows = signed.select("doc_id", "text_mark", "n_shingles", "words_mark")
    found = rows.join(per_class, (F.col("words_mark") == F.col("mark")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(component) & F.coalesce(F.col("first.text_mark") == F.col("text_mark"), F.lit(True))
    # a row with a null id is linked with nothing
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        (F.col("doc_id").isNull() | kept).alias("kept"), "text_mark")

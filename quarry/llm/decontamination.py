"""Benchmark decontamination by a distributed positional inverted index.

Test texts are cut to phrases. The corpus frequencies of their words tell
each phrase's two rarest terms; postings (document, position) are stored for
these terms only. The two lists of a phrase, moved by the terms' offsets,
are intersected, and what is left is compared word by word with the texts
that hold it. Where the two terms stand near each other in any order, the
words around are counted that the phrase has too. Texts are cut into words
once; every step reads the written words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import ascii_lower, materialise, text_or_empty, written

#: Words: runs of digits, letters a to z and anything outside ASCII, after A to Z are lower-cased.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms that are broadcast at once; more are taken in several scans.
BROADCAST_TERMS = 200_000
#: Marks of texts (8 bytes each) that are broadcast at once.
BROADCAST_MARKS = 1_000_000
#: Of a phrase's different words, how many in a hundred make a near match.
NEAR_PERCENT = 80


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def test_phrases(items: DataFrame, width: int = 10) -> DataFrame:
    """item_id, phrase_id, phrase: each ``width`` consecutive words of an item, or all words of a shorter one."""
    words = items.select("item_id", tokens(text_or_empty()).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(width) + 1, F.lit(1)))
    windows = F.transform(starts, lambda s: F.slice("words", s, width))
    return (words.select("item_id", F.explode(windows).alias("phrase"))
            .withColumn("phrase_id", F.md5(F.array_join("phrase", " "))).distinct())


def _in_parts(terms: DataFrame, use):
    """``use(part)`` over parts of ``terms`` that are small enough to broadcast, as one table."""
    parts = max(1, -(-terms.count() // BROADCAST_TERMS))
    if parts == 1:
        return use(F.broadcast(terms))
    return reduce(DataFrame.unionByName, [
        use(F.broadcast(terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == i))) for i in range(parts)])


def word_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_mark, words of each row; ``text_mark``, a hash, tells apart texts of one id."""
    text = text_or_empty()
    return materialise(docs.select("doc_id", F.xxhash64(text).alias("text_mark"), tokens(text).alias("words")), "index-words")


def term_frequencies(worded: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of ``terms`` occurs in all texts."""
    exploded = worded.select(F.explode("words").alias("term"))
    return _in_parts(terms, lambda t: exploded.join(t, "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("n")))


def rarest_terms(phrases: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The two rarest places of each phrase among its words that occur in the corpus.

    phrase_id, length, missing (words that do not occur), term_1, offset_1,
    term_2, offset_2 and ``pair``, which names the two terms and their
    distance. A phrase with one such word has that word twice.
    """
    places = (phrases.select("phrase_id", "phrase").distinct()
              .select("phrase_id", F.size("phrase").alias("length"), F.posexplode("phrase").alias("offset", "term")))
    known = places.join(frequencies, "term", "left")
    place = F.when(F.col("n").isNotNull(), F.struct(F.col("n"), F.col("term"), F.col("offset")))
    rare = (known.groupBy("phrase_id", "length").agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.array_sort(F.collect_list(place)).alias("places"))
        .filter(F.size("places") > 0))
    first, second = F.get("places", F.lit(0)), F.get("places", F.least(F.size("places"), F.lit(2)) - 1)
    return rare.select(
        "phrase_id", "length", "missing", first["term"].alias("term_1"), first["offset"].alias("offset_1"),
        second["term"].alias("term_2"), second["offset"].alias("offset_2"),
        F.concat_ws(" ", first["term"], second["term"], (second["offset"] - first["offset"]).cast("string")).alias("pair"))


def postings(worded: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, text_mark, pos: where ``terms`` occur."""
    exploded = worded.select("doc_id", "text_mark", F.posexplode("words").alias("pos", "term"))
    return _in_parts(terms, lambda t: exploded.join(t, "term").select("term", "doc_id", "text_mark", "pos"))


def _pairs(rare: DataFrame, nth: int) -> DataFrame:
    move = F.col("offset_2") - F.col("offset_1") if nth == 2 else F.lit(0)
    return rare.select(F.col(f"term_{nth}").alias("term"), "pair", move.alias("move")).distinct()


def _same_text(*more: Column) -> Column:
    return reduce(Column.__and__, more, F.col("doc_id").eqNullSafe(F.col("doc_2")) & (F.col("text_mark") == F.col("mark_2")))


def candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """doc_id, text_mark, phrase_id, length, start: where both rarest terms of a phrase stand in their places."""
    first = index.join(_pairs(rare, 1), "term").select("doc_id", "text_mark", "pair", "pos")
    second = index.join(_pairs(rare, 2), "term").select(
        F.col("doc_id").alias("doc_2"), F.col("text_mark").alias("mark_2"), F.col("pair").alias("pair_2"),
        (F.col("pos") - F.col("move")).alias("pos_2"))
    both = first.join(second, _same_text(F.col("pair") == F.col("pair_2"), F.col("pos") == F.col("pos_2")), "left_semi")
    return (both.join(rare.select("pair", "phrase_id", "length", "offset_1"), "pair")
            .select("doc_id", "text_mark", "phrase_id", "length", (F.col("pos") - F.col("offset_1")).alias("start"))
            .filter("start >= 0").distinct())


def _in_texts(worded: DataFrame, found: DataFrame, holds) -> DataFrame:
    """doc_id, text_mark and the ``place`` of each row of ``found`` (doc_id, text_mark, place) that its text ``holds``.

    Where the texts with places are few enough, their marks are broadcast,
    so that only the words of these are dealt out for the join.
    """
    found = materialise(found, "index-places")
    marks = materialise(found.select("text_mark").distinct(), "index-marks")
    if marks.count() <= BROADCAST_MARKS:
        worded = worded.join(F.broadcast(marks), "text_mark", "left_semi")
    per_text = found.groupBy("doc_id", "text_mark").agg(F.collect_set("place").alias("places")).select(
        F.col("doc_id").alias("doc_2"), F.col("text_mark").alias("mark_2"), "places")
    # the places of a text are looked up in its words where they are, not each in a copy of them
    held = worded.join(per_text, _same_text()).select(
        "doc_id", "text_mark", F.filter("places", lambda p: holds(F.col("words"), p)).alias("places"))
    return held.select("doc_id", "text_mark", F.explode("places").alias("place")).distinct()


def phrase_matches(worded: DataFrame, index: DataFrame, rare: DataFrame) -> DataFrame:
    """doc_id, text_mark, phrase_id, start, length of all exact occurrences."""
    whole = rare.filter("missing = 0")
    found = candidates(index, whole).select("doc_id", "text_mark", F.struct("start", "length", "phrase_id").alias("place"))
    said = lambda words, p: F.md5(F.array_join(F.slice(words, p["start"] + 1, p["length"]), " ")) == p["phrase_id"]
    return _in_texts(worded, found, said).select("doc_id", "text_mark", "place.*")


def proximity_matches(index: DataFrame, rare: DataFrame, span: int = 20) -> DataFrame:
    """doc_id, text_mark, phrase_id, pos, gap: a phrase's two rarest terms at most ``span`` words apart, in any order.

    Each place of the first term is matched with the nearest of the second
    before and after it, by one pass over the places of both in a text;
    ``gap`` is the smaller distance.
    """
    pair = rare.filter("term_1 <> term_2").select("pair", "term_1", "term_2").distinct()
    sides = [index.join(pair.select(F.col(f"term_{k}").alias("term"), "pair"), "term").select(
        "doc_id", "text_mark", "pair", "pos", F.lit(k).alias("side")) for k in (1, 2)]
    order = W.partitionBy("doc_id", "text_mark", "pair").orderBy("pos")
    other = F.when(F.col("side") == 2, F.col("pos"))
    before = F.last(other, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(other, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    gap = F.least(F.col("pos") - before, after - F.col("pos"))
    near = sides[0].unionByName(sides[1]).withColumn("gap", gap).filter("side = 1").filter(F.col("gap") <= span)
    return near.join(rare.select("pair", "phrase_id"), "pair").select("doc_id", "text_mark", "phrase_id", "pos", "gap")


def near_phrases(worded: DataFrame, index: DataFrame, rare: DataFrame, phrases: DataFrame, span: int = 20,
                 percent: int = NEAR_PERCENT) -> DataFrame:
    """doc_id, text_mark, phrase_id: phrases of which ``percent`` of the different words stand within ``span`` words of
    the rarest of them, in any order."""
    words = phrases.select("phrase_id", F.array_distinct("phrase").alias("terms")).distinct()
    found = (proximity_matches(index, rare, span).join(words, "phrase_id")
             .select("doc_id", "text_mark", F.struct("pos", "phrase_id", "terms").alias("place")))

    def holds(words, p):
        around = F.slice(words, F.greatest(p["pos"] + 1 - span, F.lit(1)), F.lit(2 * span + 1))
        return F.size(F.array_intersect(p["terms"], around)) * 100 >= F.size(p["terms"]) * percent
    return _in_texts(worded, found, holds).select("doc_id", "text_mark", "place.phrase_id").distinct()


def build_index(worded: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored postings of the phrases' rarest terms, and the table of these terms."""
    terms = materialise(phrases.select(F.explode("phrase").alias("term")).distinct(), "index-terms")
    rare = materialise(rarest_terms(phrases, term_frequencies(worded, terms)), "index-rare")
    chosen = materialise(rare.select(F.explode(F.array("term_1", "term_2")).alias("term")).distinct(), "index-chosen")
    return materialise(postings(worded, chosen), "index-postings"), rare


@written("contamination-result")
def contamination(docs: DataFrame, items: DataFrame, width: int = 10, near: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_mark, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word is hit inside any occurrence of a phrase of ``width`` item words
    (all words of a shorter item). ``items_sha256`` is of the ids of items
    with occurring phrases, sorted as strings and joined by commas; a null
    item id has its phrases hit words but is not listed. ``n_near`` counts the
    items with a phrase that occurs or nearly does (:func:`near_phrases`);
    without ``near`` it is null. Null and empty texts have no words; empty
    items give no phrases; repeated rows repeat their result; a null doc_id
    is an id like any other. With no items, or no documents, nothing is hit.
    """
    phrases = materialise(test_phrases(items.select("item_id", "text"), width), "phrases")
    worded = word_table(docs)
    index, rare = build_index(worded, phrases)
    hits = materialise(phrase_matches(worded, index, rare), "phrase-hits")
    covered = (hits.select("doc_id", "text_mark", F.explode(F.sequence(
        F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
        .groupBy("doc_id", "text_mark").agg(F.count(F.lit(1)).alias("n_hit")))
    met = hits.select("doc_id", "text_mark", "phrase_id", F.lit(True).alias("exact"))
    if near:
        met = met.unionByName(near_phrases(worded, index, rare, phrases).withColumn("exact", F.lit(False)))
    found = (met.groupBy("doc_id", "text_mark", "phrase_id").agg(F.max("exact").alias("exact"))
             .join(phrases.select("phrase_id", F.col("item_id").cast("string").alias("item")), "phrase_id")
             .groupBy("doc_id", "text_mark").agg(F.collect_set(F.when(F.col("exact"), F.col("item"))).alias("items"),
                                                 F.count_distinct("item").alias("n_near")))
    both = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_mark") == F.col(f"{b}.text_mark"))
    per_text = materialise(found.alias("f").join(covered.alias("c"), both("f", "c"), "left").select(
        F.col("f.doc_id").alias("doc"), F.col("f.text_mark").alias("mark"), "n_hit", "items", "n_near"), "per-text")
    rows = worded.select("doc_id", "text_mark", F.size("words").cast("long").alias("n_words"))
    joined = rows.join(per_text, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_mark") == F.col("mark")), "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_near = F.coalesce("n_near", F.lit(0).cast("long")) if near else F.lit(None).cast("long")
    return joined.select("doc_id", "text_mark", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                         F.size(items_found).cast("long").alias("n_items"),
                         F.sha2(F.array_join(F.array_sort(items_found), ","), 256).alias("items_sha256"),
                         F.col("n_hit").isNotNull().alias("contaminated"), n_near.alias("n_near"))

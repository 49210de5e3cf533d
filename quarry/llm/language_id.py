"""Language identification by rank-order n-gram profiles.

A language's profile is the ranked list of its most frequent character
1- to 3-grams over all learned texts. A document's own list is compared with
each profile by the out-of-place distance: how far each n-gram is from its
place in the profile, or the length of the profile where it is missing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import ship_package
from .tables import held_out

UNDETERMINED = "und"
#: N-grams in a profile.
PROFILE = 400
#: Characters counted at once; longer texts are counted in pieces that overlap by two.
PIECE = 1 << 20
#: Distinct n-grams of a language that a task holds before it passes their counts on.
HELD = 1 << 20
_BASE = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(_BASE)])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _codes(points: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of code points in which 0 stands between words."""
    n = points[points > 0] + 2 * _BASE ** 3
    pair = points[:-1] * _BASE + points[1:]
    pair = pair[(points[:-1] > 0) | (points[1:] > 0)] + _BASE ** 3
    inner = points[1:-1] > 0
    return np.concatenate([n, pair, ((points[:-2] * _BASE + points[1:-1]) * _BASE + points[2:])[inner]])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending codes and counts of all 1- to 3-grams of letters, words padded by one blank."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    tail = np.zeros(1, np.int64)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        points[~_letters()[points]] = 0
        last = at + PIECE >= len(text)
        points = np.concatenate([tail, points, np.zeros(int(last), np.int64)])
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] > 0) | (points[:-1] > 0)
        points = points[keep]
        held.append(np.unique(_codes(points), return_counts=True))
        if not last:
            # what the next piece repeats to see n-grams across the cut is not counted twice
            tail = points[-2:]
            held.append(tuple(a * s for a, s in zip(np.unique(_codes(tail), return_counts=True), (1, -1))))
    if len(held) == 1:
        return held[0]
    return _merged(held)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    counts = np.zeros(len(codes), np.int64)
    np.add.at(counts, where, np.concatenate([n for _, n in parts]))
    return codes[counts > 0], counts[counts > 0]


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        codes, counts = _merged(held.pop(lang))
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            codes, counts = ngram_counts(text.as_py())
            key = lang.as_py()
            held.setdefault(key, []).append((codes, counts))
            sizes[key] = sizes.get(key, 0) + len(codes)
            if sizes[key] > HELD:
                held[key] = [_merged(held[key])]
                sizes[key] = len(held[key][0][0])
                if sizes[key] > HELD // 2:
                    yield out(key)
    for lang in list(held):
        yield out(lang)


@dataclass(frozen=True)
class Profiles:
    """Learned languages, ascending, and each known n-gram's rank in every profile."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        own = ranked(*ngram_counts(text), self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        place = self.ranks[at[known]]
        # an n-gram that a profile lacks is as far away as can be, whether another has it or not
        away = np.where(place < self.size, np.abs(place - np.flatnonzero(known)[:, None]), self.size).sum(axis=0)
        distance = away + self.size * int((~known).sum())
        best = int(distance.argmin())
        return self.languages[best], float(1.0 - distance[best] / (self.size * len(own)))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of all non-null languages from all rows of ``docs``.

    Counts are made in the tasks, summed by Spark and cut to ``size`` n-grams
    for each language before they leave the executors: what the driver holds
    is bounded by the number of languages. Languages without a letter in any
    text are not learned.
    """
    ship_package(docs.sparkSession)
    learned = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = (learned.mapInArrow(_count_by_language, "lang string, gram bigint, n bigint")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = W.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    rows = top.select("lang", "gram", "rank").collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(grams), len(languages)), size, np.int64)
    if rows:
        ranks[np.searchsorted(grams, [r["gram"] for r in rows]),
              [languages.index(r["lang"]) for r in rows]] = [r["rank"] - 1 for r in rows]
    return Profiles(languages, grams, ranks, size)


_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def with_prediction(docs: DataFrame, profiles: Profiles, column: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``column`` of ``lang_pred`` and ``score`` (see ``predict_languages``); all others stay."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [model.value.predict(t.as_py()) for t in column]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["lang_pred", "score"])

    return docs.withColumn(column, F.arrow_udf(predict, _RESULT)(F.col(text)))


def predict_languages(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1: every n-gram in its place) of each whole text.

    A text that is null or has no letter, and every text if no language was
    learned, gets ``und`` and 0. Equally distant languages: the first by
    name. Repeated rows repeat their result; columns of these two names are
    replaced and all others stay.
    """
    got = with_prediction(docs, profiles, "__found", text)
    return (got.withColumn("lang_pred", F.col("__found.lang_pred")).withColumn("score", F.col("__found.score"))
            .drop("__found"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows not held out, predicted for all.

    One row per row of ``docs``. Null texts and texts without a letter get
    ``und`` and 0, long ones are read whole, ties go to the first language by
    name, repeated rows repeat their result and count each when learning.
    Ids are only passed on (a null id is not held out), columns other than
    doc_id, text and lang not read; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = learn_profiles(rows.filter(~F.col("held_out")))
    return predict_languages(rows.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")

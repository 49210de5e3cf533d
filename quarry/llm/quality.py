"""Quality: a weak-label model over heuristic labellers trains a hashed linear scorer.

Each labeller votes good (1), bad (0) or nothing (-1) on a text. The counts of
all vote patterns, a table of bounded size, are what expectation-maximisation
needs to estimate each labeller's accuracy. The posterior of its pattern is a
document's label; a logistic scorer on hashed words learns these labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import ship_package
from .samples import bounded, lowest_ids, one_row_each
from .tables import WORD, held_out, text_or_empty
from .toxicity import BUCKETS, word_ids

#: Ids learned from at most, by a hash of the id, and words of such a document at most (together: samples.TOTAL_WORDS).
SAMPLE, SAMPLE_WORDS = 4_000, 20_000
ROUNDS, EPOCHS, RATE = 50, 5, 0.5


def votes(text: Column) -> list[Column]:
    """The labellers' votes; the number of patterns is 3 to their number."""
    words, length = F.regexp_count(text, F.lit(WORD)), F.greatest(F.char_length(text), F.lit(1))
    letters = F.regexp_count(text, F.lit(r"\p{L}")) / length
    digits = F.regexp_count(text, F.lit("[0-9]")) / length
    odd = F.regexp_count(text, F.lit(r"[|<>{}#=~\\_]")) / length
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    fresh = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    ends = F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")) / F.greatest(words, F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, 0).otherwise(-1)

    return [vote(words >= 100, words < 20), vote(letters > 0.75, letters < 0.6), vote(digits < 0.02, digits > 0.1),
            vote(odd < 0.002, odd > 0.01), vote(fresh > 0.95, fresh < 0.7), vote(ends.between(0.02, 0.3), ends < 0.005)]


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "good" for each vote pattern, and the accuracies (class, labeller), by EM from the majority."""
    cast, good = patterns >= 0, patterns == 1
    post = (good.sum(axis=1) + 0.5) / (cast.sum(axis=1) + 1.0)
    accuracy = np.full((2, patterns.shape[1]), 0.5)
    for _ in range(ROUNDS):
        prior = (counts @ post + 1.0) / (counts.sum() + 2.0)
        for c, weight in ((0, counts * (1 - post)), (1, counts * post)):
            right = good if c else cast & ~good
            accuracy[c] = (weight @ right + 2.0) / (weight @ cast + 3.0)
        like = [np.where(cast, np.where(good == bool(c), np.log(accuracy[c]), np.log(1 - accuracy[c])), 0).sum(axis=1)
                for c in (0, 1)]
        odds = np.log(prior / (1 - prior)) + like[1] - like[0]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, accuracy


def _means(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(row, weights=values, minlength=len(counts)) / np.maximum(np.sqrt(counts), 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, ids = word_ids(batch.column(1))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(ids[:, 0], pa.int32()))], ["post", "ids"])


def _train(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    weight = np.zeros(BUCKETS + 2)
    order = np.random.default_rng(3)
    # both classes weigh the same
    share = np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98)
    scale = 0.5 * (y / share + (1 - y) / (1 - share))
    for epoch in range(EPOCHS):
        for i in order.permutation(len(rows)):
            norm = max(np.sqrt(len(rows[i])), 1.0)
            z = weight[rows[i]].sum() / norm + weight[-1]
            step = RATE / (1 + epoch) * min(scale[i], 10.0) * (y[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            np.add.at(weight, rows[i], step / norm)
            weight[-1] += 0.1 * step
    return weight


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, weak_label (the posterior), score, good (score >= 0.5).

    Votes and their counts are of all documents. The scorer learns from at
    most ``SAMPLE`` ids that are not held out, one text of each. Null and empty texts get
    the votes of an empty text and the score of a text without words;
    repeated rows repeat their result; other columns are not read; an empty
    table gives no rows.
    """
    ship_package(docs.sparkSession)
    text = text_or_empty()
    said = F.concat_ws(",", *[v.cast("string") for v in votes(F.col("text"))]).alias("votes")
    rows = docs.select("doc_id", text.alias("text"))
    voted = rows.select("doc_id", "text", said)
    seen = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    patterns = np.array([[int(v) for v in r["votes"].split(",")] for r in seen] or np.zeros((0, 6)))
    post, _ = estimate(patterns, np.array([r["n"] for r in seen], float)) if len(seen) else (np.zeros(0), None)
    # at most 3^6 rows
    known = docs.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(seen, post)], "votes string, post double")
    learned = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id")
    chosen = lowest_ids(learned, SAMPLE, learned.agg(F.approx_count_distinct("doc_id").alias("n")).first()["n"])
    # votes of the chosen documents only: sorting them would run the votes of all twice more
    sample = (one_row_each(rows.join(F.broadcast(chosen), "doc_id"), ["text"]).select("text", said)
              .join(F.broadcast(known), "votes").select("post", "text"))
    got = bounded(sample.mapInArrow(_features, "post double, ids array<int>"), SAMPLE_WORDS, order=("post",))
    ids = got["ids"].combine_chunks()
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    model = docs.sparkSession.sparkContext.broadcast(
        _train([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], got["post"].to_numpy()))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = [np.zeros(0)]
            for a in range(0, len(column), 1024):
                counts, word = word_ids(column[a:a + 1024])
                z = _means(counts, model.value[word[:, 0]]) + model.value[-1]
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.array(np.concatenate(out), pa.float64())

    scored = voted.join(F.broadcast(known), "votes").withColumn("score", F.arrow_udf(score, DoubleType())(F.col("text")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("post").alias("weak_label"), "score",
                         (F.col("score") >= 0.5).alias("good"))

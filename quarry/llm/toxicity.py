"""Toxicity: a convolutional text classifier trained in the tasks.

Words (lower-cased letters and digits) and their first bytes are hashed to
embeddings; filters of several widths run over a text, each keeps its largest
value, and a logistic layer scores these. All labelled rows that are not held
out are learned from: they are dealt out to shards, in each epoch every shard
learns from its rows with a copy of the weights, and the copies are averaged.
A fifth of the rows, by a hash, validates: scores are shifted so that the
decision with the best F1 score on these is at 0.3, and each language's own
best decision is kept as its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..operators.prefix import running_sum
from ..session import cut_lineage, ship_package
from . import wordhash
from .samples import likely, one_row_each
from .tables import held_out, materialise, written

#: The score from which a text is predicted toxic.
DECISION = 0.3
#: Labelled rows of a shard, about; one task learns from it.
SHARD_ROWS = 10_000
BUCKETS, PREFIX_BUCKETS, PREFIX_BYTES = 1 << 15, 1 << 13, 4
WIDTH, FILTERS, FILTER_WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 5, 32, 0.01, 1e-4
#: Rows from which a fifth only validates; of fewer, all do both.
VALIDATED_ROWS = 100
#: Validation rows of a language and class from which it gets a threshold of its own.
LANGUAGE_ROWS = 20
#: Averaged weights are sums of whole numbers, so that their order does not matter.
UNIT = float(1 << 32)
_LOWER = wordhash.ascii_lower_table()
#: Words scored at once.
SCORED_WORDS = 1 << 19


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per row, and two embedding rows for each word (its own bucket and its prefix's)."""
    data, offsets = wordhash.buffers(column)
    counts, (whole, start) = wordhash.words(data, offsets, wordhash.ALPHANUMERIC, _LOWER, PREFIX_BYTES)
    ids = np.stack([1 + (whole % np.uint64(BUCKETS)).astype(np.int32),
                    1 + BUCKETS + (start % np.uint64(PREFIX_BUCKETS)).astype(np.int32)], axis=1)
    return counts, ids.astype(np.int32)


def _padded(counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in one array, each text followed by blanks (embedding 0), with its first place and end."""
    # one blank more than a filter spans, so that the last text may be without words too
    gap = max(FILTER_WIDTHS) + 1
    starts = np.concatenate([[0], np.cumsum(counts + gap)[:-1]]).astype(np.int64)
    out = np.zeros((int((counts + gap).sum()), 2), np.int32)
    inside = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
    out[inside] = ids
    return out, starts, starts + counts


def _groups(counts: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Texts ``first`` to ``last`` of up to ``SCORED_WORDS`` words together, or one longer text, with their words."""
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SCORED_WORDS, side="right")))
        yield first, last, ids[done:int(ends[last - 1])]
        first = last


@dataclass
class Model:
    """Weights; ``score`` gives the probability-like score of each text."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    offset: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: bool = False):
        x = self.table[words[:, 0]] + self.table[words[:, 1]]
        edges = np.stack([starts, np.maximum(ends, starts + 1)], axis=1).reshape(-1)
        tops, at = [], []
        for w in FILTER_WIDTHS:
            n = len(x) - w + 1
            y = x[:n] @ self.filters[w][0]
            for j in range(1, w):
                y += x[j:n + j] @ self.filters[w][j]
            top = np.maximum.reduceat(y, edges, axis=0)[::2]
            tops.append(np.maximum(top + self.bias[w], 0.0))
            if places:
                at.append(np.stack([s + y[s:max(e, s + 1)].argmax(axis=0) for s, e in zip(starts, ends)]))
        return x, np.concatenate(tops, axis=1), at

    def logits(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(counts))
        for first, last, part in _groups(counts, ids):
            top = self._pieces(part) if len(part) > SCORED_WORDS else self.pooled(*_padded(counts[first:last], part))[1]
            out[first:last] = top @ self.dense + self.offset[0]
        return out

    def _pieces(self, ids: np.ndarray) -> np.ndarray:
        """The pooled values of one long text, from pieces in which every window starts once."""
        top = None
        for a in range(0, len(ids), SCORED_WORDS):
            part = ids[a:a + SCORED_WORDS + max(FILTER_WIDTHS) - 1]
            padded, starts, _ = _padded(np.array([len(part)]), part)
            here = self.pooled(padded, starts, np.array([min(SCORED_WORDS, len(part))]))[1]
            top = here if top is None else np.maximum(top, here)
        return top

    def winners(self, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The pooled values, and for each width the words (n, filter, place, 2) of the windows that gave them."""
        tops, windows = [], []
        for first, last, part in _groups(counts, ids):
            top = None
            # a long text is taken in pieces in which every window starts once
            for a in range(0, max(len(part), 1), SCORED_WORDS):
                if len(part) > SCORED_WORDS:
                    piece = part[a:a + SCORED_WORDS + max(FILTER_WIDTHS) - 1]
                    words, starts, _ = _padded(np.array([len(piece)]), piece)
                    ends = np.array([min(SCORED_WORDS, len(part) - a)])
                else:
                    words, starts, ends = _padded(counts[first:last], part)
                _, here, at = self.pooled(words, starts, ends, places=True)
                won = [words[at[k][:, :, None] + np.arange(w)] for k, w in enumerate(FILTER_WIDTHS)]
                if top is None:
                    top, held = here, won
                    continue
                for k in range(len(won)):
                    more = (here > top)[:, k * FILTERS:(k + 1) * FILTERS]
                    held[k][more] = won[k][more]
                top = np.maximum(top, here)
            tops.append(top)
            windows.append(held)
        return np.concatenate(tops), [np.concatenate(w) for w in zip(*windows)]

    def values(self) -> dict[str, np.ndarray]:
        """What is learned, without the table."""
        return {"dense": self.dense, "offset": self.offset,
                **{f"f{w}": self.filters[w] for w in FILTER_WIDTHS}, **{f"b{w}": self.bias[w] for w in FILTER_WIDTHS}}

    def matrix(self) -> np.ndarray:
        """All that is learned in rows of ``WIDTH`` numbers: the table, then the other values."""
        flat = np.concatenate([v.reshape(-1) for v in self.values().values()])
        return np.concatenate([self.table, np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)])

    def with_matrix(self, matrix: np.ndarray) -> Model:
        """A new model of the numbers of ``matrix``."""
        flat = matrix[len(self.table):].reshape(-1)
        out, at = {}, 0
        for k, v in self.values().items():
            out[k] = flat[at:at + v.size].reshape(v.shape).copy()
            at += v.size
        return Model(matrix[:len(self.table)].copy(), {w: out[f"f{w}"] for w in FILTER_WIDTHS},
                     {w: out[f"b{w}"] for w in FILTER_WIDTHS}, out["dense"], out["offset"])

    def score(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(counts, ids) + self.shift, -30, 30)))


@dataclass
class LearningRows:
    """Labelled rows ``(shard, label, lang, ids)``; each partition is one shard."""

    fitted: DataFrame
    checks: DataFrame
    rows: int

    def __len__(self) -> int:
        return self.rows


def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The two embedding rows of each word in one number."""
    for column in batches:
        counts, ids = word_ids(column)
        words = (ids[:, 0] - 1) | (ids[:, 1] - 1 - BUCKETS) * BUCKETS
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        yield pa.ListArray.from_arrays(offsets, pa.array(words, pa.int32()))


class _Texts:
    """Labels and words of an Arrow batch of learning rows."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("ids")
        self.words = column.values.to_numpy(zero_copy_only=False)
        self.offsets = column.offsets.to_numpy().astype(np.int64)
        self.labels = batch.column("label").to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.labels)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words per text and their embedding rows, as ``word_ids`` gives them."""
        counts = self.offsets[rows + 1] - self.offsets[rows]
        words = np.concatenate([self.words[self.offsets[i]:self.offsets[i + 1]] for i in rows])
        return counts, np.stack([1 + words % BUCKETS, 1 + BUCKETS + words // BUCKETS], axis=1)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and bucket the number of texts that hold it."""
    seen = np.zeros((2, 1 + BUCKETS + PREFIX_BUCKETS), np.int64)
    for batch in batches:
        texts = _Texts(batch)
        for i in range(len(texts)):
            seen[texts.labels[i], np.unique(texts.of(np.array([i]))[1])] += 1
    label, bucket = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(bucket, pa.int32()),
                                      pa.array(seen[label, bucket], pa.int64())], ["label", "bucket", "n"])


def _log_odds(rows: DataFrame, sizes: np.ndarray) -> np.ndarray:
    """For each bucket the shrunk log odds of texts that hold it, where a class holds it clearly more often."""
    held = (rows.mapInArrow(_holders, "label int, bucket int, n long").groupBy("label", "bucket")
            .agg(F.sum("n").alias("n")).toArrow())  # two rows a bucket at most
    seen = np.zeros((2, 1 + BUCKETS + PREFIX_BUCKETS))
    seen[held["label"].to_numpy(), held["bucket"].to_numpy()] = held["n"].to_numpy()
    n = sizes + 1.0
    share = n[1] / n.sum()
    prior = 4.0
    p = (seen[1] + prior * share) / (seen.sum(axis=0) + prior)
    return np.clip(np.log(p / (1 - p)) - np.log(share / (1 - share)), -3, 3)


class _Learner:
    """A copy of the weights that learns from the texts of one shard."""

    def __init__(self, model: Model, weight: np.ndarray, rng: np.random.Generator):
        self.model, self.weight, self.rng = model, weight, rng
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in {**model.values(), "table": model.table}.items()}
        self.step, self.touched = 0, np.zeros(len(model.table), np.int64)

    def learn(self, counts: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        model = self.model
        top, windows = model.winners(counts, ids)
        keep = self.rng.random(top.shape) > 0.2
        z = (top * keep / 0.8) @ model.dense + model.offset[0]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * self.weight[y] / len(y)
        grads = {"dense": (top * keep / 0.8).T @ error + DECAY * model.dense, "offset": np.array([error.sum()])}
        back = error[:, None] * model.dense[None, :] * keep / 0.8 * (top > 0)
        rows_at, values_at = [], []
        for k, w in enumerate(FILTER_WIDTHS):
            g, words = back[:, k * FILTERS:(k + 1) * FILTERS], windows[k]
            grads[f"b{w}"] = g.sum(axis=0)
            grads[f"f{w}"] = np.empty_like(model.filters[w])
            for j in range(w):
                x = model.table[words[:, :, j, 0]] + model.table[words[:, :, j, 1]]
                grads[f"f{w}"][j] = np.einsum("nf,nfd->df", g, x) + DECAY * model.filters[w][j]
                # the two embeddings of a word share its gradient
                share = g[:, :, None] * model.filters[w][j].T[None]
                for side in (0, 1):
                    rows_at.append(words[:, :, j, side].reshape(-1))
                    values_at.append(share.reshape(-1, WIDTH))
        self.step += 1
        values = model.values()
        for k, g in grads.items():
            _adam(values[k], self.moments[k], g, self.step, slice(None))
        touched, where = np.unique(np.concatenate(rows_at), return_inverse=True)
        parts = np.concatenate(values_at)
        g = np.stack([np.bincount(where, parts[:, d], len(touched)) for d in range(WIDTH)], axis=1)
        g[touched == 0] = 0.0
        _adam(model.table, self.moments["table"], g, self.step, touched)
        self.touched[touched] += 1


def _epoch(shared, weight: np.ndarray, seed: int, epoch: int):
    """Each shard learns from its rows once; the changed weights leave, times the steps that changed them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        for batch in batches:
            if not len(batch):
                continue
            if learner is None:
                model = shared.value.with_matrix(shared.value.matrix())
                learner = _Learner(model, weight, np.random.default_rng([seed, epoch, batch.column("shard")[0].as_py()]))
            texts = _Texts(batch)
            order = learner.rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                part = order[a:a + BATCH]
                learner.learn(*texts.of(part), texts.labels[part])
        if learner is not None:
            matrix = learner.model.matrix()
            steps = np.concatenate([learner.touched, np.full(len(matrix) - len(learner.touched), learner.step)])
            rows = np.flatnonzero(steps)
            sums = np.rint(matrix[rows] * steps[rows, None] * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(steps[rows], pa.int64()),
                                              *(pa.array(sums[:, d], pa.int64()) for d in range(WIDTH))],
                                             ["row", "steps", *(f"v{d}" for d in range(WIDTH))])
    return run


def _averaged(model: Model, rows: DataFrame, weight: np.ndarray, seed: int, epoch: int) -> Model:
    """The model after an epoch: the mean of the shards' weights, each by the steps that changed it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    columns = ["steps", *(f"v{d}" for d in range(WIDTH))]
    learned = rows.mapInArrow(_epoch(shared, weight, seed, epoch), "row int, " + ", ".join(f"{c} long" for c in columns))
    # a row for each row of the matrix
    got = learned.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    shared.unpersist()
    matrix = model.matrix()
    steps = got["steps"].to_numpy()
    matrix[got["row"].to_numpy()] = np.stack([got[c].to_numpy() / steps for c in columns[1:]], axis=1) / UNIT
    return model.with_matrix(matrix)


def _checked(model: Model, checks: DataFrame) -> DataFrame:
    """``(lang, label, z)`` of the validation rows, written."""
    shared = checks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _Texts(batch)
            z = [shared.value.logits(*texts.of(np.arange(a, min(a + 2048, len(texts))))) for a in range(0, len(texts), 2048)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"),
                                              pa.array(np.concatenate([*z, np.zeros(0)]), pa.float64())], ["lang", "label", "z"])

    return materialise(checks.mapInArrow(run, "lang string, label int, z double"), "validated")


def best_decisions(scored: DataFrame) -> dict[str, float]:
    """For each ``grp`` of ``(grp, label, z)`` the value half-way between neighbouring ``z`` from which on predicting 1 has
    the best F1 score, the highest of equally good ones."""
    each = scored.groupBy("grp", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    falling = [F.col("z").desc()]
    ranked = running_sum(running_sum(each, ["grp"], falling, "n", "predicted"), ["grp"], falling, "hits", "found")
    ranked = materialise(ranked.select("grp", "z", "predicted", "found"), "decisions")
    total = ranked.groupBy("grp").agg(F.max("found").alias("total"))
    f1 = 2 * F.col("found") / (F.col("predicted") + F.greatest("total", F.lit(1)))
    best = ranked.join(total, "grp").groupBy("grp").agg(F.max(F.struct(f1.alias("f1"), "z"))["z"].alias("best"))
    below = F.max(F.when(F.col("z") < F.col("best"), F.col("z")))
    rows = ranked.join(best, "grp").groupBy("grp", "best").agg(below.alias("below")).collect()
    return {r.grp: (r.best + (r.best - 1.0 if r.below is None else r.below)) / 2 for r in rows}


def train(rows: LearningRows, sizes: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """A model of all ``rows``, of whose fitted ones ``sizes`` are of class 0 and 1; ``languages`` get thresholds of their own."""
    rng = np.random.default_rng(seed)
    size = 1 + BUCKETS + PREFIX_BUCKETS
    model = Model(rng.normal(0, 0.05, (size, WIDTH)),
                  {w: rng.normal(0, 0.3, (w, WIDTH, FILTERS)) for w in FILTER_WIDTHS},
                  {w: np.zeros(FILTERS) for w in FILTER_WIDTHS},
                  rng.normal(0, 0.1, FILTERS * len(FILTER_WIDTHS)), np.zeros(1))
    if np.count_nonzero(sizes) < 2:
        # one class or none: a constant score on that class's side of the decision
        model.dense[:] = 0.0
        model.offset[0] = 3.0 if np.any(sizes[1:]) else -3.0
        return model
    # the first dimension starts as the buckets' log odds, read by the first filter of each width
    model.table[:, 0] = 0.5 * _log_odds(rows.fitted, sizes)
    model.table[0] = 0.0
    for w in FILTER_WIDTHS:
        model.filters[w][:, 0, 0] = 1.0 / w
        model.dense[FILTERS * FILTER_WIDTHS.index(w)] = 1.0
    weight = sizes.sum() / (2 * sizes)
    distance = F.when(F.col("label") == 1, F.col("z")).otherwise(-F.col("z"))
    loss = (F.when(F.col("label") == 1, float(weight[1])).otherwise(float(weight[0]))
            * (F.greatest(-distance, F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))))
    held, best, checked = np.inf, None, None
    for epoch in range(EPOCHS):
        model = _averaged(model, rows.fitted, weight, seed, epoch)
        seen = _checked(model, rows.checks)
        now = seen.agg(F.avg(loss)).first()[0]
        if best is None or now < held:
            held, best, checked = now, model, seen
    scored = checked.select(F.lit("").alias("grp"), "label", "z")
    if languages:
        scored = scored.unionByName(checked.filter(F.col("lang").isin(languages)).select(F.col("lang").alias("grp"), "label", "z"))
    decisions = best_decisions(scored)
    best.shift = float(np.log(DECISION / (1 - DECISION)) - decisions[""])
    for lang in languages:
        best.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(decisions[lang] + best.shift, -30, 30))))
    return best


def _adam(value, state, grad, step, at) -> None:
    m, v = state
    m[at] = 0.9 * m[at] + 0.1 * grad
    v[at] = 0.99 * v[at] + 0.01 * grad * grad
    value[at] -= RATE * (m[at] / (1 - 0.9 ** step)) / (np.sqrt(v[at] / (1 - 0.99 ** step)) + 1e-6)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model of all labelled rows that are not held out.

    Their word ids, of whole texts, are written in shards of about
    ``SHARD_ROWS`` rows by a hash of the id; only counts and weights, of a
    size that does not grow with the rows, reach the driver. A label that is
    null or neither 0 nor 1 is no label; of an id with several labels the
    largest counts, of one with several texts that with the lowest hash. Null
    and empty texts are learned from as texts without words.
    """
    ship_package(docs.sparkSession)
    known = materialise(labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
                        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), "labelled")
    n_known = known.count()
    shards = max(1, -(-n_known // SHARD_ROWS))
    rows = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & ~held_out())
    rows = likely(rows, known, n_known).join(known, "doc_id")
    mark = F.xxhash64("doc_id")
    rows = one_row_each(rows, ["doc_id", "lang", "label", "text"]).select(
        F.pmod(F.shiftrightunsigned(mark, 8), F.lit(shards)).cast("int").alias("shard"), mark.alias("mark"), "doc_id",
        "label", "lang", F.arrow_udf(_packed, ArrayType(IntegerType()))("text").alias("ids"))
    # a checkpoint keeps the partitions, so that every epoch reads a shard as one
    rows = cut_lineage(rows.repartitionById(shards, "shard").sortWithinPartitions("mark", "doc_id"))
    checks = F.pmod("mark", F.lit(5)) == 4
    seen = {(r.label, r.checks): r.n for r in rows.groupBy("label", checks.alias("checks")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(seen.values())
    if n < VALIDATED_ROWS or len(seen) < 4:
        learned, sizes = LearningRows(rows, rows, n), [sum(v for k, v in seen.items() if k[0] == c) for c in (0, 1)]
    else:
        learned, sizes = LearningRows(rows.filter(~checks), rows.filter(checks), n), [seen[c, False] for c in (0, 1)]
    clear = (learned.checks.filter("lang <> ''").groupBy("lang").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
             .filter(F.least("ones", "zeros") >= LANGUAGE_ROWS))
    languages = sorted(r.lang for r in clear.select("lang").collect())
    return train(learned, np.array(sizes, float), languages)


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of each whole text, from the text alone.

    Null and empty texts are scored as texts without words. Repeated rows
    repeat their score; a column ``score`` is replaced, all others stay.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            size = 2048
            yield pa.array(np.concatenate(
                [shared.value.score(*word_ids(column[a:a + size])) for a in range(0, len(column), size)]
                or [np.zeros(0)]), pa.float64())

    return docs.withColumn("score", F.arrow_udf(score, DoubleType())(F.col(text)))


def flag(scored: DataFrame, model: Model, lang: str = "lang") -> DataFrame:
    """``scored`` with its language's ``threshold`` (the general decision where none was calibrated) and ``flagged``."""
    threshold = F.lit(DECISION)
    for name, value in model.thresholds.items():
        threshold = F.when(F.col(lang) == name, F.lit(value)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= F.col("threshold"))


@written("toxicity")
def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged: learned from the rows not held out.

    One row per row of ``docs``. Null and empty texts are scored as texts
    without words, long ones whole; repeated rows repeat their score; ids are
    only passed on; columns other than doc_id, text and lang (for the
    threshold) are not read; an empty table gives no rows, and without
    labels, or with those of one class, every score is the same.
    """
    model = fit(docs, labels)
    scored = flag(score_texts(docs.select("doc_id", "lang", "text"), model), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= DECISION).cast("int").alias("predicted"), "threshold", "flagged")

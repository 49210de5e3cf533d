"""Learned operators against plain Python: profiles and distances, forward pass, expectation-maximisation, linear scorer."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import language_id, pii, quality, queries, samples, toxicity


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def grams(text):
    """1- to 3-grams of letters, each word with one blank around it, blanks shared between neighbours."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " " if words else ""
    out = Counter(c for c in line if c != " ")
    out.update(line[i:i + 2] for i in range(len(line) - 1))
    out.update(line[i:i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return out


def code(gram):
    points = [0 if c == " " else ord(c) for c in gram]
    base, n = 0x110000, 0
    for p in points:
        n = n * base + p
    return n + {1: 2 * base ** 3, 2: base ** 3, 3: 0}[len(gram)]


def profile(counted, size):
    return [g for g, _ in sorted(counted.items(), key=lambda e: (-e[1], code(e[0])))[:size]]


def test_languages_are_those_of_out_of_place_distances(spark):
    rng = random.Random(5)
    letters = {"one": "abcde é", "two": "cdefgß", "tie": "cdefgß", None: "xyz"}
    rows = [(i, None if i == 7 else prose(rng, letters[lang], rng.randrange(0, 60)) + rng.choice(["", " 12,3", " E\n"]), lang)
            for i, lang in enumerate(list(letters) * 30)]
    rows += rows[:9] + [(None, prose(rng, "abc", 9), "one"), (900, "1 2", "one"), (901, "", None), (902, None, "two")]
    learned = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            learned.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(profile(c, 400))} for lang, c in sorted(learned.items())}
    want = Counter()
    for i, text, _ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if not text or not any(c.isalpha() for c in text):
            want[i, held, "und", 0.0] += 1
            continue
        own = profile(grams(text), 400)
        away = {lang: sum(abs(p[g] - r) if g in p else 400 for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(away, key=lambda lang: (away[lang], lang))
        want[i, held, best, round(1 - away[best] / (400 * len(own)), 12)] += 1
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 12)) for r in language_id.identify(docs).collect())
    assert got == want and {k[2] for k in want} == {"one", "two", "tie", "und"}


def test_toxicity_scores_are_those_of_a_plain_forward_pass(spark):
    import pyarrow as pa
    rng = random.Random(2)
    texts = [prose(rng, "abcdef", rng.randrange(0, 40)) + (" vile" if i % 4 == 0 else "") for i in range(300)] + [None, "", " . "]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    for i, text in enumerate(texts):
        _, ids = toxicity.word_ids(pa.array([text], pa.string()))
        x = [[model.table[a][k] + model.table[b][k] for k in range(toxicity.WIDTH)] for a, b in ids]
        x += [[2 * v for v in model.table[0]]] * max(toxicity.FILTER_WIDTHS)
        pooled = []
        for w in toxicity.FILTER_WIDTHS:
            for f in range(toxicity.FILTERS):
                over = [sum(x[at + j][k] * model.filters[w][j][k][f] for j in range(w) for k in range(toxicity.WIDTH))
                        for at in range(max(len(ids), 1))]
                pooled.append(max(max(over) + model.bias[w][f], 0.0))
        z = sum(p * d for p, d in zip(pooled, model.dense)) + model.offset[0] + model.shift
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 2000)
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, *a: seen.append((rows, *a)) or train(rows, *a))
    docs = spark.range(12_000).selectExpr(
        "id AS doc_id", "IF(id % 2 = 0, 'en', 'fr') AS lang",
        "CASE WHEN id % 1000 = 5 THEN NULL WHEN id = 8 THEN repeat('word ', 20001) "
        "ELSE concat('own', id, ' some words ', IF(id % 5 = 0, 'vile', 'mild')) END AS text")
    labels = spark.range(11_000).selectExpr("id AS doc_id", "CAST(id % 5 = 0 AS INT) AS toxic")
    model = toxicity.fit(docs, labels)
    learned = [i for i in range(11_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows, sizes, languages = seen[0]
    assert len(rows) == len(learned) and languages == ["en", "fr"] == sorted(model.thresholds)
    all_rows = rows.fitted.unionByName(rows.checks).collect()
    assert len(all_rows) == len(learned) and sum(r.label for r in all_rows) == sum(i % 5 == 0 for i in learned)
    assert 0.15 * len(learned) < rows.checks.count() < 0.25 * len(learned) and sizes.sum() == rows.fitted.count()
    assert max(len(r.ids) for r in all_rows) == 20_001 and min(len(r.ids) for r in all_rows) == 0
    # a shard is one partition
    at = rows.fitted.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(at) == len({r.p for r in at}) == len({r.shard for r in at}) == -(-len(learned) // 2000)
    held = [r for r in toxicity.score_texts(docs, model).filter("doc_id >= 11000 AND text IS NOT NULL").collect()]
    assert all((r.score >= toxicity.DECISION) == (r.doc_id % 5 == 0) for r in held)


def test_averaged_weights_are_the_shards_means(spark):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=(1 + toxicity.BUCKETS + toxicity.PREFIX_BUCKETS, toxicity.WIDTH)),
                           {w: rng.normal(size=(w, toxicity.WIDTH, toxicity.FILTERS)) for w in toxicity.FILTER_WIDTHS},
                           {w: np.zeros(toxicity.FILTERS) for w in toxicity.FILTER_WIDTHS},
                           rng.normal(size=toxicity.FILTERS * len(toxicity.FILTER_WIDTHS)), np.zeros(1))
    rows = [(s, int(rng.random() < 0.3), None, rng.integers(0, 50, rng.integers(0, 9)).tolist()) for s in (0, 1, 1) for _ in range(80)]
    table = spark.createDataFrame(rows, "shard int, label int, lang string, ids array<int>").repartitionById(2, "shard").sortWithinPartitions("ids", "label")
    weight = np.array([0.7, 1.7])
    got = toxicity._averaged(model, table, weight, 7, 0).matrix()
    total, steps = np.zeros_like(got), np.zeros(len(got))
    for s in (0, 1):
        mine = sorted(((r[3], r[1]) for r in rows if r[0] == s))
        learner = toxicity._Learner(model.with_matrix(model.matrix()), weight, np.random.default_rng([7, 0, s]))
        order = learner.rng.permutation(len(mine))
        for a in range(0, len(mine), toxicity.BATCH):
            part = [mine[i] for i in order[a:a + toxicity.BATCH]]
            words = np.concatenate([np.array(p[0], int) for p in part])
            ids = np.stack([1 + words % toxicity.BUCKETS, 1 + toxicity.BUCKETS + words // toxicity.BUCKETS], axis=1)
            learner.learn(np.array([len(p[0]) for p in part]), ids, np.array([p[1] for p in part]))
        touched = np.concatenate([learner.touched, np.full(len(got) - len(learner.touched), learner.step)])
        total += touched[:, None] * learner.model.matrix()
        steps += touched
    want = np.where(steps[:, None] > 0, total / np.maximum(steps, 1)[:, None], model.matrix())
    assert np.allclose(got, want, atol=1e-8) and (steps == 0).any()


def test_best_decisions_are_those_of_all_cuts(spark):
    rng = random.Random(6)
    rows = [(g, int(rng.random() < p), float(rng.randrange(40))) for g, p in (("a", 0.3), ("b", 0.7), ("c", 0.0), ("d", 1.0)) for _ in range(90)]
    got = toxicity.best_decisions(spark.createDataFrame(rows, "grp string, label int, z double").repartition(5))
    for g in "abcd":
        mine = [(z, y) for h, y, z in rows if h == g]
        ones = max(sum(y for _, y in mine), 1)
        f1 = {c: 2 * sum(y for z, y in mine if z >= c) / (sum(z >= c for z, _ in mine) + ones) for c, _ in mine}
        best = max(f1, key=lambda c: (f1[c], c))
        assert got[g] == (best + max([z for z, _ in mine if z < best], default=best - 1)) / 2


def test_likely_rows_hold_all_of_the_ids(spark):
    rows = spark.range(-20_000, 20_000).selectExpr("id * 7919 AS doc_id", "'x' AS text")
    ids = rows.select("doc_id").filter("doc_id % 3 = 0")
    n = ids.count()
    got = samples.likely(rows, ids, n)
    assert got.columns == rows.columns and ids.join(got, "doc_id").count() == n
    assert got.filter("doc_id % 3 <> 0").count() < 2 * (40_000 - n) / samples.ID_BITS
    assert samples.likely(rows, ids.limit(0), 0).count() == 0


def test_expectation_maximisation_is_the_plain_one():
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.6
    votes = np.where(rng.random((3000, 4)) < [0.9, 0.8, 0.7, 0.6], truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, accuracy = quality.estimate(patterns, counts.astype(float))
    rows = votes.tolist()
    belief = [(sum(v == 1 for v in r) + 0.5) / (sum(v >= 0 for v in r) + 1) for r in rows]
    for _ in range(quality.ROUNDS):
        prior = (sum(belief) + 1) / (len(rows) + 2)
        right = [[0.0] * 4, [0.0] * 4]
        for c in (0, 1):
            for k in range(4):
                weight = [b if c else 1 - b for b, r in zip(belief, rows) if r[k] >= 0]
                hit = [b if c else 1 - b for b, r in zip(belief, rows) if r[k] == c]
                right[c][k] = (sum(hit) + 2) / (sum(weight) + 3)
        odds = [math.log(prior / (1 - prior)) + sum(
            math.log(right[1][k] if v else 1 - right[1][k]) - math.log(1 - right[0][k] if v else right[0][k])
            for k, v in enumerate(r) if v >= 0) for r in rows]
        belief = [1 / (1 + math.exp(-o)) for o in odds]
    assert np.allclose(accuracy, right)
    by_pattern = {tuple(p): b for p, b in zip(patterns.tolist(), post)}
    assert np.allclose([by_pattern[tuple(r)] for r in rows], belief)


def test_quality_scores_are_those_of_the_linear_model(spark, monkeypatch):
    import pyarrow as pa
    held = []
    train = quality._train
    monkeypatch.setattr(quality, "_train", lambda *a: held.append(train(*a)) or held[-1])
    rng = random.Random(3)
    texts = [prose(rng, "abcdef", rng.randrange(0, 200)) + ". " for _ in range(80)] + ["1 2 3 | " * 30, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality(docs).collect():
        counts, ids = toxicity.word_ids(pa.array([texts[r.doc_id]], pa.string()))
        z = sum(held[0][i] for i in ids[:, 0]) / max(math.sqrt(counts[0]), 1) + held[0][-1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_one_id_repeated_is_learned_from_once(spark, monkeypatch):
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, *a: seen.append(len(rows)) or train(rows, *a))
    scorer = quality._train
    monkeypatch.setattr(quality, "_train", lambda rows, *a: seen.append(len(rows)) or scorer(rows, *a))
    docs = spark.range(10_000).selectExpr("CASE WHEN id < 9900 THEN 1 ELSE id END AS doc_id", "'en' AS lang",
                                          "concat('some words of ', id % 50) AS text")
    labels = spark.range(10_000).selectExpr("CASE WHEN id < 9900 THEN 1 ELSE id END AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    assert toxicity.toxicity(docs, labels).count() == 10_000
    assert quality.quality(docs).count() == 10_000
    learned = [i for i in [1, *range(9900, 10_000)] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen == [len(learned), len(learned)]
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_samples_keep_the_lowest_hashes_and_a_bound_of_words(spark, monkeypatch):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    cut = {r.doc_id for r in samples.lowest_ids(ids, 500, 20_000).collect()}
    whole = {r.doc_id for r in ids.orderBy(samples._rank("doc_id"), "doc_id").limit(500).collect()}
    assert cut == whole
    rows = spark.range(100).selectExpr("transform(sequence(1, 10), x -> CAST(x * 1000 + id AS INT)) AS ids", "id AS label")
    monkeypatch.setattr(samples, "TOTAL_WORDS", 205)
    assert samples.bounded(rows, 20).num_rows == 20 and samples.bounded(rows, 5).num_rows == 0


def test_account_numbers_in_sql_are_those_of_the_library(spark):
    be, at, es, de = "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "DE89370400440532013000"
    texts = [f"to {be} BIC KREDBEBB", f"{at} EUR 20", f"x {es} CAIXESBB", f"{be} {at}", f"REF AB13 3456 7890 {be} OK", f"{de} BIC {es}",
             f"{be}, {be}", f"x{be} {be}x", "BE68 5390 0754 7035 BIC", f"é\U0001f600 {be}\n{at}", f"{de}{de} {de}.", None, "", "123-45-6789 ssn"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in pii.pii_report(docs).collect())
    assert got == sorted(con.execute(queries.ORACLES["op3_pii"]).fetchall())

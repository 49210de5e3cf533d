"""Operators against brute force, and nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import brute
from quarry.llm import (decontamination, exact_dedup, language_id, mixing, near_dedup, pii, quality, repeated_windows,
                        token_counts, toxicity)
from quarry.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, size long, score double, mark string, kept boolean"


def docs(spark, texts, ids=None):
    rows = [(i, t, "xx" if n % 2 else "yy", None if n % 3 == 0 else f"s{n % 3}", -1, -1.0, "m", False)
            for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t", "x", "é", "1234 +5", "\x00", "a" * 5000, "word " * 3000]


def edited(rng, text, n):
    out = text.split(" ")
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(out)


def near_texts():
    rng = random.Random(5)
    texts = list(ODD)
    for size in (6, 20, 80, 200):
        base = words(rng, size, 10 ** 4)
        texts += [base, base.upper(), base.replace(" ", "\n")]
        texts += [edited(rng, base, rng.randrange(max(1, size // 25) + 1)) for _ in range(25)]
        chain = base
        for _ in range(8):
            chain = edited(rng, chain, max(1, size // 40))
            texts.append(chain)
    return texts


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_all_pairs(spark, k, percent):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in
           near_dedup.near_duplicates(docs(spark, texts), k, percent).collect()}
    want = brute.near_components(list(enumerate(texts)), k, percent)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert any(c != i for i, (_, c) in want.items())


def test_near_duplicates_of_null_ids_and_repeated_rows(spark):
    same = "one two three four five six"
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(
        docs(spark, [same, same, same, same, None], [4, 4, None, 2, None])).collect())
    assert got == [("2", "2", True), ("4", "2", False), ("4", "2", False), ("None", "None", True), ("None", "None", True)]
    assert near_dedup.near_duplicates(docs(spark, ["x"]).limit(0)).collect() == []


def test_near_duplicates_of_one_id_with_different_texts(spark):
    rng = random.Random(6)
    a, b, c = (words(rng, 60, 10 ** 4) for _ in range(3))
    texts = [a, a + " end", b, c, c + " end", b.upper() + " tail"]
    got = near_dedup.near_duplicates(docs(spark, texts, [3, 5, 5, 7, 7, 9])).collect()
    by = {(r.doc_id, r.component_id): [x.kept for x in got if (x.doc_id, x.component_id) == (r.doc_id, r.component_id)] for r in got}
    assert {k: sorted(v) for k, v in by.items()} == {
        (3, 3): [True], (5, 3): [False], (5, 5): [True], (7, 7): [False, True], (9, 5): [False]}


def test_links_grow_with_the_family_not_with_its_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = words(rng, 60, 10 ** 4)
    confirmed = []
    plain = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda *a: confirmed.append(plain(*a)) or confirmed[-1])
    for n in (150, 300):
        texts = [edited(rng, base, rng.randrange(1, 4)) for _ in range(n)]
        confirmed.clear()
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates.__wrapped__(docs(spark, texts), 5, 80).collect()}
        want = brute.near_components(list(enumerate(texts)), 5, 80)
        assert got == {i: c for i, (_, c) in want.items()}
        assert sum(c.count() for c in confirmed) <= 2 * n


@pytest.mark.parametrize("block", [1 << 17, 50])
def test_comparison_by_blocks_finds_the_components_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rng = random.Random(9)
    texts = []
    for _ in range(3):
        at = words(rng, 30, 10 ** 4)
        for _ in range(12):
            at = edited(rng, at, 1)
            texts += [at, edited(rng, at, 2)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, texts), 3, 70).collect()}
    assert got == {i: c for i, (_, c) in brute.near_components(list(enumerate(texts)), 3, 70).items()}


def test_signatures_estimate_the_similarity():
    import numpy as np
    a, b = np.arange(1, 901, dtype=np.uint64), np.arange(101, 1001, dtype=np.uint64)
    from quarry.llm.wordhash import mix
    s = near_dedup.min_max_signature([mix(a), mix(b)], 500)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.05


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 49), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 49: 49, 50: 49}


@pytest.mark.parametrize("window, gram, run", [(40, 10, 1 << 19), (40, None, 1 << 19), (12, 3, 64)])
def test_repeated_windows_are_those_of_a_table_of_all(spark, monkeypatch, window, gram, run):
    monkeypatch.setattr(repeated_windows, "RUN", run)
    rng = random.Random(3)
    letters = lambda n, of="ab cdé": "".join(rng.choice(of) for _ in range(n))
    base = letters(300)
    texts = [*ODD[:7], base, base, base[:100] + "X" + base[101:], letters(40) + base[20:200] + letters(30), "a" * 200,
             "ab" * 60, base[-40:], base[:40], base[:39], *[letters(rng.randint(0, 200), "ab") for _ in range(40)],
             *["xy" + base[10:90] + "q" + base[100:160]] * 3]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           repeated_windows.repeated_windows(docs(spark, texts), window, gram).collect()}
    assert got == dict(enumerate(brute.repeated_bytes(texts, window)))


@pytest.mark.parametrize("words_, run", [(12, 1 << 19), (3, 64), (1, 1 << 19)])
def test_repeated_passages_are_those_of_a_table_of_all(spark, monkeypatch, words_, run):
    monkeypatch.setattr(repeated_windows, "RUN", run)
    rng = random.Random(5)
    base = words(rng, 60, 10 ** 4)
    texts = [*ODD, base, base, base.replace(" ", " \n"), words(rng, 20) + " " + " ".join(base.split()[10:30]) + " é", "x y " * 40,
             " ".join(base.split()[:12]), " ".join(base.split()[:11]), edited(rng, base, 4), *[words(rng, rng.randrange(30), 4) for _ in range(40)]]
    split = [brute.re.findall("[^ \\t-\\r]+", t or "") for t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - words_ + 1):
            seen[tuple(w[i:i + words_])] = seen.get(tuple(w[i:i + words_]), 0) + 1
    want = {}
    for d, w in enumerate(split):
        gone = [False] * len(w)
        for i in range(len(w) - words_ + 1):
            if seen[tuple(w[i:i + words_])] > 1:
                gone[i:i + words_] = [True] * words_
        want[d] = (sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)))
    rows = repeated_windows.repeated_windows(docs(spark, texts), 40, words=words_).collect()
    assert {r.doc_id: (r.n_passage_words, r.n_passages) for r in rows} == want
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(enumerate(brute.repeated_bytes(texts, 40)))


def test_repeated_windows_of_an_empty_table(spark):
    assert repeated_windows.repeated_windows(docs(spark, ["x"]).limit(0)).collect() == []


def test_exact_groups(spark):
    texts = ["a b", "ab", " a b", "a  b", None, "", "c", "c", "C"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark, texts)).collect()}
    assert got == {0: (2, 4, False), 1: (2, 4, False), 2: (2, 4, True), 3: (2, 4, False), 4: (4, 2, True), 5: (4, 2, False),
                   6: (6, 2, True), 7: (6, 2, False), 8: (8, 1, True)}


def test_exact_groups_keep_one_of_repeated_rows_and_split_large_groups(spark):
    texts, ids = ["same text"] * 400 + ["same  text", None, "", "z"], [*range(399), 5, 1000, None, None, None]
    rows = exact_dedup.exact_groups(docs(spark, texts, ids)).collect()
    assert sum(r.kept for r in rows) == 3
    assert [(r.doc_id, r.group_size) for r in rows if r.kept and r.doc_id is not None] == [(1000, 401)]
    assert exact_dedup.exact_groups(docs(spark, ["x"]).limit(0)).collect() == []


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    texts = [*ODD, "x<|endoftext|> y <|endoftext|>", "a  b", "it's 's  's", "tab\t x", "\n\n a b\n", "日本 語 ", "a\x1c b \x1cc",
             "a\x85 b", ("word\n" * 30000) + " z", "a" * 70000 + " b", " lead", "1 2 ,, ,a"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts)}
    got = token_counts.count_tokens(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) and r.mark == "m" for r in got)
    assert token_counts.count_tokens(docs(spark, ["x"]).limit(0)).collect() == []


def test_pii_spans(spark):
    text = ("é mail a@b.co_c@d.ef, 1.2.3.4.5.6.7.300 +1 (743) 555-3824 card 4111 1111 1111 1111 "
            "my iban DE89 3704 0044 0532 0130 00; ssn 123-45-6789 and 987-65-4321x")
    got = pii.find_spans(docs(spark, [text, text, None, "", "7" * 200_000, "+" * 1000], [1, 1, 2, None, 3, 4])).collect()
    for r in got:
        assert text[r.start:r.end] == r.value
    assert sorted((r.kind, r.value) for r in got) == [
        ("card", "4111 1111 1111 1111"), ("email", "_c@d.ef"), ("email", "a@b.co"), ("iban", "DE89 3704 0044 0532 0130 00"),
        ("ip", "1.2.3.4"), ("phone", "+1 (743) 555-3824"), ("ssn", "123-45-6789")]
    report = pii.pii_report(docs(spark, [text, text, None], [1, 1, None])).collect()
    assert len(report) == 3
    empty = [r for r in report if r.doc_id is None][0]
    assert empty.spans == "" and empty.n_email == 0 and empty.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_account_numbers_before_other_words_in_capitals(spark):
    be, at, es, de = "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "DE89370400440532013000"
    cases = [(f"to {be} BIC KREDBEBB", [be]), (f"{at} EUR 20", [at]), (f"x {es} CAIXESBB", [es]), (f"{be} {at}", [be, at]),
             (f"REF AB13 3456 7890 {be} OK", [be]), (f"{de} BIC {es}", [de, es]), (f"{be}, {be}", [be, be]),
             (f"x{be} {be}x", []), ("BE68 5390 0754 7035 BIC", []), (f"é\U0001f600 {be}\n{at}", [be, at])]
    got = pii.find_spans(docs(spark, [t for t, _ in cases])).filter("kind = 'iban'").collect()
    for r in got:
        assert cases[r.doc_id][0][r.start:r.end] == r.value
    found = sorted((r.doc_id, r.start, r.value) for r in got)
    assert [[v for i, _, v in found if i == n] for n in range(len(cases))] == [want for _, want in cases]


def test_language_profiles(spark):
    rng = random.Random(1)
    say = lambda of, n: " ".join("".join(rng.choice(of) for _ in range(5)) for _ in range(n))
    rows = [(i, say("abcdef" if i % 2 else "uvwxyz", 30), "one" if i % 2 else "two") for i in range(60)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(learned)
    got = language_id.predict_languages(docs(spark, [*ODD, "fade bead", "wux zyv"]), profiles).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (0, 1, 2, 5, 6)] == ["und"] * 5 and by[len(ODD)] == "one" and by[len(ODD) + 1] == "two"
    assert all(0 <= r.score <= 1 for r in got)
    none = language_id.learn_profiles(learned.limit(0))
    assert {r.lang_pred for r in language_id.predict_languages(learned, none).collect()} == {"und"}


def test_ngrams_do_not_depend_on_the_piece(monkeypatch):
    text = "Ab cde, é1fg  hij " * 20
    whole = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert all((a == b).all() for a, b in zip(whole, language_id.ngram_counts(text)))


def test_toxicity_learns_words_and_scores_odd_texts(spark):
    rng = random.Random(2)
    texts = [words(rng, 40) + (" vile" if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, texts), labels)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs(spark, [*ODD, "so vile", "w1 w2"]), model).collect()}
    assert got[len(ODD)] >= toxicity.DECISION > got[len(ODD) + 1]
    assert all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    none = toxicity.toxicity(docs(spark, ["x"]), labels.limit(0)).collect()
    assert [r.predicted for r in none] == [0]


def test_long_texts_score_as_whole_ones(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(0)
    model = toxicity.train([], np.zeros(0), [])
    model.dense[:] = 1.0
    ids = rng.integers(1, 100, (1000, 2)).astype(np.int32)
    whole = model.logits(np.array([1000]), ids)
    monkeypatch.setattr(toxicity, "SCORED_WORDS", 64)
    assert np.allclose(whole, model.logits(np.array([1000]), ids))


def test_mixing_targets_and_taken_words(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(300)] + [None, "", "x"]
    rows = mixing.mix_sources(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    total = sum(r.size for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target) <= 3 * mine[0].source_size
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-6 * total
    assert all(r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.passes) for r in rows)
    order = mixing.training_order(mixing.mix_sources(docs(spark, texts))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and 0 <= order[0].position <= order[-1].position <= 1
    assert mixing.mix_sources(docs(spark, ["x"]).limit(0)).collect() == []
    assert [r.taken for r in mixing.mix_sources(docs(spark, [None, ""])).collect()] == [0, 0]


def test_targets_reshare_the_excess(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 20), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(totals).collect()}
    assert got == {"a": 940.0, "b": 30.0, "c": 60.0, None: 0.0}


def test_contamination(spark):
    item = " ".join(f"t{i}" for i in range(14))
    texts = [f"x {item} y", item.upper(), "t1 t2 t3 t4 t5 t6 t7 t8 t9", "a short one", "short", None, "", item]
    items = spark.createDataFrame([(1, item), (10, item), (2, "Short  ONE"), (3, None), (4, ""), (None, "a")],
                                  "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, 0]), items).collect()
            if r.doc_id}
    assert [(rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].contaminated) for i in range(1, 7)] == [
        (14, 14, 2, True), (9, 0, 0, False), (3, 3, 1, True), (1, 0, 0, False), (0, 0, 0, False), (0, 0, 0, False)]
    assert rows[1].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert not any(r.contaminated for r in decontamination.contamination(docs(spark, texts), items.limit(0)).collect())


def near_items(texts, items, span=20, percent=80, width=10):
    """Items nearly in each text, by looking at every place of every phrase's rarest word."""
    split = lambda t: brute.re.findall("[a-z0-9\\x80-\\U0010ffff]+", brute.re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [split(t) for t in texts]
    n = {}
    for w in words:
        for t in w:
            n[t] = n.get(t, 0) + 1
    out = [set() for _ in texts]
    for item, text in items:
        w = split(text)
        for s in range(max(len(w) - width + 1, 1) if w else 0):
            phrase = w[s:s + width]
            known = sorted((n[t], t, k) for k, t in enumerate(phrase) if t in n)
            for held, own in zip(out, words):
                at = {i for i in range(len(own)) if own[i:i + len(phrase)] == phrase}
                if at and item is not None:
                    held.add(item)
                if len(known) < 2 or known[0][1] == known[1][1]:
                    continue
                for pos in (i for i, t in enumerate(own) if t == known[0][1]):
                    first = max(pos - span, 0)
                    if known[1][1] in own[first:pos + span + 1] and item is not None and \
                            100 * len(set(phrase) & set(own[first:first + 2 * span + 1])) >= percent * len(set(phrase)):
                        held.add(item)
    return [len(x) for x in out]


def test_proximity_is_that_of_every_place(spark):
    rng = random.Random(7)
    base = [f"t{i}" for i in range(40)]
    items = [(1, " ".join(base[:14])), (2, " ".join(base[10:30])), (3, "alpha beta"), (4, "gamma"), (5, None), (6, "unseen " + " ".join(base[30:])),
             (None, " ".join(base[5:16]))]
    texts = [None, "", " ".join(base[:14]), " ".join(reversed(base[:14])), "alpha x x beta", "beta " + "x " * 30 + "alpha", "gamma gamma"]
    for _ in range(40):
        at, size = rng.randrange(30), rng.randrange(6, 14)
        some = [t if rng.random() < 0.85 else f"z{rng.randrange(9)}" for t in base[at:at + size]]
        if rng.random() < 0.5:
            rng.shuffle(some)
        texts.append(words(rng, rng.randrange(30)) + " " + " ".join(some).upper() + " " + words(rng, rng.randrange(30)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.n_near for r in decontamination.contamination(docs(spark, texts), table).collect()}
    want = near_items(texts, items)
    assert got == dict(enumerate(want)) and sum(want) > 5
    exact = decontamination.contamination(docs(spark, texts), table, near=False).collect()
    assert {r.n_near for r in exact} == {None} and any(r.contaminated for r in exact)


def test_contamination_of_long_texts_and_empty_tables(spark):
    item = " ".join(f"t{i}" for i in range(12))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = "word " * 60_000 + item + " word" * 60_000
    rows = sorted((r.n_words, r.n_hit, r.n_near) for r in decontamination.contamination(docs(spark, [long, item, "x"], [0, 0, 0]), items).collect())
    assert rows == [(1, 0, 0), (12, 12, 1), (120_012, 12, 1)]
    assert decontamination.contamination(docs(spark, ["x"]).limit(0), items).collect() == []


def test_language_learning_rows_are_not_held_out(spark):
    got = language_id.identify(docs(spark, ["abc def"] * 12)).select("doc_id", "held_out").collect()
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert F.col("x") is not None


def test_weak_labels_and_quality_scores(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    right = np.array([0.9, 0.8, 0.6])
    votes = np.where(rng.random((4000, 3)) < right, truth[:, None], ~truth[:, None]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, accuracy = quality.estimate(patterns, counts.astype(float))
    assert accuracy.mean(axis=0).argmax() == 0 and accuracy.mean(axis=0).argmin() == 2
    got = quality.quality(docs(spark, [*ODD, "a fine text. " * 60])).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in got)
    assert quality.quality(docs(spark, ["x"]).limit(0)).collect() == []

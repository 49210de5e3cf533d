"""The pipeline's stages on odd rows."""

import corpus_pipeline as P


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    benchmark = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [" ".join(f"c{n}x{i}" for i in range(30)) for n in range(8)]
    near = clean[0] + " end"
    leak = "see " + " ".join(f"b{i}" for i in range(11))
    texts = [*clean, clean[1], clean[2].replace(" ", "  "), near, leak, None, "", "12 34", clean[3]]
    rows = [(n, t, "en", "a" if n % 2 else None, len(t or ""), n) for n, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here", "en", "a", 10, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, position long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        now = P.materialise(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    # of texts that differ in white space the longest stays, of near copies the smallest id
    assert sorted(str(r.doc_id) for r in now.collect()) == sorted(["0", "1", "9", "3", "4", "5", "6", "7", "None"])
    out = P.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sum(r.words for r in out) <= sum(len(r.text.split()) for r in now.collect())
    assert [r.position for r in out] == sorted(r.position for r in out)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_language_stage_without_languages_and_with_columns_of_its_names(spark, tmp_path):
    rows = [(1, "a text", None, 7.0, "mine"), (2, None, None, 8.0, "mine"), (3, "12 34", None, 9.0, None), (4, "é", None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = P.detect_language(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[3]]
    known = [(i, t, "en", s, p) for i, t, _, s, p in rows]
    got = P.detect_language(spark, spark.createDataFrame(known, docs.schema), str(tmp_path))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [known[0], known[3]]

"""Order keys of the bindings on keys beyond the test tables."""

from quarry.operators import architecture as A
from quarry.plans import tables as B


def test_entities_of_large_part_keys_come_by_line(spark, tmp_path):
    spark.createDataFrame([(1, "1-URGENT", "O", 1.0)], "o_orderkey long, o_orderpriority string, o_orderstatus string, "
                          "o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 1, 9, 150_000, 1.0, "O"), (1, 2, 3, 10_000, 1.0, "O"), (1, 2, 200_000, 9_999, 1.0, "O")]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, "
                          "l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = A.first_n_entities(B.order_entities(spark, str(tmp_path), "O"), 20).collect()
    assert [r.name for r in sorted(got, key=lambda r: r.rank)] == ["L1_150000_9", "L2_9999_200000", "L2_10000_3"]


def test_words_of_long_lines_come_by_line(spark, tmp_path):
    text = "a " * 200_001 + "last\nnext"
    spark.createDataFrame([(1, text, "en", "src1")], "doc_id long, text string, lang string, source string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = B.doc_words(spark, str(tmp_path)).filter("name in ('last', 'next')").orderBy("seq").collect()
    assert [r.name for r in got] == ["last", "next"]

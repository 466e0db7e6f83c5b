from pyspark.sql import functions as F

from opinionmill.functions import text as tx
from opinionmill.functions.vectors import argmax, cosine, unit
from opinionmill.operators.cleaning import assign_doc_id, drop_incomplete, with_review


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("s"))).collect()]


CLEANED = {
    None: "",
    "": "",
    "HTTP://X.y/a?b=1&amp;c end": "end",
    "a&amp;quot;b": "a&quot;b",
    "see www.x.org now": "see now",
    "a\t\n\xa0 b": "a b",
    "  ÉTÉ Über  ": "été über",
    "x &quot;y&quot; &lt;": 'x "y" &lt;',
    "end\xa0http://a.b\xa0c": "end c",
    "a\x1cb\u2003c": "a b c",
    "https://": "https://",
    "www.": "www.",
}


def test_clean_text(spark):
    assert column(spark, list(CLEANED), tx.clean_text) == list(CLEANED.values())


def test_word_counts(spark):
    values = ["", "a  b", " a b ", None, "one"]
    assert column(spark, values, lambda c: tx.word_count(c, "space")) == [1, 3, 4, 1, 1]
    assert column(spark, values, lambda c: tx.word_count(c, "ws")) == [1, 2, 2, 1, 1]
    assert column(spark, values, tx.char_count) == [0, 4, 5, 0, 3]


def test_tokens_fold_accents_and_drop_single_letters(spark):
    values = ["A b été-naïve x_1 ß ﬁn 12", "", None, "don't"]
    assert column(spark, values, tx.word_tokens) == [["ete", "naive", "x_1", "fin", "12"], [], [], ["don"]]
    assert column(spark, values, lambda c: tx.word_tokens(c, False))[0] == ["été", "naïve", "x_1", "ﬁn", "12"]


def test_ngrams(spark):
    grams = lambda low, high: lambda c: tx.ngrams(tx.whitespace_tokens(c), low, high)
    values = ["a b c", "a", ""]
    assert column(spark, values, grams(1, 2)) == [["a", "b", "c", "a b", "b c"], ["a"], []]
    assert column(spark, values, grams(2, 3)) == [["a b", "b c", "a b c"], [], []]


def test_truncate_and_pad(spark):
    cut = lambda pad: lambda c: tx.truncate_tokens(tx.whitespace_tokens(c), 2, pad)
    assert column(spark, ["a b c", "a"], cut("-")) == [["a", "b"], ["a", "-"]]
    assert column(spark, ["a b c", "a"], cut(None)) == [["a", "b"], ["a"]]


def test_review_columns(spark):
    raw = spark.createDataFrame([(2, None, "B"), (1, "T", "x"), (None, "T", "x"), (1, "T", None)], "polarity long, title string, text string")
    rows = with_review(drop_incomplete(raw)).orderBy("label").collect()
    assert [(r.raw, r.review, r.label) for r in rows] == [("T. x", "t. x", 0), (". B", ". b", 1)]


def test_doc_ids_are_unique_and_depend_on_content_only(spark):
    rows = [("a", "x")] * 25 + [("a", None), ("a", ""), ("b", "x"), ("b", "x")]
    frame = spark.createDataFrame(rows, "p string, q string")
    keys = [
        sorted(r.doc_id for r in assign_doc_id(frame.repartition(n), ["p", "q"], chunk=4).collect()) for n in (1, 7)
    ]
    assert keys[0] == keys[1] and len(set(keys[0])) == len(rows)


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = frame.select(cosine("a", "b").alias("c"), unit("a").alias("u"), argmax("b").alias("m")).collect()
    assert abs(rows[0].c - 1) < 1e-12 and rows[0].u == [0.6, 0.8] and rows[0].m == 1
    assert rows[1].c is None and rows[1].u == [0.0, 0.0] and rows[1].m == 0

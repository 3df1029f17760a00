"""Names of long texts follow from the part that settles them; the result is that of the whole text."""

from pyspark.sql import functions as F

from foliospark.functions import text as X

ODD = ["", " ", None, "ab " * 40, "con.txt", "a" * 300, "ä中 " * 200, " /:* " * 90 + "end", "x́" * 200, "e ́" * 130 + "≮", "...  .a" * 40, "a" * 50, "a" * 51, "a " * 26, "ab-" * 60, "﻿\n " * 99 + "Brief   an: alle " * 9]


def test_the_end_of_a_long_text_changes_nothing(spark, monkeypatch):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").cache()

    def named():
        return [tuple(r) for r in texts.select("i", *[f(F.col("t"), n) for f in (X.clean_name, X.slug) for n in (1, 10, 50)]).orderBy("i").collect()]

    got = named()
    monkeypatch.setattr(X, "_settling", lambda text, most: text)
    assert got == named()


def test_long_texts_are_cut_before_a_letter(spark):
    long = spark.createDataFrame([("b́ c, " * 5000,), ("中" * 5000,)], "t string")
    assert [r.n for r in long.select(F.length(X._settling(F.col("t"), 50)).alias("n")).collect()] == [6 * 25 + 3, 5000]

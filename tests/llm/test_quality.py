import zlib

import pytest

from foliospark.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = quality.query(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_query_against_a_plain_version(spark):
    rows = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality in (0, 1)}
    ids = [d for d in sorted(labels) if d in texts and zlib.crc32(str(d).encode()) % 4 != 2]
    assert max(len(texts[d]) for d in ids) > 20_000  # long texts are fitted on too
    model = quality.fit([texts[d] for d in ids], [labels[d] for d in ids])
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        score = quality.scores(model, [t])[0]
        assert abs(rows[d].score - score) < 1e-12  # sums of a batch may be rounded otherwise
        assert (rows[d].predicted, rows[d].held_out) == (int(rows[d].score >= 0.7), zlib.crc32(str(d).encode()) % 4 == 2)


def test_the_model_follows_from_the_tables_alone(spark):
    rows = [(i, f"fine words in a row {i} " * (i % 5 + 1) if i % 2 else f"x%%% y### {i} " * (i % 7 + 1)) for i in range(200)] + [(3, "another text"), (3, "and a third"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0)], "doc_id long, quality int")
    one = quality.fit_on(docs.repartition(7), labels.repartition(3), 30)
    assert one == quality.fit_on(docs.orderBy("text").coalesce(1), labels.orderBy("doc_id").coalesce(1), 30) != quality.fit_on(docs, labels)


def test_a_score_at_the_threshold_is_predicted(spark):
    model = quality.Model(prior=quality.THRESHOLD)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in quality.score(docs, model).collect()] == [(0.7, 1)] * 2


@pytest.mark.parametrize("n", [0, 1, 1999, 2000, 2001, 140_000])
def test_a_text_gives_all_its_bytes(n):
    text = "".join(f"{i:06d} " for i in range(n // 7 + 1))[:n]
    assert b"".join(quality.pieces(text)) == text.encode() and all(0 < len(p) <= quality.SAMPLE_BYTES for p in quality.pieces(text))
    raw, trained = quality._dictionary([quality.pieces("ab")])
    assert (raw, trained) == (b"ab", False)


def test_the_end_of_a_long_text_counts():
    long = "plain " * 20_000
    some = [long + f"rare{k} marks{k} at{k} the{k} end{k} " * 300 for k in range(4)]
    rest = [f"other {k} text " * 40 for k in range(40)]
    with_end, without = quality.dictionaries([quality.pieces(t) for t in [*some, *rest]], [1] * 4 + [0] * 40), quality.dictionaries([quality.pieces(long)] * 4 + [quality.pieces(t) for t in rest], [1] * 4 + [0] * 40)
    assert b"marks" in with_end.good and b"marks" not in without.good


def test_held_out_rule(spark):
    ids = spark.createDataFrame([(i,) for i in range(300)] + [(None,)], "doc_id long")
    for r in ids.select("doc_id", quality.is_held_out("doc_id").alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "good words in a row " * (i % 5 + 1) if i % 2 else "x%%% y### " * (i % 7 + 1)) for i in range(80)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    flipped = labels.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["x"]).when(quality.is_held_out("doc_id"), 1 - labels["quality"]).otherwise(labels["quality"]))
    assert quality.fit_on(docs, labels) == quality.fit_on(docs, flipped)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (3, 1), (4, 1)], [(None, 1), (1, None), (3, 7)]])
def test_few_or_no_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "b" * 100_000)], "doc_id long, text string")
    model = quality.fit_on(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1


def test_nulls_repeats_and_clashing_names(spark):
    model = quality.fit(["fine words here %d" % i for i in range(20)] + [f"%%% ### {i}" for i in range(20)], [1] * 20 + [0] * 20)
    docs = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (2, "fine words", "s"), (2, "fine words", "s")], "doc_id long, text string, score string")
    rows = quality.score(docs, model).collect()
    assert len(rows) == 4 and rows[0].score == rows[1].score and rows[2].score == rows[3].score
    assert quality.score(docs.limit(0), model).collect() == []

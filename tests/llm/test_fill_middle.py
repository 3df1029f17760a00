import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import fill_middle as fim

SF = "/root/testdata/sf0.001"


def plainly(doc_id, text):
    """n, form, prefix, middle, output of a text, unit by unit."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "a", " ", "\n\n", "word", "two words", "<P>", "x <M> y", "<P <S< <", "<<S", "äöü ñ 😀😀 naïve", "a" * 100_000, "! " * 20_000, "ab cd " * 5_000, "x1" * 64, "q " * 32, "-" * 64, "a\x00b\r\n c"]


def test_rows_against_units_by_hand(spark):
    rows = [(i * len(ODD) + k, t, "x") for i in range(40) for k, t in enumerate(ODD)] + [(None, "some text of a null id", "x")] * 3 + [(7, "same row again " * 20, "x")] * 4 + [(7, "same id, another text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = fim.fill_middle(docs).withColumn("back", fim.restored()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text), (r.doc_id, r.text[:50])
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_against_its_sql_and_by_hand(spark):
    tables = duckdb.connect()
    tables.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = tables.sql(fim.SQL)
    got = fim.query(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want.select(", ".join(got.columns)).fetchall())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, n, form, prefix, middle, output, back in rows:
        *head, out = plainly(doc_id, texts[doc_id])
        assert [n, form, prefix, middle] == head and output == digest(out) and back == digest(texts[doc_id] or "")


@pytest.mark.parametrize("run", [1, 3, 64])
def test_length_of_runs_does_not_matter(spark, run, monkeypatch):
    monkeypatch.setattr(fim, "RUN", run)
    docs = spark.createDataFrame([(i, f"un{i} deux, trois: " * (i % 9)) for i in range(60)], "doc_id long, text string")
    for r in fim.fill_middle(docs, rate=100, suffix_first=50).collect():
        n, _, _, _, _ = plainly(r.doc_id, r.text)
        assert r.n == n and (r.form == "plain") == (not r.text)


def test_rates_and_seed(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    assert {r.form for r in fim.fill_middle(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_middle(docs, rate=100, suffix_first=100).collect()} == {"spm"}
    one, two = ([r.output for r in fim.fill_middle(docs, seed=s).orderBy("doc_id").collect()] for s in (1, 2))
    assert one != two


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_middle(docs).collect() == []


def test_no_python_runs(spark):
    plan = fim.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

"""run() against a version that works the stages out in plain Python, from the operators' rules."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from foliospark.llm import bpe, mixing, quality, simhash_cover
from tests.llm.test_line_chunks import by_force as without_repeated
from tests.llm.test_mixing import brute

PASSAGE = "\n".join(f"shared line number {i}" for i in range(12))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(160):
        text = " ".join(f"word{(i * k) % 97} and" for k in range(1, 40))
        if i % 5 == 0:
            text = " ".join(f"junk{(i * k) % 89}%%%" for k in range(1, 40))
        if i % 7 == 1:
            text += "\n" + PASSAGE
        if i % 10 == 3:
            text = rows[1][1]
        if i % 20 == 17:
            text = rows[2][1].replace(" and", f" other{i}", 1)
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
    rows += [(160, "", "en", "s1", 0), (161, None, "en", None, None), (162, rows[2][1], "en", "hot", 1), (2, rows[2][1], "en", "hot", 1)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_run_against_brute_force(spark, folder):
    got = Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in docs.collect() if quality.scores(model, [r.text or ""])[0] >= 0.7]
    assert 0 < len(rows) < docs.count()
    left = without_repeated([(r.doc_id, r.text) for r in rows])
    rows = [(r.doc_id, None if r.text is None else t, r.source) for r, t in zip(rows, left)]
    assert any(t == "" or len(t or "") < len(r[1] or "") for t, r in zip(left, rows)) or left
    sets = [frozenset(simhash_cover.shingles(t or "", 5)) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    best = {}
    for (d, t, s), r in zip(rows, root):
        if r not in best or d < best[r][0]:
            best[r] = (d, t, s)
    assert 1 < len(best) < len(set(sets))  # some near copies, not only equal ones
    kept = spark.createDataFrame(list(best.values()), "doc_id long, text string, source string")
    copies, _ = brute(kept)
    ranks, pattern = bpe.public_ranks()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Codec(ranks, pattern).ranks, special_tokens={})
    want = Counter()
    for (d, s, t), n in copies.items():
        ids = own.encode_ordinary(t or "")
        want[d, s, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += n
    assert got == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name


def test_mixing_repeats_at_most_twice(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"]).where("source is not null")
    counts = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, folder).collect())
    assert max(counts.values()) <= mixing.REPETITION_LIMIT and min(counts.values()) >= 1


@pytest.mark.parametrize("labels", [[], [(1, None, 0), (2, None, 0)], [(1, 1, 0)]])
def test_without_a_model_nothing_is_rejected(spark, tmp_path, labels):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect()) == list(range(8))

import math
import re
from collections import Counter, defaultdict

import pytest

from foliospark.llm import mixing


def test_bisection_meets_the_limit():
    tokens = {"big": 1_000_000, "mid": 100_000, "small": 1_000, "none": 0}
    exponent, shares = mixing.temper(tokens, repetition_limit=2)
    repeats = {s.source: s.budget / s.tokens for s in shares if s.tokens}
    assert max(repeats.values()) == pytest.approx(2, rel=1e-6) and min(repeats.values()) == pytest.approx(1)
    assert exponent == pytest.approx(1 - math.log(2) / math.log(1000), abs=1e-9)
    assert sum(s.weight for s in shares) == pytest.approx(1)


def test_bisection_meets_the_entropy():
    tokens = {"a": 900, "b": 90, "c": 10}
    whole, even = mixing.entropy(mixing.weights([900, 90, 10], 1)), math.log(3)
    _, shares = mixing.temper(tokens, repetition_limit=None, target_entropy=(whole + even) / 2)
    assert mixing.entropy([s.weight for s in shares]) == pytest.approx((whole + even) / 2, abs=1e-6)
    assert mixing.temper(tokens, None, 0.0)[0] == 1.0  # out of reach
    assert mixing.temper({}, 2) == (1.0, [])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 13 + 1), "hot" if i % 3 == 0 else None if i % 17 == 0 else f"s{i % 5}") for i in range(900)]
    return spark.createDataFrame(rows + [(900, "", "void"), (901, None, "void"), (3, "w " * 4, "hot"), (None, "w w", "s1")], "doc_id long, text string, source string").cache()


def brute(docs, seed=mixing.SEED, **targets):
    """Copies of each row, by walking through every source's permuted blocks."""
    from pyspark.sql import functions as F

    with_block = docs.withColumn("block", mixing._block("doc_id", F.xxhash64("text"), seed, mixing.BLOCKS))
    ordered = with_block.select("*", *[mixing._block_order(F.lit(e), "source", "block", seed).alias(f"b{e}") for e in range(4)], *[mixing._place_order(F.lit(e), "doc_id", F.xxhash64("text"), seed).alias(f"p{e}") for e in range(4)]).collect()
    n = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    tokens = defaultdict(int)
    for r in ordered:
        tokens[r.source] += n(r)
    _, shares = mixing.temper(dict(tokens), **targets)
    copies = Counter()
    for s in shares:
        own = [r for r in ordered if r.source == s.source]
        for r in own:
            copies[r.doc_id, r.source, r.text] += s.passes
        if not s.tokens:
            continue
        e, left = s.passes, s.rest
        groups = defaultdict(list)
        for r in own:
            groups[r[f"b{e}"], r[f"p{e}"]].append(r)
        for key in sorted(groups):  # equal rows are drawn together or not at all
            cost = sum(map(n, groups[key]))
            if cost > left + 1e-9:
                break
            left -= cost
            for r in groups[key]:
                copies[r.doc_id, r.source, r.text] += 1
    return +copies, shares


@pytest.mark.parametrize("targets", [{}, {"repetition_limit": 3.0}, {"budget": 2000.0, "repetition_limit": 1.5}, {"target_entropy": 1.2, "repetition_limit": None, "budget": 5000.0}])
def test_draws_match_a_walk_through_the_permutations(spark, docs, targets):
    mixture = mixing.plan(docs, **targets)
    want, shares = brute(docs, **targets)
    got = Counter((r.doc_id, r.source, r.text) for r in mixing.mixed(docs, mixture).collect())
    assert got == want
    drawn = mixing.draws(mixture).collect()
    assert Counter((r.doc_id, r.source) for r in drawn) == Counter(x for (d, s, _), k in want.items() for x in [(d, s)] * k)
    for s in shares:
        own = sorted((r for r in drawn if r.source == s.source), key=lambda r: (r.start, r.tokens))
        assert sum(r.tokens for r in own) <= s.budget + 1e-6
        at = 0
        for r in own:
            assert r.start == at
            at += r.tokens
        assert len({(r["pass"]) for r in own}) <= s.passes + 1


def test_every_document_is_used_by_default(spark, docs):
    got = {r.doc_id for r in mixing.mixed(docs, mixing.plan(docs)).where("source <> 'void'").collect()}
    assert got >= {i for i in range(900) if i % 17}
    assert mixing.mixed(docs, mixing.plan(docs)).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    mixture = mixing.plan(docs)
    assert mixing.mixed(docs, mixture).collect() == [] and mixing.draws(mixture).collect() == []


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x", "y", 7)], "doc_id long, text string, source string, cut_block string, block string, tokens int")
    assert [tuple(r) for r in mixing.mixed(docs, mixing.plan(docs)).collect()] == [(1, "a b", "s", "x", "y", 7)]


def test_blocks_grow_with_the_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    few = mixing.plan(docs)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    many = mixing.plan(docs)
    assert few.n_blocks == 4 and many.n_blocks == docs.count() // 10
    for mixture in (few, many):
        drawn = mixing.draws(mixture).groupBy("source").agg({"tokens": "sum"}).collect()
        budgets = {s.source: s.budget for s in mixture.sources.collect()}
        assert all(r[1] <= budgets[r[0]] + 1e-6 or not budgets[r[0]] for r in drawn) and len(drawn) == len(budgets)


@pytest.mark.parametrize("large", [1, 3, 1000])
def test_small_sources_are_mixed_alike(spark, docs, large, monkeypatch):
    """Whichever sources count as large, the draws are the same."""
    want, _ = brute(docs)
    monkeypatch.setattr(mixing, "LARGE", large)
    mixture = mixing.plan(docs)
    assert mixture.small == (large < 1000)
    assert Counter((r.doc_id, r.source, r.text) for r in mixing.mixed(docs, mixture).collect()) == want
    assert mixing.draws(mixture).count() == sum(want.values())


def test_a_source_for_each_row(spark):
    docs = spark.range(110_000).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 + 1 as int)) as text", "concat('s', id) as source")
    mixture = mixing.plan(docs)
    assert mixture.exponent == pytest.approx(1 - math.log(2) / math.log(7), abs=1e-9)  # the smallest source is used twice
    once = {r["source"]: r["passes"] for r in mixture.sources.select("source", "passes").collect()}
    assert len(once) == 110_000 and set(once.values()) <= {1, 2}
    assert mixing.mixed(docs, mixture).count() == sum(once.values())


def test_many_rows_of_one_id(spark):
    docs = spark.range(1_000_000).selectExpr("if(id < 10, id, 7) as doc_id", "concat('w', id) as text", "if(id % 3 = 0, 'a', 'b') as source")
    mixture = mixing.plan(docs)
    sizes = [r["n"] for r in mixture.blocks.collect()]
    assert len(sizes) == 2 * mixing.BLOCKS and max(sizes) < 2 * 1_000_000 / mixing.BLOCKS
    drawn = mixing.draws(mixture).groupBy("source").agg({"tokens": "sum"}).collect()
    budgets = {s.source: s.budget for s in mixture.sources.collect()}
    assert all(budgets[r[0]] - 1.001 <= r[1] <= budgets[r[0]] + 1e-6 for r in drawn)


def test_tempering_a_table_is_tempering_its_counts(spark):
    counts = {"a": 900, "b": 90, "c": 90, "d": 3, "none": 0, None: 17}
    table = spark.createDataFrame([(s, t, 1) for s, t in counts.items()], "source string, tokens long, n long")
    for targets in ({}, {"repetition_limit": 1.2}, {"repetition_limit": None, "target_entropy": 1.0}, {"budget": 5000.0, "repetition_limit": 9.0}, {"repetition_limit": None, "target_entropy": 0.0}):
        exponent, shares = mixing.temper(counts, **targets)
        own, given = mixing._tempered(table, **targets)
        assert own == pytest.approx(exponent, abs=1e-9)
        found = {r.source: r for r in given.collect()}
        for s in shares:
            assert (found[s.source].weight, found[s.source].budget) == pytest.approx((s.weight, s.budget), rel=1e-9)
            assert found[s.source].passes == s.passes and found[s.source].rest == pytest.approx(s.rest, abs=1e-6)


def test_the_whole_query_against_the_walk(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    want, shares = brute(docs)
    drawn = mixing.query(spark, folder).collect()
    assert Counter((r.doc_id, r.source) for r in drawn) == Counter({(d, s): k for (d, s, _), k in want.items()})
    assert {r.doc_id for r in drawn} == {r.doc_id for r in docs.select("doc_id").collect()} and len({r.exponent for r in drawn}) == 1
    for s in shares:
        own = sorted((r for r in drawn if r.source == s.source), key=lambda r: (r.start, r.tokens))
        assert {round(r.weight, 9) for r in own} == {round(s.weight, 9)}
        assert [r.start for r in own] == [sum(r.tokens for r in own[:k]) for k in range(len(own))]
        assert all(r.place == pytest.approx(r.start / s.budget) for r in own if s.budget)

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import simhash_cover as S
from foliospark.llm.components import connected_components


def roots_by_force(values, radius):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_every_pair_within_the_radius_meets_in_some_table():
    rng = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = S.cover_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            flipped = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not flipped & m for m in masks)


def test_fingerprint_by_hand():
    text = "The Quick brown\tfox  jumps over"
    words = ["the", "quick", "brown", "fox", "jumps over"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert S.fingerprint(text) == want
    assert S.fingerprint("a B") == xxhash.xxh64_intdigest("a b", 42)
    assert S.fingerprint(" \n ") == S.fingerprint("") == 0
    assert S.fingerprint("Ä x y") != S.fingerprint("ä x y")  # only A to Z are lowered


@pytest.mark.parametrize("limit", [1, 10, 16_384])
def test_links_connect_what_all_pairs_connect(spark, limit):
    rng = random.Random(limit)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(25)} | {0, 7, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket_limit=limit)
    found = {r.node % (1 << 64): r.root for r in connected_components(edges).collect()}
    want = roots_by_force(values, 3)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(found) == {g for g in groups(want) if len(g) > 1}
    assert edges.count() <= len(values) * 15 * (1 if limit > 1000 else 600)


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (6, 5), (5, 6), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1050)} | {5000: 5000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [(5, long, "x"), (9, long, "x"), (3, long + " z", "x"), (7, "one two", "x"), (8, "three four", None), (20, "", "x"), (11, None, "x"), (12, " \n", "x"), (None, long, "x"), (9, long, "x"), (None, "alone here now", "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, fp string")
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    near = (S.fingerprint(long) ^ S.fingerprint(long + " z")).bit_count() <= 3
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[5] == by[9] == (3 if near else 5) and by[20] == by[11] == by[12] == 11 and by[7] == 7 and by[8] == 8
    assert sorted((r.component_id is None) for r in rows if r.doc_id is None) == [False, True]
    kept = S.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1, 3, 7, 8, 11] + ([] if near else [5]))
    assert S.near_duplicates(docs.limit(0)).collect() == [] and S.keep_one_each(docs.limit(0)).collect() == []


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = S.query(spark, sf).collect()
    prints = {r.doc_id: S.fingerprint(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    roots = roots_by_force(prints.values(), 3)
    first = {}
    for d in sorted(prints):
        first.setdefault(roots[prints[d]], d)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{v:016x}", first[roots[v]]) for d, v in prints.items()}


def test_forest_is_small():
    values = np.array([0, 1, 3, 7, 15, 255 << 40], np.uint64)
    a, b = S._forest(values, 3)
    assert len(a) == 4 and set(b.tolist()) == {1, 3, 7, 15}


@pytest.mark.parametrize("block", [2, 512])
def test_near_copies_go(spark, block):
    rng = random.Random(11)
    texts = []
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(120)]
        texts += [" ".join(words)] + [" ".join(words[:k] + ["new"] + words[k + 1 :]) for k in rng.sample(range(10, 110), 3)]
        texts.append(" ".join(words[:60] + [f"other{g}x{i}" for i in range(60)]))  # a half alone isn't a near copy
    texts += ["a b", "A  b", "", None, " "]
    sets = [set(S.shingles(t or "", 5)) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if not x and not sets[j] or x and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_copies(docs, block=block).collect()} == dict(enumerate(root))
    assert {r.doc_id for r in S.keep_one_each(docs).collect()} == set(root) and len(set(root)) == 26


def hot_bucket(spark, n, common=30, own=10):
    """One bucket of n sets that share most of their shingles; every 50th is like the one before it."""
    base = F.when(F.col("id") % 50 == 0, F.greatest(F.col("id") - 1, F.lit(0))).otherwise(F.col("id"))
    alike = F.transform(F.sequence(F.lit(1), F.lit(own)), lambda k: F.xxhash64(F.when(k > 1, base).otherwise(F.col("id")), k))
    grams = F.array_sort(F.concat(F.transform(F.sequence(F.lit(1), F.lit(common)), lambda k: F.xxhash64(F.lit(-1), k)), alike))
    sets = spark.range(n).select(F.col("id").alias("fp"), grams.alias("grams"))
    return sets.select(F.lit(0).alias("v"), F.lit(7).cast("long").alias("key"), "fp", F.col("fp").alias("component")), sets


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_rows_of_a_hot_bucket_grow_with_its_sets(spark, n):
    buckets, grams = hot_bucket(spark, n)
    parted = S.checkpointed(S._parted(buckets, grams, S.BLOCK))
    # the sets of a pair share nine shingles that no other has; what all have brings none together
    assert parted.count() <= 9 * 2 * n // 50 and S._block_pairs(parted, S.BLOCK).count() <= 2 * 9 * 2 * n // 50
    pairs = parted.groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("met")).select("met").distinct().collect()
    assert sorted(tuple(r.met) for r in pairs) == [(k - 1, k) for k in range(50, n, 50)]


def test_a_hot_bucket_loses_no_pair(spark):
    """Sets of random halves of a few shingles, all in one bucket: every pair that is alike enough meets, whatever is rare."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 45, 34)) for _ in range(300)] + [np.arange(k) for k in range(1, 45)]
    rows = [(0, 7, i, i) for i in range(len(sets))]
    grams = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "fp long, grams array<long>")
    met = set()
    for r in S._parted(spark.createDataFrame(rows, "v int, key long, fp long, component long"), grams, 4).groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("met")).collect():
        met |= {(a, b) for i, a in enumerate(r.met) for b in r.met[i + 1 :]}
    alike = {(a, b) for b in range(len(sets)) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    assert len(alike) > 100 and alike <= met


def test_sets_that_one_hash_stands_for_stay_apart(spark, monkeypatch):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "one two three four five six"]
    real = S.map_columns

    def one_hash(df, needs, fields, work, keep=None):
        return real(df, needs, fields, (lambda texts: [[5] * len(texts), *work(texts)[1:]]) if fields[0].name == "fp" else work, keep)

    monkeypatch.setattr(S, "map_columns", one_hash)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    assert found in ({0: 0, 1: 1, 2: 0}, {0: 0, 1: 1, 2: 2})


def test_a_family_of_copies_near_the_bound(spark):
    """Copies of one text whose likeness to it and to one another lies on both sides of the bound, in large buckets."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        own = list(words)
        for k in rng.sample(range(150), rng.randrange(1, 7)):
            own[k] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [set(S.shingles(t, 5)) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (16, 512):
        assert {r.doc_id: r.component_id for r in S.near_copies(docs, block=block).collect()} == dict(enumerate(root))
    assert 3 < len(set(root)) < 100

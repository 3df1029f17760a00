import hashlib
import random
import re
import struct

import xxhash

from foliospark.llm import fingerprint as P


def by_hand(text):
    words = re.split(r"[\x20\x09-\x0D]+", text)
    votes, total = [0] * 128, 0
    for i, w in enumerate(words):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        if i + 1 < len(words):
            h = xxhash.xxh64_intdigest(words[i + 1].encode(), h)
        g = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
        weight = min(len(w), 16)
        total += weight
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
            votes[64 + b] += weight * (g >> b & 1)
    first, second = (sum(1 << b for b in range(64) if 2 * votes[at + b] > total) for at in (0, 64))
    return f"{first:016x}{second:016x}"


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp1 string")
    got = P.edited_fingerprints(docs).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    want = []
    for i, (d, t) in enumerate(ordered):
        t, following = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, e, n = by_hand(t), by_hand(edited), by_hand(following)
        alike = lambda x, y: 1 - (int(x, 16) ^ int(y, 16)).bit_count() / 128
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, e, alike(a, e), alike(a, n)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([tuple(r)[:7] for r in got], key=key) == sorted(want, key=key)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "the", "of", "größer", "x" * 40, "😀😀"]
    rows = [(rng.choice([i, i, i - 1]), " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(700)]
    check(spark, rows + [(5, None), (6, ""), (7, " \n "), (None, "no id"), (None, None), (-5, "negative id"), (1 << 60, "far away"), (8, "a b c"), (8, "a b c")])


def test_one_row_two_rows_none(spark):
    check(spark, [(1, "only one here")])
    check(spark, [(2, "b"), (1, "a longer one")])
    assert P.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text(spark):
    check(spark, [(1, "word " * 120_000), (2, "other " * 3)])


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(30)]
    values = list({b ^ sum(1 << i for i in rng.sample(range(128), rng.randrange(0, 6))) for b in base for _ in range(12)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(v & (1 << 64) - 1), signed(v >> 64)) for v in values + values[:5]], "fp1 long, fp2 long")
    asked = values[::3]
    rows = P.neighbours(spark.createDataFrame([(signed(v & (1 << 64) - 1), signed(v >> 64)) for v in asked], "fp1 long, fp2 long"), table).collect()
    join = lambda a, b: (a % (1 << 64)) | (b % (1 << 64)) << 64
    want = {(q, v, (q ^ v).bit_count()) for q in asked for v in values if (q ^ v).bit_count() <= 3}
    assert {(join(r.q1, r.q2), join(r.fp1, r.fp2), r.distance) for r in rows} == want and len(rows) == len(want)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = P.query(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: int(by_hand(t), 16) for d, t in texts.items()}
    assert len(rows) == len(texts) and sum(r.near_edited > r.near_next for r in rows) / len(rows) > 0.95
    for r in rows:
        assert int(r.fingerprint, 16) == prints[r.doc_id]
        if r.doc_id % 50:
            assert r.n_same is None and r.n_within is None
        else:
            far = [(prints[r.doc_id] ^ v).bit_count() for d, v in prints.items() if d != r.doc_id]
            assert (r.n_same, r.n_within) == (far.count(0), sum(x <= 3 for x in far))


def test_links_of_equal_fingerprints_are_counted(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(i, text if i % 2 else f"own text number {i} " * 9) for i in range(40, 61)] + [(100, text), (150, None), (200, ""), (250, text + " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_same, r.n_within) for r in P.query(spark, str(tmp_path)).collect()}
    assert got[100][0] == 10 and got[100][1] >= got[100][0] and got[150] == got[200] and got[150][0] == 1 and got[50][0] == 0


def test_ranges_are_even_whatever_the_ids(spark):
    dense, spread = spark.range(200_000).selectExpr("id as doc_id"), spark.range(200_000).selectExpr("1000000 + id * 30000000000 as doc_id")
    crowd = spark.range(100_000).selectExpr("cast(7 as long) as doc_id", "cast(id as string) as text")
    docs = dense.unionByName(spread).selectExpr("doc_id", "'a' as text").unionByName(crowd)
    keys = P._placed(docs).groupBy(*P._PLACE).count().repartitionByRange(40, *P._PLACE)
    sizes = [r["count"] for r in keys.groupBy(P.F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 500_000 / 40
    after = P._successors(P._placed(docs))
    assert after.count() == after.select("next").distinct().count() == 500_000
    wrong = after.where("(given, id, k1, k2) >= (next.given, next.id, next.k1, next.k2)").count()
    assert wrong == 1  # the last one's

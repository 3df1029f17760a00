import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from foliospark.llm import importance

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plainly(rows, targets, longest=1, drawn=10, least=20):
    """Rows of resampled(), feature by feature."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    every, target = Counter(), Counter()
    for _, text in rows:
        every.update(map(bucket, features(text, longest)[1]))
    for text in targets:
        target.update(map(bucket, features(text, longest)[1]))
    s, t = sum(every.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s + 10000) / ((every[b] + 1) * (t + 10000)))) for b in every}
    out = []
    for doc_id, text in rows:
        n_words, some = features(text, longest)
        weight = sum(gain[bucket(f)] for f in some)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n_words, len(some), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [tuple([*r, k + 1 if k < drawn * len(fit) // 100 else None]) for k, r in enumerate(fit)]
    return sorted(ranks + [tuple([*r, None]) for r in out if r[1] < least], key=repr)


def test_query_against_its_sql_and_by_hand(spark):
    tables = duckdb.connect()
    for name in ("documents", "benchmark"):
        tables.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = importance.query(spark, SF)
    want = tables.sql(importance.SQL)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(want.select(", ".join(got.columns)).fetchall(), key=repr)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    whole = plainly(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert rows == sorted(((r[0], *r[2:]) for r in whole), key=repr)
    assert sum(r[-1] is not None for r in rows) == sum(r[1] >= 20 for r in rows) // 10 > 0


ROWS = [(i, " ".join(f"Wort{(i * j) % (11 + i % 7)}" for j in range(i % 60))) for i in range(300)]
ROWS += [(None, "ein Text ohne Nummer " * 9), (None, None), (1000, ""), (1001, "!?"), (1002, "Ärger über Öl 12a " * 8), (1003, "x" * 100_000), (1004, "lang " * 50_000), (5, "noch einmal fünf " * 10), (5, "noch einmal fünf " * 10)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_rows_by_hand(spark, longest, monkeypatch):
    monkeypatch.setattr(importance, "PACKED_DOCS", 7)
    monkeypatch.setattr(importance, "PACKED_FEATURES", 500)
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in ROWS], "doc_id long, text string, score double, rank string").repartition(5)
    target = spark.createDataFrame([("wort1 wort2 Wort3",), ("Öl",), (None,)], "text string")
    got = importance.resampled(docs, target, longest=longest)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(ROWS, ["wort1 wort2 Wort3", "Öl", None], longest)


def test_draw_everything_or_nothing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    target = docs.select("text").limit(0)
    for drawn, least in ((100, 0), (0, 0), (33, 5)):
        got = importance.resampled(docs, target, drawn=drawn, least_words=least).collect()
        assert sorted(map(tuple, got), key=repr) == plainly(ROWS, [], 1, drawn, least)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(docs, docs).collect() == []


def test_streams(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "B")], "doc_id long, text string").coalesce(1)
    (row,) = importance.packed(docs).collect()
    a, b = (zlib.crc32(x) % 10000 for x in (b"a", b"b"))
    assert (row.ids, row.words) == ([1, 2, 3], [3, 0, 1])
    assert bytes(row.stream) == b"".join(x.to_bytes(2, "little") for x in (a, b, a, b))
    assert bytes(row.offsets) == b"".join(x.to_bytes(8, "little") for x in (0, 3, 3, 4))
    counts = importance.bucket_counts(importance.packed(docs))
    assert counts.sum() == 4 and counts[a] == counts[b] == 2

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import backoff

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    """Split by hand: a token ends at a white-space character of ASCII."""
    out, word = [], ""
    for c in (text or "").translate(LOWER):
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + ([word] if word else []) + ["</s>"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def interpolated(rows, order, strengths):
    """p(n-gram's last token | the others) from counts in dictionaries, with neither hashes nor states; the counts of single tokens."""
    counts = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            seq = ["<s>", *tokens(text)]
            counts.update(tuple(seq[i : i + k]) for k in range(1, order + 1) for i in range(len(seq) - k + 1))
    starts = counts.pop(("<s>",), 0)
    single = {g[0]: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(single.values()), len(single)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.5) / (n + 0.5 * (v + 1))
        strong = strengths[min(len(gram) - 2, len(strengths) - 1)]
        context = starts if gram[:-1] == ("<s>",) else counts[gram[:-1]]
        return (counts[gram] + strong * p(gram[1:])) / (context + strong)

    return p, single


def brute(rows, order, strengths):
    p, single = interpolated(rows, order, strengths)
    out = []
    for doc_id, text in rows:
        seq = ["<s>", *tokens(text)]
        base = sum(math.log10(p((w,))) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i + 1]))) for i in range(1, len(seq)))
        out.append((doc_id, held(doc_id), len(seq) - 1, sum(w in single for w in seq[1:]), sum(single.values()), base, score))
    return out


def same(got, want):
    got, want = (sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2:])) for rows in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_query_against_counts_in_dictionaries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(backoff.query(spark, SF).collect(), brute(rows, backoff.ORDER, backoff.STRENGTH))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_many_blocks_and_ranges(spark, order):
    rows = [(i, " ".join(f"W{(i * i + j * j) % (7 + i % 5)}" for j in range(i % 23))) for i in range(200)]
    rows += [(None, "a b a b"), (None, None), (3, "w1 w1"), (3, "w1 w1"), (11, ""), (12, " \t\n"), (13, "Ä Ä ä\x1cb"), (14, "x" * 50_000), (15, "w1 w2 " * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = backoff.scores(docs, order=order, strengths=(3.0, 0.7), block_bytes=5_000, range_keys=1_000)
    same(got.collect(), brute(rows, order, (3.0, 0.7)))


def test_the_model_beats_single_tokens_on_held_out_texts(spark):
    rows = [r for r in backoff.query(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.99 * sum(r.base_score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_add_up_to_one(spark):
    """What is compared with is a distribution in every context; the unknown token stands for all that training hasn't."""
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d", "b c", "c a b c d", ""] * 3)]
    p, single = interpolated(rows, 3, backoff.STRENGTH)
    for context in [(), ("<s>",), ("a",), ("a", "b"), ("zz",), ("zz", "a"), ("<s>", "a")]:
        assert sum(p((*context, w)) for w in [*single, "unknown"]) == pytest.approx(1)
    same(backoff.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows, backoff.ORDER, backoff.STRENGTH))


def test_empty_table_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert backoff.scores(docs).collect() == []
    same(backoff.scores(spark.createDataFrame([(7, ""), (7, None)], "doc_id long, text string")).collect(), brute([(7, ""), (7, None)], 3, backoff.STRENGTH))
    only = next(i for i in range(100) if held(i))
    (row,) = backoff.scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.base_score == row.score == 0.0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 2.0, 5, "x")], "doc_id long, text string, score double, block int, learnt string")
    assert backoff.scores(docs).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert len(backoff.scores(docs).collect()) == 1


@pytest.mark.parametrize("keys", [[], [0], [0, 1], [5, 5 + (1 << 63)], list(range(0, 10**6, 997))])
def test_packed_keys(keys):
    keys = np.array(keys, np.uint64)
    assert backoff._unpack(backoff._pack(keys)).tolist() == keys.tolist()
    counts = np.array([1, 0, 255, 256, 70_000, 1 << 40], np.int64)
    for n in range(7):
        assert backoff._stretch(backoff._squeeze(counts[:n])).tolist() == counts[:n].tolist()

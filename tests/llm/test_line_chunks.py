import hashlib
import random
from collections import defaultdict

from foliospark.llm import line_chunks as L


def cut(text):
    """(start, stop) of the chunks of each remainder, those that lie alike once; and those of them that count."""
    lines = (text or "").split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    long = [x.count(" ") >= 49 for x in lines] + [False]
    spans = set()
    for r in range(3):
        start = 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or long[i] or long[i + 1] or (hashes[i] + (hashes[i - 1] * 31 if i else 0)) % 3 == r:
                spans.add((start, i + 1))
                start = i + 1
    return lines, {(a, b) for a, b in spans if (b - a > 1 or long[a]) and any(x.strip(" \t\r") for x in lines[a:b])}


def by_force(rows):
    seen = defaultdict(list)
    for r, (doc, text) in enumerate(rows):
        lines, spans = cut(text)
        for a, b in spans:
            seen["\n".join(lines[a:b])].append((doc, r, a, b))
    gone = set()
    for places in seen.values():
        ids = [d for d, *_ in places if d is not None]
        keeper = min(ids) if ids else None
        if len(places) > 1:
            first = {}
            for d, r, a, b in places:
                first[r] = min(a, first.get(r, a))
            gone |= {(r, i) for d, r, a, b in places if d != keeper or a > first[r] for i in range(a, b)}
    return ["\n".join(x for i, x in enumerate((text or "").split("\n")) if (r, i) not in gone) for r, (_, text) in enumerate(rows)]


PASSAGE = "\n".join(f"shared line {i}" for i in range(30))


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_lines int")
    got = L.drop_repeated_chunks(docs.withColumnRenamed("n_lines", "i")).collect()
    assert len(got) == len(rows)
    want = by_force(rows)
    for r in got:
        assert (r.text or "") == want[r.i]
        assert r.n_lines - r.removed_lines == sum(1 for _ in (r.text.split("\n") if r.text else [""])) or r.removed_lines == r.n_lines or r.text == ""


def test_against_brute_force(spark):
    rows = [(i, f"own {i}\n" + PASSAGE + f"\nend {i}") for i in range(6)]
    rows += [(10, PASSAGE + "\n" + PASSAGE), (11, None), (12, ""), (13, "\n\n\n\n"), (14, "\n\n\n\n"), (15, "single"), (16, "single"), (15, "single"), (None, PASSAGE), (3, "other\n" + PASSAGE)]
    check(spark, rows)


def test_rows_without_ids_and_repeated_rows(spark):
    check(spark, [(None, PASSAGE), (None, PASSAGE), (None, "x\n" + PASSAGE)])
    check(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)])


def test_boundaries_resist_shifts():
    texts = ["a\nb\nc\n" + PASSAGE, "q\n" + PASSAGE]
    shared = set.intersection(*({"\n".join(lines[a:b]) for a, b in spans} for lines, spans in map(cut, texts)))
    assert len({x for part in shared for x in part.split("\n")}) > 25


def test_long_lines_go_alone(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own {i}\n{long}\nother {i}\nshort line") for i in range(5)] + [(9, long), (10, f"{long} more\n{long}\n{long}")]
    check(spark, rows)
    left = {r.doc_id: r.text for r in L.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[0] == rows[0][1] and left[3] == "own 3\nother 3\nshort line" and left[9] == "" and left[10] == f"{long} more"


def test_lines_that_repeat_without_a_boundary(spark):
    # one hash throughout: its remainder ends every line, and the two others have a single chunk
    check(spark, [(i, "same\n" * (20 + i)) for i in range(4)] + [(7, "same\n" * 5000)])


def test_one_copy_of_every_line_stays(spark):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(60)] + [" ".join(f"w{k}x{i}" for i in range(55)) for k in range(6)]
    starts = [[rng.randrange(66) for _ in range(4)] for _ in range(120)]
    rows = [(d, "\n".join(x for at in own for x in lines[at : at + rng.randrange(1, 9)])) for d, own in enumerate(starts)]
    check(spark, rows)
    left = L.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in left for x in r.text.split("\n")} - {""} == {x for _, t in rows for x in t.split("\n")} - {""}


def test_most_of_a_shared_passage_goes(spark):
    docs = spark.createDataFrame([(i, f"own {i}\n{PASSAGE}") for i in range(50)], "doc_id long, text string")
    rows = {r.doc_id: r for r in L.drop_repeated_chunks(docs).collect()}
    assert rows[0].removed_lines == 0 and all(rows[i].removed_lines > 20 and f"own {i}" in rows[i].text for i in range(1, 50))


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"line {i % 5000}" for i in range(20_000))
    check(spark, [(1, long)])
    assert L.drop_repeated_chunks(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", "de", "x", 1, "k", "r", "p")], "doc_id long, text string, lang string, source string, removed_lines int, k1 string, r1 string, pos string")
    done = L.drop_repeated_chunks(docs)
    assert done.columns == ["doc_id", "text", "lang", "source", "k1", "r1", "pos", "n_lines", "removed_lines"]
    assert tuple(done.first()) == (1, "a", "de", "x", "k", "r", "p", 1, 0)

from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import dates
from foliospark.functions import text as X


def one(spark, column, *values, names=("a", "b", "c")):
    schema = ", ".join(f"{n} string" for n in names[: len(values[0])])
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.x for r in rows.withColumn("x", column).orderBy("i").collect()]


#: Syllables that names of the tests are put together from.
SYLLABLES = ("lo", "mir", "tå", "Quel", "Ørb", "neß", "7", "ka2")


def made(seed, words, gap=" "):
    """A name of so many words, which follow from the seed alone."""
    parts = ["".join(SYLLABLES[(seed * 5 + w * 3 + k * k) % len(SYLLABLES)] for k in range(1 + (seed + w) % 4)) for w in range(words)]
    return gap.join(parts)


def test_characters_that_no_name_may_hold_become_spaces(spark):
    for seed, bad in enumerate('\\/:*?"<>|\x01\x1f\x7f'):
        one_, two = made(seed, 2), made(seed + 7, 1)
        assert one(spark, X.clean_name(F.col("a"), 200), (f"{one_}{bad}{two}",), (f"{bad}{one_}{bad}{bad} {two}{bad}",)) == [f"{one_} {two}"] * 2, repr(bad)


def test_names_lose_what_surrounds_them(spark):
    names = [made(seed, 1 + seed % 4) for seed in range(12)]
    around = [(" ", "  "), ("..", "."), (" . ", ".. "), ("\u00a0", "\ufeff"), ("\u3000.", "\t")]
    dressed = [(before + n.replace(" ", "\u2003 ") + after, n) for n in names for before, after in around]
    assert one(spark, X.clean_name(F.col("a"), 100), *[(d,) for d, _ in dressed]) == [n for _, n in dressed]
    assert one(spark, X.clean_name(F.col("a"), 9), ("",), ("  ",), ("...",), (None,)) == ["", "", "", None]


def test_names_of_devices_get_a_mark(spark):
    devices = ["con", "prn", "aux", "nul", *(f"{d}{k}" for d in ("com", "lpt") for k in range(1, 10))]
    spelled = [f(d) + end for d in devices for f, end in ((str.upper, ""), (str.title, ".b"), (str.lower, ".c.d"))]
    assert one(spark, X.clean_name(F.col("a"), 40), *[(n,) for n in spelled]) == [f"_{n}" for n in spelled]
    free = [d + "x" for d in devices] + ["com0", "com10", "lpt", "console.x"]
    assert one(spark, X.clean_name(F.col("a"), 40), *[(n,) for n in free]) == free


def test_names_are_composed(spark):
    import unicodedata

    names = [made(seed, 3) for seed in range(6)]
    assert one(spark, X.clean_name(F.col("a"), 100), *[(unicodedata.normalize("NFD", n),) for n in names]) == names


def cut(words, most, gap):
    """As many whole words as fit; of a first word that doesn't, its beginning."""
    while len(words) > 1 and len(gap.join(words)) > most:
        words = words[:-1]
    return gap.join(words)[:most]


@pytest.mark.parametrize("most", [1, 7, 20, 41])
def test_long_names_and_slugs_are_cut_between_words(spark, most):
    texts = [made(seed, 1 + seed % 9) for seed in range(20)]
    assert one(spark, X.clean_name(F.col("a"), most), *[(t,) for t in texts]) == [cut(t.split(), most, " ") for t in texts]
    short = [" ".join(w[:most] for w in t.split())[: 2 * most].rpartition(" ")[0] or t[:most] for t in texts]
    assert one(spark, X.slug(F.col("a"), most), *[(t,) for t in short]) == [cut(t.split(), most, "-") for t in short]


def test_slugs_keep_letters_digits_and_joints(spark):
    for seed, mark in enumerate("!,;()[]{}'&%$§=+~#@"):
        one_, two = made(seed, 1), made(seed + 3, 2)
        assert one(spark, X.slug(F.col("a"), 200), (f"{one_}{mark} {two}",), (f"{mark}{one_} {mark} {two}{mark}",)) == [f"{one_}-{two.replace(' ', '-')}"] * 2, mark
    assert one(spark, X.slug(F.col("a"), 50), ("a_b.c-d",), ("..a--b..",), ("-_x",), ("-.-",), ("",)) == ["a_b.c-d", "a-b", "_x", "", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=80), min_size=1, max_size=20))
def test_names_are_valid_and_stable(spark, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    names = one(spark, X.clean_name(F.col("a"), 30), *[(t,) for t in texts])
    for n in names:
        assert len(n) <= 31 and not set(n) & set('\\/:*?"<>|\n\t') and not n.startswith(".")
    again = one(spark, X.clean_name(F.col("a"), 31), *[(n,) for n in names])
    assert again == names


def test_dates_of_the_calendar(spark):
    """Days around the ends of the span, and every spelling of one of them."""
    now = datetime(2031, 5, 11, 9)
    first, last = date(dates.EARLIEST_YEAR, 1, 1), now.date() + timedelta(days=dates.DAYS_AHEAD)
    days = [d + timedelta(days=k) for d in (first, last, date(2028, 2, 29)) for k in (-400, -1, 0, 1)]
    good = [first <= d <= last for d in days]
    assert one(spark, dates.valid_date(F.col("a"), now), *[(d.isoformat(),) for d in days]) == [d.isoformat() if g else None for d, g in zip(days, good)]
    never = [f"{y}-02-{29 + y % 4 // 3}" for y in (2021, 2022, 2023)] + ["2024-00-10", "2024-13-01", "2024-06-31", "2024-1-01", "24-01-01", "01.02.2024", "2024/01/02", "2024-01-02T00", "x", ""]
    assert one(spark, dates.valid_date(F.col("a"), now), *[(n,) for n in never]) == [None] * len(never)
    assert one(spark, dates.valid_date(F.col("a"), now), ("\t 2024-01-02\u00a0",), (None,)) == ["2024-01-02", None]


def test_words_and_white_space(spark):
    assert one(spark, X.is_plausible(F.col("a")), ("ab",), ("a",), ("a.",), ("abcd...",), ("abc.",), ("",)) == [True, False, False, False, True, False]
    assert one(spark, F.array_join(X.tokens(F.col("a")), "|"), (" a b c\n",), (None,)) == ["a|b|c", ""]
    assert one(spark, X.collapse(F.col("a")), ("﻿ a 　 b ",)) == ["a b"]
    assert one(spark, X.without_controls(F.col("a")), ("\x01a\x7fb\n",)) == ["a b"]


def test_settings_and_languages(spark):
    assert one(spark, X.flag(F.col("a")), (" Ja ",), ("ON",), ("",), ("none",), ("maybe",), (None,)) == [True, True, False, False, None, False]
    installed = F.split(F.col("b"), ",")
    picked = X.pick_languages(F.col("a"), installed, F.col("c"))
    assert one(spark, picked, ("de-DE", "eng,deu,osd", ""), ("fr-FR", "eng,deu", ""), ("de-DE", "eng", "deu+fra"), ("en-US", "osd,fra", ""), ("xx", "osd", " ")) == ["deu+eng", "eng", "deu+fra", "fra", "eng"]
    assert one(spark, X.language_code(F.col("a")), ("de_AT",), ("PT",), ("xx",)) == ["deu", "por", None]
    assert one(spark, F.array_join(X.list_setting(F.col("a")), "|"), (" A ; ;B;",), (None,)) == ["A|B", ""]
    assert one(spark, X.model_name_ok(F.col("a")), ("gpt-x:1/2",), ("a b",), ("x" * 101,), (None,)) == [True, False, False, False]


def test_numbers_and_paths(spark):
    rows = spark.range(1).select(*[X.number(F.lit(v).cast("double")).alias(str(i)) for i, v in enumerate((1.0, 0.12346, -2.5, 100.0, 0.00001, float("nan"), float("inf")))]).first()
    assert list(rows) == ["1", "0.1235", "-2.5", "100", "0", "0", "0"]
    assert one(spark, X.base_name(F.col("a")), ("/x/Scan 1.v2.PDF",), ("a.pdf",), (".hidden",), ("none",)) == ["Scan 1.v2", "a", ".hidden", "none"]
    assert one(spark, X.log_value(F.col("a")), ("plain",), ("two words",), ('q"',), ("a=b",)) == ["plain", '"two words"', '"q\\""', '"a=b"']
    assert one(spark, X.json_quoted(F.col("a")), ('ü"\n',)) == ['"ü\\"\\n"']


@pytest.mark.parametrize("length", [299, 300, 301])
def test_errors_are_shortened(spark, length):
    assert len(one(spark, X.shortened(F.col("a")), ("x" * length,))[0]) == min(300, length)

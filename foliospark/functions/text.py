"""Text functions. White space is the whole Unicode class everywhere, and lengths count code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that names and layers are split and trimmed on, for use within a character class
SPACE = "\\t\\n\\x0B\\f\\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
# Characters that no file name may hold, and names that devices have
FORBIDDEN = "[\\\\/:*?\"<>|\\x00-\\x1f\\x7f]"
RESERVED = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$"
WORD_CHARACTER = "\\p{L}\\p{N}"
# Language subtag to the code of the local recogniser
LANGUAGES = {
    "de": "deu", "en": "eng", "fr": "fra", "es": "spa", "it": "ita", "nl": "nld", "pt": "por", "sv": "swe", "da": "dan",
    "fi": "fin", "nb": "nor", "no": "nor", "pl": "pol", "cs": "ces", "tr": "tur", "hu": "hun", "ru": "rus", "ro": "ron",
}
# What counts as yes and as no
YES = ("true", "1", "yes", "on", "ja")
NO = ("", "false", "0", "no", "off", "nein", "none")
MODEL_NAME = "^[A-Za-z0-9_.:\\-/]{1,100}$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonical composition; the one text function that the engine has no built-in for."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def shown_of_markup(html: Column) -> Column:
    """Text of a web page without its scripts, styles, comments and tags, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", ""), "<[^>]*>", " "))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def has_text(text: Column) -> Column:
    """Whether without_controls() leaves anything, told without working it out."""
    return text.rlike(f"[^\\x00-\\x1f\\x7f{SPACE}]")


def without_controls(text: Column) -> Column:
    return trim(F.regexp_replace(text, "[\\x00-\\x1f\\x7f]", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda t: t != "")


def is_plausible(token: Column) -> Column:
    """A word: two letters or digits at least, and seven in ten of its characters."""
    return let(F.length(F.regexp_replace(token, f"[^{WORD_CHARACTER}]", "")), lambda n: (n >= 2) & (n / F.greatest(F.length(token), F.lit(1)) >= 0.7))


def _settling(text: Column, most: int) -> Column:
    """The part of a text that settles its name of `most` characters, or the whole text if that is shorter.

    It ends right before an ASCII letter or digit, which composes with nothing before it, and holds more than `most` of them,
    each a visible character of the name. What follows can neither change the first `most` characters nor make the name fit.
    """
    plain = "A-Za-z0-9"
    head = F.regexp_extract(text, f"(?s)\\A((?:[^{plain}]*+[{plain}]){{{most + 1}}}[^{plain}]*+)[{plain}]", 1)
    return F.when(head != "", head).otherwise(text)


def clean_name(text: Column, most: int, composed: bool = False) -> Column:
    """A file or folder name that is valid everywhere, of at most `most` characters (one more where `_` is put before).

    A name that is too long loses its last, partial word; only a single long word is cut hard. composed: the text is in
    canonical composition already. Null stays null.
    """
    space = f"[{SPACE}]"
    part = _settling(text, most)
    raw = part if composed else nfc(part)

    def fitted(t):
        head = F.substring(t, 1, most)
        words = trim(F.regexp_replace(head, f"{space}+[^{SPACE}]*$", ""))
        return F.when(F.length(t) <= most, t).when(words != "", words).otherwise(trim(head))

    cleaned = let(collapse(F.regexp_replace(raw, FORBIDDEN, " ")), fitted)
    bare = F.regexp_replace(cleaned, f"^[.{SPACE}]+|[.{SPACE}]+$", "")
    return let(bare, lambda t: F.when(t.rlike(RESERVED), F.concat(F.lit("_"), t)).otherwise(t))


def slug(text: Column, most: int, composed: bool = False) -> Column:
    """Words joined by hyphens, for a part of a file name: letters, digits, `-`, `_` and `.` stay; cut between words."""
    dashed = F.regexp_replace(clean_name(text, most * 2, composed), f"[{SPACE}]+", "-")
    kept = F.regexp_replace(F.regexp_replace(dashed, f"[^{WORD_CHARACTER}_.-]", ""), "-{2,}", "-")

    def fitted(t):
        head = F.substring(t, 1, most)
        words = F.when(F.substring(t, most + 1, 1) == "-", head).otherwise(F.regexp_replace(head, "-[^-]*$", ""))
        return F.when(F.length(t) <= most, t).otherwise(let(words, lambda w: F.regexp_replace(F.when(w != "", w).otherwise(head), "[-.]+$", "")))

    return let(F.regexp_replace(kept, "^[-.]+|[-.]+$", ""), fitted)


def number(value: Column) -> Column:
    """At most four decimals, without trailing zeros; 0 for what isn't finite.

    A value that is written with four decimals at most anyway is taken as it is written, as formatting takes far longer.
    """
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    written, size = value.cast("double").cast("string"), F.abs(value)
    short = ((size == 0) | (size >= 1e-3)) & (size < 1e7) & (F.length(F.substring_index(written, ".", -1)) <= 4)
    text = F.when(short, written).otherwise(F.format_string("%.4f", F.when(finite, value).otherwise(0.0)))
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def base_name(path: Column) -> Column:
    """Last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), "(?<=.)\\.[^.]*$", "")


def list_setting(text: Column) -> Column:
    """Parts between semicolons, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), trim), lambda t: t != "")


def flag(text: Column) -> Column:
    """true or false; null for a value that is neither (an error to the caller)."""
    return let(F.lower(trim(F.coalesce(text, F.lit("")))), lambda v: F.when(v.isin(*YES), True).when(v.isin(*NO), False))


def model_name_ok(text: Column) -> Column:
    return F.coalesce(text.rlike(MODEL_NAME), F.lit(False))


def language_code(locale: Column) -> Column:
    """Recogniser's code of a locale such as de-DE; null for an unknown language."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.get(F.split(locale, "[-_]"), F.lit(0))))


def pick_languages(locale: Column, installed: Column, override: Column) -> Column:
    """override unless blank; else the locale's language and English, as far as installed, joined by +; else the first
    installed one that isn't `osd`, else eng."""
    wanted = F.array_distinct(F.filter(F.array(language_code(locale), F.lit("eng")), lambda c: c.isNotNull() & F.array_contains(installed, c)))
    other = F.coalesce(F.get(F.filter(installed, lambda c: c != "osd"), F.lit(0)), F.lit("eng"))
    return F.when(~is_blank(override), trim(override)).when(F.size(wanted) > 0, F.array_join(wanted, "+")).otherwise(other)


def json_quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("t"))), "^\\{\"t\":|\\}$", "")


def log_value(text: Column) -> Column:
    """Quoted if it holds white space, a quote or an equals sign."""
    return F.when(text.rlike(f"[{SPACE}\"=]"), json_quoted(text)).otherwise(text)


def shortened(text: Column, most: int = 300) -> Column:
    return F.substring(text, 1, most)

"""Content streams of pages: taking out invisible text, counting visible characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import is_blank

VISIBLE_MODES = frozenset((0, 1, 2, 4, 5, 6))
SHOWING = frozenset((b"Tj", b"TJ", b"'", b'"'))
DEEPEST = 3

_LEXEME = re.compile(
    rb"(?P<skip>[\x00\t\n\x0c\r ]+|%[^\n\r]*|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|<(?!<)[^>]*>?|[)<>\[\]{}])"
    rb"|(?P<string>\()"
    rb"|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)"
)
_IN_STRING = re.compile(rb"\\.|[()]", re.DOTALL)
_IMAGE_END = re.compile(rb"(?<=[\x00\t\n\x0c\r ])EI(?=[\x00\t\n\x0c\r ]|$)")


def _after_string(data: bytes, at: int) -> int:
    depth = 0
    for m in _IN_STRING.finditer(data, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth and m[0] == b")":
            return m.end()
    return len(data)


def words(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Operators and numbers with their places. What strings, names, comments and inline images hold is none."""
    at = 0
    while m := _LEXEME.match(data, at):
        at = m.end()
        if m["string"]:
            at = _after_string(data, m.start())
        elif m["word"]:
            yield m["word"], m.start(), at
            if m["word"] == b"ID":
                end = _IMAGE_END.search(data, at + 1)
                at = end.end() if end else len(data)


def _mode(operand: bytes, now: int) -> int:
    try:
        value = float(operand) if operand else 0.0
    except ValueError:
        return now
    return int(value) if value == value and abs(value) < 1e9 and value == int(value) else now


def without_invisible_text(data: bytes) -> bytes:
    """The stream without the text objects that draw nothing visible; all else stays byte for byte.

    The rendering mode is followed through the graphics state, as it may be set outside of the object. An object that isn't
    closed runs to the end. Inside a text object, saving and restoring doesn't occur and is not followed.
    """
    gone: list[tuple[int, int]] = []
    mode, saved, before, begun, visible = 0, [], b"", -1, False
    for word, start, end in words(data):
        if word == b"Tr":
            mode = _mode(before, mode)
        elif begun >= 0:
            if word == b"ET":
                if not visible:
                    gone.append((begun, end))
                begun = -1
            visible = visible or (word in SHOWING and mode in VISIBLE_MODES)
        elif word == b"BT":
            begun, visible = start, False
        elif word == b"q":
            saved.append(mode)
        elif word == b"Q" and saved:
            mode = saved.pop()
        before = word if word != b"BT" or begun != start else b""
    if begun >= 0 and not visible:
        gone.append((begun, len(data)))
    kept, at = [], 0
    for start, end in gone:
        kept += [data[at:start], b"\n"]
        at = end
    return b"".join([*kept, data[at:]])


def glyphs(argument, depth: int = 0) -> int:
    """Glyphs within the nested arguments of a showing operator; white space counts none."""
    if isinstance(argument, list):
        return 0 if depth >= DEEPEST else sum(glyphs(a, depth + 1) for a in argument)
    if isinstance(argument, dict) and "unicode" in argument:
        u = argument["unicode"]
        return 0 if isinstance(u, str) and u and not u.strip() else 1
    return 0


def visible_characters(operators: list[tuple[str, list]]) -> int:
    """Visible glyphs of a page's operator list of (name, arguments): save, restore, form_begin, form_end, mode, show."""
    mode, saved, n = 0, [], 0
    for name, arguments in operators:
        if name in ("save", "form_begin"):
            saved.append(mode)
        elif name in ("restore", "form_end"):
            mode = saved.pop() if saved else mode
        elif name == "mode":
            mode = arguments[0] if arguments else None
        elif name == "show" and mode in VISIBLE_MODES:
            n += glyphs(arguments)
    return n


@F.pandas_udf(T.BinaryType())
def strip_invisible(streams: pd.Series) -> pd.Series:
    return streams.map(lambda s: None if s is None else without_invisible_text(bytes(s)))


@F.pandas_udf(T.BinaryType())
def joined_and_stripped(streams: pd.Series) -> pd.Series:
    """Content streams of a page (an array) are one stream: the state goes on from part to part."""
    return streams.map(lambda parts: None if parts is None else without_invisible_text(b"\n".join(bytes(p) for p in parts)))


def visible_count(pages: Column | str) -> Column:
    """Visible glyphs of each page's operators (int), an array of (name, mode, glyphs); glyphs are what each shows, in order.

    A fold over the operators, whose state is the mode, those that were saved, and the count. Null for null.
    """
    operators = F.col(pages) if isinstance(pages, str) else pages

    def shown(glyphs):
        return F.size(F.filter(F.coalesce(glyphs, F.array().cast("array<string>")), lambda g: g.isNull() | (g == "") | ~is_blank(g)))

    def step(state, o):
        opens, closes, some = o["name"].isin("save", "form_begin"), o["name"].isin("restore", "form_end"), F.size(state["saved"]) > 0
        mode = F.when(closes & some, F.element_at(state["saved"], -1)).when(o["name"] == "mode", o["mode"]).otherwise(state["mode"])
        saved = F.when(opens, F.concat(state["saved"], F.array(state["mode"]))).when(closes & some, F.slice(state["saved"], F.lit(1), F.greatest(F.lit(0), F.size(state["saved"]) - 1))).otherwise(state["saved"])
        seen = (o["name"] == "show") & F.coalesce(state["mode"].isin(*sorted(VISIBLE_MODES)), F.lit(False))
        return F.struct(mode.alias("mode"), saved.alias("saved"), (state["n"] + F.when(seen, shown(o["glyphs"])).otherwise(0)).alias("n"))

    start = F.struct(F.lit(0).alias("mode"), F.array().cast("array<int>").alias("saved"), F.lit(0).alias("n"))
    return F.aggregate(operators, start, step, lambda state: state["n"])


@F.pandas_udf(T.MapType(T.StringType(), T.BinaryType()))
def stripped_forms(forms: pd.Series, roots: pd.Series) -> pd.Series:
    """strip_forms() of each page: forms is an array of (name, stream, inner), roots one of names."""

    def strip(own, names):
        if own is None or names is None:
            return None
        return strip_forms({f["name"]: (bytes(f["stream"]), list(f["inner"])) for f in own}, list(names))

    return pd.Series([strip(own, names) for own, names in zip(forms, roots)])


def strip_forms(forms: dict[str, tuple[bytes, list[str]]], roots: list[str], deepest: int = 5) -> dict[str, bytes]:
    """Stripped streams of the forms that can be reached from roots, each once, at most `deepest` levels down.

    forms: name to its stream and the names of the forms within it.
    """
    done: dict[str, bytes] = {}
    level = list(roots)
    for _ in range(deepest + 1):
        fresh = [n for n in dict.fromkeys(level) if n in forms and n not in done]
        for name in fresh:
            done[name] = without_invisible_text(forms[name][0])
        level = [inner for name in fresh for inner in forms[name][1]]
    return done

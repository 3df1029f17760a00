"""SQL forms of the text functions, for the comparison with another engine."""

from __future__ import annotations

from foliospark.functions.text import FORBIDDEN, SPACE, WORD_CHARACTER

_S = SPACE.replace("\\x0B", "\\x0b")


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{_S}]+', ' ', 'g')")


def blank(x: str) -> str:
    return f"NOT regexp_matches(coalesce({x}, ''), '[^{_S}]')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '[{_S}]+'), lambda t: t <> '')"


def plausible(t: str) -> str:
    alnum = f"length(regexp_replace({t}, '[^{WORD_CHARACTER}]', '', 'g'))"
    return f"({alnum} >= 2 AND {alnum} / greatest(length({t}), 1) >= 0.7)"


def clean_name(x: str, most: int) -> str:
    """Nested lateral steps as one expression: list_transform stands for a let."""
    forbidden = FORBIDDEN.replace("'", "''")
    start = collapse(f"regexp_replace(nfc_normalize({x}), '{forbidden}', ' ', 'g')")
    head = f"substring(t, 1, {most})"
    words = trim(f"regexp_replace({head}, '[{_S}]+[^{_S}]*$', '')")
    fitted = f"CASE WHEN length(t) <= {most} THEN t WHEN {words} <> '' THEN {words} ELSE {trim(head)} END"
    bare = f"regexp_replace(list_transform([{start}], lambda t: {fitted})[1], '^[.{_S}]+|[.{_S}]+$', '', 'g')"
    return f"list_transform([{bare}], lambda t: CASE WHEN regexp_matches(t, '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$', 'i') THEN '_' || t ELSE t END)[1]"


def slug(x: str, most: int) -> str:
    dashed = f"regexp_replace({clean_name(x, most * 2)}, '[{_S}]+', '-', 'g')"
    kept = f"regexp_replace(regexp_replace({dashed}, '[^{WORD_CHARACTER}_.-]', '', 'g'), '-{{2,}}', '-', 'g')"
    edged = f"regexp_replace({kept}, '^[-.]+|[-.]+$', '', 'g')"
    head = f"substring(t, 1, {most})"
    words = f"CASE WHEN substring(t, {most + 1}, 1) = '-' THEN {head} ELSE regexp_replace({head}, '-[^-]*$', '') END"
    return f"list_transform([{edged}], lambda t: CASE WHEN length(t) <= {most} THEN t ELSE regexp_replace(coalesce(nullif({words}, ''), {head}), '[-.]+$', '') END)[1]"

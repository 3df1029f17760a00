"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans, which always stay. Around them a field is laid over the suspicious tokens of a document:
neighbours share chain potentials, and distant tokens that are equal or alike share skip potentials. Loopy message
passing then carries a label that one mention has to the mentions that no pattern catches. What it adds carries the kinds
`linked_email`, `linked_ip`, `linked_card`, `linked_phone` and `secret`. The weights are learnt together, from documents
to which altered mentions of their own spans are added; see lessons().
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import hashed_share, map_columns, read_table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
ADDED = (None, *[f"linked_{k}" for k in KINDS], "secret")
ORDER = {k: i for i, k in enumerate([*KINDS, *[a for a in ADDED if a]])}
SECRET = len(LABELS) - 1
SAME, ALIKE = 0, 1
#: Kinds of links: two of neighbours, two of distant tokens.
LINKS = 4
#: Documents that the field's weights are learnt from, a sample by hash; what they teach comes to the driver as counts of
#: different patterns.
FIT_ROWS = 8_000
#: Tokens that a value in groups may have.
GROUPS = 8
ROUNDS = 40
DAMPING = 0.3
#: Marginal probability from which a label is added.
CERTAIN = 0.6

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # starts within a number can't do better
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]+")
_SECRET_SHAPE = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_BARE = re.compile(r"(?<!\S)[A-Za-z._%+-]{4,}[,;:!?]*(?!\S)")
_SPACE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, in the order of start and kind; places count code points."""
    found = []
    floor, at = 0, text.find("@")
    while at >= 0:  # a match holds one at sign; all starts before it fare alike, so the first will do
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end(), "email"))
            floor = m.end()
        at = text.find("@", floor)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


@dataclass(frozen=True)
class Field:
    """Weights of the field, all learnt together: unary (features x labels), and symmetric tables of labels by kind of link."""

    unary: tuple[tuple[float, ...], ...]
    chain: tuple[tuple[float, ...], ...]
    group: tuple[tuple[float, ...], ...]
    same: tuple[tuple[float, ...], ...]
    alike: tuple[tuple[float, ...], ...]


FEATURES = ("bias", "at sign", "dotted", "digits only", "12 to 19 digits", "luhn", "9 to 15 digits", "long token", "hex", "letters and digits", "plus", "after = or :", "few digits", "number before", "number after", "few digits alone", "long hex after = or :")
_EDGE = ".,;:!?()[]{}\"'#$%&*|"
_NUMBER = re.compile("[0-9]+")
_ALNUM = re.compile(r"[\W_]+")


@dataclass
class _Token:
    start: int
    end: int
    text: str
    before: str
    after: str
    known: int  # label of the base span that covers part of it, or -1
    whole: str  # digits of the base span that ends in it, if that has other tokens too


def _features(token: _Token) -> list[float]:
    token, before, after = token.text, token.before, token.after
    digits = _digits(token)
    n = len(digits)
    core = token.strip(_EDGE)
    left, right = before[-1:].isdigit() or before[-1:] == ")", after[:1].isdigit() or after[:1] in ("(", "+") and after[1:2].isdigit()
    assigned = before.rstrip("\"'| ").endswith(("=", ":"))
    return [
        1.0, "@" in token, core.count(".") >= 3, bool(core) and n == len(core), 12 <= n <= 19, 12 <= n <= 19 and _luhn(digits), 9 <= n <= 15, len(core) >= 20,
        len(core) >= 20 and all(c in "0123456789abcdefABCDEF" for c in core), bool(n) and any(c.isalpha() for c in core), core.startswith("+"), assigned, n < 5, left, right, n < 5 and not left and not right, assigned and _shaped_like_a_secret(core),
    ]


def _tokens(text: str, spans: list[tuple[int, int, str]]) -> list[_Token]:
    """Maximal runs without white space that hold a digit or an at sign, and those that repeat an address's local part.

    A base span over several runs gives one token for each of them.
    """
    places = []
    at, n = 0, len(text)
    while m := _DIGIT_OR_AT.search(text, at):
        start, end = m.start(), m.end()
        while start and text[start - 1] not in _SPACE:
            start -= 1
        while end < n and text[end] not in _SPACE:
            end += 1
        places.append((start, end))
        at = end
    names = {text[s:e].split("@")[0] for s, e, k in spans if k == "email"}
    if names:
        places += [(m.start(), m.start() + len(bare)) for m in _BARE.finditer(text) if (bare := m[0].rstrip(".,;:!?")) in names]
    tokens, k = [], 0
    for start, end in sorted(set(places)):
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        j, known, whole = k, -1, ""
        while j < len(spans) and spans[j][0] < end:
            if spans[j][1] > start:
                known = KINDS.index(spans[j][2]) + 1
                if spans[j][0] < start and spans[j][1] <= end:
                    whole = _digits(text[spans[j][0] : spans[j][1]])
                break
            j += 1
        tokens.append(_Token(start, end, text[start:end], text[max(0, start - 12) : start].rstrip(" "), text[end : end + 4].lstrip(" "), known, whole))
    return tokens


def _numbers(token: _Token) -> list[str]:
    """The digits that a token stands for: of one that ends a base span over several, those of the span."""
    return [d for d in [token.whole or _digits(token.text)] if len(d) >= 7]


def _grams(bare: str) -> set[str]:
    letters = _ALNUM.sub("", bare)
    return {letters[i : i + 4] for i in range(len(letters) - 3)}


def _keys(token: _Token) -> list[tuple[str, int]]:
    """What mentions of one thing have in common, and the kind of link that it makes.

    SAME: the bare token, all its digits, four numbers or more whatever parts them. ALIKE: the digits' head or tail, an address's local part, and the two four-letter
    pieces with the smallest checksums, by which links are only made if half of all pieces are shared. Heads and tails only link
    digits of which the one begin or end with all the others.
    """
    bare = token.text.strip(_EDGE).casefold()
    keys = [(f"b{bare}", SAME)] if len(bare) > 4 else []
    for digits in {_digits(bare), token.whole}:
        if len(digits) >= 7:
            keys += [(f"d{digits}", SAME), (f"t{digits[-7:]}", ALIKE)]
            if len(digits) >= 10:
                keys.append((f"h{digits[:8]}", ALIKE))
    if len(groups := _NUMBER.findall(bare)) > 3:
        keys.append(("n" + "-".join(groups), SAME))
    if len(local := bare.split("@")[0]) > 3:
        keys.append((f"l{local}", ALIKE))
        if "@" in bare and len(letters := _ALNUM.sub("", local)) > 5:
            keys.append((f"a{letters}", ALIKE))
    if len(bare) >= 10:
        keys += [(f"g{g}", ALIKE) for g in sorted(_grams(bare), key=lambda g: zlib.crc32(g.encode()))[:2]]
    return keys


def _within(a: str, b: str, ends: bool) -> bool:
    """Whether the one number begins (or ends) with all of the other, zeros before it aside."""
    a, b = sorted((a.lstrip("0"), b.lstrip("0")), key=len) if ends else sorted((a, b), key=len)
    return bool(a) and (b.endswith(a) if ends else b.startswith(a))


def _grouped(tokens: list[_Token], chain: set[tuple[int, int]]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Values in groups: skip links of the first of tokens that follow one another to the base span's token whose digits, or whose
    last nine at least, they have together; and the chain links between such tokens, by which alone the others hang on the first."""
    ends: dict[str, int] = {}
    for i, t in enumerate(tokens):
        if t.known >= 0:
            digits = t.whole or _digits(t.text)
            for n in range(len(digits) if len(digits) < 9 else 9, len(digits) + 1):
                if n >= 6:
                    ends.setdefault(digits[-n:], i)
    found, inner = set(), set()
    for i, t in enumerate(tokens if ends else []):
        if t.known >= 0:
            continue
        together = _digits(t.text)
        for j in range(i + 1, min(len(tokens), i + GROUPS)):
            if (j - 1, j) not in chain or tokens[j].known >= 0:
                break
            together += _digits(tokens[j].text)
            if (at := ends.get(together.lstrip("0"))) is not None and at != i:
                found.add((min(i, at), max(i, at)))
                inner |= {(k, k + 1) for k in range(i, j)}
    return found, inner


def _links(tokens: list[_Token]) -> tuple[list[tuple[int, int]], ...]:
    """Chain links of tokens next to each other, those within a value in groups apart from the others; skip links SAME and ALIKE, each
    of an earlier and a later token.

    A token is linked to the one before it with which it shares a key, and to the first base span of each kind that shares
    one, so that evidence is one link away however many mentions lie between. A pair has one link, the strongest. Time and
    links are in proportion to the tokens.
    """
    chain = {(i - 1, i) for i in range(1, len(tokens)) if tokens[i].start - tokens[i - 1].end <= 2}
    keys = [_keys(t) for t in tokens]
    first: dict[str, dict[int, int]] = {}
    for i, t in enumerate(tokens):
        if t.known >= 0:
            for k, _ in keys[i]:
                first.setdefault(k, {}).setdefault(t.known, i)
    last: dict[str, int] = {}
    found: tuple[set, set] = (set(), set())
    for i in range(len(tokens)):
        for k, kind in keys[i]:
            for j in {*first.get(k, {}).values(), *([last[k]] if k in last else [])} - {i}:
                if k[0] == "g":
                    a, b = _grams(tokens[i].text.casefold()), _grams(tokens[j].text.casefold())
                    if 2 * len(a & b) < len(a | b):
                        continue
                if k[0] in "th" and not any(_within(a, b, k[0] == "t") for a in _numbers(tokens[i]) for b in _numbers(tokens[j])):
                    continue
                found[kind].add((min(i, j), max(i, j)))
            last[k] = i
    firsts, inner = _grouped(tokens, chain)
    same = (found[SAME] | firsts) - chain
    return sorted(chain - inner), sorted(inner), sorted(same), sorted(found[ALIKE] - same - chain)


def _shaped_like_a_secret(core: str) -> bool:
    return bool(_SECRET_SHAPE.fullmatch(core)) and any(c.isalpha() for c in core) and any("0" <= c <= "9" for c in core)


def _taught_label(token: _Token) -> int:
    """Label that a token has for learning: its base span's, secret for a long key that something is set to, else none."""
    if token.known >= 0:
        return token.known
    assigned = token.before.rstrip("\"'| ").endswith(("=", ":"))
    return SECRET if assigned and _shaped_like_a_secret(token.text.strip(_EDGE)) else 0


def _altered(value: str, label: int, turn: int) -> str:
    """A form of a value that the patterns don't catch but a reader knows again."""
    digits = _digits(value)
    if label == SECRET:
        return value
    if LABELS[label] == "email":
        return value.split("@")[0]
    if LABELS[label] == "ip":
        return value.replace(".", " " if turn % 2 else "-")
    if LABELS[label] == "card":
        return digits[-10:] if turn % 2 else "/".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if turn % 5 > 2:
        return _in_groups(digits[-10:], turn)
    return (digits, digits[-10:], digits[-7:-4] + "-" + digits[-4:])[turn % 5]


def _in_groups(digits: str, seed: int) -> str:
    """Digits in groups of two to four, which follow from the seed."""
    out, at = [], 0
    while at < len(digits):
        size = 2 + (seed >> at) % 3
        out.append(digits[at : at + size])
        at += size
    return " ".join(out)


def _another(value: str, seed: int) -> str:
    """A value of the same shape that names something else."""
    return "".join(str((int(c) + 1 + (seed + 7 * i) % 8) % 10) if "0" <= c <= "9" else "fedcba"[(ord(c) + seed) % 6] if c in "abcdef" else c for i, c in enumerate(value))


def lessons(text: str) -> list[tuple[str, int]]:
    """What one text teaches: (pattern, label) of each token whose label the patterns don't say.

    Every value that the text has labelled is told again behind it in an altered form, next to
    another value of the same form that has no label. So a form alone doesn't say whether a token is personal data, and the
    weights of links can only be learnt from what distant mentions have. A pattern has the token's features, and how many
    neighbours with each label it has by each kind of link, three at most. Half of the secrets aren't told again, as their
    own form must be learnt too, and half of the rest is told twice.
    """
    spans = base_spans(text)
    values: dict[int, dict[str, None]] = {}
    for s, e, k in spans:
        values.setdefault(KINDS.index(k) + 1, {})[text[s:e]] = None
    for t in _tokens(text, spans):
        if t.known < 0 and _taught_label(t) == SECRET:
            values.setdefault(SECRET, {})[t.text.strip(_EDGE)] = None
    told, parts, at = {}, [text], len(text)
    for label, some in values.items():
        for turn, value in enumerate(some):
            seed = zlib.crc32(value.encode())
            form = _altered(value, label, seed + turn)
            forms = [] if label == SECRET and seed % 2 else [(form, label), (_another(form, seed), 0)]
            for form, own in forms * (1 + (seed >> 1) % 2):
                lead = "\nagain, "
                told[at + len(lead), at + len(lead) + len(form)] = own
                parts += [lead, form, " then"]
                at += len(lead) + len(form) + 5
    whole = "".join(parts)
    tokens = _tokens(whole, base_spans(whole))
    labels, places, k = [], sorted(told.items()), 0
    for t in tokens:
        while k < len(places) and places[k][0][1] <= t.start:
            k += 1
        inside = k < len(places) and places[k][0][0] < t.end
        labels.append(t.known if t.known >= 0 else places[k][1] if inside else _taught_label(t))
    counts = np.zeros((len(tokens), LINKS, len(LABELS)), int)
    for kind, pairs in enumerate(_links(tokens)):
        for i, j in pairs:
            counts[i, kind, labels[j]] += 1
            counts[j, kind, labels[i]] += 1
    near = np.minimum(counts, 3).reshape(len(tokens), LINKS * len(LABELS))
    return [("".join(str(int(x)) for x in [*_features(t), *near[i]]), labels[i]) for i, t in enumerate(tokens) if t.known < 0]


def learn(patterns: dict[tuple[str, int], int]) -> Field:
    """Weights that maximise the regularised pseudo-likelihood of the patterns' labels, with how often each was met.

    Unary, chain and skip weights are learnt together, by gradient ascent with momentum; the tables of links are kept
    symmetric. Each pattern counts with the square root of its number, so that the commonest don't drown the others.
    """
    n, f = len(LABELS), len(FEATURES)
    weight = np.zeros((f + LINKS * n, n))
    if patterns:
        rows = sorted(patterns)
        x = np.array([list(map(int, p)) for p, _ in rows], float)
        share = np.sqrt([patterns[r] for r in rows])
        share /= share.sum()
        target = np.eye(n)[[y for _, y in rows]]
        speed = np.zeros_like(weight)
        for _ in range(1500):
            p = np.exp(x @ weight - (x @ weight).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            step = x.T @ ((target - p) * share[:, None]) - 3e-4 * weight
            for k in range(LINKS):
                own = step[f + k * n : f + (k + 1) * n]
                own[:] = (own + own.T) / 2
            speed = 0.9 * speed + step
            weight += 0.5 * speed
    as_tuple = lambda a: tuple(map(tuple, np.round(a, 6).tolist()))
    return Field(as_tuple(weight[:f]), *[as_tuple(weight[f + k * n : f + (k + 1) * n]) for k in range(LINKS)])


def fit(texts: list[str]) -> Field:
    """The field that these texts teach."""
    return learn(Counter(p for text in texts for p in lessons(text)))


def marginals(field: Field, tokens: list[_Token]) -> np.ndarray:
    """Marginal label probabilities of the tokens by damped loopy sum-product message passing; base spans are evidence."""
    n = len(LABELS)
    own = np.array([_features(t) for t in tokens], float) @ np.array(field.unary)
    for i, t in enumerate(tokens):
        if t.known >= 0:
            own[i] = -1e9  # no number of messages outweighs evidence
            own[i, t.known] = 0.0
    found = _links(tokens)
    links = np.array([p for pairs in found for p in pairs], int).reshape(-1, 2)
    kind = np.repeat(np.arange(LINKS), [len(p) for p in found])
    belief = own.copy()
    # a message goes one link a round: what no token with evidence reaches in time stays as it is
    known = np.array([t.known >= 0 for t in tokens])
    reached = known | (np.exp(own - own.max(1, keepdims=True)).sum(1) > 1.1) | (own.argmax(1) > 0)
    for _ in range(ROUNDS if len(links) else 0):
        wider = reached.copy()
        for here, there in ((0, 1), (1, 0)):
            wider[links[reached[links[:, here]], there]] = True
        if (wider == reached).all():
            break
        reached = wider
    needed = reached[links].all(1) & ~known[links].all(1) if len(links) else np.zeros(0, bool)
    links, kind = links[needed], kind[needed]
    if len(links):
        kind = np.concatenate([kind, kind])
        tables = np.exp(np.array([field.chain, field.group, field.same, field.alike]))
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        message, fresh = np.zeros((2, len(source), n))
        for _ in range(ROUNDS):
            out = belief[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            for k in range(LINKS):
                fresh[kind == k] = out[kind == k] @ tables[k]
            fresh = np.log(fresh / fresh.max(1, keepdims=True))
            change = np.abs(fresh - message).max()
            message = DAMPING * message + (1 - DAMPING) * fresh
            belief = own + np.stack([np.bincount(target, m, len(own)) for m in message.T], 1)
            if change < 1e-4:
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(field: Field, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base ones and those that the field adds, never over a base span."""
    base = base_spans(text)
    tokens = _tokens(text, base)
    if all(t.known >= 0 for t in tokens):
        return base, base
    p = marginals(field, tokens)
    added = []
    for token, row in zip(tokens, p):
        label = int(row.argmax())
        if token.known < 0 and label and row[label] >= CERTAIN:
            head = len(token.text) - len(token.text.lstrip("([{\"'#$%&*|"))
            tail = len(token.text) - len(token.text.rstrip(".,;:!?)]}\"'#$%&*|"))
            if token.start + head < token.end - tail:
                start = token.start + head
                if added and added[-1][2] == ADDED[label] and label != SECRET and start - added[-1][1] <= 2 and not text[added[-1][1] : start].strip(" ()"):
                    start = added.pop()[0]  # a value in groups
                added.append((start, token.end - tail, ADDED[label]))
    return base, sorted([*base, *added], key=lambda s: (s[0], ORDER[s[2]]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def fit_on(docs: DataFrame, rows: int = FIT_ROWS) -> Field:
    """The field that about `rows` documents teach, or all if there are fewer: those whose hash of id and text is small enough.

    Whole texts are read where they lie; only counts of patterns come to the driver. The result doesn't depend on how the
    table is dealt out.
    """
    share = rows / max(1, docs.count())
    some = docs.where(hashed_share("doc_id", "text") < share).select("text")
    taught = map_columns(some, ["text"], [T.StructField("lessons", T.ArrayType(T.StringType()))], lambda texts: [[[f"{p} {y}" for p, y in lessons(t or "")] for t in texts]], [])
    counted = taught.select(F.explode("lessons").alias("lesson")).groupBy("lesson").agg(F.count("*").alias("n"))
    return learn({(p, int(y)): r["n"] for r in counted.collect() for p, y in [r["lesson"].split(" ")]})


FIELDS = [*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]


def find(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (spans of exactly these kinds), base_sha256, spans and n_spans (all) to every row.

    Whole texts are searched. A null text counts as empty: no spans, and the digest of the empty string. Repeated rows stay
    and get equal spans; input columns named like an added one are replaced. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(texts):
        out = []
        for t in texts:
            base, spans = all_spans(shared.value, t or "")
            kinds = [k for _, _, k in base]
            out.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans)))
        return list(zip(*out)) if out else [[] for _ in FIELDS]

    return map_columns(docs, [text], FIELDS, work, keep)


def masked(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows with every span of `text` replaced by its kind in square brackets; overlapping spans become one."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def mask(t):
        if t is None:
            return None
        out, at = [], 0
        for start, end, kind in all_spans(shared.value, t)[1]:
            if start >= at:
                out += [t[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join([*out, t[at:]])

    return map_columns(docs, [text], [T.StructField(text, T.StringType())], lambda texts: [[mask(t) for t in texts]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and n_spans of every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return find(docs, fit_on(docs), keep=["doc_id"])

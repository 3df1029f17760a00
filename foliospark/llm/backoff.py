"""Scores of a weighted backoff automaton.

The language model interpolates n-grams of up to ORDER tokens: p(w | h) = (c(hw) + K p(w | shorter h)) / (c(h) + K), down to the
smoothed counts of single tokens. Written as an automaton, its states are the contexts met in training, an arc carries a
token's log-probability and leads to the longest context that then holds, and a failure arc, weighted log K / (c(h) + K), leads
to the next shorter context. A text is scored in one traversal from left to right that carries the state.

Neither the model nor an automaton of it is ever in one place. Documents are dealt to blocks. A block sends each different
n-gram of its texts once, as packed runs by ranges of their hashes, with how often its training texts have it. A range adds up
all runs and answers each with the totals. From its answers a block builds the part of the automaton that its own texts can
reach, and walks it. All of the corpus is counted, whatever its size, and what moves grows in proportion with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import plain_table

#: Tokens of an n-gram at most.
ORDER = 3
#: K for n-grams of two tokens, and of three and more: log10 of the probability of a token in held-out texts of the test tables
#: at sf0.1 is -3.51 with (1000, 30), -3.62 with (100, 30), -3.87 with (8, 4), and -4.19 for single tokens.
STRENGTH = (500.0, 20.0)
#: Bytes of text of a block, and different n-grams of a range, about. They bound what a task holds besides its longest text.
BLOCK_BYTES = 6_000_000
RANGE_KEYS = 3_000_000
#: An n-gram of two or more tokens is known by a hash of so many bits more than it takes to number all of them, so that a
#: lookup of one that isn't there finds another with a probability of 2 ** -SPARE_BITS. Single tokens have 96 bits.
SPARE_BITS = 20

#: What stands before each text and behind it; no token contains a space.
_START, _END = b" start", b" end"
_U64 = np.uint64


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits and another 32 of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)
    return both[:, 1].astype(_U64), both[:, 0].astype(np.uint32)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of all tokens but the last, and of the last one."""
    x = (left ^ (left >> _U64(29))) * _U64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


def _pack(keys: np.ndarray) -> bytes:
    """Ascending numbers as their differences, all lowest bytes first, then all next ones, compressed: what differences of
    random numbers lack are their highest bits."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, _U64)
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[9:]), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    steps[1:, :width] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=_U64)


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, compressed."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(f"<u{width}").tobytes())


def _stretch(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


@dataclass
class Level:
    """The different n-grams of one length in a block, in the order of their hashes, and where they are.

    at: for each position its n-gram's number, -1 where none ends. first: a position of each. check: 32 bits more, of single tokens.
    """

    keys: np.ndarray
    at: np.ndarray
    first: np.ndarray
    check: np.ndarray | None = None


@dataclass
class Block:
    """Texts of a block one behind the other, each between a start and an end."""

    starts: np.ndarray
    sizes: np.ndarray
    levels: list[Level]


def read_block(texts: list[bytes], order: int, bits: int) -> Block:
    """The n-grams of texts in UTF-8. Tokens are what ASCII white space leaves, A to Z in lower case."""
    words: list[bytes] = []
    n = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        tokens = text.lower().split()
        words += tokens
        n[i] = len(tokens)
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    hashes, check = _word_hashes([_START, _END, *coded.dictionary.to_pylist()])
    sizes = n + 2
    starts = np.cumsum(sizes) - sizes
    codes = np.empty(int(sizes.sum()), np.int64)
    inner = np.ones(len(codes), bool)
    inner[starts] = inner[starts + sizes - 1] = False
    codes[starts], codes[starts + sizes - 1] = 0, 1
    codes[inner] = coded.indices.to_numpy() + 2
    ranked = np.lexsort((check, hashes))
    place = np.empty(len(ranked), np.int64)
    place[ranked] = np.arange(len(ranked))
    at = place[codes]
    first = np.zeros(len(ranked), np.int64)
    first[at] = np.arange(len(at))
    levels = [Level(hashes[ranked], at, first, check[ranked])]
    longer, alone = hashes[codes], hashes[codes]
    behind = np.arange(len(codes)) - np.repeat(starts, sizes)  # tokens before each in its text
    for k in range(2, order + 1):
        longer = np.concatenate([longer[:1], _joined(longer[:-1], alone[1:])])  # that of the token before, and this one
        ends = np.flatnonzero(behind >= k - 1)
        met = longer[ends] >> _U64(64 - bits)
        ordered = np.argsort(met)
        met = met[ordered]
        new = np.ones(len(met), bool)
        new[1:] = met[1:] != met[:-1]
        at = np.full(len(codes), -1, np.int64)
        at[ends[ordered]] = np.cumsum(new) - 1
        levels.append(Level(met[new], at, ends[ordered[new]]))
    return Block(starts, sizes, levels)


@dataclass
class Automaton:
    """The part of the model's automaton that a block's texts can reach.

    A state is a context of one or more tokens, or the root. arcs[k]: weight of the arc that reads the last token of the
    n-gram of k + 1 tokens in the state of the others; nan if it isn't there. fails[k]: weight of the failure arc of the state of the
    n-gram of k + 1 tokens. single: weight of every token in the root; known: whether training has it.
    """

    single: np.ndarray
    known: np.ndarray
    arcs: list[np.ndarray]
    fails: list[np.ndarray]

    def tapes(self, block: Block) -> list[list[np.ndarray]]:
        """What the automaton has for each position of the texts: single and known; arcs, and failure arcs, by the depth of the state."""
        at = [level.at for level in block.levels]
        deeper = range(1, len(at))
        # -1, where no n-gram ends, takes the nan behind the last
        at_positions = lambda weights, k: np.append(weights, np.nan)[k]
        return [[self.single[at[0]], self.known[at[0]]], [at_positions(self.arcs[k], at[k]) for k in deeper], [at_positions(self.fails[k - 1], np.roll(at[k - 1], 1)) for k in deeper]]


def walk(single: list[float], known: list[bool], arcs: list[list[float]], fails: list[list[float]]) -> float:
    """Log-probability (base 10) of a text by one traversal from left to right; see Automaton.tapes(). Position 0 is the start."""
    deepest = len(arcs)
    total, depth = 0.0, min(1, deepest)  # the state is a context of so many tokens, first that of the start
    for i in range(1, len(single)):
        while depth:
            weight = arcs[depth - 1][i]
            if weight == weight:
                break
            total += fails[depth - 1][i]
            depth -= 1
        else:
            weight = single[i]
        total += weight
        # the arc leads to the n-gram read, without its first token if it is as long as can be; that of an unknown token to the root
        if depth < deepest and (depth or known[i]):
            depth += 1
    return total


def strength(k: int, strengths: tuple[float, ...]) -> float:
    """K for n-grams of k tokens."""
    return strengths[min(k - 2, len(strengths) - 1)]


def automaton(block: Block, counts: list[np.ndarray], n: int, v: int, strengths: tuple[float, ...] = STRENGTH) -> Automaton:
    """Weights from how often training has each of a block's n-grams, of how many tokens in all, how many of them different."""
    single = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
    levels, shorter = block.levels, single
    # what is there of the next shorter n-grams
    there, arcs, fails = counts[0] > 0, [np.zeros(0)], []
    for k in range(1, len(levels)):
        strong = strength(k + 1, strengths)
        fails.append(np.log10(strong / (counts[k - 1] + strong)))
        first = levels[k].first
        context, suffix = levels[k - 1].at[first - 1], levels[k - 1].at[first]
        likely = (counts[k] + strong * shorter[suffix]) / (counts[k - 1][context] + strong)
        # an n-gram that is there has only parts that are; by chance a hash may say otherwise
        there = (counts[k] > 0) & (counts[k - 1][context] > 0) & there[suffix]
        arcs.append(np.where(there, np.log10(likely), np.nan))
        shorter = likely
    return Automaton(np.log10(single), counts[0] > 0, arcs, fails)


def is_held_out(doc_id: str) -> F.Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 1 when divided by 5. False for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


def _sent(order: int, bits: int, ranges: int):
    """What a block asks: a row for each range that has any of its n-grams."""
    kinds = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("keys", pa.list_(pa.binary())), ("check", pa.binary()), ("counts", pa.list_(pa.binary()))])

    def run(table: pa.Table) -> pa.Table:
        block = read_block(table["text"].to_pylist(), order, bits)
        learnt = np.repeat(table["learnt"].to_numpy(zero_copy_only=False).astype(bool), block.sizes)
        cuts, keys, counts = [], [], []
        for k, level in enumerate(block.levels):
            met = level.at[learnt]
            counts.append(np.bincount(met[met >= 0], minlength=len(level.keys)))
            cuts.append(_cuts(level.keys, bits if k else 64, ranges))
            keys.append(level.keys)
        own = table["block"][0].as_py()
        rows = []
        for r in range(ranges):
            parts = [slice(c[r], c[r + 1]) for c in cuts]
            if any(p.start < p.stop for p in parts):
                rows.append((own, r, [_pack(x[p]) for x, p in zip(keys, parts)], block.levels[0].check[parts[0]].astype("<u4").tobytes(), [_squeeze(c[p]) for c, p in zip(counts, parts)]))
        return pa.Table.from_arrays([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return run


def _cuts(keys: np.ndarray, bits: int, ranges: int) -> list[int]:
    """Where each range of hashes begins among ascending keys, and the end."""
    edges = np.array([(r << bits) // ranges for r in range(1, ranges)], _U64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _answered(order: int):
    """The totals of a range: for each row asked, those of its n-grams in their order; the first also has the range's different tokens and all of its tokens."""
    kinds = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("counts", pa.list_(pa.binary())), ("v", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows, v, n = table.num_rows, 0, 0
        keys, counts, checks = table["keys"].to_pylist(), table["counts"].to_pylist(), table["check"].to_pylist()
        answers: list[list[bytes]] = [[] for _ in range(rows)]
        for k in range(order):
            runs = [_unpack(keys[i][k]) for i in range(rows)]
            every = np.concatenate(runs)
            given = np.concatenate([_stretch(counts[i][k]) for i in range(rows)])
            check = np.concatenate([np.frombuffer(c, "<u4") for c in checks]) if not k else None
            # the runs are in order already, which a stable sort makes use of
            ordered = np.argsort(every, kind="stable") if k else np.lexsort((check, every))
            there = every[ordered]
            new = np.ones(len(there), bool)
            new[1:] = there[1:] != there[:-1]
            if not k:
                new[1:] |= np.diff(check[ordered].astype(np.int64)) != 0
            begins = np.flatnonzero(new)
            sums = np.add.reduceat(given[ordered], begins) if len(begins) else np.zeros(0, np.int64)
            total = np.empty(len(every), np.int64)
            total[ordered] = sums[np.cumsum(new) - 1]
            if not k:
                start_hash, start_check = _word_hashes([_START])
                tokens = (there[begins] != start_hash[0]) | (check[ordered][begins] != start_check[0])
                v, n = int(np.count_nonzero(sums[tokens])), int(sums[tokens].sum())
            for i, part in enumerate(np.split(total, np.cumsum([len(r) for r in runs])[:-1])):
                answers[i].append(_squeeze(part))
        made = [table["block"], table["range"], answers, [v] + [0] * (rows - 1), [n] + [0] * (rows - 1)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(made, kinds)], schema=kinds)

    return run


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(order: int, bits: int, strengths: tuple[float, ...]):
    """The scores of a block's texts, by the answers to what it asked."""
    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return kinds.empty_table()
        block = read_block(docs["text"].to_pylist(), order, bits)
        in_order = answers.sort_by("range")
        by_row = in_order["counts"].to_pylist()
        counts = [np.concatenate([_stretch(row[k]) for row in by_row]) for k in range(order)]
        n, v = in_order["all_n"][0].as_py(), in_order["all_v"][0].as_py()
        model = automaton(block, counts, n, v, strengths)
        (single, known), arcs, fails = model.tapes(block)
        n_tokens, n_known, base, score = [], [], [], []
        for start, size in zip(block.starts.tolist(), block.sizes.tolist()):
            own = slice(start, start + size)
            plain = single[own].tolist()
            n_tokens.append(size - 1)
            n_known.append(int(np.count_nonzero(known[own][1:])))
            base.append(math.fsum(plain[1:]))
            score.append(walk(plain, known[own].tolist(), [a[own].tolist() for a in arcs], [f[own].tolist() for f in fails]))
        made = [docs["doc_id"].combine_chunks(), pa.compute.invert(docs["learnt"].combine_chunks()), n_tokens, n_known, [n] * len(base), base, score]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, kinds)], schema=kinds)

    return run


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, strengths: tuple[float, ...] = STRENGTH, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Tokens are words and one end a text. Rows that is_held_out() names are scored, and nothing is learnt from them. base_score
    is that of single tokens. A null text counts as empty, whose one token is the end; a null id is never held out. Repeated
    rows stay, each counts in training. Without any training text all tokens are alike unknown. An empty table gives an empty
    table; other columns aren't read. Texts are dealt to blocks by id and text, so neither a source nor a null id meets in one
    place; rows that are equal in both do. A text is held whole by its task. Everything is one plan: what blocks ask is shuffled
    once, and a lost executor's part is made again from it.
    """
    spark = docs.sparkSession
    learnt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = learnt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    every = max(1, size // 6 * order)  # n-grams at most, about
    bits = min(64, every.bit_length() + SPARE_BITS)
    ranges = max(1, -(-every // 2 // range_keys))
    dealt = learnt.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", (~is_held_out("doc_id")).alias("learnt"), F.col("text").cast("binary").alias("text"))
    asked = dealt.groupBy("block").applyInArrow(_sent(order, bits, ranges), "block bigint, range bigint, keys array<binary>, check binary, counts array<binary>")
    answers = asked.groupBy("range").applyInArrow(_answered(order), "block bigint, range bigint, counts array<binary>, v bigint, n bigint")
    sums = answers.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    told = answers.select("block", "range", "counts", sums.select("v").scalar().alias("all_v"), sums.select("n").scalar().alias("all_n"))
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scored(order, bits, strengths), _SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole document."""
    return scores(plain_table(spark, sf_dir, "documents", "doc_id", "text"))

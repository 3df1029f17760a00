"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves whole pre-tokens that are vocabulary entries through a minimal perfect hash (hash and displace);
tier two merges the bytes of the others with a heap over a linked list. Both give the ids that the rank file defines.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foliospark.llm.common import map_columns

#: Distinct pre-tokens whose ids a Python worker remembers before it starts a new memo, which takes over from the last one
#: what is used again; only speed depends on it.
MEMO_ENTRIES = 200_000
#: Characters of a pre-token from which it isn't remembered.
MEMO_CHARACTERS = 256


class PerfectHash:
    """Minimal perfect hash over byte strings: every key has its own slot in 0..n-1, without empty slots.

    Keys are dealt to buckets by one part of a 64-bit hash; each bucket, largest first, gets the smallest displacement
    that puts all its keys on free slots. A lookup of a string that is no key lands on some slot and fails the
    comparison with the key stored there.
    """

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // 3)
        bucket, start, step = self._parts(keys)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(self.n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = bytearray(self.n)
        left: list[int] = []  # free slots, once only buckets of one key remain
        for b in np.argsort(-np.diff(bounds), kind="stable").tolist():
            members = order[bounds[b] : bounds[b + 1]].tolist()
            if not members:
                break
            if len(members) == 1:
                left = left or [i for i in range(self.n) if not taken[i]]
                slot = left.pop()
                self.shift[b] = (slot - start[members[0]]) % self.n
                self.slot_key[slot] = members[0]
                continue
            pairs = list(zip(start[members].tolist(), step[members].tolist()))
            if len(set(pairs)) < len(pairs):
                raise ValueError("two keys can't be told apart by their hash")
            d = 0
            while True:
                slots = {(s + d // self.n * t + d) % self.n for s, t in pairs}
                if len(slots) == len(pairs) and not any(taken[x] for x in slots):
                    break
                # equal starts only part if the step's factor grows
                d += 1 if len({s for s, _ in pairs}) == len(pairs) or d >= self.n else self.n
            self.shift[b] = d
            for key, (s, t) in zip(members, pairs):
                at = (s + d // self.n * t + d) % self.n
                taken[at] = 1
                self.slot_key[at] = key
        self.keys = keys

    def _parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = np.uint64(self.n)
        bucket = (h >> np.uint64(40)) % np.uint64(self.buckets)
        start = (h & np.uint64(0xFFFFFFFF)) % n
        step = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % n
        return bucket.astype(np.int64), start.astype(np.int64), step.astype(np.int64)

    def find(self, words: list[bytes]) -> list[int]:
        """Index of each word among the keys, -1 for a word that is none."""
        if not words:
            return []
        bucket, start, step = self._parts(words)
        d = self.shift[bucket]
        at = self.slot_key[(start + d // self.n * step + d) % self.n].tolist()
        keys = self.keys
        return [i if i >= 0 and keys[i] == w else -1 for i, w in zip(at, words)]


def joinable(ranks: dict[bytes, int]) -> dict[int, int]:
    """Id of what two tokens make when joined, by (left id << 32 | right id): every cut of every token into two tokens."""
    found = {}
    for word, rank in ranks.items():
        for cut in range(1, len(word)):
            left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
            if left is not None and right is not None:
                found[left << 32 | right] = rank
    return found


def merge_bytes(start: list[int], joins: dict[int, int]) -> list[int]:
    """Ids of a pre-token given as the ids of its bytes: join the adjacent pair of lowest rank, leftmost first, until none
    is in the vocabulary. A heap holds (rank << 32 | place); what it says of a place that has changed since is passed over."""
    ids, n = start, len(start)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 32 | i for i in range(n - 1) if (r := joins.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if j >= n or joins.get(ids[i] << 32 | ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1  # no pair begins with -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := joins.get(rank << 32 | ids[k])) is not None:
                heapq.heappush(heap, r << 32 | i)
        if (p := before[i]) >= 0 and (r := joins.get(ids[p] << 32 | rank)) is not None:
            heapq.heappush(heap, r << 32 | p)
    return [x for x in ids if x >= 0]


class Codec:
    """Encodes and decodes texts by a rank file's lines (base64 of a token's bytes, its rank)."""

    def __init__(self, rank_lines: bytes, pattern: str):
        pairs = [line.split() for line in rank_lines.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.words = list(self.ranks)
        self.ids = list(self.ranks.values())
        self.bytes_of = dict(zip(self.ids, self.words))
        self.perfect = PerfectHash(self.words)
        self.joins = joinable(self.ranks)
        self.of_byte = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        # the library's \s is Unicode's White_Space, which lacks the separators 1C to 1F
        self.split = regex.compile(pattern, regex.V0).findall
        #: Pre-token to its ids, packed as little-endian unsigned 32-bit integers: those in use, and those before them.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        fresh = []
        for w in words:
            if (known := self.older.get(w)) is not None:
                self.memo[w] = known
            else:
                fresh.append(w)
        raw = [w.encode() for w in fresh]
        for w, b, i in zip(fresh, raw, self.perfect.find(raw)):
            ids = (self.ids[i],) if i >= 0 else merge_bytes([self.of_byte[x] for x in b], self.joins)
            self.memo[w] = struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.split(text)
        words = set(parts)
        missing = [w for w in words if w not in self.memo]
        if missing:
            if len(self.memo) > MEMO_ENTRIES:
                self.older, self.memo = self.memo, {}
                missing = list(words)
            self._learn(missing)
        ids = b"".join(map(self.memo.__getitem__, parts))
        for w in missing:
            if len(w) >= MEMO_CHARACTERS:
                del self.memo[w]
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(rank_lines: bytes, pattern: str) -> Codec:
    return Codec(rank_lines, pattern)


def load_ranks(path: str) -> bytes:
    """Content of a rank file on the driver: some hundred kB, sent to the executors as one broadcast variable."""
    with open(path, "rb") as file:
        return file.read()


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds column `to`, the array of token ids of every whole text.

    A null text counts as empty and gives an empty array; so does an empty text. Rows are never merged, dropped or
    reordered, and an input column named like `to` is replaced. An empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def work(texts):
        codec = _codec(shared.value, pattern)
        return [[np.frombuffer(codec.packed(t or ""), "<i4") for t in texts]]

    return map_columns(df, [text], [T.StructField(to, T.ArrayType(T.IntegerType(), False))], work)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds column `to`, the bytes (binary) of an array of ids; null for a null array."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def work(arrays):
        codec = _codec(shared.value, pattern)
        return [[None if a is None else codec.decode(a) for a in arrays]]

    return map_columns(df, [ids], [T.StructField(to, T.BinaryType())], work)


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def token_digests(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: list[str] | None = None, to: str | None = None) -> DataFrame:
    """Number of tokens, SHA-256 of the ids (little-endian unsigned 32-bit) and SHA-256 of the bytes decoded from them.

    to: name of a column for the ids themselves; without it the id arrays don't leave the Python worker. Encodes and
    decodes within one pass. Nulls, empty texts, repeated rows and clashing names as in encode().
    """
    wanted = [T.StructField(to, T.ArrayType(T.IntegerType(), False))] if to else []
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def work(texts):
        codec = _codec(shared.value, pattern)
        n, of_ids, of_bytes, kept = [], [], [], []
        for t in texts:
            ids = codec.packed(t or "")
            kept.append(np.frombuffer(ids, "<i4"))
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
        return n, of_ids, of_bytes, *([kept] if to else [])

    return map_columns(df, [text], [*DIGESTS, *wanted], work, keep)


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Rank file and pattern of the installed public tokenizers."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    ranks, pattern = public_ranks()
    return token_digests(docs.select("doc_id", "text"), ranks, pattern, keep=["doc_id"])

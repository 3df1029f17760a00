"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a nonzero label of radius + 1 bits; table v keeps the positions whose label has an odd overlap
with v. The labels of any `radius` differing positions span too little to meet every v, so some table masks all of them
out: two fingerprints within the radius agree on the whole key of at least one table. Nothing is missed by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import checkpointed, map_columns, read_table
from foliospark.llm.components import connected_components

BITS = 64
RADIUS = 3
WIDTH = 3
#: Distinct fingerprints of a table's bucket that are compared in one task; larger buckets take the ball join.
BUCKET_LIMIT = 16_384
#: Fingerprints whose points go on in one batch.
BALL_ROWS = 64
#: Near copies for keep_one_each(): Jaccard similarity of the sets of shingles of so many words, bands of minima of so many
#: hashes each (a pair at the similarity misses all bands with probability 0.00007).
ALIKE = 0.8
ALIKE_WIDTH = 5
BANDS, BAND_ROWS = 24, 5
#: Columns of a sketch, eight minima each; a pair goes on if its sketches agree by so much less than the similarity, four
#: standard deviations; members of a band's bucket that are compared with as many others in one go.
SKETCH = [f"s{i}" for i in range(BANDS * BAND_ROWS // 8)]
MARGIN = 0.15
BLOCK = 512
#: Blocks of a bucket beyond which its members are told apart by their rare shingles; a shingle that more than one member in
#: so many has isn't rare.
MOST_BLOCKS = 8
RARE = 64
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = {c: c + 32 for c in range(65, 91)}


def cover_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering family. Labels are dealt in turn, so that masks are about equally large."""
    span = (1 << radius + 1) - 1
    labels = [i % span + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(labels) if (m & v).bit_count() % 2) for v in range(1, span + 1)]


def shingles(text: str, width: int = WIDTH) -> list[str]:
    words = _WORDS(text.translate(_LOWER))
    if len(words) < width:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42); 0 for a text without words."""
    grams = shingles(text, width)
    if not grams:
        return 0
    return vote(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), "<u8", len(grams)))


def vote(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp", width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint of every whole text as a signed long; a null text counts as empty and gives 0."""

    def work(texts):
        values = np.fromiter((fingerprint(t or "", width) for t in texts), "<u8", len(texts))
        return [values.view("<i8").tolist()]

    return map_columns(docs, [text], [T.StructField(to, T.LongType())], work, keep)


def _forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is within the radius in one bucket: at most one for each value, to its component's first."""
    n = len(values)
    root = np.arange(n)
    rows = max(1, (1 << 22) // n)
    for at in range(0, n, rows):
        i, j = np.nonzero(np.bitwise_count(values[at : at + rows, None] ^ values[None, :]) <= radius)
        i += at
        i, j = i[i < j], j[i < j]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    moved = np.nonzero(root != np.arange(n))[0]
    return values[root[moved]], values[moved]


_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of equal leading key columns in sorted batches, those of one row left out; a run may cross batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        change = np.zeros(len(columns[0]) - 1, bool)
        for k in columns[:keys]:
            change |= k[1:] != k[:-1]
        starts = np.concatenate([[0], np.nonzero(change)[0] + 1])
        sizes = np.diff(starts)
        for s, size in zip(starts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            yield [c[s : s + size] for c in columns]
        held = [c[starts[-1] :] for c in columns]
    if held is not None and len(held[0]) > 1:
        yield held


def links(values: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect exactly what pairs within the radius connect.

    A bucket gives at most one edge for each of its members, not all pairs. Buckets of at most bucket_limit distinct
    fingerprints are compared in one task. Of a larger one, every fingerprint goes to the points around it that
    differ in the bits outside the table's mask: as a centre to those within half the radius, as a guest to those within
    the rest. Two fingerprints within the radius meet at such a point, which at most a few hundred distinct
    fingerprints can reach, whatever the bucket's size.
    """
    masks = cover_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = values.select(F.col("fp"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("v", "key")).select("v", "key", "fp")
    big = checkpointed(keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_limit).select("v", "key"))
    some_big = not big.isEmpty()
    usual = keyed.join(big, ["v", "key"], "left_anti") if some_big else keyed

    def compare(batches):
        for _, _, fps in _groups(batches, 2):
            a, b = _forest(np.ascontiguousarray(fps).view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    edges = usual.repartition("v", "key").sortWithinPartitions("v", "key", "fp").mapInArrow(compare, _EDGES)
    if not some_big:
        return edges
    return edges.unionByName(_ball_links(keyed.join(big, ["v", "key"], "left_semi"), masks, radius))


def _ball_links(keyed: DataFrame, masks: list[int], radius: int) -> DataFrame:
    from itertools import combinations

    inner, outer = radius // 2, radius - radius // 2

    def flips(mask: int, most: int) -> np.ndarray:
        free = [i for i in range(BITS) if not mask >> i & 1]
        return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(free, k)], np.uint64)

    def scatter(batches):
        around = {v: (flips(m, inner), flips(m, outer)) for v, m in enumerate(masks)}
        for batch in batches:
            tables, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for v in np.unique(tables).tolist():
                own, (near, far) = fps[tables == v], around[v]
                n = len(near) + len(far)
                for at in range(0, len(own), BALL_ROWS):
                    some = own[at : at + BALL_ROWS, None]
                    points = np.concatenate([some ^ near, some ^ far], axis=1)
                    guest = np.tile(np.repeat(np.array([0, 1], np.int32), [len(near), len(far)]), len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(points.size, v, np.int32)), pa.array(points.ravel().view(np.int64)), pa.array(guest), pa.array(np.repeat(some.ravel(), n).view(np.int64))], names=["v", "z", "guest", "fp"])

    def star(batches):
        for _, _, guest, fps in _groups(batches, 2):
            if guest[0] == 0:  # sorted: centres, which are within the radius of one another and of all guests, come first
                others = fps[1:][fps[1:] != fps[0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), fps[0])), pa.array(np.ascontiguousarray(others))], names=["a", "b"])

    points = keyed.select("v", "fp").distinct().mapInArrow(scatter, "v int, z long, guest int, fp long")
    return points.repartition("v", "z").sortWithinPartitions("v", "z", "guest", "fp").mapInArrow(star, _EDGES)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, fp (signed long) and component_id of every row.

    Fingerprints link within the radius, the fingerprint zero of texts without words (null, empty, white space) like any
    other; component_id is the smallest doc_id that can be reached, a row's own included. Exact copies are merged
    before any comparison, so their number doesn't matter. Repeated rows all stay. A null doc_id never is the
    smallest; it gets its component's, and null if no row of the component has one. An empty table gives an empty one.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = checkpointed(fingerprints(plain, width=width, keep=["doc_id", "text_hash"]))
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = checkpointed(connected_components(links(values.select("fp"), radius)))
    placed = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_value = placed.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(by_value, "fp").select("doc_id", "text_hash", "fp", "component_id")


def _grams(text: str) -> np.ndarray:
    """Different hashes of a text's shingles, in order."""
    grams = shingles(text, ALIKE_WIDTH)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), "<u8", len(grams)))


def _minima(grams: np.ndarray) -> np.ndarray:
    """The smallest values that BANDS * BAND_ROWS hashes take over a set of shingles."""
    n = BANDS * BAND_ROWS
    rng = np.random.default_rng(5)
    flip, times = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)
    least = np.full(n, (1 << 64) - 1, np.uint64)
    for at in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[at : at + 4096, None] ^ flip) * times).min(0))
    return least


def _signature(text: str) -> tuple:
    """fp (which stands for the set of shingles), SimHash, keys of the bands, and a byte of every minimum, packed in longs."""
    grams = _grams(text)
    if not len(grams):
        return 0, 0, [], [0] * len(SKETCH)
    least = _minima(grams)
    bands = [xxhash.xxh64_intdigest(b.tobytes(), 7) - (1 << 63) for b in least.reshape(BANDS, BAND_ROWS)]
    # the low bits of a product by an odd number know nothing of the high ones of its factor
    sketch = (least >> np.uint64(32)).astype(np.uint8).view("<i8")
    return xxhash.xxh64_intdigest(grams.tobytes(), 42) - (1 << 63), int(np.int64(np.uint64(vote(grams)))), bands, sketch.tolist()


def _few(frame: DataFrame, most: int = 100_000) -> bool:
    """Whether a checkpointed frame of two longs a row is small enough to be broadcast."""
    return frame.limit(most + 1).count() <= most


def _alike_pairs(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The checkpointed pairs (a, b), and whether their shingles are alike enough; each pair is compared once and exactly.

    The second set comes to its pair first: it moves with the pair to the first one, which many pairs may share.
    """
    left, right = (grams.select(F.col("fp").alias(c), F.col("grams").alias(f"g{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("ga", "gb"))
    if _few(pairs):
        left = left.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
        pairs = F.broadcast(pairs)
    known = left.join(right.join(pairs, "b"), "a").select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb")).alias("all"))
    return checkpointed(known.select("a", "b", (F.col("both") >= ALIKE * (F.col("all") - F.col("both")) - 1e-9).alias("alike")))


def _open_buckets(members: DataFrame, component: DataFrame) -> DataFrame:
    """v, key, fp, component of the members of buckets that still hold more than one component."""
    roots = component.withColumnRenamed("node", "fp")
    known = members.join(F.broadcast(roots) if _few(component) else roots, "fp", "left").select("v", "key", "fp", F.coalesce("root", "fp").alias("component"))
    apart = known.groupBy("v", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("v", "key")
    return known.join(apart, ["v", "key"])


def _block_pairs(buckets: DataFrame, block: int) -> DataFrame:
    """v, key, kind, p, q, side, component, fp: open buckets cut into blocks, and the pairs of blocks that are to be compared.

    A bucket's largest component needn't be compared with itself. The other members' blocks are compared with one another
    (kind 0, p <= q), and with those of the largest component (kind 1: p theirs, q its own). No pair of blocks has more than
    about twice `block` members, so a bucket of any size is spread over many tasks.
    """
    sizes = buckets.groupBy("v", "key", "component").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("v", "key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("most"))
    dealt = buckets.join(whole, ["v", "key"]).withColumn("large", F.col("component") == F.col("most.component"))
    blocks = {c: F.ceil(n / block).cast("int") for c, n in (("larges", F.col("most.n")), ("others", F.col("all") - F.col("most.n")))}
    dealt = dealt.withColumns(blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.when(F.col("large"), F.col("larges")).otherwise(F.col("others"))).cast("int"))
    own, zero = F.col("own"), F.lit(0)

    def place(kind, p, q, side):
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.alias("side"))

    others, larges = F.sequence(zero, F.col("others") - 1), F.sequence(zero, F.col("larges") - 1)
    among = F.transform(others, lambda j: place(0, F.least(own, j), F.greatest(own, j), (own > j).cast("int")))
    to_large = F.transform(larges, lambda j: place(1, own, j, zero))
    of_large = F.transform(others, lambda j: place(1, j, own, F.lit(1)))
    places = F.when(F.col("large"), of_large).otherwise(F.concat(among, to_large))
    return dealt.select("v", "key", "component", "fp", F.explode(places).alias("at")).select("v", "key", "at.kind", "at.p", "at.q", "at.side", "component", "fp")


def _prefix_length(n: int) -> int:
    """How many of a set's n shingles, in an order that all sets share, one of those of any set that is alike enough is among."""
    return n - int(np.ceil(ALIKE * n - 1e-9)) + 1


def _parted(buckets: DataFrame, grams: DataFrame, block: int) -> DataFrame:
    """buckets (v, key, fp, component), those of more than MOST_BLOCKS blocks replaced by buckets of single shingles.

    Two sets that are alike enough share one of their first shingles, in any order that is the same for all; the order here has
    frequent shingles last, so a passage that all members of a bucket have brings none of them together. A set has a row for about
    a fifth of its shingles, whatever the size of its bucket, and none is lost: the bound is exact. The frequent shingles are
    RARE times as many as a member has on average, at most.
    """
    sizes = checkpointed(buckets.groupBy("v", "key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_BLOCKS * block).select("v", "key"))
    if sizes.isEmpty():
        return buckets
    kept = buckets.join(sizes, ["v", "key"], "left_anti").select("v", "key", "fp", "component")
    members = checkpointed(buckets.join(sizes, ["v", "key"]).select("fp", "component").distinct())
    sets = members.join(grams, "fp")
    often = members.count() // RARE
    counts = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > often)
    frequent = sorted((r["n"], r["gram"]) for r in counts.collect())
    table = np.array([g for _, g in frequent], np.int64)
    shared = buckets.sparkSession.sparkContext.broadcast((np.sort(table), np.argsort(table)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            some = []
            for own in batch.column("grams"):
                own = own.values.to_numpy()
                last = np.full(len(own), -1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    last[known[at] == own] = rank[at[known[at] == own]]
                some.append(own[np.lexsort((own, last))][: _prefix_length(len(own))])
            times = [len(s) for s in some]
            each = [np.repeat(batch.column(c).to_numpy(), times) for c in ("fp", "component")]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (np.concatenate([np.zeros(0, np.int64), *some]), *each)], names=["key", "fp", "component"])

    parts = sets.select("fp", "component", "grams").mapInArrow(first, "key long, fp long, component long").select(F.lit(BANDS).alias("v"), "key", "fp", "component")
    apart = parts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return kept.unionByName(parts.join(apart, "key").select("v", "key", "fp", "component"))


def _linked(places: DataFrame, sketches: DataFrame, grams: DataFrame) -> DataFrame:
    """Edges (a, b) of sets that are alike enough, by which each pair of blocks connects what it can connect, and no more.

    Sketches choose the pairs of different components that come near the similarity; their sets are compared exactly, in
    the order of their sketches' likeness, unless they have been joined meanwhile.
    """
    rows = places.join(sketches, "fp").join(grams, "fp").select("v", "key", "kind", "p", "q", "side", "component", "fp", *SKETCH, "grams")
    least = int(BANDS * BAND_ROWS * (ALIKE - MARGIN))

    def compare(batches):
        for _, _, kind, p, q, side, component, fp, *longs, sets in _groups(batches, 5):
            sketch, n = np.ascontiguousarray(np.stack(longs, 1)).view(np.uint8), len(fp)
            alone = kind[0] == 0 and p[0] == q[0]
            root = {c: c for c in component.tolist()}
            step = max(1, (1 << 24) // (n * sketch.shape[1]))
            for at in range(0, n, step):
                some = np.arange(at, min(n, at + step))
                agree = (sketch[some, None, :] == sketch[None, :, :]).sum(2, dtype=np.int16)
                apart = some[:, None] < np.arange(n)[None, :] if alone else side[some, None] < side[None, :]
                x, y = np.nonzero(apart & (agree >= least) & (component[some, None] != component[None, :]))
                for i in np.unique(x).tolist():
                    mine = y[x == i]
                    mine = mine[np.argsort(-agree[i, mine], kind="stable")]
                    for part in (mine[:1], mine[1:]):  # the closest mostly joins the others' component
                        part = [j for j in part.tolist() if _root(root, component[some[i]]) != _root(root, component[j])]
                        if not part:
                            continue
                        own = sets[some[i]]
                        others = np.concatenate([sets[j] for j in part])
                        places_in = np.minimum(np.searchsorted(own.view(np.uint64), others.view(np.uint64)), len(own) - 1)
                        ends = np.cumsum([len(sets[j]) for j in part])
                        both = np.diff(np.concatenate([[0], np.cumsum(own[places_in] == others)[ends - 1]]))
                        whole = len(own) + np.diff(np.concatenate([[0], ends])) - both
                        for j in np.array(part)[both >= ALIKE * whole - 1e-9].tolist():
                            a, b = _root(root, component[some[i]]), _root(root, component[j])
                            if a != b:
                                root[max(a, b)] = min(a, b)
                                yield pa.RecordBatch.from_arrays([pa.array([fp[some[i]]]), pa.array([fp[j]])], names=["a", "b"])

    return rows.repartition("v", "key", "kind", "p", "q").sortWithinPartitions("v", "key", "kind", "p", "q").mapInArrow(compare, _EDGES)


def _root(root: dict[int, int], of: int) -> int:
    of = int(of)
    while root[of] != of:
        root[of] = root[root[of]]
        of = root[of]
    return of


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, fp and component_id of every row, as near_duplicates(), but fp stands for a set of shingles.

    Rows link whose sets of five-word shingles have a Jaccard similarity of 0.8 at least; a text of fewer words is one
    shingle, and texts without words are alike. Each link is found by comparing the sets exactly. Candidates:
      1. the first of each group that covering SimHash of these shingles makes, with the others of the group;
      2. the first of each band's bucket: every set with that one of its 24 which most of its buckets share;
      3. all pairs of what then still is in one bucket and different components, by sketch, in blocks within tasks.
    What an earlier round has joined isn't compared again. So only bands and sketches can miss a pair, with a probability
    under 0.0001 each at a similarity of 0.8. In the third step a bucket of n sets makes n / block rows a set, MOST_BLOCKS at
    most: of a larger bucket, each set has a row for a fifth of its shingles, the rarest ones, and is compared with those that
    share one (see _parted()). Pairs near the bound, which only an exact comparison tells apart, never leave their task.

    fp is a hash of 64 bits. Rows whose sets have one fp but different sketches aren't taken for equal: those of all but one of
    the sets are left to themselves, their component_id their own doc_id.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row_hash"), F.col(text).alias("text"))

    def sign(texts):
        found = [_signature(t or "") for t in texts]
        return [*([f[i] for f in found] for i in range(3)), *([f[3][i] for f in found] for i in range(len(SKETCH)))]

    fields = [T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), *[T.StructField(s, T.LongType()) for s in SKETCH]]
    signed = checkpointed(map_columns(plain, ["text"], fields, sign, ["doc_id", "text_hash", "row_hash"]))
    rows = signed.select("doc_id", "text_hash", "fp", F.xxhash64("sim", *SKETCH).alias("mark"))
    # all rows of a set have equal bands, so the parts of a bucket can be told apart before anything is grouped
    members = signed.select("fp", F.posexplode("bands").alias("v", "key")).distinct()
    shared = members.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1").select("v", "key")
    met = checkpointed(members.join(shared, ["v", "key"]).select("v", "key", "fp"))
    sets = checkpointed(signed.groupBy("fp").agg(F.min("row_hash").alias("row_hash"), *[F.min(c).alias(c) for c in ("sim", *SKETCH)]))

    # operator 3 over the sets, which gives every group's first
    prints = sets.groupBy("sim").agg(F.min("fp").alias("fp"))
    covered = connected_components(links(prints.select(F.col("sim").alias("fp"))))
    placed = sets.select("sim", "fp").join(covered.withColumnRenamed("node", "sim"), "sim", "left").select("fp", F.coalesce("root", "sim").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("root", "a")
    pairs = checkpointed(placed.join(firsts, "root").where("fp <> a").select("a", F.col("fp").alias("b")))

    wanted = met.select("fp").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("fp"))).distinct().join(sets.select("fp", "row_hash"), "fp")
    texts = plain.select("row_hash", "text").join(wanted.select("row_hash"), "row_hash", "left_semi")
    shingled = map_columns(texts, ["text"], [T.StructField("grams", T.ArrayType(T.LongType()))], lambda ts: [[_grams(t or "").view("<i8") for t in ts]], ["row_hash"])
    grams = checkpointed(shingled.dropDuplicates(["row_hash"]).join(wanted, "row_hash").select("fp", "grams"))

    tested = _alike_pairs(pairs, grams)
    # each group's links run to its first, so they are stars
    stars = tested.where("alike")
    component = checkpointed(stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))

    buckets = _open_buckets(met, component)
    led = buckets.groupBy("v", "key").agg(F.min(F.struct("component", "fp")).alias("first")).select("v", "key", "first.component", "first.fp").withColumnsRenamed({"fp": "a", "component": "ca"})
    asked = buckets.join(led, ["v", "key"]).where("component <> ca").groupBy("fp", "a").agg(F.count("*").alias("n"))
    best = asked.groupBy("fp").agg(F.max(F.struct("n", "a"))["a"].alias("a")).select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    best = checkpointed(best.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    tested = tested.unionByName(_alike_pairs(best, grams))
    component = checkpointed(connected_components(tested.where("alike").select("a", "b")))

    buckets = checkpointed(_open_buckets(met, component))
    if not buckets.isEmpty():
        found = _linked(_block_pairs(checkpointed(_parted(buckets, grams, block)), block), sets.select("fp", *SKETCH), grams)
        known = tested.where("alike").select("a", "b")
        component = checkpointed(connected_components(known.unionByName(found)))

    values = rows.groupBy("fp", "mark").agg(F.min("doc_id").alias("first")).groupBy("fp").agg(F.min(F.struct("mark", "first")).alias("m")).select("fp", "m.*")
    placed = values.join(component, values["fp"] == component["node"], "left").select("fp", "mark", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_value = placed.select("fp", F.col("mark").alias("own"), "root").join(smallest, "root").select("fp", "own", "component_id")
    return rows.join(by_value, "fp").select("doc_id", "text_hash", "fp", F.when(F.col("mark") == F.col("own"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, as near_copies() links them, all columns unchanged: that with the smallest doc_id.

    Of rows that share this doc_id within a group, the one with the smallest hash of its text stays, and of equal ones,
    one. Rows without a doc_id go if their group has a row with one; groups without any keep one for each set of shingles.
    """
    found = near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp")).alias("apart")).agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    # a missing id is made a key of its own, so that both sides are dealt by plain columns
    keyed = keyed.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull()})
    kept = keyed.join(chosen.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("text_hash").alias("__hash")), ["__id", "__none", "__hash"], "left_semi")
    same = Window.partitionBy("__id", "__none", "__hash").orderBy("__hash")
    return kept.withColumn("__row", F.row_number().over(same)).where("__row = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Document fingerprints: weighted SimHash of word pairs, and search by permuted block tables. DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import checkpointed, plain_table

BITS = 128
#: A term is a word with the word after it; it weighs as many votes as the first word has characters, up to this many.
MOST_WEIGHT = 16
#: Search: differing bits at most, and blocks of bits; two blocks at least agree in all pairs within the radius.
RADIUS = 3
BLOCKS = 5
SPACE = "[\\x20\\x09-\\x0D]+"
_LANE = (1 << 32) | 1
_LOW = (1 << 32) - 1


def _votes(terms: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Fingerprint columns fp1, fp2 (long) of the weighted 64-bit hashes h1, h2 by key.

    One long adds up the votes for two bits, in halves of 32 bits: the weights of a text are fewer than its characters,
    so no half can overflow.
    """
    sums = [F.sum(F.shiftright(h, k).bitwiseAND(F.lit(_LANE)) * F.col("w")).alias(f"{h}_{k}") for h in ("h1", "h2") for k in range(32)]
    total = terms.groupBy(*keys).agg(F.sum("w").alias("w"), *[F.max(c).alias(c) for c in carried], *sums)

    def bits(h):
        word = F.lit(0).cast("long")
        for k in range(32):
            lane = F.col(f"{h}_{k}")
            for votes, at in ((lane.bitwiseAND(F.lit(_LOW)), k), (F.shiftrightunsigned(lane, 32), k + 32)):
                word = word.bitwiseOR(F.shiftleft((2 * votes > F.col("w")).cast("long"), at))
        return word

    return total.select(*keys, *carried, bits("h1").alias("fp1"), bits("h2").alias("fp2"))


def _terms(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, and weight w and hashes h1, h2 of every term; a text without words gives a term of weight 0."""
    words = texts.select(*keep, F.split(F.col(text), SPACE).alias("words"))
    each = words.select(*keep, "words", F.posexplode_outer("words").alias("pos", "word"))
    hashed = each.select(*keep, F.least(F.length("word"), F.lit(MOST_WEIGHT)).cast("long").alias("w"), F.xxhash64("word", F.get("words", F.col("pos") + 1)).alias("h1"))
    return hashed.withColumn("h2", F.xxhash64("h1"))


#: A document's place: null ids first, then by id, then by the hashes of its text. Rows with one place are equal.
_PLACE = ["given", "id", "k1", "k2"]


def _placed(docs: DataFrame) -> DataFrame:
    """_PLACE and text of every row; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").isNotNull().cast("int").alias("given"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def _successors(placed: DataFrame) -> DataFrame:
    """_PLACE of each different row, n (rows with it), half (of its length), and next: the place after it, the first one's after the last.

    Only places are put in order, not texts: Spark deals them to ranges by quantiles that it samples, so that neither gaps
    nor crowds among the ids matter. Each range hands its first place to the range before it.
    """
    keys = placed.groupBy(*_PLACE).agg(F.count("*").alias("n"), F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"))
    ranged = checkpointed(keys.repartitionByRange(*_PLACE).withColumn("range", F.spark_partition_id()))
    place = F.struct(*_PLACE)
    order = Window.orderBy("range")  # one row a range, of which there are as many as tasks
    heads = ranged.groupBy("range").agg(F.min(place).alias("head"))
    ahead = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("ahead"))
    within = ranged.withColumn("after", F.lead(place).over(Window.partitionBy("range").orderBy(*_PLACE)))
    return checkpointed(within.join(F.broadcast(ahead), "range").select(*_PLACE, "n", "half", F.coalesce("after", "ahead").alias("next")))


def _alike(a: str, b: str) -> F.Column:
    """Share of equal bits."""
    differing = F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1"))) + F.bit_count(F.col(f"{a}2").bitwiseXOR(F.col(f"{b}2")))
    return 1 - differing / F.lit(float(BITS))


def _hex(fp: str) -> F.Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f"{fp}{i}")), 16, "0") for i in (1, 2)])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp1, fp2: the fingerprint of each key's text; a key with several texts gives a row for each of them."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.col("text"))})
    return _votes(_terms(rows, "text", [key, "k1", "k2"]), [key, "k1", "k2"], []).drop("k1", "k2")


def neighbours(queries: DataFrame, values: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """q1, q2, fp1, fp2, distance: for each fingerprint of queries all of values within the radius, itself included.

    The bits are cut into blocks. However the differing bits fall, at least blocks - radius blocks have none, so each
    choice of so many blocks has a table keyed by their bits, and every pair within the radius meets in one. Copies are
    merged first: a fingerprint counts once, whatever the number of its documents; join them by it to get these.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in kept) for kept in combinations(range(blocks), blocks - radius)]

    def signed(x):
        x &= (1 << 64) - 1
        return F.lit(x - (1 << 64) if x >> 63 else x)

    def tables(frame):
        distinct = frame.select("fp1", "fp2").distinct()
        keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp1").bitwiseAND(signed(m)).alias("b1"), F.col("fp2").bitwiseAND(signed(m >> 64)).alias("b2")) for t, m in enumerate(masks)])
        return distinct.select("fp1", "fp2", F.explode(keys).alias("k")).select("fp1", "fp2", "k.*")

    asked = tables(queries).withColumnsRenamed({"fp1": "q1", "fp2": "q2"})
    distance = F.bit_count(F.col("fp1").bitwiseXOR(F.col("q1"))) + F.bit_count(F.col("fp2").bitwiseXOR(F.col("q2")))
    met = tables(values).join(asked, ["table", "b1", "b2"]).withColumn("distance", distance)
    return met.where(F.col("distance") <= radius).select("q1", "q2", "fp1", "fp2", "distance").distinct()


_SHA = [f"sha{i}" for i in range(5)]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text; see query(). Also fp1, fp2.

    Documents are put in the order of doc_id, null ids first; those with equal ids in the order of their texts' hashes.
    Equal rows all stay: each is the next one of the one before it. A null text counts as empty: its fingerprint has no
    bits set, as that of any text without words has. A single row is its own next one. An empty table gives an empty
    table; columns other than doc_id and text aren't used.

    A text moves once, to its place's partition, and from there as much of its beginning as the document before it takes.
    """
    placed = _placed(docs)
    after = _successors(placed)
    place = F.struct(*_PLACE)
    whole = placed.groupBy(*_PLACE).agg(F.first("text").alias("text"))
    asked = after.select("next.*", place.alias("asker"), F.col("half").alias("wanted"))
    lent = whole.join(asked, _PLACE).select("asker.*", F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("lent"))
    full = whole.join(after.select(*_PLACE, "n", "half"), _PLACE).join(lent, _PLACE)
    kept = F.expr("substring(text, 1, length(text) - half)")
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.concat(kept, "lent").alias("text")), F.when(F.col("n") > 1, F.struct(F.lit(2).alias("which"), F.concat(kept, F.substring(F.col("text"), F.lit(1), F.col("half"))).alias("text"))))
    each = full.select(*_PLACE, F.length("text").cast("long").alias("n_chars"), F.explode(F.filter(texts, lambda t: t.isNotNull())).alias("t")).select(*_PLACE, "n_chars", "t.*")
    # the digest rides along as numbers, which a hash aggregate can hold
    digest = each.withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))
    pieces = [F.conv(F.substring("sha", 1 + 13 * i, 13), 16, 10).cast("long").alias(c) for i, c in enumerate(_SHA)]
    carried = ["n_chars", *_SHA]
    terms = _terms(digest.select(*_PLACE, "which", "n_chars", *pieces, "text"), "text", [*_PLACE, "which", *carried])
    voted = checkpointed(_votes(terms, [*_PLACE, "which"], carried))
    own = voted.where("which = 0").select(*_PLACE, "fp1", "fp2")
    following = own.select(place.alias("next"), F.col("fp1").alias("next1"), F.col("fp2").alias("next2"))
    edits = voted.where("which > 0").withColumnsRenamed({"fp1": "edited1", "fp2": "edited2"})
    both = edits.join(own, _PLACE).join(after.select(*_PLACE, "n", "next"), _PLACE).join(following, "next")
    # of equal rows, all but the last are followed by their like
    rows = both.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("which") == 1, 1).otherwise(F.col("n") - 1).cast("int"))))
    sha = F.concat(*[F.lpad(F.lower(F.hex(c)), 13 if i < 4 else 12, "0") for i, c in enumerate(_SHA)])
    near_next = F.when(F.col("which") == 1, _alike("fp", "next")).otherwise(1.0)
    return rows.select(F.when(F.col("given") == 1, F.col("id")).alias("doc_id"), "n_chars", sha.alias("edited_sha256"), _hex("fp").alias("fingerprint"), _hex("edited").alias("edited_fingerprint"), _alike("fp", "edited").alias("near_edited"), near_next.alias("near_next"), "fp1", "fp2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_same, n_within.

    For the documents whose id is divisible by 50, null for the others: n_same is the number of other documents with the
    same fingerprint, n_within that of all others whose fingerprints lie within RADIUS bits, those with the same included.
    """
    rows = checkpointed(edited_fingerprints(plain_table(spark, sf_dir, "documents", "doc_id", "text")))
    asked = rows.where(F.col("doc_id") % 50 == 0)
    classes = rows.groupBy("fp1", "fp2").agg(F.count("*").alias("size"))
    found = neighbours(asked, rows).join(classes, ["fp1", "fp2"])
    linked = found.groupBy(F.col("q1").alias("fp1"), F.col("q2").alias("fp2")).agg((F.sum(F.when(F.col("distance") == 0, F.col("size"))) - 1).alias("n_same"), (F.sum("size") - 1).alias("n_within"))
    counted = rows.join(linked, ["fp1", "fp2"], "left")
    own = [F.when(F.col("doc_id") % 50 == 0, F.col(c)).alias(c) for c in ("n_same", "n_within")]
    return counted.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *own)

"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent between 0 (all alike) and 1 (as they are). The
exponent is bisected to meet a repetition limit, a target entropy, or both. The weights become token budgets, and each
budget is drawn from passes over the source's documents in block permutations: blocks are permuted anew in every pass, and
the documents within each block. Only the last pass of a source may stop early, where its budget ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import checkpointed, read_table

#: A source with more than one in so many rows is a large one. There can't be more large ones than that, so these are broadcast; rows
#: of the others are joined by their source, of which none has many.
LARGE = 1_000
#: Exponents that are tried in one pass over the token counts, and passes: 60 bits in all.
TRIED, PASSES = 31, 12
#: Blocks that each source's documents are dealt to by the hash of their id and text: so many at least, and one for so many rows of
#: the table, so that no block of the largest source grows with the table.
BLOCKS = 1024
BLOCK_ROWS = 100_000
REPETITION_LIMIT = 2.0
SEED = 17


@dataclass(frozen=True)
class Share:
    source: str | None
    tokens: int
    weight: float
    budget: float

    @property
    def passes(self) -> int:
        """Whole passes; documents of a source without any tokens cost nothing and are all drawn once."""
        return int(self.budget / self.tokens + 1e-9) if self.tokens else 1

    @property
    def rest(self) -> float:
        return max(0.0, self.budget - self.passes * self.tokens) if self.tokens else 0.0


def bisect(holds: Callable[[float], bool], steps: int = 60) -> float:
    """Smallest exponent in 0..1 for which holds() is true; it must stay true above, and 1 is returned if it never is."""
    return sect(lambda tried: [holds(a) for a in tried], 1, steps)


def sect(hold: Callable[[list[float]], list[bool]], tried: int = TRIED, passes: int = PASSES) -> float:
    """bisect() with so many exponents tried at a time, evenly between the bounds."""
    if hold([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(passes):
        inner = [low + (high - low) * k / (tried + 1) for k in range(1, tried + 1)]
        first = next((k for k, held in enumerate(hold(inner)) if held), tried)
        low, high = inner[first - 1] if first else low, inner[first] if first < tried else high
    return high


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [r / (sum(raised) or 1.0) for r in raised]


def entropy(shares: list[float]) -> float:
    return -sum(w * math.log(w) for w in shares if w > 0)


#: For exponents: sums over all sources of share ** exponent, and of share ** exponent x ln share.
Sums = Callable[[list[float]], list[tuple[float, float]]]


def _exponent(sums: Sums, total: int, least: float, most: float, repetition_limit: float | None, target_entropy: float | None, budget: float | None, tried: int = TRIED, passes: int = PASSES) -> float:
    """The exponent of temper(), from sums alone; least and most are the smallest and largest share of a source with tokens.

    Budgets are budget(a) x share ** a / S(a), so the smallest source is repeated most, whatever the exponent; the entropy of the
    weights is ln S(a) - a x D(a) / S(a).
    """

    def kept(exponents: list[float]) -> list[bool]:
        return [least ** (a - 1) * _whole(a, s, total, most, budget) / (s * total) <= repetition_limit * (1 + 1e-12) for a, (s, _) in zip(exponents, sums(exponents))]

    def reached(exponents: list[float]) -> list[bool]:
        return [math.log(s) - a * d / s <= target_entropy for a, (s, d) in zip(exponents, sums(exponents))]

    at = [0.0] if repetition_limit is None else [sect(kept, tried, passes)]
    if target_entropy is not None:
        at.append(sect(reached, tried, passes))
    return max(at)


def _whole(exponent: float, raised: float, total: int, most: float, budget: float | None) -> float:
    """Tokens of all budgets: as wanted, or just enough for every document of the largest source, which is repeated least."""
    return budget if budget is not None else total * most ** (1 - exponent) * raised


def temper(tokens: dict, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget: float | None = None) -> tuple[float, list[Share]]:
    """Exponent and shares for the sources' token counts.

    repetition_limit: no source's budget is more than so many times its tokens. The smallest exponent, that is the most
    even mixture, that keeps to it is taken. target_entropy (nats): the exponent at which the entropy falls to it; where
    both are given, the larger exponent, which keeps to the limit. budget: tokens in all; by default just enough that
    every document is used once at least. Sources without tokens get no budget. A limit that not even the sources' own
    shares meet (a budget larger than limit x tokens) leaves exponent 1.
    """
    names = sorted(tokens, key=lambda s: (s is not None, s or ""))
    counts = [tokens[s] for s in names]
    total = sum(counts)
    if not total:
        return 1.0, [Share(s, 0, 0.0, 0.0) for s in names]
    own = [t / total for t in counts if t]
    raised = lambda tried: [(sum(s**a for s in own), sum(s**a * math.log(s) for s in own)) for a in tried]
    exponent = _exponent(raised, total, min(own), max(own), repetition_limit, target_entropy, budget, 1, 60)
    whole = _whole(exponent, raised([exponent])[0][0], total, max(own), budget)
    return exponent, [Share(s, t, w, w * whole) for s, t, w in zip(names, counts, weights(counts, exponent))]


def _tempered(sources: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget: float | None = None) -> tuple[float, DataFrame]:
    """temper() for sources (source, tokens, n) of any number: exponent, and sources with weight, budget, passes and rest.

    Sources with equal token counts count together, as (tokens, how many), a table that each pass over it sums for TRIED
    exponents. Sums are decimals, so they don't depend on how the table is dealt out.
    """
    counts = checkpointed(sources.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")))
    all_ = counts.agg(F.sum(F.col("tokens") * F.col("n")).alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    total = all_["total"]
    if not total:
        nothing = {"weight": F.lit(0.0), "budget": F.lit(0.0), "passes": F.lit(1), "rest": F.lit(0.0)}
        return 1.0, sources.withColumns(nothing)
    share = F.col("tokens") / F.lit(float(total))
    exact = "decimal(38,18)"

    def raised(tried: list[float]) -> list[tuple[float, float]]:
        # exponents are data, so that the same compiled code serves every pass
        each = counts.select("tokens", "n", F.posexplode(F.lit(tried)).alias("i", "a"))
        power = F.col("n") * F.pow(share, F.col("a"))
        found = each.groupBy("i").agg(F.sum(power.cast(exact)).alias("s"), F.sum((power * F.ln(share)).cast(exact)).alias("d")).collect()
        return [(float(r["s"]), float(r["d"])) for r in sorted(found)]

    least, most = all_["least"] / total, all_["most"] / total
    exponent = _exponent(raised, total, least, most, repetition_limit, target_entropy, budget)
    ((s, _),) = raised([exponent])
    whole = _whole(exponent, s, total, most, budget)
    some = F.col("tokens") > 0
    weight = F.when(some, F.pow(share, F.lit(exponent)) / s).otherwise(0.0)
    given = sources.withColumn("weight", weight).withColumn("budget", F.col("weight") * whole)
    given = given.withColumn("passes", F.when(some, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(1).cast("int"))
    return exponent, given.withColumn("rest", F.when(some, F.greatest(F.lit(0.0), F.col("budget") - F.col("passes") * F.col("tokens"))).otherwise(0.0))


def _words(text: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _block(doc_id: str, text, seed: int, n) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), text), F.lit(n)).cast("int")


def _block_order(epoch, source: str, block: str, seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), epoch, F.col(source), F.col(block))


def _place_order(epoch, doc_id: str, text, seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed + 1), epoch, F.col(doc_id), text)


@dataclass(frozen=True)
class Mixture:
    exponent: float
    #: source, tokens, n (rows), weight, budget, passes, rest, cut_block, cut_place: one row a source; what comes before the cut is in
    #: the last pass.
    sources: DataFrame
    #: doc_id, source, tokens, text_hash, block of every row.
    rows: DataFrame
    #: source, block, tokens: sums over rows.
    blocks: DataFrame
    seed: int
    #: Blocks of a source, rows in all, and whether there are sources that aren't large.
    n_blocks: int
    n_rows: int
    small: bool


def _joined(frame: DataFrame, sources: DataFrame, source: str, n_rows: int, small: bool) -> DataFrame:
    """Each row of frame with its source's row (source_, n_ and others): large sources are broadcast, those of the others shuffled."""
    large = F.col("n_") * LARGE >= n_rows
    met = frame.join(F.broadcast(sources.where(large)), frame[source].eqNullSafe(F.col("source_")))
    if not small:
        return met
    return met.unionByName(frame.join(sources.where(~large).hint("merge"), frame[source].eqNullSafe(F.col("source_"))))


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, **targets) -> Mixture:
    """Exponent, weights, and for each source where its last pass ends; targets as in temper(). Tokens are words here.

    The sums by source and block are all that is looked at as a whole, and stay a table; a cut is found in one block of a
    source. So a source that holds most of the rows is spread over its blocks like any other, and any number of sources will do.
    """
    n_rows = docs.count()
    n_blocks = max(BLOCKS, n_rows // BLOCK_ROWS)
    own = F.xxhash64(text)
    rows = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _words(text).alias("tokens"), own.alias("text_hash"), _block(doc_id, own, seed, n_blocks).alias("block")))
    blocks = checkpointed(rows.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    exponent, given = _tempered(checkpointed(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))), **targets)
    shares = checkpointed(given)
    small = not shares.where(F.col("n") * LARGE < n_rows).isEmpty()
    known = shares.select(F.col("source").alias("source_"), F.col("n").alias("n_"), "passes", "rest")
    by_source = Window.partitionBy("source").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    ordered = _joined(blocks.drop("n"), known, "source", n_rows, small).withColumn("at", _block_order(F.col("passes"), "source", "block", seed)).withColumn("upto", F.sum("tokens").over(by_source))
    # the block in which the budget ends: the first that goes beyond it
    ends = checkpointed(ordered.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("block", "at", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"), "passes"), "at").alias("end")).select(F.col("source").alias("s"), "end.*"))
    sized = ends.join(shares.select(F.col("source").alias("source_"), F.col("n").alias("n_")), F.col("s").eqNullSafe(F.col("source_"))).select("source_", "n_", F.col("block").alias("end_block"), "room", "passes")
    near = _joined(rows, sized, "source", n_rows, small).where("block = end_block").select("source", "tokens", "room", _place_order(F.col("passes"), "doc_id", F.col("text_hash"), seed).alias("place"))
    within = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    places = near.withColumn("upto", F.sum("tokens").over(within)).where(F.col("upto") <= F.col("room")).groupBy(F.col("source").alias("p")).agg(F.max("place").alias("cut_place"))
    cuts = shares.join(ends.select("s", F.col("at").alias("cut_block")), shares["source"].eqNullSafe(F.col("s")), "left").join(places, shares["source"].eqNullSafe(F.col("p")), "left").drop("s", "p")
    return Mixture(exponent, checkpointed(cuts), rows, blocks, seed, n_blocks, n_rows, small)


def _copies(frame: DataFrame, mixture: Mixture, doc_id: str, source: str, text) -> DataFrame:
    """Adds __passes, how often a row is drawn, and __budget and __weight of its source."""
    named = {"source": "source_", "n": "n_", "passes": "__full", "budget": "__budget", "weight": "__weight", "cut_block": "__cut_block", "cut_place": "__cut_place"}
    cuts = mixture.sources.select(*[F.col(c).alias(to) for c, to in named.items()])
    at = F.xxhash64(F.lit(mixture.seed), F.col("__full"), F.col(source), _block(doc_id, text, mixture.seed, mixture.n_blocks))
    in_last = (at < F.col("__cut_block")) | ((at == F.col("__cut_block")) & (_place_order(F.col("__full"), doc_id, text, mixture.seed) <= F.col("__cut_place")))
    joined = _joined(frame, cuts, source, mixture.n_rows, mixture.small)
    return joined.withColumn("__passes", F.col("__full") + F.when(F.coalesce(in_last, F.lit(False)), 1).otherwise(0)).drop("source_", "n_", "__full", "__cut_block", "__cut_place")


def mixed(docs: DataFrame, mixture: Mixture, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every row of docs as often as the mixture draws it, columns unchanged; of large sources, no text is shuffled for it.

    Rows with equal doc_id, source and text are drawn equally often. A null source is a source of its own, and null ids take
    part like one id. A source without any words is drawn once. An empty table gives an empty table.
    """
    hidden = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.withColumnsRenamed(hidden)
    drawn = _copies(renamed, mixture, hidden[doc_id], hidden[source], F.xxhash64(hidden[text])).withColumn("__pass", F.explode(F.array_repeat(F.lit(1), F.col("__passes"))))
    return drawn.select(*[F.col(f"`{own}`").alias(c) for c, own in hidden.items()])


def draws(mixture: Mixture) -> DataFrame:
    """One row for each time a document is drawn: doc_id, source, pass, block, tokens, start, place, weight.

    start is the number of the source's tokens drawn before; place = start / budget: in the order of place, all sources
    run along evenly, so that any stretch of the mixture has about the target weights.
    """
    seed = mixture.seed
    rows = _copies(mixture.rows, mixture, "doc_id", "source", F.col("text_hash")).withColumn("pass", F.explode(F.expr("filter(sequence(0, __passes), i -> i < __passes)"))).withColumn("at", _place_order(F.col("pass"), "doc_id", F.col("text_hash"), seed))
    own = Window.partitionBy("source", "pass", "block").orderBy("at", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    known = mixture.sources.select(F.col("source").alias("source_"), F.col("n").alias("n_"), F.col("passes").alias("full"))
    each = _joined(mixture.blocks.drop("n"), known, "source", mixture.n_rows, mixture.small).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full")))).select("source", "pass", "block", "tokens").withColumn("at", _block_order(F.col("pass"), "source", "block", seed))
    order = Window.partitionBy("source", "pass").orderBy("at", "block")
    whole = Window.partitionBy("source", "pass")
    offsets = each.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("block").alias("b"), (F.sum("tokens").over(order) - F.col("tokens") + F.col("pass") * F.sum("tokens").over(whole)).alias("offset"))
    placed = within.join(offsets, within["source"].eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("offset") + F.col("inside")
    return placed.select("doc_id", "source", F.col("pass").cast("int").alias("pass"), "block", "tokens", start.alias("start"), F.coalesce(F.try_divide(start, F.col("__budget")), F.lit(0.0)).alias("place"), F.col("__weight").alias("weight"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of the mixture of all documents: doc_id, source, pass, block, tokens, start, place, weight, exponent."""
    mixture = plan(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return draws(mixture).withColumn("exponent", F.lit(mixture.exponent))

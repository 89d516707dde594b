"""Mixing sources to target weights.

Method: temperature mixing. ``temper`` raises the sources' own token shares to an exponent and
normalises them: 1 leaves the shares, 0 makes all sources equal. The exponent is bisected to meet a
target entropy, or to the lowest one that meets the repetition limits at an asked size (the sources as
even as may be). The weights are realised as budgeted block permutations: a
source is passed over as often as its budget holds all its tokens; what is left of the budget takes a
permutation of its documents, by blocks of hashed ids, up to the block in which the budget ends, in
that block by smaller blocks, and in the last of those document by document. ``permuted`` gives the
order of the mix: every pass over a source has a permutation of its own.

No exponent on the own shares alone reaches arbitrary target shares. ``plan`` therefore bends from the
targets: with a source's own share p and its target t the weight is t * (p / t) ** a, normalised; the
exponent 0 gives the targets, 1 the shares as they are, and it is the smallest, found by bisection,
that meets the repetition limits at the asked total size. Without an asked size the mix is as large as
the limits let it be with all targets reached, and the exponent 0.

Scale: texts are read once, to count tokens; ids and counts are written and used from there. Only the
listed sources' totals (at most ``MAX_SOURCES``) reach the driver. Running sums go over the blocks of a
source, 4096 whatever the number of sources, over the 4096 blocks within one of them, and
over the documents of one of those: a 16-millionth of a source.

Defined results: sources are the same if they agree without case and blanks at either end, and hyphens
and inner blanks are underscores; unlisted and null sources have no part in the mix and are reported
without target; listed sources without tokens can't be reached, get weight 0, and the others' targets
are scaled up to 1; documents with null or empty text have no tokens and no part; equal documents are
documents of their own; of repeated listings of a source the greatest row holds; null, zero or negative
shares and repeats leave a source out; an empty corpus gives an empty mix.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

MAX_SOURCES = 10_000
#: Blocks of a source, and blocks within a block: as many bits of the hashed id each.
BLOCK_BITS = 12
#: Beyond this even the entropy of near shares is next to none.
MOST_EXPONENT = 64.0
#: A public tokenizer's ranks; the path is a parameter wherever it is used.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to those ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def same_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""), r"(?U)[\s-]+", "_"))


def _counter(path: str):
    held: list = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            held.append(tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
        encode = held[0]
        for b in batches:
            counts = [len(encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return count


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of documents with text; ``source`` in its canonical spelling."""
    texts = documents.where(F.length("text") > 0).select("doc_id", same_source(F.col("source")).alias("source"), "text")
    return texts.mapInArrow(_counter(tokenizer), "doc_id bigint, source string, n_tokens bigint")


@dataclass(frozen=True)
class Share:
    source: str
    tokens: int
    target: float
    repeats: int
    weight: float
    budget: float


def weights_at(exponent: float, natural: list[float], target: list[float]) -> list[float]:
    raw = [math.exp(math.log(t) + exponent * (math.log(p) - math.log(t))) if p > 0 and t > 0 else 0.0 for p, t in zip(natural, target, strict=True)]
    total = sum(raw)
    return [r / total for r in raw] if total else raw


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect(good, low: float, high: float, steps: int = 80) -> float:
    """The smallest exponent in ``[low, high]`` that is ``good``, which all above it are."""
    if good(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def plan(sources: list[tuple[str, int, float, int]], size: float | None = None, target_entropy: float | None = None) -> list[Share]:
    """Weights and budgets of ``(source, tokens, target share, most repeats)``.

    ``size``: tokens of the whole mix. A size that even the shares as they are can't fill within the
    repetition limits is lowered to what they can.
    """
    able = [s for s in sources if s[1] > 0 and s[2] and s[2] > 0 and s[3] and s[3] > 0]
    if not able:
        return []
    tokens = sum(s[1] for s in able)
    natural, total = [s[1] / tokens for s in able], sum(s[2] for s in able)
    target = [s[2] / total for s in able]
    most = [s[1] * s[3] for s in able]

    def largest(weights: list[float]) -> float:
        return min(m / w for m, w in zip(most, weights, strict=True) if w > 0)

    exponent = 0.0
    if target_entropy is not None:
        rising = entropy(weights_at(1.0, natural, target)) >= entropy(target)
        exponent = bisect(lambda a: (entropy(weights_at(a, natural, target)) >= target_entropy) == rising, 0.0, 1.0)
    if size is not None:
        size = min(size, largest(natural))
        exponent = max(exponent, bisect(lambda a: largest(weights_at(a, natural, target)) >= size * (1 - 1e-12), 0.0, 1.0))
    weights = weights_at(exponent, natural, target)
    size = largest(weights) if size is None else min(size, largest(weights))
    return [Share(s[0], s[1], s[2], s[3], w, w * size) for s, w in zip(able, weights, strict=True)]


def temper(sources: list[tuple[str, int, float, int]], target_entropy: float | None = None, size: float | None = None) -> list[Share]:
    """Weights ``p ** a`` of the sources' own shares, and budgets, of ``(source, tokens, target share, most repeats)``.

    ``target_entropy``: the exponent in [0, ``MOST_EXPONENT``] that gives it (at an end of that range, what comes
    nearest). ``size``: tokens of the whole mix; the lowest exponent in [0, 1] (sources as equal as may
    be) at which no source is repeated more often than its limit, lowered if even the shares as they are
    can't fill it. With both, the higher of the two exponents. With neither, the shares as they are.
    """
    able = [s for s in sources if s[1] > 0 and s[3] and s[3] > 0]
    if not able:
        return []
    tokens = sum(s[1] for s in able)
    natural, even = [s[1] / tokens for s in able], [1 / len(able)] * len(able)
    most = [s[1] * s[3] for s in able]

    def weights_of(a: float) -> list[float]:
        return weights_at(a, natural, even)  # even shares raised to 1 - a are one constant, so these are p ** a normalised

    def largest(a: float) -> float:
        return min(m / w for m, w in zip(most, weights_of(a), strict=True))

    exponents = []
    if target_entropy is not None:  # entropy falls as the exponent rises
        exponents.append(bisect(lambda a: entropy(weights_of(a)) <= target_entropy, 0.0, MOST_EXPONENT))
    if size is not None:
        size = min(size, largest(1.0))
        exponents.append(bisect(lambda a: largest(a) >= size * (1 - 1e-12), 0.0, 1.0))
    exponent = max(exponents, default=1.0)
    size = largest(exponent) if size is None else min(size, largest(exponent))
    return [Share(s[0], s[1], s[2], s[3], w, w * size) for s, w in zip(able, weights_of(exponent), strict=True)]


def listed_totals(counts: DataFrame, listed: DataFrame) -> list[tuple[str, int, float, int]]:
    """The listed sources with their tokens; ``listed`` has source, target_share, max_repeats."""
    one = listed.where(F.col("source").isNotNull()).groupBy(same_source(F.col("source")).alias("source")).agg(F.max(F.struct("target_share", "max_repeats")).alias("l"))
    totals = counts.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    rows = one.join(totals, "source", "left").select("source", F.coalesce("n", F.lit(0)), "l.target_share", "l.max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    return sorted(tuple(r) for r in rows)


def _boundary(sizes: DataFrame, block: str, budget: str) -> DataFrame:
    """Per source the block in which the budget ends, and what of the budget falls into it; no row if the budget is spent before."""
    along = Window.partitionBy("source").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    running = sizes.withColumn("before", F.coalesce(F.sum("block_tokens").over(along), F.lit(0)))
    inside = (F.col("before") < F.col(budget)) & (F.col("before") + F.col("block_tokens") >= F.col(budget))
    return running.where(inside).select("source", F.col(block).alias(f"last_{block}"), (F.col(budget) - F.col("before")).alias(f"{block}_budget"))


def realise(counts: DataFrame, shares: list[Share], seed: int = 0, bits: int = BLOCK_BITS) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the documents that have a part in the mix.

    The tables that are broadcast have a row per planned source.
    """
    spark = counts.sparkSession
    rows = [(s.source, int(s.budget // s.tokens), float(s.budget - s.tokens * (s.budget // s.tokens))) for s in shares]
    passes = spark.createDataFrame(rows, "source string, passes int, remainder double")
    place = F.xxhash64("doc_id", F.lit(seed))
    top = lambda shift: F.shiftrightunsigned("place", 64 - bits * shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    docs = counts.where(F.col("n_tokens") > 0).join(F.broadcast(passes), "source").withColumn("place", place)
    docs = docs.withColumn("block", top(1)).withColumn("part", top(2))
    sizes = docs.groupBy("source", "block", "remainder").agg(F.sum("n_tokens").alias("block_tokens"))
    first = materialize(_boundary(sizes, "block", "remainder"))
    within = docs.join(F.broadcast(first), "source").where(F.col("block") == F.col("last_block"))
    second = materialize(_boundary(within.groupBy("source", "part", "block_budget").agg(F.sum("n_tokens").alias("block_tokens")), "part", "block_budget"))
    cut = docs.join(F.broadcast(first.join(F.broadcast(second), "source")), "source", "left")
    before = (F.col("block") < F.col("last_block")) | ((F.col("block") == F.col("last_block")) & (F.col("part") < F.col("last_part")))
    here = F.coalesce((F.col("block") == F.col("last_block")) & (F.col("part") == F.col("last_part")), F.lit(False))
    clear = cut.where(~here).withColumn("more", F.coalesce(before, F.lit(False)).cast("int"))
    # unsigned order, as that of the blocks
    order = [F.shiftrightunsigned("place", 1), "place", "doc_id"]
    earlier = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a document that the budget ends in is taken if more than half of it fits
    part = cut.where(here).withColumn("more", (earlier + F.col("n_tokens") / 2 <= F.col("part_budget")).cast("int"))
    every = clear.unionByName(part).withColumn("copies", F.col("passes") + F.col("more"))
    return every.where(F.col("copies") > 0).select("doc_id", "source", "n_tokens", "copies")


def permuted(mix: DataFrame, seed: int = 0) -> DataFrame:
    """A row per copy with its ``pass_no`` and a ``place`` to sort the mix by: each pass has an order of its own."""
    copies = mix.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("pass_no"))
    return copies.withColumn("place", F.xxhash64("doc_id", "pass_no", F.lit(seed)))


def shares_reached(counts: DataFrame, mix: DataFrame, listed: DataFrame) -> DataFrame:
    """Per source, listed or not: documents, tokens, target, what of them is in the mix and the share reached."""
    there = counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    used = mix.groupBy(F.col("source").alias("used_source")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    one = listed.where(F.col("source").isNotNull()).groupBy(same_source(F.col("source")).alias("listed_source")).agg(F.max(F.struct("target_share", "max_repeats")).alias("l"))
    rows = there.join(one, F.col("source") == F.col("listed_source"), "full").withColumn("source", F.coalesce("source", "listed_source"))
    rows = rows.join(used, F.col("source") == F.col("used_source"), "left")
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "source",
        zero("n_documents").alias("n_documents"),
        zero("n_tokens").alias("n_tokens"),
        F.col("l.target_share").alias("target_share"),
        F.col("l.max_repeats").alias("max_repeats"),
        zero("mixed_tokens").alias("mixed_tokens"),
        zero("most_copies").alias("most_copies"),
        F.coalesce(F.col("mixed_tokens") / total, F.lit(0.0)).alias("share_reached"),
    )

"""Mixing sources to target weights: temperature mixing with a bisected exponent, and budgeted block permutations.

A source with the share p of all tokens gets the weight p^t / sum(p^t). Lowering t from 1 to 0 raises the entropy of the
weights and the repetition of the smallest source. Bisection finds the largest t in [0, 1] whose entropy reaches ``evenness`` times
the largest possible one, unless that repeats a source more than ``max_epochs`` times: then the smallest t that does not.
At t = 1 every source is repeated budget / corpus times, so a larger budget than ``max_epochs`` corpora is not met.

The weights are realised by streams. Each source's documents are permuted anew for every epoch by a hash of (seed, epoch,
id); they are taken until the source's budget is used, the last one starting within it. Block k holds the
documents that start within the k-th ``block_tokens`` * weight tokens of every stream, so each block has the target weights and
blocks can be read in order or in parallel.

Tokens are words between ASCII white space. Null and empty texts have none; such documents come in where their place in the permutation
falls. A null source is the source ''. Repeated rows are documents by themselves; those alike in id and length are
interchangeable. A corpus without tokens gives no rows. Everything is DataFrame expressions; a hot source is a
range of many partitions, never one window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.ordered import running_sums
from recollect.llm.common import saved, words_of

EVENNESS = 0.95
MAX_EPOCHS = 4
BLOCK_TOKENS = 1_000_000
SEED = 17
LEVELS = 5  # levels of the bisection that one pass over the sources answers
PASSES = 8


def sources_of(docs: DataFrame) -> DataFrame:
    """_source, tokens: one row per source that has any."""
    return docs.groupBy("_source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")


def find_exponent(sources: DataFrame, total: int, budget: int, evenness: float, max_epochs: float) -> float:
    """Bisect the exponent. One pass evaluates the 2^LEVELS - 1 inner points that the next LEVELS halvings can ask for."""
    p = F.col("tokens") / F.lit(float(total))

    def holds(points: list[float]) -> list[tuple[bool, bool]]:
        sums = []
        for i, t in enumerate(points):
            w = F.pow(p, F.lit(t))
            sums += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"l{i}"), F.max(w / p).alias(f"r{i}")]
        row = sources.agg(F.count(F.lit(1)).alias("n"), *sums).first()
        entropy = [math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"] for i in range(len(points))]
        epochs = [row[f"r{i}"] / row[f"z{i}"] * budget / total for i in range(len(points))]
        return [(h >= evenness * math.log(row["n"]) - 1e-12, e <= max_epochs) for h, e in zip(entropy, epochs, strict=True)]

    def bisect(which: int, low: float, high: float) -> float:
        """Entropy (0) holds below a border, the repetition limit (1) above it; the border's side that holds."""
        for _ in range(PASSES):
            step = (high - low) / (1 << LEVELS)
            points = [low + step * i for i in range(1, 1 << LEVELS)]
            true = [x[which] for x in holds(points)]
            k = sum(true) if which == 0 else len(true) - sum(true)
            low, high = low + step * k, low + step * (k + 1)
        return low if which == 0 else high

    (even, rare), (_, widest) = holds([1.0, 0.0])
    if not rare:
        return 1.0
    wanted = 1.0 if even else bisect(0, 0.0, 1.0)
    return round(wanted if widest else max(wanted, bisect(1, 0.0, 1.0)), 9)


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in its source's permutation of an epoch."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix_sources(
    docs: DataFrame,
    budget: int | None = None,
    evenness: float = EVENNESS,
    max_epochs: float = MAX_EPOCHS,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, epoch, block, place, n_tokens, weight. ``budget`` in tokens; without one, the corpus size."""
    sized = docs.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("_source"), F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))
    sized = saved(sized, "mixture-sizes")
    sources = saved(sources_of(sized), "mixture-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    t = find_exponent(sources, total, budget, evenness, max_epochs) if total else 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(t))
    norm = sources.agg(F.sum(weight)).first()[0] or 1.0
    shares = sources.select("_source", (weight / F.lit(norm)).alias("weight"), "tokens")
    shares = shares.withColumn("_wanted", F.round(F.col("weight") * F.lit(float(budget)), 3))
    epochs = F.greatest(F.ceil(F.col("_wanted") / F.col("tokens")).cast("int"), F.lit(1))
    # A hot source's documents stay where they are if the sources are few; otherwise adaptive execution splits them.
    passes = sized.join(shares, "_source").select("*", F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch"))
    placed = passes.withColumn("place", place(seed, F.col("epoch"), F.col("doc_id"))).drop("tokens")
    # Whole epochs before the last are taken entirely; the running sum also orders them.
    summed = running_sums(placed, ["_source"], ["epoch", "place", "doc_id", "n_tokens"], {"_end": "n_tokens"})
    begun = F.col("_end") - F.col("n_tokens")
    taken = summed.where(begun < F.col("_wanted"))
    block = F.floor(begun / (F.col("weight") * F.lit(float(block_tokens)))).cast("long")
    return taken.select("doc_id", "source", "epoch", block.alias("block"), "place", "n_tokens", "weight")

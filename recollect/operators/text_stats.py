"""Term statistics and sparse vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions.similarity import dense
from recollect.session import cut

HOT_DF = 1000  # below this no term is hot, however small the corpus
HOT_SHARE = 200  # a term of more than this part of the documents is hot
COUNTED = 1 << 20  # tokens that a task counts at once
LISTED = 1 << 17  # terms that may be broadcast with their counts

Tokenizer = Callable[[str], Column]  # from the name of a text column to its tokens, an array of strings
Embedder = Callable[[DataFrame], DataFrame]  # from (key, text) to (key, embedding); null or no row where it has none


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, term, tf) from (keys, list of tokens), whole documents at a time."""
    for batch in batches:
        upto = np.cumsum(batch.column(batch.num_columns - 1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + COUNTED, side="right")))
            part = batch.slice(begin, end - begin)
            lists, begin = part.column(part.num_columns - 1), end
            held = lists.flatten().dictionary_encode(null_encoding="encode")
            if not len(held):
                continue
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            places, counts = np.unique(rows * len(held.dictionary) + held.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(places, len(held.dictionary))
            keys = [c.take(pa.array(row)) for c in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*keys, held.dictionary.take(pa.array(code)), pa.array(counts, pa.int64())], names=[*part.schema.names[:-1], "term", "tf"])


def term_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text", *scope: str, tokenizer: Tokenizer = X.tokens) -> DataFrame:
    """(key, term, tf). ``scope`` columns, such as an owner, are carried along; ``tokenizer`` may be any expression or pandas UDF.

    A document is one input row, so its task counts it completely, without a shuffle. Only where a look at the keys finds one that repeats are the counts of its rows added.
    """
    keys = list(dict.fromkeys([*scope, key]))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    counted = docs.select(*keys, tokenizer(text).alias("_words")).mapInArrow(_counted, f"{fields}, term string, tf long")
    if docs.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return counted
    return counted.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def document_frequency(tf: DataFrame, *scope: str) -> DataFrame:
    """(term, df) over the rows of :func:`term_frequency`."""
    return tf.groupBy(*scope, "term").agg(F.count("*").alias("df"))


def _with_df(tf: DataFrame, df: DataFrame, n: Column, key: str, listed: int = 0) -> DataFrame:
    """Left join on the term without a hot task for terms that very many documents hold.

    At most 200 times the mean number of terms per document can have a df above n / 200. That list is broadcast, so the rows of these terms, the most of all, stay where
    they are; only the others are joined by a shuffle. With ``listed``, the list holds as many of the most frequent terms as that, if these are more; it reads ``df`` once more.
    """
    least = F.greatest(n / HOT_SHARE, F.lit(HOT_DF))
    if listed:
        # There are few different counts: so many have a sum of at least half their square.
        upto = F.sum("_n").over(Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0))
        sizes = df.groupBy("df").agg(F.count("*").alias("_n")).select("df", upto.alias("_upto"))
        least = F.least(least, sizes.where(F.col("_upto") <= listed).agg(F.min("df") - F.lit(1)).scalar())
    is_hot = F.col("df") > least
    hot, rest = F.broadcast(df.where(is_hot)), df.where(~is_hot)
    names = [*tf.columns, *[c for c in df.columns if c != "term"]]
    rare = tf.join(hot.select("term"), "term", "left_anti").join(rest, "term", "left")
    return tf.join(hot, "term").select(*names).unionByName(rare.select(*names))


def tfidf(tf: DataFrame, df: DataFrame, n: Column, key: str = "doc_id", listed: int = 0) -> DataFrame:
    """(key, term, weight) with weight tf * ln(n / (1 + df)); an unseen term counts as df 1. May be negative. ``listed``: see :func:`_with_df`."""
    joined = _with_df(tf, df, n, key, listed)
    idf = F.ln(n.cast("double") / (1 + F.coalesce("df", F.lit(1))))
    return joined.select(key, "term", (F.col("tf") * idf).alias("weight"))


def _slot1(dim: int) -> Column:
    return F.pmod(F.abs(X.java_hash("term")), F.lit(dim)).cast("int")


def _slot_weights(tf: DataFrame, df: DataFrame, n: Column, key: str, dim: int) -> DataFrame:
    # The hash runs once per term of the vocabulary; only terms it lacks are hashed where they occur.
    joined = _with_df(tf, df.withColumn("slot1", _slot1(dim)), n, key)
    idf = F.ln(1 + F.greatest(n, F.lit(1)).cast("double") / (1 + F.coalesce("df", F.lit(1))))
    weighted = joined.select(
        key, F.length("term").alias("_len"), (F.col("tf") * idf).alias("w"), F.coalesce("slot1", _slot1(dim)).alias("slot1")
    ).withColumn("slot2", ((F.col("slot1") * 31 + F.col("_len")) % dim).cast("int"))
    # Dealt out by key once: the sums, and what callers group by key, need no further shuffle.
    entries = weighted.repartition(key).select(
        key,
        F.explode(
            F.array(
                F.struct(F.col("slot1").alias("slot"), F.col("w").alias("w")),
                F.struct(F.col("slot2").alias("slot"), (F.col("w") * 0.5).alias("w")),
            )
        ).alias("e"),
    )
    return entries.groupBy(key, F.col("e.slot").alias("slot")).agg(F.sum("e.w").alias("weight"))


def hashed_tfidf(tf: DataFrame, df: DataFrame, n: Column, key: str = "doc_id", dim: int = 256) -> DataFrame:
    """(key, slot, weight): tf * ln(1 + n / (1 + df)) hashed into ``dim`` slots, L2-normalised per key."""
    summed = _slot_weights(tf, df, n, key, dim)
    # At most ``dim`` rows per key.
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return (
        summed.withColumn("_norm", norm)
        .where(F.col("_norm") > 0)
        .select(key, "slot", (F.col("weight") / F.col("_norm")).alias("weight"))
    )


def hashed_vectors(tf: DataFrame, df: DataFrame, n: Column, key: str = "doc_id", dim: int = 256) -> DataFrame:
    """The same vectors in dense form (key, embedding); not normalised, as cosine ignores the length."""
    return dense(_slot_weights(tf, df, n, key, dim), key, dim)


def embed_texts(texts: DataFrame, key: str, text: str, embedders: Sequence[Embedder]) -> DataFrame:
    """(key, embedding) by the first of the caller's embedders that has one for a text; texts that none can embed are left out.

    An embedder may be a composition of expressions, a pandas UDF over a model, or a look-up. Later ones see only what is left. ``key`` is unique.
    """
    left = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    done = []
    for embedder in embedders:
        made = cut(embedder(left).where(F.col("embedding").isNotNull()).select("key", "embedding"))
        done.append(made)
        left = left.join(made, "key", "left_anti")
    return reduce(DataFrame.unionByName, done).withColumnRenamed("key", key)

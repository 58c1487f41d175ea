"""Top rows per key.

``row_number() <= constant`` lets Spark keep only the best rows of each key inside every input partition
(window group limit) before the shuffle, so a key that owns a third of the table sends a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str | None = "rank"
) -> DataFrame:
    """The first ``k`` rows of every key in the given order, with their 1-based rank."""
    name = rank_col or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(name) <= k)
    return ranked if rank_col else ranked.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, None)


def ordered_text(value: Column, order: Column, sep: str) -> Column:
    """Join the texts of a bounded group in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), sep)

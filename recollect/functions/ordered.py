"""Order-dependent sums and folds over keys of any size.

A plain window over a key runs in one task, however many rows the key has. Here the rows are range-partitioned by
(key, order), so that a hot key spans many partitions; every partition is a block of consecutive rows. A small table
with one summary per (key, block) carries the state over block borders, and only the two keys at the borders of a
block can need it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.ranking import ordered_text
from recollect.session import cut

BLOCK = "_block"
PART_BYTES = 1 << 20


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Sort by (keys, order) over the cluster and number the sorted partitions.

    The result is written to the checkpoint folder: the range borders come from a sample, so the two passes over it
    must see the same blocks.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, *order]
    ranged = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    return cut(ranged.withColumn(BLOCK, F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    blocks: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` per key."""
    blocked = ordered_blocks(df, keys, order, blocks)
    return block_sums(blocked, keys, order, sums).drop(BLOCK)


def block_sums(blocked: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Running sums over a frame that :func:`ordered_blocks` made."""
    totals = blocked.groupBy(*keys, BLOCK).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    # One row per (key, block): the frame before the current row sums the earlier blocks of the key.
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, BLOCK, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[F.sum(v).over(inside).alias(f"_l_{n}") for n, v in sums.items()])
    joined = local.join(offsets, [*keys, BLOCK])
    return joined.select(
        *[F.col(c) for c in blocked.columns if c != BLOCK],
        F.col(BLOCK),
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
    )


def row_numbers(df: DataFrame, order: Sequence[str], out: str, blocks: int | None = None) -> DataFrame:
    """Number all rows from 1 in the given ascending order, without bringing them into one task."""
    keyed = df.withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("long")})
    return running_sums(keyed, ["_all"], order, {out: "_one"}, blocks).drop("_all", "_one")


def text_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column, sep: str = "", part_bytes: int = PART_BYTES, out: str = "text") -> DataFrame:
    """(keys, part, out): the texts of a key in order, joined by ``sep``, in parts of about ``part_bytes`` so that no key becomes one giant row.

    A part holds the texts that begin within its bytes of the whole; a text is never cut. The separator before a part's first text is
    its first piece, so the parts of a key, put together as they are, make the whole text. Rows with one place are ordered by their texts; null texts are left out.
    """
    pieces = df.select(*keys, *order, text.alias("_x")).where("_x IS NOT NULL")
    sized = pieces.withColumns({"_one": F.lit(1).cast("long"), "_len": (F.octet_length("_x") + len(sep.encode())).cast("long")})
    summed = running_sums(sized, keys, [*order, "_x"], {"_i": "_one", "_end": "_len"})
    piece = F.when(F.col("_i") > 1, F.concat(F.lit(sep), "_x")).otherwise(F.col("_x"))
    part = F.floor((F.col("_end") - F.col("_len")) / part_bytes).cast("int").alias("part")
    return summed.groupBy(*keys, part).agg(ordered_text(piece, F.col("_i"), "").alias(out))

"""Match every row of one table against every row of another without pairing them as rows.

The queries are written once, cut into blocks of a bounded size. Each block travels to the tasks that read the corpus; the Arrow
batches of the corpus meet it there and leave the task reduced to results. The corpus is read once per block and never
shuffled. With several blocks the results of each are written before the next is fetched, so driver and tasks hold one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.session import cut

BLOCK_ROWS = 4096  # most queries in a block
BLOCK_BYTES = 16 << 20  # and about its most bytes

Prepare = Callable[[pa.Table], Any]
Match = Callable[[Any, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def query_blocks(queries: DataFrame, key: str, block_rows: int, size: Column) -> tuple[int, Callable[[int], pa.Table]]:
    """How many blocks the queries make, at least one, and a function that fetches one of them. The queries are computed once."""
    held = cut(queries.withColumn("_size", size))
    rows, total = held.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    n = max(1, -(-rows // block_rows), -(-total // BLOCK_BYTES))
    numbered = held.drop("_size").withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)))
    return n, lambda k: numbered.where(F.col("_block") == k).drop("_block").toArrow()


def block_match(
    queries: DataFrame,
    corpus: DataFrame,
    key: str,
    prepare: Prepare,
    match: Match,
    schema: str,
    size: Column,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Results of ``match(prepare(queries), batches)`` for the batches of every task of the corpus and every block of queries.

    ``size`` gives the bytes of a query row.
    """

    def against(block: pa.Table) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from match(prepare(block), (batch for batch in batches if batch.num_rows))

        return corpus.mapInArrow(run, schema)

    n, fetch = query_blocks(queries, key, block_rows, size)
    if n == 1:
        return against(fetch(0))
    return reduce(DataFrame.unionByName, [cut(against(fetch(k))) for k in range(n)])

"""Exact cosine scoring of a query table against a vector table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.blocks import BLOCK_ROWS, block_match
from recollect.functions.ranking import top_per_key

DIGITS = 6  # of the scores that are returned
RANK_DIGITS = 12  # equal vectors tie whatever the order of their products, and the id then decides
TILE = 1 << 20  # scores in memory at once
PENDING = 32 << 20  # bytes of vectors that a task gathers before it searches them
HELD_ROWS = 1 << 21  # best rows of a block of queries that a task holds
QUERY_GROUP, ROW_GROUP, FEW_GROUPS = 128, 256, 8


def _unit(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), dim)
    norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return np.divide(matrix, norm[:, None], out=np.zeros_like(matrix), where=norm[:, None] > 0)


def _lengths(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.value_lengths().to_numpy(zero_copy_only=False)


def _values(a: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return a.to_numpy() if isinstance(a, pa.ChunkedArray) else a.to_numpy(zero_copy_only=False)


def _sortable(ids: np.ndarray) -> np.ndarray:
    """The ids as they are ordered by Spark: a null comes first."""
    if ids.dtype.kind == "f":
        return np.where(np.isnan(ids), -np.inf, ids)
    return np.array(["" if x is None else x for x in ids], dtype=object) if ids.dtype == object else ids


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(order, ranges): the rows put in groups of at most ``size`` near rows, by halving along the widest dimension."""
    order, out, left = np.arange(len(x)), [], [(0, len(x))]
    while left:
        a, b = left.pop()
        if b - a <= size:
            out.append((a, b))
            continue
        part, half = x[order[a:b]], (b - a) // 2
        wide = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order[a:b] = order[a:b][np.argpartition(part[:, wide], half)]
        left += [(a, a + half), (a + half, b)]
    return order, sorted(out)


def _balls(x: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(centres, radii) of the groups."""
    centres = np.array([x[a:b].mean(axis=0) for a, b in ranges])
    return centres, np.array([np.sqrt(((x[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(ranges, centres)])


def _few_equal(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows without those that follow ``k`` equal vectors with smaller ids."""
    hashed = (x.view(np.uint64) * (2 * np.arange(x.shape[1], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((ids, hashed))
    new = np.ones(len(x), dtype=bool)
    new[1:] = (hashed[order[1:]] != hashed[order[:-1]]) | (x[order[1:]] != x[order[:-1]]).any(axis=1)
    place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return order[place < k]


class _Best:
    """The best ``k`` rows so far of each of the queries, all of one length and scope.

    Scores below a query's k-th best change nothing, so queries and rows are put in groups of near vectors: a group of rows that is too far from
    a group of queries to reach the least of their k-th best scores is not looked at. Unit vectors at a distance d have the cosine 1 - d * d / 2.
    """

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int):
        known = np.flatnonzero(np.isfinite(q).all(axis=1) & (q != 0).any(axis=1))  # others score with nothing
        order, self.groups = _leaves(q[known], QUERY_GROUP)
        self.qids, self.q, self.k = qids[known][order], q[known][order], k
        self.centres, self.radii = _balls(self.q, self.groups) if len(self.q) else (self.q, np.zeros(0))
        self.scores, self.ids = np.zeros((len(self.q), k)), None

    def offer(self, rows: np.ndarray, ids: np.ndarray) -> None:
        known = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
        rows, ids = rows[known], ids[known]
        if not len(rows) or not len(self.q):
            return
        if self.ids is None:
            self.ids = np.zeros((len(self.q), self.k), dtype=ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids.dtype, ids.dtype))
        if len(self.groups) <= FEW_GROUPS:  # too few to pay for the groups of rows
            for a, b in self.groups:
                for at in range(0, len(rows), TILE // QUERY_GROUP):
                    self._merge(a, b, rows[at : at + TILE // QUERY_GROUP], ids[at : at + TILE // QUERY_GROUP])
            return
        kept = _few_equal(rows, _sortable(ids), self.k)
        order, cells = _leaves(rows[kept], ROW_GROUP)
        rows, ids = rows[kept][order], ids[kept][order]
        centres, radii = _balls(rows, cells)
        squares = (centres**2).sum(axis=1)
        for (a, b), centre, radius in zip(self.groups, self.centres, self.radii):
            # Both are rounded by less than the slack.
            apart = np.sqrt(np.maximum(squares + centre @ centre - 2 * (centres @ centre) - 1e-13, 0)) - radii - radius
            reach = 1 - np.maximum(apart - 1e-9, 0) ** 2 / 2 + 1e-11
            near = np.argsort(-reach)
            at, step = 0, 2
            while at < len(near):
                least = self.scores[a:b, -1].min()
                some = [c for c in near[at : at + step] if reach[c] >= least]
                if not some:
                    break
                found = np.concatenate([np.arange(*cells[c]) for c in some])
                self._merge(a, b, rows[found], ids[found])
                at, step = at + step, min(2 * step, TILE // QUERY_GROUP // ROW_GROUP)

    def _merge(self, a: int, b: int, rows: np.ndarray, ids: np.ndarray) -> None:
        raw, k = self.q[a:b] @ rows.T, self.k
        least = np.maximum(self.scores[a:b, -1:] - 10.0**-RANK_DIGITS, 0)
        hit = raw > least
        if np.count_nonzero(hit) > 4 * k * (b - a) and len(rows) > k:
            hit &= raw >= np.partition(raw, len(rows) - k, axis=1)[:, [len(rows) - k]] - 10.0**-RANK_DIGITS
        at, col = np.nonzero(hit)
        scores = np.round(raw[at, col], RANK_DIGITS)
        at, col, scores = (x[scores > 0] for x in (at, col, scores))
        if not len(at):
            return
        held = np.nonzero(self.scores[a:b] > 0)
        at, scores = np.concatenate([held[0], at]), np.concatenate([self.scores[a:b][held], scores])
        ids = np.concatenate([self.ids[a:b][held], ids[col]])
        order = np.lexsort((_sortable(ids), -scores, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < k
        at, place, order = at[kept], place[kept], order[kept]
        self.scores[a + at, place], self.ids[a + at, place] = scores[order], ids[order]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, len(self.q), max(1, TILE // 8 // self.k)):
            at, place = np.nonzero(self.scores[a : a + max(1, TILE // 8 // self.k)] > 0)
            if len(at):
                yield self.qids[a + at], self.ids[a + at, place], self.scores[a + at, place]


def _usable(df: DataFrame, key: str, alias: str, vec: str, scope: str | None) -> DataFrame:
    cols = [F.col(key).alias(alias), F.col(vec).cast("array<double>").alias("v")]
    if scope:
        cols.append(F.col(scope).cast("string").alias("s"))
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(*cols)


def cosine_hits(
    queries: DataFrame,
    vectors: DataFrame,
    k: int | None,
    query_id: str = "query_id",
    id_col: str = "id",
    vector_col: str = "embedding",
    scope: str | None = None,
    block_rows: int | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """(query_id, id, score, rank) for the best ``k`` positive cosines per query; all, unranked, where ``k`` is None.

    Scores are ranked as they are and returned with ``digits``. With ``scope`` a query only sees vectors with the same value in that column. A vector whose length differs from
    the query's scores 0 and so never appears. A task holds k rows per query of a block, ``PENDING`` bytes of vectors and ``TILE`` scores at a time.
    """
    q = _usable(queries, query_id, "q", vector_col, scope)
    v = _usable(vectors, id_col, "id", vector_col, scope)
    names = [query_id, id_col, "score"]
    schema = f"{query_id} {q.schema['q'].dataType.simpleString()}, {id_col} {v.schema['id'].dataType.simpleString()}, score double"

    def by_length(rows: pa.Table | pa.RecordBatch):
        """(dim, ids, unit vectors, positions per scope) of the rows of each length; without a scope all positions are under None."""
        lengths = _lengths(rows["v"]) if rows.num_rows else np.array([], dtype=int)
        for dim in np.unique(lengths):
            part = rows.filter(pa.array(lengths == dim))
            scopes: dict[str | None, list[int]] = {}
            for at, value in enumerate(part["s"].to_pylist() if scope else []):
                scopes.setdefault(value, []).append(at)
            yield int(dim), _values(part.column(0)), _unit(part["v"], int(dim)), scopes or {None: slice(None)}

    def prepare(table: pa.Table):
        known = {}
        for dim, qids, matrix, scopes in by_length(table):
            for value, at in scopes.items():
                known[dim, value] = (qids[at], matrix[at]) if k is None else _Best(qids[at], matrix[at], k)
        return known, table.schema.field("q").type

    def batch_of(types: list[pa.DataType], *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, [*types, pa.float64()])], names=names)

    def every(state, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, q_type = state
        for batch in batches:
            for dim, ids, matrix, scopes in by_length(batch):
                for value, at in scopes.items():
                    qids, q_matrix = known.get((dim, value), ((), None))
                    some, some_ids = matrix[at], ids[at]
                    step = max(1, TILE // max(len(qids), 1))
                    for a in range(0, len(some) if len(qids) else 0, step):
                        scores = np.round(some[a : a + step] @ q_matrix.T, RANK_DIGITS)
                        row, col = np.nonzero(scores > 0)
                        if len(row):
                            yield batch_of([q_type, batch.schema.field("id").type], qids[col], some_ids[a : a + step][row], scores[row, col])

    def best(state, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, q_type = state
        waiting: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        id_type, held = None, 0

        def offer() -> None:
            for key, parts in waiting.items():
                known[key].offer(*(np.concatenate(x) for x in zip(*parts)))
            waiting.clear()

        for batch in batches:
            id_type = batch.schema.field("id").type
            for dim, ids, matrix, scopes in by_length(batch):
                for value, at in scopes.items():
                    if (dim, value) in known:
                        waiting.setdefault((dim, value), []).append((matrix[at], ids[at]))
                        held += waiting[dim, value][-1][0].nbytes
            if held > PENDING:
                offer()
                held = 0
        offer()
        for one in known.values():
            for columns in one.rows():
                yield batch_of([q_type, id_type], *columns)

    block_rows = block_rows or (BLOCK_ROWS if k is None else max(BLOCK_ROWS, HELD_ROWS // k))
    hits = block_match(q, v, "q", prepare, every if k is None else best, schema, 8 * F.size("v"), block_rows)
    ranked = hits if k is None else top_per_key(hits, [query_id], [F.desc("score"), F.asc(id_col)], k)
    return ranked.withColumn("score", F.round("score", digits))


def dense(df: DataFrame, key: str, dim: int, slot: str = "slot", weight: str = "weight") -> DataFrame:
    """Dense vectors (key, embedding) from (key, slot, weight) rows with one row per key and slot."""
    # At most ``dim`` entries per key, so the lists are bounded.
    listed = df.groupBy(key).agg(F.collect_list(F.struct(F.col(slot).cast("int").alias("s"), F.col(weight).cast("double").alias("w"))).alias("e"))
    sparse = listed.select(key, F.col("e.s").alias("s"), F.col("e.w").alias("w"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.repeat(np.arange(batch.num_rows), _lengths(batch.column("s")))
            matrix = np.zeros((batch.num_rows, dim))
            matrix[rows, batch.column("s").flatten().to_numpy()] = batch.column("w").flatten().to_numpy()
            offsets = pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32())
            vectors = pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), vectors], names=[key, "embedding"])

    return sparse.mapInArrow(fill, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>")


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays as a column expression; 0 for a zero norm or unequal lengths."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    def norm(c):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double")))

    denom = norm(x) * norm(y)
    return F.when((F.size(x) != F.size(y)) | (denom == 0), F.lit(0.0)).otherwise(dot / denom)

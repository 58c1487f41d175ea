"""Vector code compression: product codebooks by dual-tree Lloyd rounds.

Vectors are integers floor(scale * component), cut into equal consecutive parts. Each part position has a codebook of ``entries`` vectors,
at first that part of the vectors with the smallest ids. A round gives every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to floor(sum / count) of its parts; an unused entry stays.

The rows are written once in blocks of at most ``BLOCK`` vectors; a block carries, for every part position, the order of its points in a
balanced tree that halves the widest dimension down to leaves of ``LEAF`` points. A round broadcasts the codebooks (entries x dimension
integers, whatever the number of rows) and walks each block's tree against a tree over the entries: from the boxes of
two nodes follow the least and the greatest distance between them, and a pair of nodes is dropped if its least distance is above another entry node's greatest one for the same
points. A point node that has one entry left is assigned whole, by its cached count and sums; only in the leaves that stay
uncertain are points compared with the entries left. Boxes, bounds, sums and distances are integers, so all is exact and the result does not depend on
how the rows lie. Tasks return one number per part, entry and component.

Rows that are left out, large components and null ids: :func:`recollect.llm.vectors.integer_vectors`. Rows with one id are ordered by their integers when
the first entries are taken; with fewer rows than entries, the codebook is as long as there are rows. If the dimension is no multiple of the
parts, the last part is filled up with zeros. An empty table gives no rows. ``label_error`` is null if the sum does not fit a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recollect.llm.common import saved
from recollect.llm.vectors import integer_vectors, matrix

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LEAF = 16
BLOCK = 1 << 14


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The rows of ``points`` (2^k * leaf of them) in the order of a balanced tree: each node, a run of rows, is halved in its widest dimension."""
    order = np.arange(len(points))
    size = len(points)
    while size > leaf:
        runs = order.reshape(-1, size)
        inside = points[runs]
        widest = (inside.max(axis=1) - inside.min(axis=1)).argmax(axis=1)
        along = np.take_along_axis(inside, widest[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(runs, np.argpartition(along, size // 2, axis=1), axis=1).ravel()
        size //= 2
    return order


def padded(n: int, leaf: int) -> int:
    """The least 2^k * leaf that holds n."""
    return leaf << max(0, (-(-n // leaf) - 1).bit_length())


def boxes(points: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, root first: the least and greatest coordinates of each node of points in tree order."""
    by_leaf = points.reshape(-1, leaf, points.shape[1])
    levels = [(by_leaf.min(axis=1), by_leaf.max(axis=1))]
    while len(levels[0][0]) > 1:
        low, high = levels[0]
        levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
    return levels


def totals(points: np.ndarray, weight: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Per level, root first: the cached sums of each node's points, with their count as the last column."""
    weighted = np.concatenate([points * weight[:, None], weight[:, None]], axis=1)
    levels = [weighted.reshape(-1, leaf, weighted.shape[1]).sum(axis=1)]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0][::2] + levels[0][1::2])
    return levels


class Walk:
    """One part position of a block against its codebook: ``whole`` nodes with their entry, and ``leaves`` point by point."""

    def __init__(self, points: np.ndarray, entries: np.ndarray, leaf: int = LEAF) -> None:
        # Entries are padded with copies of the last one; a copy ties with it and has its index.
        index = np.minimum(np.arange(padded(len(entries), 1)), len(entries) - 1)
        index = index[tree_order(entries[index], 1)]
        self.whole: list[tuple[int, np.ndarray, np.ndarray]] = []  # level, nodes, entries
        self.compared = 0  # pairs of a point and an entry
        near, far = boxes(points, leaf), boxes(entries[index], 1)
        node = other = np.zeros(1, np.int64)
        at = to = 0
        while True:
            low, high = near[at][0][node], near[at][1][node]
            least_e, most_e = far[to][0][other], far[to][1][other]
            least = (np.maximum(np.maximum(least_e - high, low - most_e), 0) ** 2).sum(axis=1)
            most = (np.maximum(high - least_e, most_e - low) ** 2).sum(axis=1)
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(node)]))
            keep = least <= bound
            node, other = node[keep], other[keep]
            if to == len(far) - 1:
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                sizes = np.diff(np.r_[starts, len(node)])
                only = starts[sizes == 1]
                self.whole.append((at, node[only], index[other[only]]))
                rest = np.repeat(sizes > 1, sizes)
                node, other = node[rest], other[rest]
                if at == len(near) - 1 or not len(node):
                    break
            else:
                to += 1
                node, other = np.repeat(node, 2), (other[:, None] * 2 + [0, 1]).ravel()
            if at < len(near) - 1:
                at += 1
                node, other = (node[:, None] * 2 + [0, 1]).ravel(), np.repeat(other, 2)
                order = np.argsort(node, kind="stable")
                node, other = node[order], other[order]
        self.leaves, self.chosen = np.zeros(0, np.int64), np.zeros((0, leaf), np.int64)
        if len(node):
            entry = index[other]
            apart = ((points.reshape(-1, leaf, points.shape[1])[node] - entries[entry][:, None]) ** 2).sum(axis=2)
            self.compared = apart.size
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            best = np.repeat(np.minimum.reduceat(apart, starts), np.diff(np.r_[starts, len(node)]), axis=0)
            self.leaves = node[starts]
            self.chosen = np.minimum.reduceat(np.where(apart == best, entry[:, None], len(entries)), starts)

    def assigned(self, n: int) -> np.ndarray:
        """The entry of each point in tree order."""
        out = np.empty(n, np.int64)
        for level, nodes, entry in self.whole:
            out.reshape(1 << level, -1)[nodes] = entry[:, None]
        if len(self.leaves):
            out.reshape(-1, self.chosen.shape[1])[self.leaves] = self.chosen
        return out

    def sums(self, points: np.ndarray, weight: np.ndarray, cached: list[np.ndarray], entries: int) -> np.ndarray:
        """(entries, components + 1): sums of the points of each entry, and their count."""
        out = np.zeros((entries, points.shape[1] + 1), np.int64)
        for level, nodes, entry in self.whole:
            np.add.at(out, entry, cached[level][nodes])
        if len(self.leaves):
            leaf = self.chosen.shape[1]
            w = weight.reshape(-1, leaf)[self.leaves].ravel()
            p = points.reshape(-1, leaf, points.shape[1])[self.leaves].reshape(len(w), -1)
            np.add.at(out, self.chosen.ravel(), np.concatenate([p * w[:, None], w[:, None]], axis=1))
        return out


def blocks_of(vectors: DataFrame, parts: int, block: int) -> DataFrame:
    """ids, labels, n, points, orders: the vectors (vec_id, label, x) in blocks with a tree per part position."""
    label = vectors.schema["label"].dataType
    label_type = to_arrow_type(label)

    def pack(ids: list, labels: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(rows)
        n = len(x)
        x = np.pad(x, ((0, padded(n, LEAF) - n), (0, -x.shape[1] % parts)))
        x[n:] = x[n - 1]
        cut = x.reshape(len(x), parts, -1)
        orders = np.stack([tree_order(cut[:, p], LEAF) for p in range(parts)])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(label_type)), pa.array([n]), pa.array([x.astype(np.int32).tobytes()]), pa.array([orders.astype(np.int32).tobytes()])],
            names=["ids", "labels", "n", "points", "orders"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, held = [], [], [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - held)
                ids += part.column(0).to_pylist()
                labels += part.column(1).to_pylist()
                rows.append(matrix(part.column(2)))
                held += part.num_rows
                batch = batch.slice(part.num_rows)
                if held == block:
                    yield pack(ids, labels, rows)
                    ids, labels, rows, held = [], [], [], 0
        if held:
            yield pack(ids, labels, rows)

    schema = f"ids array<long>, labels array<{label.simpleString()}>, n long, points binary, orders binary"
    return saved(vectors.select(F.col("vec_id").cast("long"), "label", "x").mapInArrow(run, schema), "code-blocks")


def read_block(batch: pa.RecordBatch, k: int, parts: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, points (padded, parts, components), orders (parts, padded) of a block."""
    orders = np.frombuffer(batch.column(4)[k].as_buffer(), np.int32).reshape(parts, -1)
    points = np.frombuffer(batch.column(3)[k].as_buffer(), np.int32).reshape(orders.shape[1], parts, -1)
    return batch.column(2)[k].as_py(), points.astype(np.int64), orders


def moved(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, components) after one round."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                n, points, orders = read_block(batch, k, parts)
                for p in range(parts):
                    own, weight = points[orders[p], p], (orders[p] < n).astype(np.int64)
                    out[p] += Walk(own, codebooks[p]).sums(own, weight, totals(own, weight, LEAF), entries)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out.ravel()[used])], names=["place", "total"])

    total = np.zeros((parts, entries, width + 1), object)
    summed = blocks.mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    for row in summed.collect():  # at most parts x entries x (components + 1) rows
        total.ravel()[row["place"]] = int(row["total"])
    out = codebooks.copy()
    for p, e in np.argwhere(total[:, :, width] > 0):
        out[p, e] = [x // total[p, e, width] for x in total[p, e, :width]]
    return out


def coded(blocks: DataFrame, codebooks: np.ndarray, label: str) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts = len(codebooks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, points, orders = read_block(batch, k, parts)
                codes, error = np.empty((points.shape[0], parts), np.uint8), np.zeros(points.shape[0], np.int64)
                for p in range(parts):
                    own = points[orders[p], p]
                    entry = Walk(own, codebooks[p]).assigned(len(own))
                    codes[orders[p], p] = entry
                    error[orders[p]] += ((own - codebooks[p][entry]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, batch.column(1)[k].values, pa.array([row.tobytes().hex() for row in codes[:n]]), pa.array(error[:n])],
                    names=["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of the vectors (vec_id, embedding, label), and the codebooks (parts, entries, components)."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits: at most 256 entries")
    whole = integer_vectors(vectors, scale)
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    blocks = blocks_of(whole, parts, block)
    width = -(-len(first[0]["x"]) // parts) if first else 1
    start = np.zeros((len(first), parts * width), np.int64)
    for k, row in enumerate(first):
        start[k, : len(row["x"])] = row["x"]
    codebooks = start.reshape(len(first), parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds if first else 0):
        codebooks = moved(blocks, codebooks)
    return coded(blocks, codebooks, whole.schema["label"].dataType.simpleString()), codebooks


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error (over equal labels, nulls together), codebooks_sha256."""
    found, codebooks = compressed(vectors, parts, entries, rounds, scale)
    rows = saved(found, "codes")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", F.expr("try_cast(_sum AS long)").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))

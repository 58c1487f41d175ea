"""N-gram Jaccard join: T-occurrence search by DivideSkip over inverted lists of word shingles.

Two sets with Jaccard similarity t share at least T = t / (1 + t) * (|x| + |y|) shingles, so a partner occurs T times in the
inverted lists of a set's shingles. DivideSkip sets the longest T - 1 lists aside: a partner must still occur in one of the
remaining short lists, and membership in the long lists is probed. Here the short lists are those of a set's rarest
shingles, |x| - T + 1 of them. Rarity is one global order, from a sketch of ``BUCKETS`` counters over all shingles of the corpus.
The lists are joined by Spark; a pair must also pass the size filter and the position filter (what stands behind the common
shingle in both sets must suffice), and no list's pairs are all made: members meet the list's hub first, then only members of
different components (:mod:`recollect.llm.links`). Inside that join a pair must pass an exact filter on ``PARITY`` bits of which every shingle of a set turns
one over (:func:`recollect.llm.minhash.few_turned`). A pair's short lists are merged for a closer bound (:func:`promising`); the sets of the pairs
left are searched block by block with
:func:`divide_skip`: short lists are merged with a heap, long ones probed by bisection, and the overlap reached is exact.

Equal sets are one class from the start, so copies cost nothing. Words are split at ASCII white space after lower-casing A-Z; a set is the
64-bit hashes of the distinct shingles. With fewer words than a shingle has, the whole sequence is the one shingle; null, empty and blank
texts have an empty set and no link. Repeated rows link to each other. A null id has the component of its class, which is
null if no id is known there. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, fresh, narrowed, run_hashes, saved, scratch, signed, split_words, word_hashes
from recollect.llm.links import joined_components, shared_members
from recollect.llm.minhash import few_turned, few_turned_in, parity_words

SHINGLE = 3
PERCENT = 90
BUCKETS = 1 << 16
PARITY = 512
PARITIES = [f"p{k}" for k in range(PARITY // 64)]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(run_hashes(word_hashes(split_words(text)), width))


def common_needed(x: int, y: int, percent: int) -> int:
    """The least overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


def divide_skip(lists: list[list[int]], least: int, long_lists: int) -> dict[int, int]:
    """Members of at least ``least`` of the sorted lists, with the number of lists they are in (exact).

    The longest ``long_lists`` (fewer than ``least``) lists are probed by bisection; the others are merged with a heap.
    """
    ordered = sorted(lists, key=len)
    cut = len(ordered) - min(long_lists, max(least - 1, 0))
    short, long = ordered[:cut], ordered[cut:]
    found: dict[int, int] = {}
    member, seen = -1, 0

    def probe() -> None:
        have = seen
        for k, held in enumerate(long):
            if have + len(long) - k < least:
                return
            at = bisect_left(held, member)
            have += at < len(held) and held[at] == member
        if have >= least:
            found[member] = have

    for x in heapq.merge(*short):
        if x == member:
            seen += 1
            continue
        if seen and seen + len(long) >= least:
            probe()
        member, seen = x, 1
    if seen and seen + len(long) >= least:
        probe()
    return found


def search_block(query: np.ndarray, members: list[np.ndarray], percent: int) -> dict[int, int]:
    """The members (by place) that the query set links with, and their overlap. A block's members have near sizes."""
    if not len(query) or not members:
        return {}
    sizes = [len(m) for m in members]
    held = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    at = np.minimum(np.searchsorted(query, held), len(query) - 1)
    hit = query[at] == held
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")  # owners stay ascending within a list
    at, owner = at[order], owner[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
    lists = [x.tolist() for x in np.split(owner, starts[1:])] if len(at) else []
    least = min(common_needed(len(query), n, percent) for n in sizes)
    found = divide_skip(lists, least, least - 1)
    return {k: n for k, n in found.items() if 100 * n >= percent * (len(query) + sizes[k] - n)}


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """How many (document, shingle) pairs fall into each of ``BUCKETS`` buckets: one row per task and bucket is shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (shingle_set(text.as_py(), width) % np.uint64(BUCKETS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    table = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in table.collect():  # at most BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


def encoded(docs: DataFrame, width: int, percent: int, counts: np.ndarray, row: str | None = None) -> DataFrame:
    """node, doc_id, text_key, set_key, n, short, p0, p1 ...: ``short`` are the shingles whose lists are merged, rarest first; the others the parities of the set.

    ``row`` names a column of unique numbers to use as nodes.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, short, turned = [], [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), width)
                n = len(own)
                order = np.lexsort((own, counts[(own % np.uint64(BUCKETS)).astype(np.int64)]))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(n)
                turned.append(parity_words(own, np.zeros(n, np.int64), 1, PARITY))
                short.append(signed(own[order[: n - -(-percent * n // 100) + 1]]) if n else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, short)])
            shingles = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(short) if short else np.zeros(0, np.int64)))
            words = signed(np.concatenate([*turned, np.zeros((0, len(PARITIES)), np.uint64)]).T.copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), shingles, batch.column(3), *map(pa.array, words)],
                names=["doc_id", "text_key", "set_key", "n", "short", "node", *PARITIES],
            )

    node = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text", node.alias("node"))
    schema = "doc_id long, text_key string, set_key binary, n long, short array<long>, node long, " + ", ".join(f"{c} long" for c in PARITIES)
    return saved(rows.mapInArrow(encode, schema), "jaccard-sets")


def text_key():
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def sets_of(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, members (sorted shingle hashes as bytes) for nodes (node, text_key). Copies of a text are combined before the shuffle."""
    texts = narrowed(docs.select(text_key().alias("text_key"), "text"), "text_key", nodes.select("text_key")).groupBy("text_key").agg(F.first("text").alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "members"])

    return nodes.join(texts, "text_key").select("node", "text").mapInArrow(encode, "node long, members binary")


def promising(pairs: DataFrame, shorts: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """The pairs (a, b) that may still link once their short lists (node, n, short) are merged.

    Up to the smaller of the last shingles of two short lists, in the global order, both lists are complete: what is common there is counted,
    and behind it no more can be common than either set has left.
    """

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                ranks = [counts[(v % np.uint64(BUCKETS)).astype(np.int64)] for v in (x, y)]
                rank, last = min((ranks[0][-1], x[-1]), (ranks[1][-1], y[-1]))
                x, y = (v[(r < rank) | ((r == rank) & (v <= last))] for v, r in zip((x, y), ranks, strict=True))
                most = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
                good.append(100 * most >= percent * (n + m - most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    shorts = narrowed(shorts, "node", pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    first = pairs.join(shorts.toDF("a", "n", "x"), "a")
    both = first.join(shorts.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    return saved(both.mapInArrow(merge, "a long, b long"), "jaccard-candidates")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Pairs of one ``a`` that reach a task together are searched as one block."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = saved(sets_of(nodes.join(used, "node", "left_semi"), docs, width), "jaccard-members")
    first = pairs.join(sets.toDF("a", "set_a"), "a")
    both = first.join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b").sortWithinPartitions("a")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            good = []
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
            for low, high in zip(starts, [*starts[1:], len(a)], strict=True):
                members = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(3)[low:high]]
                good += [low + k for k in search_block(np.frombuffer(batch.column(2)[low].as_py(), np.uint64), members, percent)]
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    links = saved(both.mapInArrow(search, "a long, b long"), "jaccard-links")
    discard(sets)
    return links


def jaccard_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, node, component: one row per row of the documents.

    ``component_id`` is the smallest doc_id of the component; ``node`` and ``component`` are row numbers of this run, or those of ``row``.
    """
    counts = rarity(docs, width)
    sets = encoded(docs, width, percent, counts, row)
    # One node stands for all documents with the same set. Combined before the shuffle, so copies do not meet in one task.
    classes = sets.where("n > 0").groupBy("set_key").agg(F.min(F.struct("node", "n", "text_key", "short", *PARITIES)).alias("r"), F.min("doc_id").alias("least_id"))
    classes = saved(classes.select("set_key", "r.*", "least_id"), "jaccard-classes")
    members = shared_members(classes.select("node", "n", F.posexplode("short").alias("at", "key")), "jaccard-lists")
    total = F.col("n") + F.col("n_h")
    overlap = F.least(F.col("n") - F.col("at"), F.col("n_h") - F.col("at_h"))
    # The overlap that the position allows makes the similarity: 100 * o >= percent * (total - o). Its size filter is implied.
    fits = (100 + percent) * overlap >= percent * total
    nodes = classes.select("node", "text_key")
    shorts = classes.select("node", "n", "short")
    verify = lambda pairs: verified(promising(pairs, shorts, counts, percent), nodes, docs, width, percent)

    def positioned(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
        return (100 + percent) * np.minimum(x["n"] - x["at"], y["n"] - y["at"]) >= percent * (x["n"] + y["n"])

    tests = [positioned, lambda x, y: few_turned_in(x, y, PARITY, percent / 100)]
    parts = joined_components(members, fits, ["n", "at"], ["at", "node"], verify, classes.select("node", *PARITIES), few_turned(PARITY, percent / 100), tests)
    placed = classes.select("set_key", "node", "least_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "component").select("set_key", "component", "component_id")
    out = sets.select("doc_id", "n", "node", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "node",
        F.coalesce("component", "node").alias("component"),
    )


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, one of each component: the one with the smallest id, or of equal ids one of them.

    Documents without words are in no group and stay. Columns of the documents may have any names.
    """
    row = fresh(docs, "row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-documents")
    with scratch(docs.sparkSession) as keep:
        found = saved(jaccard_components(rows, width, percent, row).where("n_shingles > 0").select("node", "component", "doc_id"), "jaccard-found")
        best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "node")).alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1")
        gone = keep(found.join(best, "component").where(F.col("node") != F.col("b.node")).select(F.col("node").alias(row)), "jaccard-gone")
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

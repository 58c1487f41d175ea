"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is far shorter than the documents that may hold it, so equal MinHash values say nothing about containment.
Instead the items are partitioned by size (powers of two of their shingle count), and each item is represented by its
smallest shingle hashes, as many as its partition needs: of an item with containment 0.8 or more in a document, no more than a
fifth of its shingles can be missing, so ``floor(0.2 * u) + 1`` hashes for the partition's upper size u always leave
one that the document holds. A
document's shingles are looked up among the sketches; each (document, item) found is verified with the words themselves.

The items are the query set: they reach the tasks in blocks of at most ``BLOCK_BYTES`` of text, each block against all
documents. With several blocks the result of each is written before the next is fetched, so neither the driver nor a task holds more than one block. Documents are never shuffled.

Words are split at ASCII white space after lower-casing A-Z; shingles are five words. An item of one to four words is one shingle of
its own length; items without words match nothing. Equal items are searched once, under the smallest id, with
``n_items`` saying how many they are; null ids come last. Documents without words match nothing. Repeated document rows
are searched each. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import SHINGLE_WORDS, SIMILARITY, discard, mixed, run_hashes, saved, split_words, word_hashes

BLOCK_BYTES = 8 << 20
MATCHES = "doc_id long, item_id long, n_items long, n_shingles long, n_found long, containment double, first_word long, last_word long"


def shingles(words: list[bytes], width: int = SHINGLE_WORDS) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


class ItemBlock:
    """A block of test items: their words, and per shingle width the sorted sketch hashes with the items they stand for."""

    def __init__(self, items: list[tuple[int | None, str, int]], similarity: float):
        self.similarity = similarity
        self.items = [(item_id, n, split_words(text)) for item_id, text, n in items]
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, _, words) in enumerate(self.items):
            width = min(SHINGLE_WORDS, len(words))
            hashes = np.unique(mixed(run_hashes(word_hashes(words), SHINGLE_WORDS)))
            upper = 1 << int(len(hashes)).bit_length()  # the item's size partition is [upper / 2, upper)
            for h in hashes[: int((1 - similarity) * upper) + 1]:
                found[width][int(h)].append(k)
        self.sketches = {
            width: (keys := np.array(sorted(by), np.uint64), [by[int(h)] for h in keys]) for width, by in found.items()
        }

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """The items of which a document, given the hashes of its words, holds a sketched shingle."""
        out: set[int] = set()
        for width, (keys, owners) in self.sketches.items():
            if len(hashes) >= width:
                own = mixed(run_hashes(hashes, width))
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                for i in np.unique(at[keys[at] == own]):
                    out.update(owners[i])
        return out

    def verify(self, words: list[bytes], k: int) -> tuple[int, int, int, int] | None:
        """Distinct shingles of the item, those in the document, and the first and last word they cover."""
        wanted = shingles(self.items[k][2])
        width = min(SHINGLE_WORDS, len(self.items[k][2]))
        places = [i for i in range(len(words) - width + 1) if tuple(words[i : i + width]) in wanted]
        held = len({tuple(words[i : i + width]) for i in places})
        if held < self.similarity * len(wanted) - 1e-9:
            return None
        return len(wanted), held, places[0], places[-1] + width - 1


def contains(docs: DataFrame, block: ItemBlock) -> DataFrame:
    schema = pa.schema([(n, pa.float64() if n == "containment" else pa.int64()) for n in [x.split()[0] for x in MATCHES.split(", ")]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split_words(text.as_py())
                for k in block.candidates(word_hashes(words)):
                    if match := block.verify(words, k):
                        item_id, n, _ = block.items[k]
                        rows.append((doc_id, item_id, n, *match[:2], match[1] / match[0], *match[2:]))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, MATCHES)


def blocks_of(items: DataFrame, size: int) -> Iterator[list[tuple[int | None, str, int]]]:
    """Distinct items with words, in blocks of at most ``size`` bytes of text (or one longer item)."""
    same = items.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id"), F.count(F.lit(1)).alias("n"))
    block, held = [], 0
    for row in same.toLocalIterator():
        if block and held + len(row["text"]) * 4 > size:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"], row["n"]))
        held += len(row["text"]) * 4
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every (document, item) with the item's containment in the document, and the stretch of words that holds it."""
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for block, alone in alone_or_not(blocks_of(items, block_bytes)):
        found = contains(docs, ItemBlock(block, similarity))
        out = found if alone else out.unionByName(saved(found, "contaminated"))
    return out


def alone_or_not(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the only one."""
    first = next(blocks, None)
    second = next(blocks, None)
    if first is not None:
        yield first, second is None
    del first
    if second is not None:
        yield second, False
        del second
        for block in blocks:
            yield block, False


def without_benchmark(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no test item, with all their columns.

    Every row is judged where it stands, block by block, so documents need no id and are not shuffled. With several blocks, what each has left is written.
    """
    before = None
    for block, alone in alone_or_not(blocks_of(items, block_bytes)):
        docs = clean_rows(docs, ItemBlock(block, similarity))
        if not alone:
            docs = saved(docs, "clean")
            if before is not None:
                discard(before)
            before = docs
    return docs


def clean_rows(docs: DataFrame, block: ItemBlock) -> DataFrame:
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text in batch.column(place):
                words = split_words(text.as_py())
                good.append(not any(block.verify(words, k) for k in block.candidates(word_hashes(words))))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

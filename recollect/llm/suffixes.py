"""Suffix-array dedup: every byte in a string of ``LENGTH`` bytes that starts at two places or more, by bucket-pointer refinement.

All starts of 200-byte strings are suffixes to be sorted; two are equal if they share a bucket once the order is fixed to 200 bytes.

1. Initial buckets. Each start falls into the bucket of a q-gram of its string: the one with the least hash among all
   ``LENGTH - Q + 1`` of them, with Q = 32. Equal strings have the same such q-gram at the same place, so buckets never need to be compared with each
   other. Consecutive starts with the same q-gram form a stretch (about 85 starts); only one row per stretch is shuffled.
2. Buckets of one stretch are done, and so are stretches that occur twice with all their bytes: all their starts repeat. Only buckets
   with different stretches, of which some occur once, need more.
3. Refinement. Within the stretches left, the bucket pointer of a start is refined from runs of 8 bytes to 16, 32, 64, 128 and 200: sorting the pairs
   (pointer at p, pointer at p + offset) gives the new pointers, which the next refinement reuses. This runs for many stretches at once, in slices of
   a bucket: stretches are cut by the distance of a start to its q-gram, and equal slices are again combined before any row is made, so a hot
   bucket becomes many small tasks. All strings of a slice share ``LENGTH - SLICE + 1`` bytes at a fixed distance from the q-gram; these refine
   the bucket first, and where they are found once, no string of the slice repeats. What is left is a pointer of 128 bits per start, counted
   with a partial aggregate.

Matches never cross documents. Texts are UTF-8 bytes; null texts are empty, texts shorter than ``LENGTH`` hold no string. Copies of a text repeat each
other. Repeated rows and null ids are documents by themselves; other columns are not read. Hashes of strings have 128 bits, those of q-grams only
divide the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, mixed, saved, scratch

LENGTH = 200
GRAM = 32
SLICE = 16
PIECE = 1 << 20  # bytes worked on at once
PLACE_BITS = 24


def gram_pointers(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on: those of runs twice as long from two of the runs before."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
    width = 1
    factor = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while width < GRAM:
            values = values[:-width] * factor + values[width:]
            factor = factor * factor
            width *= 2
    return mixed(values)


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """begin, n, lead, gram of every stretch of starts with one least gram; ``ends``: where the texts in ``data`` end.

    ``lead`` is the distance of the first start to the gram. Equal grams count at their first place, so the choice depends on the string only.
    """
    grams = gram_pointers(data)
    window = length - GRAM + 1
    least = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(data) - length + 1], least[window - width :])
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    valid = np.ones(len(at), bool)
    for end in ends:
        valid[max(end - length + 1, 0) : end] = False
    starts = np.flatnonzero(valid)
    own = at[starts]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else np.zeros(0, np.int64)
    begin = starts[first]
    return begin, np.diff(np.r_[first, len(starts)]), own[first] - begin, grams[own[first]]


def refined_pointers(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit pointers of the ``length`` bytes from each place on.

    The first buckets are runs of 8 bytes as they are; each refinement takes the pointer of a place and that of a later place, both
    from the refinement before, until the runs reach the length.
    """
    wide = data.astype(np.uint64)
    eight = wide[: len(data) - 7].copy()
    for i in range(1, 8):
        eight = eight << np.uint64(8) | wide[i : len(data) - 7 + i]
    out = []
    for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        pointer, width = mixed(eight ^ factor), 8
        while width < length:
            offset = min(width, length - width)
            pointer = mixed(mixed(pointer[: len(pointer) - offset]) * factor + pointer[offset:])
            width += offset
        out.append(pointer)
    return out[0], out[1]


def pieces(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that share ``length - 1`` bytes, so that every string lies in one; nothing of a shorter text."""
    for low in range(0, len(data) - length + 1, PIECE):
        yield low, data[low : low + PIECE + length - 1]


def digest(data: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(data)
    low, high = value & (1 << 64) - 1, value >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def stretch_rows(texts: DataFrame, length: int) -> DataFrame:
    """row, begin, n, lead, gram, lo, hi, w: the stretches of the texts (row, text, copies); ``w`` is 2 where the text has copies."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0
            for row, text, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for low, piece in pieces(text.as_py().encode("utf-8", "surrogatepass"), length):
                    held.append((row, low, piece, min(copies, 2)))
                    total += len(piece)
                    if total >= PIECE:
                        yield pack(held)
                        held, total = [], 0
            if held:
                yield pack(held)

    def pack(held: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        ends = np.cumsum([len(p) for _, _, p, _ in held])
        data = b"".join(p for _, _, p, _ in held)
        begin, n, lead, gram = stretches(np.frombuffer(data, np.uint8), ends, length)
        owner = np.searchsorted(ends, begin, side="right")
        row = np.array([r for r, _, _, _ in held], np.int64)[owner]
        shift = np.array([low for _, low, _, _ in held], np.int64) - np.r_[0, ends[:-1]]
        weight = np.array([w for _, _, _, w in held], np.int32)[owner]
        both = [digest(data[b : b + k + length - 1]) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
        lo, hi = np.array(both, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (row, begin + shift[owner], n.astype(np.int32), lead.astype(np.int32), gram.view(np.int64), lo, hi, weight)],
            names=["row", "begin", "n", "lead", "gram", "lo", "hi", "w"],
        )

    return texts.select("row", "text", "copies").mapInArrow(find, "row long, begin long, n int, lead int, gram long, lo long, hi long, w int")


def with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """row, text, places: the texts that have places (row, begin, n, ...), which are at most as many as the text has starts."""
    named = [c for c in places.columns if c != "row"]
    per = places.groupBy("row").agg(F.collect_list(F.struct(*named)).alias("places"))
    return texts.select("row", "text").join(per, "row")


def split_strings(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The stretches (row, begin, n, lead, gram, w) in slices of SLICE starts by the distance to the gram: ... and slice, core, lo, hi.

    ``core`` is a hash of the bytes that all strings with such a distance share, so equal strings have equal cores.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for p in own.as_py():
                    i = 0
                    while i < p["n"]:
                        far = p["lead"] - i
                        k = min(p["n"] - i, far % SLICE + 1)
                        at = p["begin"] + i
                        shared = at + far % SLICE  # the last start that the slice could have
                        core = xxhash.xxh3_64_intdigest(data[shared : shared + length - SLICE + 1])
                        rows.append((row, at, k, p["gram"], far // SLICE, core - (core >> 63 << 64), *digest(data[at : at + k + length - 1]), p["w"]))
                        i += k
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 9, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()], strict=True)],
                names=["row", "begin", "n", "gram", "slice", "core", "lo", "hi", "w"],
            )

    return with_places(texts, places).mapInArrow(cut, "row long, begin long, n int, gram long, slice int, core long, lo long, hi long, w int")


def single_strings(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """row, begin, lo, hi, w: the pointers of every start of the slices (row, begin, n, w)."""

    def refine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0
            for row, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for p in own.as_py():
                    held.append((row, p["begin"], p["n"], p["w"], data[p["begin"] : p["begin"] + p["n"] + length - 1]))
                    total += len(held[-1][-1])
                    if total >= PIECE:
                        yield pack(held)
                        held, total = [], 0
            if held:
                yield pack(held)

    def pack(held: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        lo, hi = refined_pointers(np.frombuffer(b"".join(x[-1] for x in held), np.uint8), length)
        sizes = np.array([x[2] for x in held])
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        lengths = np.array([len(x[-1]) for x in held])
        at = np.repeat(np.cumsum(lengths) - lengths, sizes) + inside
        of = lambda k, kind: np.repeat(np.array([x[k] for x in held], kind), sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (of(0, np.int64), of(1, np.int64) + inside, lo[at].view(np.int64), hi[at].view(np.int64), of(3, np.int32))], names=["row", "begin", "lo", "hi", "w"]
        )

    return with_places(texts, places).mapInArrow(refine, "row long, begin long, lo long, hi long, w int")


def settled(strings: DataFrame, group: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Split strings (group, lo, hi, row, begin, n, w) into (row, begin, n) that repeat, and those that need a closer look.

    A string repeats if its digest has a weight of two or more. Of a group with different digests, some of them of weight 1, one string per digest
    goes on. Digests are added up before the shuffle, and the joins have one row per digest or group on one side.
    """
    kinds = strings.groupBy(*group, "lo", "hi").agg(F.sum("w").alias("all"), *[F.first(c).alias(c) for c in strings.columns if c not in {*group, "lo", "hi", "w"}])
    kinds = saved(kinds, f"suffix-{name}-kinds")
    many = kinds.where("all > 1").select(*group, "lo", "hi")
    again = saved(strings.where("w = 1").join(many, [*group, "lo", "hi"], "left_semi").select("row", "begin", "n"), f"suffix-{name}-again")
    open_groups = kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.min("all").alias("least")).where("k > 1 and least = 1").select(*group)
    onward = kinds.join(open_groups, group, "left_semi").withColumn("w", F.least("all", F.lit(2)).cast("int")).drop("all", "lo", "hi")
    onward = saved(onward, f"suffix-{name}-open")
    discard(strings, kinds)
    return again, onward


def distinct_texts(docs: DataFrame) -> DataFrame:
    """row, text_key, text, copies: each text once. Copies are combined before the shuffle."""
    same = docs.select(text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).groupBy("text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return saved(same.withColumn("row", F.monotonically_increasing_id()), "suffix-texts")


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def repeated_starts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, begin, n: runs of starts whose strings also start elsewhere, in texts without copies (texts with copies repeat entirely)."""
    with scratch(texts.sparkSession) as keep:
        all_rows = saved(stretch_rows(texts.where(F.octet_length("text") >= length), length), "suffix-stretches")
        shared = saved(all_rows.groupBy("gram").agg(F.sum("w").alias("all")).where("all > 1").select("gram"), "suffix-grams")
        rows = saved(all_rows.join(shared, "gram", "left_semi"), "suffix-shared")
        discard(all_rows, shared)
        first, onward = settled(rows, ["gram"], "stretch")
        slices = saved(split_strings(texts, onward, length), "suffix-slices")
        discard(onward)
        second, onward = settled(slices, ["gram", "slice", "core"], "slice")
        singles = saved(single_strings(texts, onward, length), "suffix-singles")
        discard(onward)
        many = singles.groupBy("lo", "hi").agg(F.sum("w").alias("all")).where("all > 1").select("lo", "hi")
        third = singles.where("w = 1").join(many, ["lo", "hi"], "left_semi").select("row", "begin", F.lit(1).alias("n"))
        return keep(first.union(second).union(third), "suffix-marks")


def cut_texts(texts: DataFrame, marks: DataFrame, length: int = LENGTH) -> DataFrame:
    """text_key, n_bytes, n_removed, n_spans, kept_sha256, kept (the text without the removed bytes, whole characters only)."""
    per = marks.groupBy("row").agg(F.collect_list(F.struct("begin", "n")).alias("places"))
    joined = texts.join(per, "row", "left").select("text_key", "text", "copies", "places")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, copies, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                edge = np.zeros(len(data) + 1, np.int64)
                if copies > 1 and len(data) >= length:
                    edge[0], edge[len(data)] = 1, -1
                for p in places.as_py() or []:
                    edge[p["begin"]] += 1
                    edge[p["begin"] + p["n"] + length - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if len(gone) else 0
                rows.append((key, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if gone.any() else text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)],
                names=["text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return joined.mapInArrow(cut, "text_key string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of the documents."""
    texts = distinct_texts(docs)
    done = cut_texts(texts, repeated_starts(texts, length), length).drop("kept")
    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key")).join(done, "text_key").drop("text_key")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All documents with all their columns, their texts without the repeated bytes; null texts stay null."""
    with scratch(docs.sparkSession) as keep:
        texts = distinct_texts(docs)
        done = cut_texts(texts, repeated_starts(texts, length), length).where("n_removed > 0").select("text_key", "kept")
        done = keep(done, "suffix-cut-texts").alias("cut")
    old = docs.alias("old")
    joined = old.join(done, F.md5(F.coalesce(F.col("old.text"), F.lit("")).cast("binary")) == F.col("cut.text_key"), "left")
    return joined.select(*[(F.coalesce("cut.kept", "old.text") if c == "text" else F.col(f"old.`{c}`")).alias(c) for c in docs.columns])

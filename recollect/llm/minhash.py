"""MinHash near-dedup: universal hash minima with banding, signature verification, and components by alternating stars.

A document's set are the distinct word shingles of its whole text, lower-cased (A-Z). Each of ``BANDS * ROWS`` hashes ``a * x + b`` (mod 2^64, a odd)
of a 32-bit fingerprint of a shingle gives one minimum per document; two sets agree in it with the probability of their Jaccard
similarity. Documents that agree in all ``ROWS`` minima of a band are candidates: with Jaccard 0.8 a pair shares no band
with probability (1 - 0.8^6)^48 = 5e-7. A candidate's signatures, four bits a minimum, are compared inside the join that
meets it, and pairs which five standard deviations tell apart from the threshold (another 3e-7 are lost) go no further; nor do
those whose sets turn over too many different bits of ``PARITY`` (:func:`few_turned`), which loses none. The
others are confirmed on the full sets, so no link is wrong. Members of a band meet its first member, then members of
other components only (:mod:`recollect.llm.links`), and the links become components by large-star and small-star rounds.

Equal sets are one class from the start: copies cost nothing and cannot be missed. With fewer words than a shingle has, the whole sequence is the
one shingle; null, empty and blank texts have an empty set and link with nothing. Repeated rows link to each other. A null
id takes the component id of its class, which is null if no id is known in the component, and is kept only then. Other columns are
not read. Per task a bounded run of shingles is in memory, or one text's if it is longer.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, mixed, narrowed, run_hashes, saved, scratch, signed, split_words, word_hashes
from recollect.llm.links import joined_components, shared_members

SHINGLE = 2
PERCENT = 80
BANDS = 48
ROWS = 6
DEVIATIONS = 5
BATCH_SHINGLES = 1 << 16
BITS = 4  # of a minimum, in the signature
PARITY = 512


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed multipliers (odd) and summands of n universal hashes."""
    drawn = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return drawn[:n] | np.uint64(1), drawn[n:]


def minima(shingles: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """(sets, n) minima of n hashes over consecutive sets of the given sizes (none 0)."""
    x = shingles >> np.uint64(32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), n), np.uint64)
    hashed = np.empty_like(x)
    for k, (a, b) in enumerate(zip(*hash_family(n), strict=True)):
        np.multiply(x, a, out=hashed)
        np.add(hashed, b, out=hashed)
        out[:, k] = np.minimum.reduceat(hashed, starts)
    return out


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands): one 64-bit key of the minima of each band."""
    rows = least.shape[1] // bands
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(least), 1))
    for k in range(rows):
        keys = mixed(keys + least[:, k::rows])
    return keys


def signatures(least: np.ndarray) -> np.ndarray:
    """(sets, words): four mixed bits of every minimum, sixteen to a 64-bit word; missing ones are 0 in all sets."""
    wide = np.zeros((len(least), signature_words(least.shape[1]) * 16), np.uint64)
    wide[:, : least.shape[1]] = mixed(least) & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(wide.reshape(len(least), -1, 16) << shifts, axis=2)


def signature_words(n: int) -> int:
    return -(-n // 16)


def most_apart(n: int, percent: int) -> int:
    """So many of n signature parts differ at most between sets of the given similarity, but for a chance in millions."""
    differ = (1 - percent / 100) * (1 - 2.0**-BITS)
    return math.floor(n * differ + DEVIATIONS * math.sqrt(n * differ * (1 - differ)))


def parts_apart(words: int) -> Column:
    """In how many four-bit parts the signatures s0, s1 ... and s0_h, s1_h ... differ."""

    def word(k: int) -> Column:
        x = F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}_h"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(add, map(word, range(words)))


def parities(shingles: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets, bits / 64) words of bits, each turned over once by every distinct shingle that falls on it, and the number of distinct shingles.

    Two sets differ in no more bits than there are shingles in one of them alone.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((shingles, owner))
    own, owner = shingles[order], owner[order]
    first = np.r_[True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])]
    own, owner = own[first], owner[first]
    return parity_words(own, owner, len(sizes), bits), np.bincount(owner, minlength=len(sizes))


def parity_words(shingles: np.ndarray, owner: np.ndarray, n: int, bits: int) -> np.ndarray:
    """(n, bits / 64) words as of :func:`parities`, of shingles that are distinct within each of n owners."""
    odd = np.bincount(owner * bits + (shingles % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little").view(np.uint64)


def few_turned(bits: int, similarity: float) -> Column:
    """Whether the parities p0, p1 ... and p0_h, p1_h ... of sets of n and n_h shingles allow the Jaccard similarity J: exact.

    Of similar sets no more than (1 - J) / (1 + J) of both sizes together stand in one set alone.
    """
    turned = reduce(add, [F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"p{k}_h"))) for k in range(bits // 64)])
    return turned <= (F.col("n") + F.col("n_h")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def few_turned_in(x: dict[str, np.ndarray], y: dict[str, np.ndarray], bits: int, similarity: float) -> np.ndarray:
    """:func:`few_turned` of columns in arrays that numpy broadcasts to pairs."""
    turned = sum(np.bitwise_count((x[f"p{k}"] ^ y[f"p{k}"]).view(np.uint64)).astype(np.int16) for k in range(bits // 64))
    return turned <= (x["n"] + y["n"]) * ((1 - similarity) / (1 + similarity)) + 1e-6


def parts_apart_in(x: dict[str, np.ndarray], y: dict[str, np.ndarray], words: int) -> np.ndarray:
    """:func:`parts_apart` of columns in arrays that numpy broadcasts to pairs."""

    def word(k: int) -> np.ndarray:
        z = (x[f"s{k}"] ^ y[f"s{k}"]).view(np.uint64)
        z = z | z >> np.uint64(1)
        z = z | z >> np.uint64(2)
        return np.bitwise_count(z & np.uint64(0x1111111111111111)).astype(np.int16)

    return sum(word(k) for k in range(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(run_hashes(word_hashes(split_words(text)), width))


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def compared(n: int) -> list[str]:
    """The columns that pairs are compared by before their sets are fetched: signatures of n minima, and parities."""
    return [*[f"s{k}" for k in range(signature_words(n))], *[f"p{k}" for k in range(PARITY // 64)]]


def encoded(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """node, doc_id, text_key, set_key, n, keys, s0, s1 ..., p0, p1 ...: set sizes, band keys, signatures and parities of all rows."""
    names = compared(bands * rows)

    def pack(ids: pa.Array, keys: pa.Array, nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets])
        full = np.flatnonzero(sizes)
        banded, signed_parts = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), len(names)), np.uint64)
        if len(full):
            together = np.concatenate([sets[k] for k in full])
            least = minima(together, sizes[full], bands * rows)
            banded[full] = band_keys(least, bands)
            signed_parts[full] = np.concatenate([signatures(least), parities(together, sizes[full], PARITY)[0]], axis=1)
        counts = np.where(sizes > 0, bands, 0)
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [nodes, ids, keys, pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(signed(banded[sizes > 0].ravel()))), *[pa.array(signed(np.ascontiguousarray(signed_parts[:, k]))) for k in range(len(names))]],
            names=["node", "doc_id", "text_key", "set_key", "n", "keys", *names],
        )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[np.ndarray] = []
            begin = total = 0
            for k, text in enumerate(batch.column(3)):
                sets.append(shingle_set(text.as_py(), width))
                total += len(sets[-1])
                if total >= BATCH_SHINGLES or k + 1 == batch.num_rows:
                    part = batch.slice(begin, len(sets))
                    yield pack(part.column(1), part.column(2), part.column(0), sets)
                    sets, begin, total = [], k + 1, 0

    rows_in = docs.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    schema = "node long, doc_id long, text_key string, set_key binary, n long, keys array<long>, " + ", ".join(f"{c} long" for c in names)
    return saved(rows_in.mapInArrow(encode, schema), "minhash-sets")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes (node, text_key) whose full sets have the similarity."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(used, "node", "left_semi")
    texts = narrowed(docs.select(text_key().alias("text_key"), "text"), "text_key", wanted.select("text_key"))
    one = texts.groupBy("text_key").agg(F.first("text").alias("text"))  # copies are combined before the shuffle

    def shingle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "members"])

    sets = saved(wanted.join(one, "text_key").select("node", "text").mapInArrow(shingle, "node long, members binary"), "minhash-members")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = saved(both.mapInArrow(verify, "a long, b long"), "minhash-links")
    discard(sets)
    return links


def minhash_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component), kept: one row per row of the documents."""
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, width, percent, bands, rows), "minhash-components")


def _components(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    words, width_s, most = compared(bands * rows), signature_words(bands * rows), most_apart(bands * rows, percent)
    sets = encoded(docs, width, bands, rows)
    grouped = sets.where("n > 0").groupBy("set_key").agg(F.min(F.struct("node", "n", "text_key", "keys", *words)).alias("r"), F.min("doc_id").alias("least_id"))
    classes = saved(grouped.select("set_key", "r.*", "least_id"), "minhash-classes")
    plain = saved(sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")), "minhash-rows")
    discard(sets)
    held = shared_members(classes.select("node", F.explode("keys").alias("key")), "minhash-bands")
    members = held.join(classes.select("node", "n", *words), "node")
    size = 100 * F.least("n", "n_h") >= percent * F.greatest("n", "n_h")
    fits = size & few_turned(PARITY, percent / 100) & (parts_apart(width_s) <= most)
    tests = [lambda x, y: few_turned_in(x, y, PARITY, percent / 100), lambda x, y: 100 * np.minimum(x["n"], y["n"]) >= percent * np.maximum(x["n"], y["n"]), lambda x, y: parts_apart_in(x, y, width_s) <= most]
    carried = ["n", *words]
    nodes = classes.select("node", "text_key")
    parts = joined_components(members, fits, carried, ["node"], lambda pairs: confirmed(pairs, nodes, docs, width, percent), tests=tests)
    placed = classes.select("set_key", "node", "least_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "component").select("set_key", "component_id")
    found = plain.join(named, "set_key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

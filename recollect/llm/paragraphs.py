"""Substring dedup by paragraphs: MinHash banding, exact verification, and removal by components.

A paragraph is either a line of at least ``LINE_WORDS`` words or a window: ``WINDOW`` words in a row, over line ends as well, which begins at an
anchor that the words themselves choose. An anchor is where a hash of the next five words is the least of ``GAP`` places in a row; so every run of
``WINDOW + GAP - 1`` = 50 words holds a whole window, and equal runs choose equal ones, wherever they stand, however they are wrapped and
whatever is around them. A passage of 50 words or more that occurs twice word by word is therefore always found, while a short line that
many documents share is shorter than any paragraph and marks nothing.

The set of a line are its distinct five-word shingles, lower-cased (A-Z). ``BANDS`` bands of ``ROWS`` MinHash values are tuned for recall: two lines
with Jaccard 0.8 share no band with probability (1 - 0.8^5)^16 = 0.002. Lines that share a band meet the band's first line and
then lines of other components only. Inside that join a pair must pass the signatures' filter (:mod:`recollect.llm.minhash`) and an exact one: each line carries ``PARITY``
bits, of which every shingle turns one over, so two lines differ in no more bits than shingles, and similar ones in few. The exact Jaccard similarity of what is left is
verified on the whole sets. Lines with the same words are one class from the start. Windows collide where they are equal: all minima
agree and the similarity is 1, so two 64-bit hashes of the words are their only band. The clusters are the components.

The first paragraph of a cluster, by document id, row and place, stays, the words of the others are removed, except those that a first paragraph covers. A cluster
whose paragraphs all overlap in one document is no repeat. Passages are reported as word ranges: paragraphs that overlap or touch are joined.
Null and empty texts have no paragraph. Repeated rows and null ids are documents by themselves: a null id comes last when the first paragraph is
chosen, and ties are broken by row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import SHINGLE_WORDS, SIMILARITY, discard, fresh, mixed, narrowed, run_hashes, saved, scratch, signed, word_hashes
from recollect.llm.links import joined_components, shared_members
from recollect.llm.minhash import band_keys, few_turned, few_turned_in, minima, most_apart, parities, parts_apart, parts_apart_in, signature_words, signatures, text_key

LINE_WORDS = 20
WINDOW = 24
GAP = 27
BANDS = 16
ROWS = 5
PARITY = 256
PLACE_BITS = np.uint64(20)
PLACES = 1 << 20  # places looked at together
BATCH_WORDS = 1 << 18
SPANS = "array<struct<start:int,end:int>>"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lines_of(text: str | None) -> tuple[list[bytes], list[int]]:
    """The lower-cased words of a text, and where each of its lines begins and the last one ends."""
    words: list[bytes] = []
    ends = [0]
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        words += line.split()
        ends.append(len(words))
    return words, ends


def anchors(places: np.ndarray, gap: int = GAP) -> np.ndarray:
    """Where the least hash of any ``gap`` places in a row stands, the first of equal ones; with fewer places, of all.

    Hashes are compared by their upper bits; the place stands in the lower ones, so one running minimum gives both.
    """
    out = []
    for begin in range(0, max(len(places) - gap + 1, min(len(places), 1)), PLACES - gap):
        part = places[begin : begin + PLACES]
        least = part >> PLACE_BITS << PLACE_BITS | np.arange(len(part), dtype=np.uint64)
        width, wanted = 1, min(gap, len(part))
        while 2 * width <= wanted:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(part) - wanted + 1], least[wanted - width :])
        out.append((np.unique(least) & np.uint64(PLACES - 1)).astype(np.int64) + begin)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def windows_of(shingles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, and two hashes of the words, of the windows of a text of n words with these shingle hashes."""
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    at = anchors(mixed(shingles[: n - WINDOW + 1]))
    hashes = np.zeros((len(at), 2), np.uint64)
    for step in [*range(0, WINDOW - SHINGLE_WORDS, SHINGLE_WORDS), WINDOW - SHINGLE_WORDS]:  # shingles that cover the window
        for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            hashes[:, k] = mixed(hashes[:, k] + shingles[at + step]) * np.uint64(odd)
    return at, hashes


def paragraph_rows(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, text_key, windows (start, a, b) and lines (start, end, key, keys, signature) of every document."""
    words_of_signature = signature_words(BANDS * ROWS)
    window_type = pa.struct([("start", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    line_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("key", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64()))])

    def grouped(sizes: list[int], columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))

    def listed(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(signed(np.ascontiguousarray(values)).ravel()))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = words = 0
            for k, size in enumerate(pa.compute.binary_length(batch.column(3)).fill_null(0).to_pylist()):
                words += size // 4
                if words >= BATCH_WORDS or k + 1 == batch.num_rows:  # so many at a time, or one longer text
                    yield coded(batch.slice(begin, k + 1 - begin))
                    begin, words = k + 1, 0

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, hashes, n_windows, spans, keys, sets, n_lines = [], [], [], [], [], [], []
        for text in batch.column(3):
            words, ends = lines_of(text.as_py())
            own = word_hashes(words)
            shingles = run_hashes(own, SHINGLE_WORDS) if len(own) >= SHINGLE_WORDS else np.zeros(0, np.uint64)
            at, pair = windows_of(shingles, len(own))
            starts.append(at)
            hashes.append(pair)
            n_windows.append(len(at))
            long = [(a, b) for a, b in zip(ends, ends[1:], strict=False) if b - a >= LINE_WORDS]
            n_lines.append(len(long))
            spans += long
            keys += [xxhash.xxh3_128_digest(own[a:b].tobytes()) for a, b in long]
            sets += [shingles[a : b - SHINGLE_WORDS + 1] for a, b in long]
        pairs = np.concatenate([*hashes, np.zeros((0, 2), np.uint64)])
        windows = grouped(n_windows, [pa.array(np.concatenate([*starts, np.zeros(0, np.int64)]), pa.int32()), *[pa.array(signed(np.ascontiguousarray(pairs[:, k]))) for k in (0, 1)]], window_type)
        banded, parts = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), words_of_signature + PARITY // 64), np.uint64)
        distinct = np.zeros(len(sets), np.int64)
        sizes = np.array([len(x) for x in sets], np.int64)
        begin = 0
        while begin < len(sets):  # so many shingles at a time fit a processor's cache
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), 1 << 16)))
            together = np.concatenate(sets[begin:end])
            least = minima(together, sizes[begin:end], BANDS * ROWS)
            banded[begin:end], parts[begin:end, :words_of_signature] = band_keys(least, BANDS), signatures(least)
            parts[begin:end, words_of_signature:], distinct[begin:end] = parities(together, sizes[begin:end], PARITY)
            begin = end
        edges = np.array(spans, np.int64).reshape(-1, 2)
        lines = grouped(n_lines, [pa.array(edges[:, 0], pa.int32()), pa.array(edges[:, 1], pa.int32()), pa.array(keys, pa.binary()), pa.array(distinct, pa.int32()), listed(banded), listed(parts)], line_type)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], windows, lines], names=["row", "doc_id", "text_key", "windows", "lines"])

    node = F.monotonically_increasing_id() if row is None else F.col(row)
    texts = docs.select(node.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(text_key()).alias("text_key"), "text")
    line = "array<struct<start:int,end:int,key:binary,n:int,keys:array<bigint>,signature:array<bigint>>>"
    return texts.mapInArrow(encode, f"row long, doc_id long, text_key binary, windows array<struct<start:int,a:bigint,b:bigint>>, lines {line}")


def shingle_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, members (sorted shingle hashes as bytes) of lines (node, text_key, start, end). Copies of a text are combined before the shuffle."""
    wanted = nodes.groupBy("text_key").agg(F.collect_list(F.struct("node", "start", "end")).alias("lines"))  # lines of one text
    texts = narrowed(docs.select(F.unhex(text_key()).alias("text_key"), "text"), "text_key", nodes.select("text_key"))
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lines in zip(batch.column(0), batch.column(1), strict=True):
                shingles = run_hashes(word_hashes(lines_of(text.as_py())[0]), SHINGLE_WORDS)
                node, start, end = (lines.values.field(k).to_numpy() for k in range(3))
                sets = [np.unique(shingles[a : b - SHINGLE_WORDS + 1]).tobytes() for a, b in zip(start, end, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sets, pa.binary())], names=["node", "members"])

    return texts.join(wanted, "text_key").select("text", "lines").mapInArrow(encode, "node long, members binary")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets have the exact Jaccard similarity."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = saved(shingle_sets(nodes.join(used, "node", "left_semi"), docs), "paragraph-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = saved(both.mapInArrow(verify, "a long, b long"), "paragraph-links")
    discard(sets)
    return links


def line_clusters(found: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """cluster (a long), row, doc_id, start, end of the lines of :func:`paragraph_rows` that are not alone."""
    words = signature_words(BANDS * ROWS)
    parts = [*[f"s{k}" for k in range(words)], *[f"p{k}" for k in range(PARITY // 64)]]
    lines = found.select("row", "doc_id", "text_key", F.explode("lines").alias("l")).select("row", "doc_id", "text_key", "l.*")
    one = lines.groupBy("key").agg(F.min(F.struct("row", "start", "end", "text_key", "n", "keys", "signature")).alias("r"), F.count(F.lit(1)).alias("size"))
    classes = one.select("key", "size", "r.*").withColumn("node", F.monotonically_increasing_id())
    classes = saved(classes.select("*", *[F.get("signature", F.lit(k)).alias(c) for k, c in enumerate(parts)]).drop("signature"), "paragraph-classes")
    held = shared_members(classes.select("node", F.explode("keys").alias("key")), "paragraph-bands")
    members = held.join(classes.select("node", "n", *parts), "node")
    most = most_apart(BANDS * ROWS, round(100 * similarity))
    fits = few_turned(PARITY, similarity) & (parts_apart(words) <= most)
    tests = [lambda x, y: few_turned_in(x, y, PARITY, similarity), lambda x, y: parts_apart_in(x, y, words) <= most]
    nodes = classes.select("node", "text_key", "start", "end")
    joined = joined_components(members, fits, ["n", *parts], ["node"], lambda pairs: similar(pairs, nodes, docs, similarity), tests=tests)
    discard(held)
    placed = classes.select("key", "node", "size").join(joined, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    sizes = placed.groupBy("cluster").agg(F.sum("size").alias("_size")).where("_size > 1").select("cluster")
    repeated = placed.join(sizes, "cluster").select("key", "cluster")
    return saved(lines.select("row", "doc_id", "start", "end", "key").join(repeated, "key").drop("key"), "paragraph-lines")


def with_removed(members: DataFrame, cluster: list[str]) -> DataFrame:
    """row, start, end, removed of the members of clusters that do not all overlap in one document; the first of each stays."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start")
    ends = [F.min("row").alias("lo"), F.max("row").alias("hi"), F.min("end").alias("least"), F.max("start").alias("most")]
    first = members.groupBy(*cluster).agg(F.min(place).alias("f"), *ends).where("lo <> hi OR most >= least").select(*cluster, "f")
    stays = (F.col("row") == F.col("f.row")) & (F.col("start") == F.col("f.start"))
    return members.join(first, cluster).select("row", "start", "end", (~stays).alias("removed"))


def joined_spans(start: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
    """Ranges that overlap or touch as one."""
    out: list[dict[str, int]] = []
    for k in np.argsort(start, kind="stable").tolist():
        if out and start[k] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], int(end[k]))
        else:
            out.append({"start": int(start[k]), "end": int(end[k])})
    return out


def passages(marked: DataFrame) -> DataFrame:
    """row, repeated, removed: the joined word ranges of the members (row, start, end, removed) of clusters."""
    per = marked.groupBy("row").agg(F.collect_list(F.struct("start", "end", "removed")).alias("m"))  # paragraphs of one document

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, removed = [], []
            for members in batch.column(1):
                start, end, gone = (members.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                repeated.append(joined_spans(start, end))
                out = np.zeros(int(end.max()) + 1, bool)
                for stays in (False, True):  # words of a first paragraph stay, whatever else covers them
                    for a, b in zip(start[gone != stays], end[gone != stays], strict=True):
                        out[a:b] = not stays
                edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(repeated, kind), pa.array(removed, kind)], names=["row", "repeated", "removed"])

    return per.mapInArrow(join, f"row long, repeated {SPANS}, removed {SPANS}")


def paragraph_passages(docs: DataFrame, similarity: float = SIMILARITY, row: str | None = None) -> DataFrame:
    """row, doc_id, repeated, removed (ranges of words, from 0, the end left out): one row per document row. ``row`` names a column of unique numbers."""
    with scratch(docs.sparkSession) as keep:
        found = saved(paragraph_rows(docs, row), "paragraphs")
        lines = with_removed(line_clusters(found, docs, similarity), ["cluster"])
        windows = found.select("row", "doc_id", F.explode("windows").alias("w")).select("row", "doc_id", "w.start", (F.col("w.start") + WINDOW).alias("end"), "w.a", "w.b")
        marked = saved(lines.union(with_removed(windows, ["a", "b"])), "paragraph-marks")
        none = F.expr(f"cast(array() AS {SPANS})")
        out = found.select("row", "doc_id").join(passages(marked), "row", "left")
        return keep(out.select("row", "doc_id", *[F.coalesce(c, none).alias(c) for c in ("repeated", "removed")]), "paragraph-passages")


def without_words(text: str, spans: list[dict[str, int]]) -> str:
    """A text without ranges of its words; the white space before a range goes with it, unless the range begins a line."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw)]
    out, last = [], 0
    for span in spans:
        begin, end = at[span["start"]][0], at[span["end"] - 1][1]
        before = raw[last:begin]
        out.append(before if before.endswith(b"\n") else before.rstrip(b"\x20\x09\x0b\x0c\x0d"))
        last = end
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def without_passages(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with all their columns, without the words removed; null texts stay null."""
    name = fresh(docs, "row")
    rows = saved(docs.withColumn(name, F.monotonically_increasing_id()), "paragraph-documents")
    gone = paragraph_passages(rows, similarity, name).where(F.size("removed") > 0).select(F.col("row").alias("_at"), F.col("removed").alias("_gone"))
    both = rows.select(F.col(name).alias("_id"), "text").join(gone, F.col("_id") == F.col("_at")).select("_id", "text", "_gone")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_words(t.as_py(), spans.as_py()) for t, spans in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "_new"])

    new = both.mapInArrow(cut, "_id long, _new string").alias("n")
    old = rows.alias("o")
    joined = old.join(new, F.col(f"o.{name}") == F.col("n._id"), "left")
    text = F.when(F.col("n._id").isNull(), F.col("o.text")).otherwise(F.col("n._new"))
    return joined.select(*[(text if c == "text" else F.col(f"o.`{c}`")).alias(c) for c in docs.columns])


def paragraph_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_repeated, n_removed (passages), removed_words, repeated, removed (word ranges): one row per document row."""
    found = paragraph_passages(docs, similarity)
    return found.select(
        "doc_id",
        F.size("repeated").cast("long").alias("n_repeated"),
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_words"),
        "repeated",
        "removed",
    )

"""Toxicity by multiple-instance learning: sentences are instances, documents are bags, and only bags have labels.

A sentence's score is a logistic function of its hashed words and word beginnings; a document's score is the noisy-or of
its sentences, 1 - prod(1 - p). The weights minimise the log loss of the document scores, so the model learns which sentences
make a document toxic, and :func:`toxic_sentences` points at them.

Training reads at most ``SAMPLE`` labelled documents, those with the smallest hash of their ids; the rows that the caller holds out are not
among them. Their features are written once; each round adds up one gradient of ``FEATURES`` numbers per partition. Scoring is
one scan with the weights (1 MB) and no shuffle. The inputs are texts only.

Lower-casing concerns A-Z. Words are runs of ASCII letters and digits and of characters beyond ASCII; a sentence ends at ``.``, ``!``,
``?`` or a line break. Null and empty texts have no sentence and the score 0. Of several labels of a document the
largest counts; labels that are null, or for no document, count for nothing. Without labels of both kinds every score is 0. Repeated rows are
scored each; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from recollect.llm.common import saved

SAMPLE = 20_000
SAMPLE_PARTS = 12
FEATURES = 1 << 17  # the lower half for words, the upper half for their beginnings
STEM = 4
ROUNDS = 50
RATE = 0.3
BIAS_RATE = 2.0
MOMENTUM = 0.9
PENALTY = 1e-3
MIN_BAGS = 5
BIAS = -5.0
THRESHOLD = 0.3
TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[.!?\n]")
ENDS = {b".", b"!", b"?", b"\n"}
BATCH_TOKENS = 400_000


class FeatureIds(dict):
    """Token -> (feature of the word) << 32 | (feature of its beginning), or -1 for the end of a sentence."""

    LIMIT = 500_000

    def __missing__(self, token: bytes) -> int:
        if token in ENDS:
            value = -1
        else:
            half = FEATURES // 2
            stem = token.decode("utf-8", "replace")[:STEM].encode()
            value = (zlib.crc32(token) % half) << 32 | (half + zlib.crc32(stem) % half)
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = value
        return value


def encode(text: str | None, ids: FeatureIds) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words, and the number of words of each sentence that has any."""
    tokens = TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())
    coded = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    ends = coded < 0
    sizes = np.bincount(np.cumsum(ends)[~ends]) if len(coded) else np.zeros(0, np.int64)
    return coded[~ends], sizes[sizes > 0].astype(np.int32)


def sentence_logits(features: np.ndarray, sizes: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    if not len(sizes):
        return np.zeros(0)
    per_word = weights[features >> 32] + weights[features & 0xFFFFFFFF]
    return np.add.reduceat(per_word, np.cumsum(sizes) - sizes) + bias


def bag_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, which may be 0."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


def noisy_or(logits: np.ndarray, bags: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) of each bag of sentences."""
    return -np.expm1(-np.maximum(bag_sums(softplus(logits), bags), 0))


def gradient(features: np.ndarray, sizes: np.ndarray, bags: np.ndarray, labels: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Of the summed log loss of the bags, with respect to the weights and the bias."""
    z = sentence_logits(features, sizes, weights, bias)
    total = np.maximum(bag_sums(softplus(z), bags), 1e-9)
    outer = np.where(labels > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
    inner = np.repeat(outer, bags) * sigmoid(z)
    spread = np.repeat(inner, sizes)
    grad = np.bincount(features >> 32, spread, FEATURES) + np.bincount(features & 0xFFFFFFFF, spread, FEATURES)
    return grad, float(inner.sum())


def training_bags(docs: DataFrame, labels: DataFrame, usable: Column | None, sample: int) -> DataFrame:
    """Encoded texts of the sampled labelled documents. The sampled ids are at most ``sample`` rows, so they may be broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if usable is None else usable)).groupBy(F.col("doc_id").cast("long").alias("_key")).agg(F.max("toxic").alias("label"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("_key"), "text").join(F.broadcast(chosen), "_key").select("label", "text")

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = FeatureIds()
        for batch in batches:
            coded = [encode(t.as_py(), ids) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array([f.tobytes() for f, _ in coded], pa.binary()), pa.array([s.tobytes() for _, s in coded], pa.binary())],
                names=["label", "features", "sizes"],
            )

    schema = "label int, features binary, sizes binary"
    return saved(rows.mapInArrow(bags, schema).repartition(SAMPLE_PARTS), "toxicity-bags")


def summed(bags: DataFrame, part: Callable[..., np.ndarray]) -> np.ndarray:
    """Add up ``part(features, sizes, bags, labels)`` over all bags: one row of FEATURES numbers per partition, SAMPLE_PARTS in all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1)
        for batch in batches:
            for low in range(0, len(batch), 512):
                piece = batch.slice(low, 512)
                sizes = [np.frombuffer(x.as_py(), np.int32) for x in piece.column(2)]
                features = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in piece.column(1)])
                total += part(features, np.concatenate(sizes), np.array([len(x) for x in sizes]), np.asarray(piece.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["total"])

    rows = bags.mapInArrow(run, "total binary").collect()
    return np.sum([np.frombuffer(r["total"], np.float32) for r in rows], axis=0, dtype=np.float64)


def bag_counts(features: np.ndarray, sizes: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """In how many bags each feature occurs."""
    bag = np.repeat(np.repeat(np.arange(len(bags)), bags), sizes).astype(np.int64)
    both = np.concatenate([bag * FEATURES + (features >> 32), bag * FEATURES + (features & 0xFFFFFFFF)])
    return np.append(np.bincount(np.unique(both) % FEATURES, minlength=FEATURES), 0.0)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Full-batch proximal descent with momentum on the log loss of noisy-or bags, plus an absolute-value penalty.

    A feature's step is divided by the share of bags that hold it; features of fewer than ``MIN_BAGS`` bags, which could only be
    learnt by heart, keep the weight 0. Returns weights and bias; a bias of -inf where nothing can be learnt.
    """
    bags = training_bags(docs, labels, usable, sample)
    counts = {r["label"] > 0: r["count"] for r in bags.groupBy(F.col("label") > 0).count().toDF("label", "count").collect()}
    weights, bias = np.zeros(FEATURES), BIAS
    if len(counts) < 2:
        return weights, -np.inf
    n = sum(counts.values())
    held = summed(bags, bag_counts)[:-1]
    scale = np.where(held >= MIN_BAGS, n / np.maximum(held, 1), 0.0)
    speed = np.zeros(FEATURES + 1)
    for _ in range(rounds):
        slope = summed(bags, lambda f, s, b, y, w=weights.astype(np.float32), c=bias: np.append(*gradient(f, s, b, y, w, c))) / n
        speed = MOMENTUM * speed - slope * np.append(scale, 1.0)
        moved, bias = weights + RATE * speed[:-1], bias + BIAS_RATE * speed[-1]
        weights = np.sign(moved) * np.maximum(np.abs(moved) - RATE * PENALTY * scale, 0)
    return weights.astype(np.float32), float(bias)


def grouped(texts: pa.Array, ids: FeatureIds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, sentence sizes and bag sizes of consecutive texts, a bounded number of words at a time (or one text)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    tokens = 0
    pack = lambda rows: (np.concatenate([f for f, _ in rows]), np.concatenate([s for _, s in rows]), np.array([len(s) for _, s in rows]))
    for text in texts:
        held.append(encode(text.as_py(), ids))
        tokens += len(held[-1][0])
        if tokens >= BATCH_TOKENS:
            yield pack(held)
            held, tokens = [], 0
    if held:
        yield pack(held)


def worst_of(logits: np.ndarray, bags: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per bag of sentences: the place of its first sentence of the greatest score (-1: no sentence), that score, and how many reach ``least``."""
    p = sigmoid(logits)
    place, best, many = np.full(len(bags), -1), np.zeros(len(bags)), np.zeros(len(bags), np.int64)
    full = np.flatnonzero(bags)
    if len(full):
        starts = (np.cumsum(bags) - bags)[full]
        best[full] = np.maximum.reduceat(p, starts)
        inside = np.arange(len(p)) - np.repeat(starts, bags[full])
        place[full] = np.minimum.reduceat(np.where(p == np.repeat(best[full], bags[full]), inside, len(p)), starts)
        many[full] = np.add.reduceat((p >= least).astype(np.int64), starts)
    return place, best, many


LOCATED = [StructField("worst_sentence", LongType()), StructField("worst_score", DoubleType()), StructField("n_toxic_sentences", LongType())]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], out: str = "score", locate: float | None = None) -> DataFrame:
    """All columns of the documents and the score of their texts.

    With ``locate`` also where the offending sentences are: worst_sentence (its number among the sentences with words, the first of equal ones; null without
    any), worst_score, and n_toxic_sentences, those that alone reach ``locate``.
    """
    weights, bias = model
    place = docs.columns.index("text")
    more = [] if locate is None else LOCATED

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = FeatureIds()
        for batch in batches:
            values, located = [np.zeros(0)], [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
            for f, s, b in grouped(batch.column(place), ids):
                z = sentence_logits(f, s, weights, bias)
                values.append(noisy_or(z, b))
                if more:
                    located.append(worst_of(z, b, locate))
            columns = [*batch.columns, pa.array(np.clip(np.concatenate(values), 0, 1))]
            if more:
                where, best, many = (np.concatenate(x) for x in zip(*located, strict=True))
                columns += [pa.array(where, pa.int64(), mask=where < 0), pa.array(best, mask=where < 0), pa.array(many)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out, *[f.name for f in more]])

    return docs.mapInArrow(score, StructType([*docs.schema, StructField(out, DoubleType()), *more]))


def toxic_sentences(docs: DataFrame, model: tuple[np.ndarray, float], least: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence (number among those with words), score of every sentence that alone reaches the threshold."""
    weights, bias = model

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = FeatureIds()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = sentence_logits(*encode(text.as_py(), ids), weights, bias)
                p = sigmoid(z)
                rows += [(doc_id, int(i), float(p[i])) for i in np.flatnonzero(p >= least)]
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["doc_id", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(locate, "doc_id long, sentence long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the place, score and number of the offending sentences (see :func:`scored`).

    ``held``: which ids (as column doc_id) may not be learnt from.
    """
    held = F.lit(False) if held is None else held
    model = train(docs, labels, ~held)
    rows = scored(docs.select("doc_id", "text"), model, locate=threshold)
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[f.name for f in LOCATED])

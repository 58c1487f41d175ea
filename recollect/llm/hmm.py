"""Language-model scores: a hidden Markov model over word classes, trained by Baum-Welch counts from all partitions.

The hidden states emit word classes, and a class emits its words: P(w | state) = P(class of w | state) * P(w | class). The
``FREQUENT`` most frequent training words are a class each; every other word, known or not, belongs to one of ``HASHED`` classes by its hash, in
which it has (c + 0.1) / (N + 0.1 * (V + 1)), one slot of which is for unknown words. So the model covers any vocabulary with a
table of a fixed size, STATES x (FREQUENT + HASHED) numbers, that travels to the tasks, as do the counts of the ``COMMON`` most frequent words.
The counts of all other words stay in a table that Spark joins with their places in the texts; no word that very many texts hold is
among them. A word's length has no bound, so words of over ``LONG`` bytes never count as common.

Training: every document is cut into runs of at most ``RUN`` tokens (all tokens, each in one run), many runs are worked on side by side, and each
round adds up the expected counts (start, transition, state x class) of all partitions. Scoring: the scaled forward recursion
over the whole document, from the end mark on as a token like others; the sum of the logarithms of the scales is the exact log
probability of the class sequence.

Lower-casing concerns A-Z; tokens are the words between ASCII white space and one end mark per text. Null texts are empty: one token. Without
training texts all words are unknown. A null id counts as the empty text when texts are held out. Repeated rows are counted and
scored each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import saved, split_words

STATES = 8
FREQUENT = 6000
HASHED = 2000
COMMON = 1 << 17
SHARE = 1 << 21
LONG = 64
RUN = 256
ROUNDS = 5
ADD = 0.1
END = b"\n"  # no word holds a line break
FLUSH = 500_000
BATCH_TOKENS = 200_000
SEED = 11
PRIOR = 1000.0  # tokens of the corpus distribution that each state is given


def tokens(text: str | None) -> list[bytes]:
    return [*split_words(text), END]


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all texts (one column). Words are added up in the tasks first, ``FLUSH`` distinct ones at a time."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > FLUSH:
                    yield pack()
                    held.clear()
        if held:
            yield pack()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class WordIds(dict):
    """Word -> rank among the common words; another word has COMMON + the number of its hashed class."""

    def __missing__(self, word: bytes) -> int:
        return COMMON + zlib.crc32(word) % HASHED


def hashed_class(word: Column) -> Column:
    return (F.crc32(word) % HASHED).cast("int") + FREQUENT


def encoded(docs: DataFrame, common: list[bytes], classes: np.ndarray, log_c: np.ndarray, inside: np.ndarray, held: Column) -> DataFrame:
    """row, doc_id, held_out, n_tokens, classes (16-bit, as bytes), rest (words that are not common), and sums over the common words:
    known, log_c, inside. The arrays give, by word id, the class, log10(c + ADD) and log10 P(word | class)."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds({w: k for k, w in enumerate(common)})
        for batch in batches:
            for low in range(0, len(batch), 256):
                piece = batch.slice(low, 256)
                sizes, known, logs, insides, coded, rest = [], [], [], [], [], []
                for text in piece.column(2):
                    words = tokens(text.as_py())
                    own = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
                    other = np.flatnonzero(own >= COMMON)
                    sizes.append(len(words))
                    known.append(len(words) - len(other))
                    logs.append(float(log_c[own].sum()))
                    insides.append(float(inside[own].sum()))
                    coded.append(classes[own].tobytes())
                    rest.append([words[i] for i in other])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(logs), pa.array(insides), pa.array(coded, pa.binary()), pa.array(rest, pa.list_(pa.binary()))],
                    names=["doc_id", "held_out", "n_tokens", "known", "log_c", "inside", "classes", "rest"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, log_c double, inside double, classes binary, rest array<binary>"
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(encode, schema)
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "hmm-texts")


def side_by_side(runs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences as columns of matrices, longest first, about ``BATCH_TOKENS`` cells at a time: (classes, lengths, which)."""
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
    low = 0
    while low < len(order):
        longest = max(len(runs[order[low]]), 1)
        chosen = order[low : low + max(1, BATCH_TOKENS // longest)]
        lengths = np.array([len(runs[i]) for i in chosen])
        table = np.zeros((longest, len(chosen)), np.uint16)
        for k, i in enumerate(chosen):
            table[: len(runs[i]), k] = runs[i]
        yield table, lengths, np.array(chosen)
        low += len(chosen)


def alive(lengths: np.ndarray, t: int) -> int:
    """How many of the sequences, sorted by falling length, have a token at place t."""
    return int(np.searchsorted(-lengths, -t, side="left"))


def log_likelihood(table: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Scaled forward recursion: log10 probability of each sequence. ``emit``: classes x states."""
    total = np.zeros(len(lengths))
    alpha = None
    for t in range(len(table)):
        n = alive(lengths, t)
        alpha = (start if t == 0 else alpha[:n] @ moves) * emit[table[t, :n]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    return total


def expected_counts(table: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: expected starts, transitions, and state x class counts (classes x states)."""
    size, width = table.shape
    states = len(start)
    alphas = np.zeros((size, width, states))
    scales = np.ones((size, width))
    for t in range(size):
        n = alive(lengths, t)
        alpha = (start if t == 0 else alphas[t - 1, :n] @ moves) * emit[table[t, :n]]
        scales[t, :n] = alpha.sum(1)
        alphas[t, :n] = alpha / scales[t, :n, None]
    beta = np.ones((width, states))
    pairs = np.zeros((states, states))
    for t in range(size - 1, 0, -1):
        n = alive(lengths, t)
        ahead = emit[table[t, :n]] * beta[:n] / scales[t, :n, None]
        pairs += alphas[t - 1, :n].T @ ahead
        alphas[t, :n] *= beta[:n]
        beta[:n] = ahead @ moves.T
    alphas[0] *= beta
    mask = np.arange(size)[:, None] < lengths[None, :]
    cells = table[mask].astype(np.int64)
    weights = alphas[mask]
    seen = np.stack([np.bincount(cells, weights[:, k], len(emit)) for k in range(states)], 1)
    return alphas[0].sum(0), pairs * moves, seen


def runs_of(batch: pa.RecordBatch, place: int, size: int | None) -> Iterator[list[np.ndarray]]:
    """The class sequences of a batch, cut into runs of ``size``, a bounded number of tokens at a time."""
    held: list[np.ndarray] = []
    total = 0
    for value in batch.column(place):
        own = np.frombuffer(value.as_py(), np.uint16)
        held += [own[i : i + size] for i in range(0, len(own), size)]
        total += len(own)
        if total > 2_000_000:
            yield held
            held, total = [], 0
    if held:
        yield held


def baum_welch(texts: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, moves, emit (classes x states), from the class sequences (column classes)."""
    size = len(class_counts)
    noise = np.random.default_rng(SEED).gamma(1.0, 1.0, (size, states))
    emit = (class_counts + ADD)[:, None] * noise
    emit /= emit.sum(0)
    start = np.full(states, 1 / states)
    moves = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    shape = states + states * states + size * states
    for _ in range(rounds):

        def part(batches: Iterable[pa.RecordBatch], model: tuple = (start, moves, emit)) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for runs in runs_of(batch, 0, RUN):
                    for table, lengths, _ in side_by_side(runs):
                        total += np.concatenate([x.ravel() for x in expected_counts(table, lengths, *model)])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["place", "n"])

        # Partitions are added up by place; what reaches the driver is one number per place of the model.
        table = texts.select("classes").mapInArrow(part, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(shape)
        total[np.asarray(table["place"])] = np.asarray(table["n"])
        if not total.any():
            break
        start = (total[:states] + 1) / (total[:states] + 1).sum()
        moves = total[states : states + states * states].reshape(states, states) + 1
        moves /= moves.sum(1, keepdims=True)
        # A state keeps a share of the corpus distribution, so that no class is impossible in it.
        emit = total[states + states * states :].reshape(size, states) + PRIOR * ((class_counts + ADD) / (class_counts + ADD).sum())[:, None]
        emit /= emit.sum(0)
    return start, moves, emit


def scored(texts: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """row and log10 probability of the class sequence of every text."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(1)]
            out = np.zeros(len(runs))
            for table, lengths, chosen in side_by_side(runs):
                out[chosen] = log_likelihood(table, lengths, *model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["row", "sequence"])

    return texts.select("row", "classes").mapInArrow(score, "row long, sequence double")


def language_model_scores(docs: DataFrame, held: Column | None = None, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of the documents."""
    held = F.lit(False) if held is None else held
    counts = saved(word_counts(docs.where(~held).select("text")), "hmm-words")
    n_all, v_all = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_all = n_all or 0
    # At most SHARE words can have so large a share; only these meet in the task that orders them, whatever the corpus.
    top = counts.where((F.col("c") * SHARE >= n_all) & (F.length("word") <= LONG)).orderBy(F.desc("c"), "word").limit(COMMON).toArrow()
    common, common_c = top["word"].to_pylist(), np.asarray(top["c"], np.float64)
    per_class = counts.groupBy(hashed_class(F.col("word")).alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # HASHED rows
    class_counts, vocabulary = np.zeros(FREQUENT + HASHED), np.zeros(FREQUENT + HASHED)
    for r in per_class:
        class_counts[r["class"]], vocabulary[r["class"]] = r["n"], r["v"]
    hashed = np.array([FREQUENT + zlib.crc32(w) % HASHED for w in common], np.int64)
    for k, c in enumerate(common_c[:FREQUENT]):  # these are classes of their own and leave their hashed ones
        class_counts[k] = c
        class_counts[hashed[k]] -= c
        vocabulary[hashed[k]] -= 1
    bottom = np.log10(class_counts + ADD * (vocabulary + 1))
    classes = np.zeros(COMMON + HASHED, np.uint16)
    log_c, inside = np.zeros(COMMON + HASHED), np.zeros(COMMON + HASHED)  # 0 for the other words, which the join below adds
    classes[COMMON:] = FREQUENT + np.arange(HASHED)
    classes[: len(common)] = np.where(np.arange(len(common)) < FREQUENT, np.arange(len(common)), hashed)
    log_c[: len(common)] = np.log10(common_c + ADD)
    inside[FREQUENT : len(common)] = log_c[FREQUENT : len(common)] - bottom[hashed[FREQUENT:]]
    texts = encoded(docs, common, classes, log_c, inside, held)
    model = baum_welch(texts.where(~F.col("held_out")), class_counts, rounds, states)
    least = F.array(*[F.lit(float(x)) for x in bottom[FREQUENT:]])
    rest = texts.select("row", F.explode("rest").alias("word"))
    met = rest.join(counts, "word", "left").select(
        "row", F.col("c").isNotNull().cast("long").alias("k"), F.log10(F.coalesce("c", F.lit(0)) + ADD).alias("l"), F.get(least, hashed_class(F.col("word")) - FREQUENT).alias("b")
    )
    others = met.groupBy("row").agg(F.sum("k").alias("rest_known"), F.sum("l").alias("rest_log_c"), F.sum(F.col("l") - F.col("b")).alias("rest_inside"))
    both = texts.drop("classes", "rest").join(scored(texts, model), "row").join(others, "row", "left")
    base = F.col("log_c") + F.coalesce("rest_log_c", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n_all + ADD * (v_all + 1)))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("sequence") + F.col("inside") + F.coalesce("rest_inside", F.lit(0.0))).alias("score"),
    )

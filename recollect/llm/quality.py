"""Quality rules: a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus, beside plain rules.

Two multinomials over ``BUCKETS`` hashed one- and two-word grams are counted: one over the documents that labels trust,
one over all documents. A document's score is the sum over its grams of log(trusted share / raw share), divided by
the number of its grams; it is kept if no plain rule fails and the score reaches a fixed threshold. Everything is DataFrame
expressions. The model is a row of ``BUCKETS`` numbers whatever the corpus holds, so it may travel as a literal.

Null and empty texts have no words: they fail the plain rules and score 0. Labels for no document, or a null id, count for
nothing; a document with several labels is trusted if one of them is 1. Repeated rows are judged and counted each by
themselves. Without trusted documents all ratios are 0. Columns other than the named ones are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import dropped_shuffles, let, words_of

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
PRIOR = 1000.0  # grams of the raw distribution that the trusted counts are given
THRESHOLD = -0.1  # natural-log units per gram
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def bucket_of(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BUCKET_BITS).cast("int")


def joined_runs(hashes: Column, apart: int) -> Column:
    """From hashes of runs that start at each word, those of the runs twice as long: each joined with the one ``apart`` later."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(runs: Column, window: int = WINDOW) -> Column:
    """How many words lie in runs that occur more than once, given the hashes of all runs of ``window`` words."""
    ordered = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(rows, k)["h"] == x["h"], F.lit(False))
        return F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1))

    starts = F.array_sort(F.transform(let(ordered, again), lambda x: x["i"]))
    begin = F.struct(F.lit(0).alias("total"), F.lit(-window).alias("last"))
    step = lambda acc, i: F.struct((acc["total"] + F.least(F.lit(window), i - acc["last"])).alias("total"), i.alias("last"))
    covered = F.aggregate(starts, begin, step)["total"]
    return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(covered).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the plain counts of every document, and the hashes of its words (_one), word pairs (_two)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", text.alias("_text"), words_of(text).alias("_words"))
    counted = split.select(
        "doc_id",
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_one"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    # Runs of 2, 4 and 8 words; each step joins neighbours of the step before.
    twos = counted.withColumn("_two", joined_runs(F.col("_one"), 1))
    fours = twos.withColumn("_four", joined_runs(F.col("_two"), 2))
    eights = fours.withColumn("_eight", joined_runs(F.col("_four"), 4))
    return eights.withColumn("n_repeat_words", repeated_words(F.col("_eight"))).drop("_four", "_eight")


def gram_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(trusted share / raw share) of each bucket. One pass: every gram row is added up before the shuffle."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_key")).distinct()
    # A null id takes its text's hash as key, so that null ids do not meet in one task; such keys never match.
    named = F.col("doc_id").isNotNull()
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_key"), named.alias("_named"), F.col("text").alias("_text"))
    flagged = keyed.join(trusted.withColumns({"_named": F.lit(True), "_trusted": F.lit(1)}).hint("shuffle_hash"), ["_key", "_named"], "left")
    hashed = flagged.select("_trusted", F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)).alias("_one"))
    grams = hashed.select("_trusted", F.explode(F.concat("_one", joined_runs(F.col("_one"), 1))).alias("gram"))
    grams = grams.select("_trusted", bucket_of(F.col("gram")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("trusted"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    with dropped_shuffles(docs.sparkSession):
        for row in counts.collect():  # at most BUCKETS rows
            raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["trusted"]
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0.0] * BUCKETS
    # The trusted shares are drawn towards the raw ones, so that what labels happen not to show says little in a small corpus.
    ratio = lambda t, r: math.log((t + PRIOR * r / all_raw) / (all_target + PRIOR)) - math.log(r / all_raw)
    return [ratio(t, r) if r else 0.0 for r, t in zip(raw, target, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept: one row per row."""
    ratios = F.split(F.lit(",".join(map(repr, gram_ratios(docs, labels)))), ",").cast("array<double>")
    counted = base_rules(docs)
    total = lambda grams, begin: F.aggregate(grams, begin, lambda acc, h: acc + F.get(ratios, bucket_of(h)))
    score = total("_two", total("_one", F.lit(0.0)))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = counted.select("*", failed.alias("base_failed"), (score / n_grams).alias("score")).drop("_one", "_two")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))

"""Scoring predictions against truth, and the reports over the scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from recollect.functions import exprs as X
from recollect.functions.ordered import row_numbers
from recollect.operators.text_rows import hash_answer, json_block

# ---------------------------------------------------------------- joining


def join_predictions(truth: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Every truth row with its prediction columns and ``answered``; a missing prediction leaves nulls."""
    return truth.join(predictions.withColumn("_p", F.lit(True)), key, "left").withColumn("answered", F.coalesce("_p", F.lit(False))).drop("_p")


def _draw(seed: int, i: Column, step: int) -> Column:
    """Pseudo-random 31-bit number of a counter: a fixed multiplier rule in plain integer arithmetic."""
    x = i * F.lit(3).cast("long") + F.lit(step).cast("long") + F.lit(seed).cast("long") * 7919
    for multiplier, increment in ((48271, 11), (69621, 7), (16807, 3)):
        x = F.pmod(x * F.lit(multiplier).cast("long") + F.lit(increment).cast("long"), F.lit(2147483647).cast("long"))
    return x


def sample_pairs(generated: DataFrame, reference: DataFrame, n: DataFrame | int, seed: int, gen_id: str = "gen_id", ref_id: str = "ref_id") -> DataFrame:
    """(pair, gen_id, ref_id, swap): n pairs drawn with replacement, each with a random side swap.

    Row numbers come from a range sort plus per-partition counts, and the drawn numbers meet the rows in equi-joins.
    """
    def numbered(df: DataFrame, col: str) -> DataFrame:
        return row_numbers(df.select(col), [col], "_n").select(col, (F.col("_n") - 1).cast("long").alias("_row"))

    g_count, r_count = (d.agg(F.count("*")).scalar() for d in (generated, reference))
    spark = generated.sparkSession
    pairs = spark.range(n).withColumnRenamed("id", "pair") if isinstance(n, int) else n.select("pair")
    drawn = pairs.select(
        "pair", F.pmod(_draw(seed, F.col("pair"), 0), g_count).alias("_g"), F.pmod(_draw(seed, F.col("pair"), 1), r_count).alias("_r"),
        (F.pmod(F.floor(_draw(seed, F.col("pair"), 2) / 1024), F.lit(2)) == 1).alias("swap"),
    )
    g = numbered(generated, gen_id).withColumnRenamed("_row", "_g")
    r = numbered(reference, ref_id).withColumnRenamed("_row", "_r")
    return drawn.join(g, "_g").join(r, "_r").select("pair", gen_id, ref_id, "swap")


# ---------------------------------------------------------------- function calls


def clean_name(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(X.col(c), F.lit("")), "[^a-zA-Z0-9_-]", "_")


def values_match(a: str | Column, b: str | Column) -> Column:
    """Equal, or numbers within 1e-9, or equal as trimmed text without quotes; null matches null only.

    Values are JSON texts: numbers bare, strings in quotes or not.
    """
    x, y = X.col(a), X.col(b)
    number = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
    numeric = x.rlike(number) & y.rlike(number)
    close = F.abs(x.try_cast("double") - y.try_cast("double")) < 1e-9

    def bare(v: Column) -> Column:
        return F.regexp_replace(X.strip(v), '"', "")

    return (
        F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull())
        .when(x == y, True).when(numeric, close).otherwise(bare(x) == bare(y))
    )


def match_calls(df: DataFrame, no_call_ok: bool = False) -> DataFrame:
    """Add ``success`` to rows with pred_name, pred_args, true_name and true_args (maps of JSON texts).

    Names must be equal after cleaning and not empty; every expected argument must be present and equal, more are
    ignored. With ``no_call_ok`` an expected empty call is met by making none.
    """
    pred, true = clean_name("pred_name"), clean_name("true_name")
    expected = F.coalesce("true_args", F.create_map().cast("map<string,string>"))
    given = F.coalesce("pred_args", F.create_map().cast("map<string,string>"))
    args = F.forall(F.map_entries(expected), lambda e: F.map_contains_key(given, e["key"]) & values_match(F.try_element_at(given, e["key"]), e["value"]))
    success = (pred != "") & (pred == true) & args
    if no_call_ok:
        success = success | ((true == "") & (pred == ""))
    return df.withColumn("success", F.coalesce(success, F.lit(False)))


def call_accuracy(results: DataFrame, by: str = "category") -> DataFrame:
    """(by, total, correct, accuracy)."""
    grouped = results.groupBy(by).agg(F.count("*").alias("total"), F.count_if("success").alias("correct"))
    return grouped.withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


# ---------------------------------------------------------------- questions and answers


def match_answers(df: DataFrame, predicted: str = "predicted", expected: str = "expected", count_empty: bool = True) -> DataFrame:
    """Add ``exact`` and ``partial`` for two answer columns.

    Partial: equal, one inside the other, or comma lists that share at least 0.8 of the longer one. An empty
    prediction is inside everything; ``count_empty=False`` rules that out.
    """
    p, e = X.normalise_answer(predicted), X.normalise_answer(expected)
    exact = p == e

    def items(v: Column) -> Column:
        parts = F.transform(F.split(v, ","), lambda s: X.strip(s))
        return F.array_distinct(F.filter(parts, lambda s: s != ""))

    longer = F.greatest(F.size(items(p)), F.size(items(e)))
    shared = F.size(F.array_intersect(items(p), items(e)))
    lists = (F.contains(p, F.lit(",")) | F.contains(e, F.lit(","))) & (F.size(items(p)) > 0) & (F.size(items(e)) > 0)
    partial = exact | F.contains(p, e) | F.contains(e, p) | (lists & (shared >= 0.8 * longer))
    if not count_empty:
        partial = partial & ((p != "") | exact)
    known = F.col(predicted).isNotNull() & F.col(expected).isNotNull()
    return df.withColumns({"exact": known & exact, "partial": known & partial})


def qa_rates(results: DataFrame, by: str = "level") -> DataFrame:
    """(by, total, exact, partial, exact_rate, partial_rate)."""
    grouped = results.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if("exact").alias("exact"), F.count_if("partial").alias("partial")
    )
    return grouped.withColumns({
        "exact_rate": F.round(F.col("exact") / F.col("total"), 6), "partial_rate": F.round(F.col("partial") / F.col("total"), 6),
    })


def level_progression(rates: DataFrame, level: str = "level", rate: str = "exact_rate") -> DataFrame:
    """Add the next level's rate and whether the rate falls, as it should; null where either rate is 0.

    Levels are integers, so the next level is an equi-join.
    """
    following = rates.select((F.col(level) - 1).cast(rates.schema[level].dataType).alias(level), F.col(rate).alias("next_rate"))
    joined = rates.join(following, level, "left")
    return joined.withColumn("ok", F.when((F.col(rate) > 0) & (F.col("next_rate") > 0), F.col(rate) > F.col("next_rate")))


# ---------------------------------------------------------------- judges and comparisons

JUDGE_FIELDS = ["correctness", "clarity", "difficulty_match", "completeness"]
# Lower bounds of the quality bands.
JUDGE_BANDS = [(4.0, "excellent"), (3.0, "good"), (2.0, "fair")]


def judge_score(raw: str | Column) -> Column:
    """Score of one JSON value: numbers are cut and clamped to 1-5, digit strings are taken as they are, else 0."""
    v = F.coalesce(X.col(raw), F.lit(""))
    number = v.try_cast("double")
    quoted = F.regexp_extract(v, r'^"([-+]?\d+)"$', 1)
    return (
        F.when(quoted != "", quoted.try_cast("int"))
        .when(v.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), F.greatest(F.lit(1), F.least(F.lit(5), number.cast("int"))))
        .otherwise(0)
    )


def judge_rows(df: DataFrame, response: str = "response") -> DataFrame:
    """Add the four scores and their mean from the JSON object in a judge's response; 0 where it cannot be read."""
    block = json_block(response)
    fields = F.from_json(F.when(F.try_parse_json(block).isNotNull(), block), "map<string,string>")
    raw = F.try_variant_get(F.try_parse_json(block), "$", "map<string,variant>")

    def value(name: str) -> Column:
        # A string keeps its quotes, so that it can be told from a number.
        kind = F.schema_of_variant(F.try_element_at(raw, F.lit(name)))
        text = F.try_element_at(fields, F.lit(name))
        return F.when(kind == "STRING", F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)

    out = df.withColumns({name: judge_score(value(name)) for name in JUDGE_FIELDS})
    return out.withColumn("average", sum(F.col(n) for n in JUDGE_FIELDS) / 4.0)


def judge_statistics(scores: DataFrame) -> DataFrame:
    """One row: the mean of each score, the overall mean, and its band."""
    means = scores.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in JUDGE_FIELDS], F.round(F.coalesce(F.avg("average"), F.lit(0.0)), 6).alias("overall"))
    return means.withColumn("band", X.band("overall", JUDGE_BANDS, "poor"))


def comparison_outcome(df: DataFrame, winner: str = "winner", swap: str = "swap", error: str | None = None) -> DataFrame:
    """Add ``outcome``: tie, generated or reference; whatever is not understood is a tie."""
    w = F.lower(X.strip(F.coalesce(F.col(winner), F.lit(""))))
    outcome = (
        F.when(F.contains(w, F.lit("tie")) | F.contains(w, F.lit("draw")), "tie")
        .when(w == "a", F.when(F.col(swap), "reference").otherwise("generated"))
        .when(w == "b", F.when(F.col(swap), "generated").otherwise("reference"))
        .otherwise("tie")
    )
    if error:
        outcome = F.when(F.col(error).isNotNull(), "error").otherwise(outcome)
    return df.withColumn("outcome", outcome)


def win_rates(comparisons: DataFrame) -> DataFrame:
    """One row: comparisons, wins, ties, losses, their rates over all (errors included), and the band."""
    o = F.col("outcome")
    counted = comparisons.agg(
        F.count("*").alias("comparisons"), F.count_if(o == "generated").alias("wins"), F.count_if(o == "tie").alias("ties"),
        F.count_if(o == "reference").alias("losses"),
    )
    rates = {f"{name}_rate": F.round(F.try_divide(F.col(c), F.col("comparisons")), 6) for name, c in (("win", "wins"), ("tie", "ties"), ("loss", "losses"))}
    rate = F.try_divide(F.col("wins"), F.col("comparisons"))
    # A rate above 0.55 is not close to the reference any more and falls to the second band.
    band = F.when((rate >= 0.45) & (rate <= 0.55), "excellent").when(rate >= 0.35, "good").when(rate >= 0.25, "fair").otherwise("poor")
    return counted.withColumns({**rates, "band": band})


# ---------------------------------------------------------------- rewards


def accuracy_reward(df: DataFrame, completion: str = "completion", truth: str = "truth", out: str = "reward") -> DataFrame:
    return df.withColumn(out, _accuracy(completion, truth))


def _accuracy(completion: str, truth: str) -> Column:
    return F.when(hash_answer(completion) == F.col(truth), 1.0).otherwise(0.0)


def length_penalty_reward(df: DataFrame, weight: float = 0.1, max_length: int = 1024, completion: str = "completion", truth: str = "truth", out: str = "reward") -> DataFrame:
    penalty = F.length(completion) / F.lit(max_length) * weight
    return df.withColumn(out, F.greatest(F.lit(0.0), _accuracy(completion, truth) - penalty))


def step_reward(df: DataFrame, bonus: float = 0.1, completion: str = "completion", truth: str = "truth", out: str = "reward") -> DataFrame:
    # A text without any sign has no line; a final line break opens none.
    text = F.coalesce(F.col(completion), F.lit(""))
    lines = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")))
    return df.withColumn(out, F.least(F.lit(2.0), _accuracy(completion, truth) + lines * bonus))


def reward_summary(rewards: DataFrame, reward: str = "reward") -> DataFrame:
    return rewards.agg(F.count("*").alias("samples"), F.round(F.avg(reward), 6).alias("mean_reward"), F.count_if(F.col(reward) >= 1.0).alias("correct"))


Reward = Callable[[pd.Series, pd.Series], pd.Series]
_REWARDS: dict[str, Reward] = {}


def register_reward(name: str, fn: Reward) -> None:
    """Register a batch reward: (completions, truths) -> scores, run on Arrow batches."""
    _REWARDS[name] = fn


def custom_reward(df: DataFrame, name: str, completion: str = "completion", truth: str = "truth", out: str = "reward") -> DataFrame:
    fn = _REWARDS[name]

    @F.pandas_udf(DoubleType())
    def score(completions: pd.Series, truths: pd.Series) -> pd.Series:
        return fn(completions, truths)

    return df.withColumn(out, score(F.col(completion), F.col(truth)))

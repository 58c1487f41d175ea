"""Registered queries: evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.operators import evaluate as E
from recollect.operators import text_rows as TR
from recollect.plans import fixtures as fx
from recollect.plans.registry import query
from recollect.session import work_path
from recollect.sources import evaluation as S

# ---------------------------------------------------------------- question answering

_QA = """truth AS (SELECT item_id AS id, text AS expected, CAST(item_id % 3 + 1 AS INTEGER) AS level FROM benchmark),
resp AS (SELECT item_id AS id, CASE item_id % 4 WHEN 0 THEN 'Some thought' || chr(10) || 'FINAL ANSWER: ' || replace(text, chr(10), ' ') WHEN 1 THEN substring(text, 1, 20) ELSE upper(replace(text, 'ß', 'ss')) || '.' END AS response FROM benchmark WHERE item_id % 4 <> 3)"""


def _truth(t):
    return t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("expected"), (F.col("item_id") % 3 + 1).cast("int").alias("level"))


def _responses(t):
    i = F.col("item_id")
    response = (
        F.when(i % 4 == 0, F.concat(F.lit("Some thought\nFINAL ANSWER: "), F.regexp_replace("text", "\n", " ")))
        .when(i % 4 == 1, F.substring("text", 1, 20)).otherwise(F.concat(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), F.lit(".")))
    )
    return t.benchmark.where(i % 4 != 3).select(i.alias("id"), response.alias("response"))


_FINAL = r"""CASE WHEN regexp_matches(response, '(?is)FINAL\s*ANSWER\s*:\s*(.+?)(?:\n|$)') THEN trim(regexp_extract(response, '(?is)FINAL\s*ANSWER\s*:\s*(.+?)(?:\n|$)', 1))
 ELSE coalesce(list_filter(list_transform(string_split(coalesce(response, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1], '') END"""


def _norm_sql(c: str) -> str:
    s = f"trim(lower(coalesce({c}, '')))"
    for pattern, new in ((r"\s+", " "), (r"(\d),(\d)", r"\1\2"), (r"\.$", ""), ("[\"'']", "")):
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    return rf"regexp_replace({s}, '^(a|an|the)\s+', '')"


_SCORED = f"""{_QA}, joined AS (SELECT id, expected, level, response, response IS NOT NULL AS answered, {_FINAL} AS predicted FROM truth LEFT JOIN resp USING (id)),
normal AS (SELECT *, {_norm_sql('predicted')} AS p, {_norm_sql('expected')} AS e FROM joined),
lists AS (SELECT *, list_distinct(list_filter(list_transform(string_split(p, ','), lambda x: trim(x)), lambda x: x <> '')) AS pl, list_distinct(list_filter(list_transform(string_split(e, ','), lambda x: trim(x)), lambda x: x <> '')) AS el FROM normal),
scored AS (SELECT id, level, answered, predicted, expected, p = e AS exact, p = e OR contains(p, e) OR contains(e, p) OR ((contains(p, ',') OR contains(e, ',')) AND len(pl) > 0 AND len(el) > 0 AND len(list_intersect(pl, el)) >= 0.8 * greatest(len(pl), len(el))) AS partial FROM lists)"""


def _qa(t):
    joined = E.join_predictions(_truth(t), _responses(t)).withColumn("predicted", X.final_answer("response"))
    return E.match_answers(joined)


@query("j11_join_predictions", f"WITH {_QA} SELECT id, level, response, response IS NOT NULL AS answered FROM truth LEFT JOIN resp USING (id)")
def j11(t):
    return E.join_predictions(_truth(t), _responses(t)).select("id", "level", "response", "answered")


@query("e03_final_answer", f"WITH {_QA} SELECT id, {_FINAL} AS answer FROM resp")
def e03(t):
    return _responses(t).select("id", X.final_answer("response").alias("answer"))


@query("e04_normalise_answer", f"SELECT doc_id, {_norm_sql('text')} AS normal FROM documents")
def e04(t):
    return t.documents.select("doc_id", X.normalise_answer("text").alias("normal"))


@query("e05_match_answers", f"WITH {_SCORED} SELECT id, exact, partial FROM scored")
def e05(t):
    return _qa(t).select("id", "exact", "partial")


_RATES = f"{_SCORED}, rates AS (SELECT level, count(*) AS total, count(*) FILTER (exact) AS exact, count(*) FILTER (partial) AS partial, round(count(*) FILTER (exact) / count(*), 6) AS exact_rate, round(count(*) FILTER (partial) / count(*), 6) AS partial_rate FROM scored GROUP BY level)"


@query("a12_qa_rates", f"WITH {_RATES} SELECT * FROM rates")
def a12(t):
    return E.qa_rates(_qa(t))


@query("a13_level_progression", f"WITH {_RATES}, w AS (SELECT level, exact_rate, lead(exact_rate) OVER (ORDER BY level) AS next_rate FROM rates) SELECT *, CASE WHEN exact_rate > 0 AND next_rate > 0 THEN exact_rate > next_rate END AS ok FROM w")
def a13(t):
    return E.level_progression(E.qa_rates(_qa(t))).select("level", "exact_rate", "next_rate", "ok")


@query("s15_export_qa_results", f"WITH {_SCORED} SELECT id AS task_id, 'm' AS model, predicted AS answer, expected AS ground_truth, exact AS exact_match, partial AS partial_match FROM scored")
def s15(t):
    path = work_path(t.spark, "qa")
    S.export_qa_results(_qa(t), "m", path)
    schema = "task_id long, model string, answer string, ground_truth string, exact_match boolean, partial_match boolean"
    return t.spark.read.schema(schema).json(f"{path}/results")


# ---------------------------------------------------------------- function calls


def _calls(t):
    """Documents as call samples: names differ in the sign or, sometimes, in the number; arguments in form or value."""
    d = F.col("doc_id")
    truth = t.documents.select(
        d.alias("id"), F.col("source").alias("category"), F.concat(F.lit("f_"), (d % 5).cast("string")).alias("true_name"),
        F.create_map(F.lit("n"), d.cast("string"), F.lit("s"), F.concat(F.lit('"'), "lang", F.lit('"'))).alias("true_args"))
    predicted = t.documents.where(d % 7 != 0).select(
        d.alias("id"), F.concat(F.lit("f."), (d % 5 + F.when(d % 11 == 0, 1).otherwise(0)).cast("string")).alias("pred_name"),
        F.create_map(
            F.lit("n"), F.when(d % 13 == 0, (d + 1).cast("string")).otherwise(F.concat(d.cast("string"), F.lit(".0"))),
            F.lit("s"), F.when(d % 2 == 0, F.col("lang")).otherwise(F.concat(F.lit('"'), "lang", F.lit('"'))), F.lit("extra"), F.lit("1"),
        ).alias("pred_args"))
    return E.match_calls(E.join_predictions(truth, predicted))


_CALLS = "calls AS (SELECT doc_id AS id, source AS category, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS success FROM documents)"


@query("e01_match_calls", f"WITH {_CALLS} SELECT * FROM calls")
def e01(t):
    return _calls(t).select("id", "category", "success")


@query("e02_values_match", """WITH p AS (SELECT event_id, CAST(event_id AS VARCHAR) AS a, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_id || '.0' WHEN 2 THEN '"' || event_id || '" ' WHEN 3 THEN NULL ELSE event_type END AS b FROM events)
SELECT event_id, CASE WHEN b IS NULL THEN false ELSE trim(replace(b, '"', '')) = a OR coalesce(abs(try_cast(b AS DOUBLE) - try_cast(a AS DOUBLE)) < 1e-9, false) END AS same FROM p""")
def e02(t):
    i = F.col("event_id")
    a = i.cast("string")
    b = F.when(i % 5 == 0, a).when(i % 5 == 1, F.concat(a, F.lit(".0"))).when(i % 5 == 2, F.concat(F.lit('"'), a, F.lit('" '))).when(i % 5 == 4, F.col("event_type"))
    return t.events.select("event_id", E.values_match(a, b).alias("same"))


@query("a11_call_accuracy", f"WITH {_CALLS} SELECT category, count(*) AS total, count(*) FILTER (success) AS correct, round(count(*) FILTER (success) / count(*), 6) AS accuracy FROM calls GROUP BY category")
def a11(t):
    return E.call_accuracy(_calls(t))


@query("s14_export_call_results", f"WITH {_CALLS} SELECT 'm' AS model, count(*) AS total, count(*) FILTER (success) AS correct FROM calls")
def s14(t):
    path = work_path(t.spark, "calls")
    scored = _calls(t).select(
        "id", F.when(F.col("answered"), F.struct(F.col("pred_name").alias("name"), F.col("pred_args").alias("arguments"))).alias("predicted"),
        F.struct(F.col("true_name").alias("name"), F.col("true_args").alias("arguments")).alias("expected"), "success", F.lit(None).cast("string").alias("error"))
    S.export_call_results(scored, "m", path)
    return t.spark.read.schema("model string, total long, correct long").json(f"{path}/summary")


# ---------------------------------------------------------------- judges

_JUDGE_SCORES = """scores AS (SELECT doc_id AS id, quality * 4 + 1 AS correctness, 5 - toxic * 4 AS clarity, CAST(greatest(1, least(5, doc_id % 7)) AS INTEGER) AS difficulty_match, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END AS completeness FROM labels)"""


def _judged(t):
    d = F.col("doc_id")
    body = F.concat(
        F.lit('Here is my view: {"correctness": '), (F.col("quality") * 4 + 1).cast("string"), F.lit(', "clarity": "'), (5 - F.col("toxic") * 4).cast("string"),
        F.lit('", "difficulty_match": '), (d % 7).cast("string"), F.lit(', "completeness": '), F.when(d % 5 == 0, F.lit('"none"')).otherwise(F.lit("3.9")), F.lit("} done."))
    return E.judge_rows(t.labels.select(d.alias("id"), body.alias("response")))


@query("e06_judge_rows", f"WITH {_JUDGE_SCORES} SELECT *, (correctness + clarity + difficulty_match + completeness) / 4.0 AS average FROM scores")
def e06(t):
    return _judged(t).drop("response")


@query("a14_judge_statistics", f"""WITH {_JUDGE_SCORES}, m AS (SELECT round(avg(correctness), 6) AS correctness, round(avg(clarity), 6) AS clarity, round(avg(difficulty_match), 6) AS difficulty_match, round(avg(completeness), 6) AS completeness,
  round(avg((correctness + clarity + difficulty_match + completeness) / 4.0), 6) AS overall FROM scores)
SELECT *, CASE WHEN overall >= 4 THEN 'excellent' WHEN overall >= 3 THEN 'good' WHEN overall >= 2 THEN 'fair' ELSE 'poor' END AS band FROM m""")
def a14(t):
    return E.judge_statistics(_judged(t))


_SEED = 7


def _draw_sql(step: int) -> str:
    x = f"(pair * 3 + {step} + {_SEED} * 7919)"
    for m, c in ((48271, 11), (69621, 7), (16807, 3)):
        x = f"(({x} * {m} + {c}) % 2147483647)"
    return x


_PAIRS = f"""g AS (SELECT item_id AS gen_id, row_number() OVER (ORDER BY item_id) - 1 AS r FROM benchmark), f AS (SELECT doc_id AS ref_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM labels),
pairs AS (SELECT pair, gen_id, ref_id, ({_draw_sql(2)} // 1024) % 2 = 1 AS swap FROM (SELECT doc_id AS pair FROM documents)
  JOIN g ON g.r = {_draw_sql(0)} % (SELECT count(*) FROM g) JOIN f ON f.r = {_draw_sql(1)} % (SELECT count(*) FROM f))"""


def _pairs(t):
    return E.sample_pairs(t.benchmark.select(F.col("item_id").alias("gen_id")), t.labels.select(F.col("doc_id").alias("ref_id")), t.documents.select(F.col("doc_id").alias("pair")), _SEED)


@query("j12_sample_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def j12(t):
    return _pairs(t)


_OUTCOMES = f"""{_PAIRS}, votes AS (SELECT pair, swap, CASE pair % 6 WHEN 0 THEN 'A' WHEN 1 THEN ' b ' WHEN 2 THEN 'Tie!' WHEN 3 THEN 'draw' WHEN 4 THEN '' ELSE 'A' END AS winner, pair % 17 = 0 AS failed FROM pairs),
outcomes AS (SELECT pair, CASE WHEN failed THEN 'error' WHEN trim(winner) = 'A' THEN CASE WHEN swap THEN 'reference' ELSE 'generated' END WHEN trim(winner) = 'b' THEN CASE WHEN swap THEN 'generated' ELSE 'reference' END ELSE 'tie' END AS outcome FROM votes)"""


def _outcomes(t):
    i = F.col("pair") % 6
    winner = F.when(i == 0, "A").when(i == 1, " b ").when(i == 2, "Tie!").when(i == 3, "draw").when(i == 4, "").otherwise("A")
    voted = _pairs(t).withColumns({"winner": winner, "error": F.when(F.col("pair") % 17 == 0, "no answer")})
    return E.comparison_outcome(voted, error="error")


@query("e07_comparison_outcome", f"WITH {_OUTCOMES} SELECT * FROM outcomes")
def e07(t):
    return _outcomes(t).select("pair", "outcome")


@query("a15_win_rates", f"""WITH {_OUTCOMES}, c AS (SELECT count(*) AS comparisons, count(*) FILTER (outcome = 'generated') AS wins, count(*) FILTER (outcome = 'tie') AS ties, count(*) FILTER (outcome = 'reference') AS losses FROM outcomes)
SELECT *, round(wins / comparisons, 6) AS win_rate, round(ties / comparisons, 6) AS tie_rate, round(losses / comparisons, 6) AS loss_rate,
 CASE WHEN wins / comparisons BETWEEN 0.45 AND 0.55 THEN 'excellent' WHEN wins / comparisons >= 0.35 THEN 'good' WHEN wins / comparisons >= 0.25 THEN 'fair' ELSE 'poor' END AS band FROM c""")
def a15(t):
    return E.win_rates(_outcomes(t))


# ---------------------------------------------------------------- rewards

_REWARD_ROWS = """rows AS (SELECT conv_id * 1000 + turn AS id, text || chr(10) || CASE WHEN turn % 3 = 2 THEN 'so it is ' || turn ELSE '#### ' || turn END AS completion, CAST(turn + conv_id % 2 AS VARCHAR) AS truth, turn % 3 <> 2 AND conv_id % 2 = 0 AS hit FROM conversations)"""


def _reward_rows(t):
    turn = F.col("turn").cast("string")
    tail = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("so it is "), turn)).otherwise(F.concat(F.lit("#### "), turn))
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.lit("\n"), tail).alias("completion"),
        (F.col("turn") + F.col("conv_id") % 2).cast("string").alias("truth"))


@query("e08_accuracy_reward", f"WITH {_REWARD_ROWS} SELECT id, CAST(hit AS INTEGER)::DOUBLE AS reward FROM rows")
def e08(t):
    return E.accuracy_reward(_reward_rows(t)).select("id", "reward")


@query("e09_length_penalty_reward", f"WITH {_REWARD_ROWS} SELECT id, round(greatest(0, CAST(hit AS INTEGER) - 0.1 * (length(completion) / 1024.0)), 6) AS reward FROM rows")
def e09(t):
    return E.length_penalty_reward(_reward_rows(t)).select("id", F.round("reward", 6).alias("reward"))


@query("e10_step_reward", f"WITH {_REWARD_ROWS} SELECT id, round(least(2, CAST(hit AS INTEGER) + 0.1 * len(string_split(completion, chr(10)))), 6) AS reward FROM rows")
def e10(t):
    return E.step_reward(_reward_rows(t)).select("id", F.round("reward", 6).alias("reward"))


def _brevity(completions: pd.Series, truths: pd.Series) -> pd.Series:
    return 1.0 / (1.0 + (completions.str.len() - truths.str.len()).abs())


@query("e11_custom_reward", f"WITH {_REWARD_ROWS} SELECT id, round(1.0 / (1.0 + abs(length(completion) - length(truth))), 6) AS reward FROM rows")
def e11(t):
    E.register_reward("brevity", _brevity)
    return E.custom_reward(_reward_rows(t), "brevity").select("id", F.round("reward", 6).alias("reward"))


@query("a16_reward_summary", f"WITH {_REWARD_ROWS} SELECT count(*) AS samples, round(avg(CAST(hit AS INTEGER)), 6) AS mean_reward, count(*) FILTER (hit) AS correct FROM rows")
def a16(t):
    return E.reward_summary(E.accuracy_reward(_reward_rows(t)))


# ---------------------------------------------------------------- evaluation sets


@query("s05_read_eval_set", "SELECT CAST(item_id AS VARCHAR) AS id, text AS question, length(text) AS n FROM benchmark")
def s05(t):
    """JSON lines, blank lines, broken lines and lines with arrays, written from the table and read back."""
    path = work_path(t.spark, "eval")
    sample = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"))
    line = F.when(F.col("item_id") % 2 == 0, F.to_json(sample)).otherwise(F.to_json(F.array(sample)))
    t.benchmark.select(F.explode(F.array(line, F.lit("  "), F.lit("{broken"))).alias("value")).write.text(path)
    good, _ = S.read_eval_set(t.spark, path)
    return good.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.question").alias("question")).withColumn("n", F.length("question"))


@query("s05_corrupt_lines", "SELECT '{broken' AS value, count(*) AS n FROM benchmark")
def s05_corrupt(t):
    path = work_path(t.spark, "eval")
    t.benchmark.select(F.explode(F.array(F.to_json(F.struct("text")), F.lit("{broken"))).alias("value")).write.text(path)
    return S.read_eval_set(t.spark, path)[1].groupBy("value").agg(F.count("*").alias("n"))


@query("s06_dataset_slice", "SELECT item_id, text FROM benchmark WHERE item_id % 5 <> 0 ORDER BY item_id LIMIT 10 OFFSET 5")
def s06(t):
    """The feature itself: ten rows of a split from the fifth on."""
    split = t.benchmark.withColumn("split", F.when(F.col("item_id") % 5 != 0, "train").otherwise("test"))
    return S.dataset_slice(split, "item_id", 10, 5, "train").select("item_id", "text")


@query("t11_parse_call_samples", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS question, 'f.' || lang AS truth_name, source AS s, CAST(doc_id AS VARCHAR) AS n, 1 AS functions FROM documents""")
def t11(t):
    """The truth is an object for even ids and a JSON string for odd ones."""
    truth = F.to_json(F.struct(F.concat(F.lit("f."), "lang").alias("name"), F.struct(F.col("source").alias("s"), F.col("doc_id").alias("n")).alias("arguments")))
    turns = F.array(F.array(F.struct(F.lit("system").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    head = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), turns.alias("question"), F.array(F.struct(F.lit("f").alias("name"))).alias("function")))
    as_string = F.regexp_extract(F.to_json(F.struct(truth.alias("x"))), r'^\{"x":(.*)\}$', 1)
    value = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "ground_truth": '), F.when(F.col("doc_id") % 2 == 0, truth).otherwise(as_string), F.lit("}"))
    parsed = TR.parse_call_samples(t.documents.select(value.alias("value")))
    return parsed.select("id", TR.question_text("question").alias("question"), "truth_name", F.col("truth_arguments")["s"].alias("s"), F.col("truth_arguments")["n"].alias("n"), F.size("functions").alias("functions"))


@query("t12_parse_qa_samples", """SELECT CAST(doc_id AS VARCHAR) AS id, text AS question, lang AS answer, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS level, CASE WHEN doc_id % 2 = 0 THEN source END AS file_name FROM documents""")
def t12(t):
    d = F.col("doc_id")
    key, text = d.cast("string"), F.col("text")
    one = F.to_json(F.struct(key.alias("id"), text.alias("question"), F.col("lang").alias("answer"), F.when(d % 3 == 0, 2).alias("level"), F.when(d % 2 == 0, F.col("source")).alias("file_name")))
    two = F.to_json(F.struct(key.alias("task_id"), text.alias("Question"), F.col("lang").alias("Answer"), F.lit("3").alias("level"), F.when(d % 2 == 0, F.col("source")).otherwise("null").alias("file_name")))
    return TR.parse_qa_samples(t.documents.select(F.when(d % 3 == 1, two).otherwise(one).alias("value")))


@query("t14_format_sft", "SELECT conv_id, turn, 'Question: ' || text || chr(10) || chr(10) || 'Let''s solve this step by step:' || chr(10) AS prompt, role AS completion, 'Question: ' || text || chr(10) || chr(10) || 'Let''s solve this step by step:' || chr(10) || role AS full_text FROM conversations")
def t14(t):
    made = TR.format_training(t.conversations.withColumnRenamed("text", "q"), "q", "role", "sft")
    return made.select("conv_id", "turn", "prompt", "completion", F.col("text").alias("full_text"))


@query("t14_format_rl", f"""WITH {_REWARD_ROWS} SELECT id, '<|im_start|>user' || chr(10) || truth || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
 CASE WHEN regexp_matches(completion, '####\\s*(-?[\\d,.]+)') THEN regexp_extract(completion, '####\\s*(-?[\\d,.]+)', 1) ELSE trim(string_split(trim(completion), chr(10))[-1]) END AS ground_truth, completion AS full_answer FROM rows""")
def t14_rl(t):
    return TR.format_training(_reward_rows(t), "truth", "completion", "rl").select("id", "prompt", "ground_truth", "full_answer")


@query("t16_label_samples", """SELECT doc_id AS id, CASE WHEN source <> 'src1' AND doc_id % 3 <> 0 THEN 'f_' || lang ELSE '' END AS truth_name, CASE WHEN source <> 'src1' AND doc_id % 3 <> 0 THEN '{"k":"' || lang || '"}' ELSE '{}' END AS truth_arguments FROM documents""")
def t16(t):
    samples = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src1", "irrelevance").otherwise("simple").alias("category"))
    made = t.documents.where(F.col("doc_id") % 3 != 0).select(F.col("doc_id").alias("id"), F.concat(F.lit("f_"), "lang").alias("name"), F.to_json(F.struct(F.col("lang").alias("k"))).alias("arguments"))
    return TR.label_samples(samples, made).select("id", "truth_name", "truth_arguments")

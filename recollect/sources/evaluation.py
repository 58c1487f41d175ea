"""Evaluation sets and score exports."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions.ordered import row_numbers, running_sums
from recollect.functions.ranking import ordered_text
from recollect.session import cut
from recollect.sources.logs import read_log_lines

#: A JSON string, or a sign that opens, closes or separates.
_SIGNS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},]')


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, corrupt): one JSON object per row in ``value``, from JSON lines or from JSON arrays.

    The first character of a file that is no white space decides. Behind ``[`` the file is one array, spread over its lines in any way, unless that
    line is a whole array by itself; then, and behind any other character, each line is a sample, or an array of samples, which is unfolded.
    Blank lines are skipped; lines and array elements that are no JSON are returned apart.
    """
    lines = read_log_lines(spark, path).select("file", "line", X.strip("value").alias("value")).where(F.col("value") != "")
    firsts = lines.groupBy("file").agg(F.min_by("value", "line").alias("_first"))
    spread = firsts.where(F.col("_first").startswith("[") & F.try_parse_json("_first").isNull()).select("file")
    plain = lines.join(spread, "file", "left_anti").select("value")
    elements = array_elements(lines.join(spread, "file", "left_semi"))
    checked = plain.union(elements).withColumn("_ok", F.try_parse_json("value").isNotNull())
    items = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    good = checked.where("_ok").select(F.explode(items).alias("value"))
    return good, checked.where(~F.col("_ok")).select("value")


def array_elements(lines: DataFrame) -> DataFrame:
    """value: the elements, as text, of files that each hold one JSON array, from their lines (file, line, value).

    A JSON string does not go over a line end, so every line begins outside of strings, and how far it opens or closes brackets can be told from the line
    alone. A running sum over the lines of a file gives the depth at which each begins; then the lines are cut at the commas of the outer
    array, another running sum numbers the elements, and the pieces of an element are joined. A file of any size is read in parallel.
    """
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"', "")
    signs = lambda some: F.length(F.regexp_replace(bare, some, ""))
    moved = (signs(r"[^\[{]") - signs(r"[^\]}]")).cast("long")
    deep = running_sums(lines.select("file", "line", "value", moved.alias("_moved")), ["file"], ["line"], {"_end": "_moved"})
    pieces = cut(deep.select("file", "line", "value", (F.col("_end") - F.col("_moved")).alias("_depth")).mapInArrow(
        _pieces, f"file string, line {lines.schema['line'].dataType.simpleString()}, commas long, pieces array<string>"
    ))
    numbered = running_sums(pieces, ["file"], ["line"], {"_last": "commas"})
    parts = numbered.select("file", "line", (F.col("_last") - F.col("commas")).alias("_at"), F.posexplode("pieces").alias("_k", "_piece")).where(X.strip("_piece") != "")
    whole = parts.groupBy("file", (F.col("_at") + F.col("_k")).alias("_element")).agg(ordered_text(F.col("_piece"), F.col("line"), "\n").alias("value"))
    return whole.select(X.strip("value").alias("value"))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, line, commas, pieces: lines that begin at a depth, cut at the commas of the outer array, without its brackets."""
    for batch in batches:
        commas, pieces = [], []
        for value, depth in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own, begin = [""], 0
            for sign in _SIGNS.finditer(value):
                mark = sign.group()
                outer = depth == (0 if mark in "[{" else 1)
                if mark[0] == '"':
                    continue
                if outer and mark in "[],":
                    own[-1] += value[begin : sign.start()]
                    begin = sign.end()
                    if mark == ",":
                        own.append("")
                depth += (mark in "[{") - (mark in "]}")
            own[-1] += value[begin:]
            commas.append(len(own) - 1)
            pieces.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(commas, pa.int64()), pa.array(pieces, pa.list_(pa.string()))], names=["file", "line", "commas", "pieces"])


def dataset_slice(df: DataFrame, order_by: str, limit: int, offset: int = 0, split: str | None = None, split_col: str = "split") -> DataFrame:
    """Rows of a split in order, from an offset on; a limit of 0 or less means all."""
    out = df if split is None else df.where(F.col(split_col) == split)
    # Numbered rows need only a filter; sorting for a slice would bring its rows into one task.
    numbered = row_numbers(out, [order_by], "_n").where(F.col("_n") > offset)
    return (numbered.where(F.col("_n") <= offset + limit) if limit > 0 else numbered).drop("_n")


def _export(rows: DataFrame, totals: DataFrame, path: str) -> None:
    """One JSON line per result, and one line of totals beside them."""
    rows.write.mode("overwrite").json(f"{path}/results")
    totals.write.mode("overwrite").json(f"{path}/summary")


def export_call_results(results: DataFrame, model: str, path: str) -> None:
    """Function-call results (id, predicted, expected, success, error) with model, total and correct counts."""
    rows = results.select(
        "id", F.lit(model).alias("model_name"),
        F.coalesce(F.to_json("predicted"), F.to_json(F.struct(F.coalesce("error", F.lit("no tool call")).alias("error")))).alias("predicted"),
        F.to_json("expected").alias("expected"), "success",
    )
    totals = results.agg(F.lit(model).alias("model"), F.count("*").alias("total"), F.count_if("success").alias("correct"))
    _export(rows, totals, path)


def export_qa_results(results: DataFrame, model: str, path: str) -> None:
    """Answers (id, predicted, expected, exact, partial) in submission form with their counts."""
    rows = results.select(
        F.col("id").alias("task_id"), F.lit(model).alias("model"), F.col("predicted").alias("answer"),
        F.col("expected").alias("ground_truth"), F.col("exact").alias("exact_match"), F.col("partial").alias("partial_match"),
    )
    totals = results.agg(
        F.lit(model).alias("model"), F.count("*").alias("total"), F.count_if("exact").alias("exact_correct"), F.count_if("partial").alias("partial_correct")
    )
    _export(rows, totals, path)

"""Dialogue logs: ``HH:mm:ss - message`` lines to typed events."""

from __future__ import annotations

import re
from functools import reduce

from recollect.functions import exprs as X
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The stage marks of the log, as (kind, pattern with the part to keep).
STAGES = [
    ("start", r"^💬 对话开始: (.*) <-> 玩家$"),
    ("message", r"^📝 玩家消息: (.*)$"),
    ("affinity", r"^💖 当前好感度: (-?[\d.]+)/100"),
    ("retrieval", r"^🧠 检索到(\d+)条相关记忆"),
    ("generating", r"^🤖 正在生成回复"),
    ("reply", r"^💬 .*?回复: (.*)$"),
    ("analysing", r"^📊 正在分析好感度变化"),
    ("change", r"^(?:📈|📉) 好感度变化: .*\(([-+]?[\d.]+)\)"),
    ("unchanged", r"^➡️ 好感度未变化 \(当前: (-?[\d.]+)\)"),
    ("reason", r"^原因: (.*)$"),
    ("sentiment", r"^情感: (.*)$"),
    ("saved", r"^💾 对话已保存到(.*)的记忆中$"),
    ("end", r"^✅ 对话完成"),
]
_TEXT = {"message", "reply", "reason", "sentiment"}
_NUMBER = {"affinity", "retrieval", "change", "unchanged"}
_SUBJECT = {"start", "saved"}


def parse_dialogue_log(lines: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(file, line, seconds, kind, subject, number, text) from (file, line, value); lines without a clock drop.

    Lines that are no stage have a null kind. ``carried`` names further columns to keep.
    """
    clock = r"^(\d{2}):(\d{2}):(\d{2}) - (.*)$"
    parsed = lines.where(F.col("value").rlike(clock)).select(
        "file", "line", *carried, *[F.substring("value", i, 2).cast("int").alias(n) for i, n in ((1, "h"), (4, "m"), (7, "s"))],
        X.strip(F.regexp_extract("value", clock, 4)).alias("msg"),
    )
    kind = part = None
    for name, pattern in STAGES:
        # The mark that a pattern begins with tells most lines apart, so a line meets few patterns.
        marks = [m for m in re.match(r"\^(?:\(\?:([^)]*)\)|([^(.\\\\]*))", pattern).groups() if m][0].split("|")
        hit = reduce(Column.__or__, [F.startswith("msg", F.lit(m)) for m in marks]) & F.col("msg").rlike(pattern)
        value = F.regexp_extract("msg", pattern, 1) if "(" in pattern.replace("(?:", "").replace(r"\(", "") else F.lit("")
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        part = F.when(hit, value) if part is None else part.when(hit, value)
    # Behind an explode, a caller's filter on the kind stays where it is; pushed down it would match all patterns once more, with the clock's again for each.
    stage = F.explode(F.array(F.struct(kind.alias("kind"), part.alias("part")))).alias("_stage")
    typed = parsed.select("file", "line", *carried, (F.col("h") * 3600 + F.col("m") * 60 + F.col("s")).alias("seconds"), stage)
    return typed.select("file", "line", *carried, "seconds", "_stage.kind", "_stage.part").select(
        "file", "line", *carried, "seconds", "kind",
        F.when(F.col("kind").isin(*_SUBJECT), F.col("part")).alias("subject"),
        F.when(F.col("kind").isin(*_NUMBER), F.col("part").try_cast("double")).alias("number"),
        F.when(F.col("kind").isin(*_TEXT), F.col("part")).alias("text"),
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): ``line`` grows along each file, over its splits and within them."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"),
    )
    # Splits of a file start at growing offsets; within one the row id grows. Both fit one number: a split holds
    # less than 2^33 rows, and the offset is the high part.
    rows = F.pmod("_i", F.lit(1 << 33))
    return raw.select("file", (F.col("_b").cast("decimal(38,0)") * F.lit(1 << 33) + rows).alias("line"), "value")


def read_dialogue_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_dialogue_log(read_log_lines(spark, path))

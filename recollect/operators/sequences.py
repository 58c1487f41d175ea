"""Operators whose result depends on the order of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions.ordered import BLOCK, PART_BYTES, block_sums, ordered_blocks, text_parts
from recollect.functions.ranking import first_per_key, top_per_key
from recollect.session import cut
from recollect.sources.logs import parse_dialogue_log

# Lower bound and name of each affinity level, from high to low.
LEVELS = [(80.0, "挚友"), (60.0, "亲密"), (40.0, "友好"), (20.0, "熟悉")]
LOWEST_LEVEL = "陌生"
DEFAULT_AFFINITY = 50.0


def affinity_level(c: str | Column) -> Column:
    return X.band(c, LEVELS, LOWEST_LEVEL)


def running_affinity(
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    change: str = "change",
    start: float = DEFAULT_AFFINITY,
    low: float = 0.0,
    high: float = 100.0,
    blocks: int | None = None,
) -> DataFrame:
    """Add old_affinity, new_affinity, old_level, new_level and level_changed, clamping at every step.

    A step maps x to min(high, max(low, x + c)). Steps in a row are again of the form min(h, max(l, x + a)), so a block
    of consecutive rows has a three-number summary. The rows are range-partitioned by key and order; the summaries of
    the first and last key of each block (at most two rows per partition) carry the value over block borders, and
    every block is then replayed on its own, however many rows its key has elsewhere.
    """
    keys, order = list(keys), list(order)
    # Keys are compared as one text: a null in a column of numbers would become NaN in the tasks, which equals nothing.
    steps = changes.withColumns({"_c": F.col(change).cast("double"), "_key": F.to_json(F.struct(*keys))})
    blocked = ordered_blocks(steps, keys, order, blocks)

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = block = None
        a, lo, hi = 0.0, float("-inf"), float("inf")
        for frame in frames:
            block = int(frame[BLOCK].iat[0])
            for key, c in zip(frame["_key"], frame["_c"]):
                if key != last:
                    if last is not None and first is None:
                        first = (last, a, lo, hi)
                    last, a, lo, hi = key, 0.0, float("-inf"), float("inf")
                a, lo, hi = a + c, min(high, max(low, lo + c)), min(high, max(low, hi + c))
        rows = [r for r in (first, (last, a, lo, hi) if last is not None else None) if r is not None]
        if rows:
            yield pd.DataFrame([(k, block, x, y, z) for k, x, y, z in rows], columns=["_key", BLOCK, "a", "lo", "hi"])

    borders = blocked.select("_key", BLOCK, "_c").mapInPandas(
        summarise, f"_key string, {BLOCK} int, a double, lo double, hi double"
    )
    # Bounded by two rows per partition, so the driver may fold them in block order.
    value: dict[str, float] = {}
    entering: dict[int, tuple[str, float]] = {}
    for row in sorted(borders.collect(), key=lambda r: r[BLOCK]):
        key = row["_key"]
        before = value.get(key, start)
        entering.setdefault(row[BLOCK], (key, before))
        value[key] = min(row["hi"], max(row["lo"], before + row["a"]))

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, start
        for frame in frames:
            old, new = [], []
            carried = entering.get(int(frame[BLOCK].iat[0]))
            for key, c in zip(frame["_key"], frame["_c"]):
                if key != last:
                    x = carried[1] if last is None and carried and carried[0] == key else start
                    last = key
                old.append(x)
                x = min(high, max(low, x + c))
                new.append(x)
            yield frame.drop(columns=[BLOCK, "_c", "_key"]).assign(old_affinity=old, new_affinity=new)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema.fields)
    out = blocked.mapInPandas(replay, f"{fields}, old_affinity double, new_affinity double")
    return out.withColumns({
        "old_level": affinity_level("old_affinity"), "new_level": affinity_level("new_affinity"),
        "level_changed": affinity_level("old_affinity") != affinity_level("new_affinity"),
    })


def affinity_snapshot(affinity: DataFrame, subjects: DataFrame, key: str = "npc") -> DataFrame:
    """(key, affinity, level) of every subject; 50 where none is known."""
    joined = subjects.select(key).distinct().join(affinity.select(key, "affinity"), key, "left")
    return joined.withColumn("affinity", F.coalesce("affinity", F.lit(DEFAULT_AFFINITY))).withColumn(
        "level", affinity_level("affinity")
    )


def last_k(messages: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The last k rows per key."""
    return top_per_key(messages, [key], [F.desc(order)], k, None)


def dedup_keep_first(df: DataFrame, key: str, order: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """One row per key, the first in order; blank keys drop; cut to ``max_rows`` in the same order."""
    once = first_per_key(df.where(~X.blank(key)), [key], [F.asc(c) for c in order])
    if max_rows is None:
        return once
    return once.orderBy(*[F.asc(c) for c in order], F.asc(key)).limit(max_rows)


def number_chunks(chunks: DataFrame, doc: str = "doc_id", order: Sequence[str] = ("start_char",)) -> DataFrame:
    """Add a 0-based chunk_index within each document."""
    w = Window.partitionBy(doc).orderBy(*order)
    return chunks.withColumn("chunk_index", F.row_number().over(w) - 1)


def latest_record(records: DataFrame, key: str, order: str, kind_col: str, kind: str, content: str) -> DataFrame:
    """(key, content) of the last record of a kind."""
    return records.where(F.col(kind_col) == kind).groupBy(key).agg(F.max_by(content, order).alias(content))


def trajectory(
    records: DataFrame, key: str, order: str, kind_col: str, content: str, headings: dict[str, str], part_bytes: int = PART_BYTES
) -> DataFrame:
    """(key, part, trajectory): records in order, each under the heading of its kind, in parts that make the whole; see :func:`text_parts`.

    Other kinds leave no text.
    """
    heading = F.create_map(*[F.lit(x) for kv in headings.items() for x in kv])
    shown = records.where(F.col(kind_col).isin(*headings))
    text = F.concat(heading[F.col(kind_col)], F.lit("\n"), F.col(content))
    return text_parts(shown, [key], [order], text, "\n\n", part_bytes, "trajectory")


# ---------------------------------------------------------------- dialogue logs


def dialogue_sessions(log: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per dialogue of (file, line, seconds, kind, subject, number, text) log events.

    A dialogue begins at a start line; a start with its message that is logged twice in a row, with the same subject and message, opens one.
    Clock times may jump back at midnight: a time below the one before raises the day of the rest of the file.
    """
    return _sessions(ordered_blocks(log.where(F.col("kind").isNotNull()), ["file"], ["line"], blocks))


def line_sessions(lines: DataFrame, blocks: int | None = None) -> DataFrame:
    """:func:`dialogue_sessions` of raw log lines (file, line, value): they are sorted as they are and parsed once behind the sort."""
    ordered = ordered_blocks(lines.select("file", "line", "value"), ["file"], ["line"], blocks)
    return _sessions(cut(parse_dialogue_log(ordered, (BLOCK,))).where(F.col("kind").isNotNull()))


def _sessions(ordered: DataFrame) -> DataFrame:
    # The rows around may lie in other blocks of the same file; what is needed of those comes from per-block summaries.
    start_subject = F.when(F.col("kind") == "start", F.col("subject"))
    ends = ordered.groupBy("file", BLOCK).agg(
        F.max_by("seconds", "line").alias("_end_s"), F.max_by("kind", "line").alias("_end_k"), F.max_by("text", "line").alias("_end_t"),
        F.max_by(start_subject, F.when(F.col("kind") == "start", F.col("line"))).alias("_end_name"), F.min_by("text", "line").alias("_first_t"),
    )
    earlier = Window.partitionBy("file").orderBy(BLOCK)
    ends = ends.select(
        "file", BLOCK, F.lag("_end_s").over(earlier).alias("_prev_s"), F.lag("_end_k").over(earlier).alias("_prev_k"),
        F.lag("_end_t").over(earlier).alias("_prev_t"), F.lead("_first_t").over(earlier).alias("_after_t"),
        F.last("_end_name", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev_name"),
    )
    inside = Window.partitionBy("file", BLOCK).orderBy("line")
    seen = ordered.select(
        "*", F.lag("seconds").over(inside).alias("_s"), F.lag("kind").over(inside).alias("_k"), F.lag("text").over(inside).alias("_t"),
        F.lead("text").over(inside).alias("_n"), F.row_number().over(inside).alias("_i"), F.lead("line").over(inside).isNull().alias("_last"),
        F.last(start_subject, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("_name"),
    )
    seen = seen.join(ends, ["file", BLOCK]).withColumns({
        "_s": F.coalesce("_s", "_prev_s"), "_k": F.coalesce("_k", "_prev_k"), "_name": F.coalesce("_name", "_prev_name"),
        "_t": F.when(F.col("_i") == 1, F.col("_prev_t")).otherwise(F.col("_t")), "_n": F.when(F.col("_last"), F.col("_after_t")).otherwise(F.col("_n")),
    })
    # A repeated start block reads start, message, start, message, with the same subject and the same message.
    same = F.col("subject").eqNullSafe(F.col("_name")) & F.col("_n").eqNullSafe(F.col("_t"))
    repeat = (F.col("kind") == "start") & (F.col("_k") == "message") & same
    flagged = seen.select(
        "file", "line", "seconds", "kind", "subject", "number", "text", BLOCK,
        F.when((F.col("kind") == "start") & ~F.coalesce(repeat, F.lit(False)), 1).otherwise(0).alias("_new"),
        F.when(F.col("seconds") < F.col("_s"), 1).otherwise(0).alias("_day"),
    )
    numbered = block_sums(flagged, ["file"], ["line"], {"dialogue": "_new", "day": "_day"})
    at = F.col("seconds") + 86400 * F.col("day")

    def when(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    per = numbered.where(F.col("dialogue") > 0).groupBy("file", "dialogue").agg(
        F.first(when("start", F.col("subject")), ignorenulls=True).alias("subject"),
        F.max_by(F.col("text"), when("message", F.col("line"))).alias("message"),
        F.max_by(F.col("text"), when("reply", F.col("line"))).alias("reply"),
        F.max(when("affinity", F.col("number"))).alias("affinity"),
        F.max(when("change", F.col("number"))).alias("change"),
        F.max(when("retrieval", F.col("number"))).cast("int").alias("retrieved"),
        F.max(when("sentiment", F.col("text"))).alias("sentiment"),
        F.min(at).alias("_start"), F.min(when("retrieval", at)).alias("_retrieval"),
        F.min(when("generating", at)).alias("_generating"), F.min(when("reply", at)).alias("_reply"),
        F.min(when("analysing", at)).alias("_analysing"), F.max(at).alias("_end"),
        F.min(F.when(F.col("kind").isin("change", "unchanged"), at)).alias("_judged"),
        F.max((F.col("kind") == "end").cast("int")).alias("_done"),
    )
    return per.select(
        "file", F.col("dialogue").cast("int").alias("dialogue"), "subject", "message", "reply", "affinity", "change",
        "retrieved", "sentiment",
        (F.col("_retrieval") - F.col("_start")).alias("retrieval_seconds"),
        (F.col("_reply") - F.col("_generating")).alias("reply_seconds"),
        (F.col("_judged") - F.col("_analysing")).alias("analysis_seconds"),
        (F.col("_end") - F.col("_start")).alias("total_seconds"),
        (F.col("_done") == 1).alias("complete"),
    )

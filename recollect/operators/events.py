"""Tool events and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_notes(tasks: DataFrame, events: DataFrame, seq: str = "seq") -> DataFrame:
    """Add note_id and note_path to tasks from the last event that names both the task and a note.

    The last writer is found by a partial aggregate, so a task with very many events costs one row per input task.
    """
    named = events.where(F.col("task_id").isNotNull() & F.col("note_id").isNotNull())
    last = named.groupBy("task_id").agg(F.max_by("note_id", seq).alias("note_id"))
    joined = tasks.join(last, "task_id", "left")
    # The place of a note file.
    return joined.withColumn("note_path", F.concat(F.lit("notes/note_"), "note_id", F.lit(".md")))

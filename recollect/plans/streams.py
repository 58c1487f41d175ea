"""Registered queries: streaming jobs run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.plans import fixtures as fx
from recollect.plans.lookup import AFFINITY_SQL, _replay_sql
from recollect.plans.registry import Tables, query
from recollect.plans.texts import _log_lines
from recollect.session import work_path
from recollect.sources.versions import read_version
from recollect.streaming import jobs as J


class _Streamed(Tables):
    """The given tables as streams."""

    def __getattr__(self, name):
        path = f"{self.folder}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def _streamed(t: Tables) -> Tables:
    return _Streamed(t.spark, t.folder)


def _run(t: Tables, frame, name: str, mode: str = "append"):
    """Run a stream over what there is and return its output as a table; an updated key has one row per batch."""
    out, check = work_path(t.spark, name), work_path(t.spark, f"{name}-state")

    def store(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = frame.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(out)


def _arriving(t: Tables, rows, time: str, closing: dict, batches: int = 2, files: int = 4):
    """The rows as a stream of one micro-batch per range of event time, and a last one with a row far behind them, which lets time go on.

    ``closing``: the columns of that row other than its time.
    """
    path = work_path(t.spark, "arriving")
    low, high = rows.agg(F.min(F.unix_micros(F.col(time).cast("timestamp"))), F.max(F.unix_micros(F.col(time).cast("timestamp")))).first()
    at = F.unix_micros(F.col(time).cast("timestamp"))
    place = F.least(F.floor((at - low) * batches / F.lit(high - low + 1)), F.lit(batches - 1))
    for k in range(batches):
        rows.where(place == k).repartition(files).write.mode("append").parquet(path)
    last = t.spark.range(1).select(*[F.lit(closing[c]).cast(rows.schema[c].dataType).alias(c) if c != time else F.timestamp_micros(F.lit(high + 400 * 86_400_000_000)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    last.write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("st1_drain_events", f"WITH {fx.TOOL_EVENTS} SELECT seq, tool, CAST(task_id AS INTEGER) AS task_id, note_id FROM tool_events")
def st1(t):
    out, check = work_path(t.spark, "drain"), work_path(t.spark, "drain-state")
    J.drain_events(fx.tool_events(_streamed(t)), out, check).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/events").select("seq", "tool", "task_id", "note_id")


@query("st1_task_notes", f"""WITH {fx.TOOL_EVENTS}, tasks AS (SELECT DISTINCT CAST(user_id AS INTEGER) AS task_id FROM events),
last AS (SELECT CAST(task_id AS INTEGER) AS task_id, arg_max(note_id, seq) AS note_id FROM tool_events WHERE task_id IS NOT NULL AND note_id IS NOT NULL GROUP BY 1)
SELECT task_id, note_id, 'notes/note_' || note_id || '.md' AS note_path FROM tasks LEFT JOIN last USING (task_id)""")
def st1_notes(t):
    """The notes of all tasks after two batches, merged into a stored table."""
    out, check = work_path(t.spark, "drain"), work_path(t.spark, "drain-state")
    events = fx.tool_events(t)
    path = work_path(t.spark, "tool-events")
    for odd in (True, False):
        events.where((F.col("seq") % 2 == 1) == odd).write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(events.schema).parquet(path)
        J.drain_events(stream, out, check).trigger(availableNow=True).start().awaitTermination()
    return J.task_notes(t.events.select(F.col("user_id").cast("int").alias("task_id")).distinct(), out)


@query("st2_latest_task_status", "SELECT user_id AS task_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def st2(t):
    events = _streamed(t).events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    updates = _run(t, J.latest_task_status(events), "status", "update")
    return updates.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


@query("st3_working_memory", _replay_sql(5, "h.c >= n.created_at - INTERVAL 2880 MINUTE"))
def st3(t):
    J.use_state_store(t.spark)
    events = t.events.select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), (F.least("value", F.lit(100.0)) / 100).alias("importance"), F.col("ts").cast("timestamp").alias("created_at"))
    stream = _arriving(t, events, "created_at", {"owner": -1, "seq": -1, "importance": 0.0})
    held = _run(t, J.working_memory_stream(stream, "owner", 5, 2880, tick="7 days"), "memory", "update")
    newest = held.groupBy("owner").agg(F.max("newest").alias("newest"))
    return held.join(newest, ["owner", "newest"], "left_semi").select("owner", "seq", F.round("importance", 6).alias("importance"))


@query("st4_affinity", AFFINITY_SQL)
def st4(t):
    J.use_state_store(t.spark)
    stream = _arriving(t, fx.affinity_changes(t), "ts", {"npc": "", "player": -1, "event_id": -1, "change": 0.0})
    return _run(t, J.affinity_stream(stream, ["npc", "player"], ["ts", "event_id"], "ts", tick="7 days"), "affinity").drop("ts", "batch")


@query("st5_dialogue_log", """WITH talks AS (SELECT event_id, 'n' || user_id AS u FROM events)
SELECT u AS subject, 'hello ' || event_id AS message, 'fine: ' || event_id AS reply, CASE WHEN event_id % 3 <> 0 THEN 2.0 END AS change, 6 AS total_seconds, true AS complete FROM talks""")
def st5(t):
    """First every log file up to a place amid a dialogue, then what lies behind it."""
    path, out, check = (work_path(t.spark, n) for n in ("log", "sessions", "sessions-state"))
    # A file for so many dialogues; the 100 places of a dialogue's lines stay in one.
    files = max(4, t.events.count() // 40_000)
    dialogue = (F.col("line") - F.pmod("line", F.lit(100))).alias("dialogue")
    _log_lines(t).select("*", dialogue).repartitionByRange(files, "file", "dialogue").sortWithinPartitions("file", "line").select("value").write.text(path)
    for part in ({"until": 20_000}, {}):
        J.dialogue_log_stream(t.spark, path, out, check, **part).trigger(availableNow=True).start().awaitTermination()
    return J.latest_sessions(t.spark, out).select("subject", "message", "reply", "change", "total_seconds", "complete")


@query("st6_snapshot", """WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq, arg_max(ts, event_id) AS ts FROM events GROUP BY user_id)
SELECT user_id, status, seq, date_diff('microsecond', ts, (SELECT max(ts) FROM last)) // 1000000 AS age_seconds FROM last""")
def st6(t):
    out, check = work_path(t.spark, "snapshot"), work_path(t.spark, "snapshot-state")
    events = _streamed(t).events.select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    J.snapshot_stream(events, "user_id", "seq", "status", "ts", out, check, once=True).start().awaitTermination()
    return read_version(t.spark, out).select("user_id", "status", "seq", "age_seconds")


@query("st7_assemble_chunks", """WITH placed AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(text) AS begun FROM conversations WHERE text IS NOT NULL)
SELECT conv_id AS task_id, CAST(begun // 300 AS INTEGER) AS part, string_agg(text, '' ORDER BY turn) AS text FROM placed GROUP BY ALL""")
def st7(t):
    """The later half of every dialogue first, then the rest."""
    path, out, check = (work_path(t.spark, n) for n in ("pieces", "chunks", "chunks-state"))
    pieces = t.conversations.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    for late in (True, False):
        pieces.where((F.col("seq") > 4) == late).write.mode("append").parquet(path)
        J.collect_chunks(t.spark.readStream.schema(pieces.schema).parquet(path), out, check).trigger(availableNow=True).start().awaitTermination()
    return J.assembled_chunks(t.spark, out, 300)

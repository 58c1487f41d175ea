"""Streaming forms of the event, memory and log jobs. Each has a batch form with the same result.

The stateful jobs need the RocksDB state store, see :func:`use_state_store`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recollect.functions.ordered import PART_BYTES, text_parts
from recollect.functions.replay import Held, insert
from recollect.operators.events import attach_notes
from recollect.operators.sequences import affinity_level, dialogue_sessions
from recollect.operators.text_rows import infer_event_keys
from recollect.sources.growing import growing_lines
from recollect.sources.logs import parse_dialogue_log
from recollect.sources.versions import commit, current_version, last_batch, merge_notes, read_version, vacuum


def use_state_store(spark: SparkSession) -> None:
    """Select the state store that keyed state needs, unless the session already names one of the kind."""
    key = "spark.sql.streaming.stateStore.providerClass"
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, provider)


# ---------------------------------------------------------------- events and tasks


def drain_events(stream: DataFrame, sink: str, checkpoint: str):
    """Writer that delivers every event once, with its task and note, and keeps the latest note of every task.

    A batch goes to a folder named by its number, so a batch that runs again replaces itself: ``sink/events/batch=n``. The notes are merged into the stored
    table ``sink/tasks``, which remembers the batch that it has reached; see :func:`task_notes`.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        keyed = infer_event_keys(batch).persist()
        keyed.orderBy("seq").write.mode("overwrite").parquet(f"{sink}/events/batch={number}")
        named = keyed.where(F.col("task_id").isNotNull() & F.col("note_id").isNotNull())
        merge_notes(batch.sparkSession, f"{sink}/tasks", named, number)
        vacuum(batch.sparkSession, f"{sink}/tasks", 2)
        keyed.unpersist()

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


def task_notes(tasks: DataFrame, sink: str) -> DataFrame:
    """The tasks (task_id, ...) with note_id and note_path as :func:`drain_events` knows them by now."""
    return attach_notes(tasks, read_version(tasks.sparkSession, f"{sink}/tasks"))


def latest_task_status(stream: DataFrame) -> DataFrame:
    """(task_id, status, seq): the status event with the highest number per task."""
    return stream.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def collect_chunks(stream: DataFrame, sink: str, checkpoint: str):
    """Writer that stores text pieces (task_id, seq, content) as they come, each batch in a folder that a second run replaces; nothing stays in the state.

    :func:`assembled_chunks` puts together what has arrived.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.select("task_id", "seq", "content").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def assembled_chunks(spark: SparkSession, sink: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(task_id, part, text): the pieces of each task by number, in parts that make the whole text; see :func:`text_parts`."""
    return text_parts(spark.read.parquet(sink), ["task_id"], ["seq"], F.col("content"), "", part_bytes)


# ---------------------------------------------------------------- keyed state in event time


def late_rows(query) -> int:
    """Rows that a query's keyed state has left out because they came behind the watermark, as its progress reports tell."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)


class _Ticks(StatefulProcessor):
    """Rows of a key wait in the state, one map entry per tick of event time, until the watermark has passed the tick.

    Then a timer applies the tick's rows in order. So the outcome does not depend on how rows fall into batches, and a key's memory need
    is one tick of its rows, whatever a batch holds. Rows behind the watermark never get here: Spark drops and counts them.
    """

    def __init__(self, columns: list[str], time: str, order: list[str], tick: int):
        self.columns, self.time, self.order, self.tick = columns, time, order, tick  # tick: milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "tick long", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:  # a key's rows come in several frames
            ticks = frame[self.time].to_numpy("datetime64[ms]").astype("int64") // self.tick
            for tick, part in frame[self.columns].groupby(ticks):
                held = self._rows(int(tick))
                if not held:
                    self.handle.registerTimer((int(tick) + 1) * self.tick)
                self.waiting.updateValue((int(tick),), (pickle.dumps(held + list(part.itertuples(index=False, name=None))),))
        return iter(())

    def _rows(self, tick: int) -> list[tuple]:
        held = self.waiting.getValue((tick,))  # one question to the store
        return pickle.loads(held[0]) if held else []

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        rows = self._rows(end // self.tick - 1)
        if rows:
            self.waiting.removeKey((end // self.tick - 1,))
            frame = pd.DataFrame(rows, columns=self.columns).sort_values(self.order, kind="stable", ignore_index=True)
            yield self.apply(key, frame)
        self.idle(end)

    def apply(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def idle(self, end: int) -> None:
        """Called when all rows before ``end`` have been applied."""

    def close(self) -> None:
        pass


def _millis(interval: str) -> int:
    """Milliseconds of an interval such as ``1 hour``."""
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _micros(ts: pd.Series) -> list[int]:
    return ts.to_numpy("datetime64[us]").astype("int64").tolist()


class _WorkingMemory(_Ticks):
    def __init__(self, owner: str, capacity: int, ttl: int, tick: int):
        super().__init__(["seq", "importance", "created_at"], "created_at", ["created_at", "seq"], tick)
        self.owner, self.capacity, self.ttl = owner, capacity, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "rows binary")

    def apply(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        known = self.held.get()
        held = [Held(*h) for h in pickle.loads(known[0])] if known else []
        for importance, at, seq in zip(frame["importance"], _micros(frame["created_at"]), frame["seq"].tolist()):
            held = insert(held, Held(float(importance), at, (seq,)), self.capacity, self.ttl)
        self.held.update((pickle.dumps([tuple(h) for h in held]),))
        # When the newest row has outlived its time, the next insert would drop all: the owner can leave the state then.
        gone = (max(h.at for h in held) + self.ttl) // 1000 + 1
        self.handle.registerTimer(-(-gone // self.tick) * self.tick)
        return pd.DataFrame({
            self.owner: [key[0]] * len(held), "seq": [h.seq[0] for h in held], "importance": [h.importance for h in held],
            "created_at": pd.to_datetime([h.at for h in held], unit="us"),
            "newest": [held[-1].seq[0]] * len(held),
        })

    def idle(self, end: int) -> None:
        known = self.held.get()
        if known and max(h[1] for h in pickle.loads(known[0])) + self.ttl < end * 1000:
            self.held.clear()


def working_memory_stream(stream: DataFrame, owner: str, capacity: int = 50, ttl_minutes: int = 60, delay: str = "10 minutes", tick: str = "1 hour") -> DataFrame:
    """(owner, seq, importance, created_at, newest): the rows an owner holds each time a tick of event time is complete.

    ``stream``: (owner, seq, importance, created_at). Rows may come in any order that is no more than ``delay`` behind the newest time seen; later ones are left out and
    counted (:func:`late_rows`). ``newest`` is the row last inserted, so of several states of an owner the one with the latest is current. State: at most ``capacity`` rows per owner, the rows that the
    watermark has not passed, and nothing for an owner whose rows have all expired. A stream shows the rows of its last ``delay`` and tick only when time goes on.
    """
    types = {c: stream.schema[c].dataType.simpleString() for c in (owner, "seq")}
    schema = f"{owner} {types[owner]}, seq {types['seq']}, importance double, created_at timestamp_ntz, newest {types['seq']}"
    slim = stream.select(owner, "seq", F.col("importance").cast("double").alias("importance"), F.col("created_at").cast("timestamp").alias("created_at"))
    return slim.withWatermark("created_at", delay).groupBy(owner).transformWithStateInPandas(
        statefulProcessor=_WorkingMemory(owner, capacity, ttl_minutes * 60_000_000, _millis(tick)), outputStructType=schema, outputMode="Update", timeMode="EventTime",
    )


class _Affinity(_Ticks):
    """One call and one value of state serve all keys of a group, since a question to the store takes longer than a key's rows.

    The rows of a tick wait in parts, one for each frame they came in, so that a batch adds to what waits and never writes it again.
    """

    def __init__(self, keys: list[str], columns: list[str], time: str, order: list[str], change: str, start: float, tick: int):
        super().__init__(columns, time, order, tick)
        self.keys, self.change, self.start = keys, change, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "tick long, part int", "rows binary")
        self.parts = handle.getMapState("parts", "tick long", "n int")
        self.values = handle.getValueState("affinity", "x binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known: dict[int, int] = {}  # parts of the ticks met
        for frame in rows:
            ticks = frame[self.time].to_numpy("datetime64[ms]").astype("int64") // self.tick
            for tick, part in frame[self.columns].groupby(ticks):
                tick = int(tick)
                if tick not in known:
                    known[tick] = self._parts(tick)
                    if not known[tick]:
                        self.handle.registerTimer((tick + 1) * self.tick)
                self.waiting.updateValue((tick, known[tick]), (pickle.dumps(part.reset_index(drop=True)),))
                known[tick] += 1
        for tick, n in known.items():
            self.parts.updateValue((tick,), (n,))
        return iter(())

    def _parts(self, tick: int) -> int:
        held = self.parts.getValue((tick,))
        return held[0] if held else 0

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick = expiredTimerInfo.getExpiryTimeInMs() // self.tick - 1
        frames = []
        for part in range(self._parts(tick)):
            frames.append(pickle.loads(self.waiting.getValue((tick, part))[0]))
            self.waiting.removeKey((tick, part))
        if frames:
            self.parts.removeKey((tick,))
            yield self.apply(key, pd.concat(frames, ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True))

    def apply(self, key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        known = self.values.get()
        values = pickle.loads(known[0]) if known else {}
        old, new = [], []
        for name, c in zip(zip(*[frame[k].tolist() for k in self.keys], strict=True), frame[self.change].tolist()):
            x = values.get(name, self.start)
            old.append(x)
            x = min(100.0, max(0.0, x + c))
            new.append(x)
            values[name] = x
        self.values.update((pickle.dumps(values),))
        return frame.assign(old_affinity=old, new_affinity=new)


GROUPS = 1024  # of keys
_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def affinity_stream(
    stream: DataFrame, keys: list[str], order: list[str], time: str, start: float = 50.0, delay: str = "10 minutes", tick: str = "1 hour", groups: int = GROUPS
) -> DataFrame:
    """Running affinity per key over a stream of changes, in ``order`` within each tick of event time; one value of state per key besides the rows that wait.

    ``time`` is the event time, which ``order`` must not contradict. Rows more than ``delay`` behind the newest time seen are left out and counted (:func:`late_rows`).
    The keys are dealt to ``groups`` by their hash; a group has its rows of a tick and the values of its keys in memory, one group at a time. A stream that goes on keeps its ``groups``.
    """
    rest = list(dict.fromkeys([*order, time]))
    slim = stream.select(*keys, *[c for c in rest if c != time], F.col(time).cast("timestamp").alias(time), F.col("change").cast("double").alias("change"))
    names = {c: f"c{i}" for i, c in enumerate(slim.columns)}  # Spark's rows for Python rename what is no identifier
    types = {c: slim.schema[c].dataType.simpleString() for c in names}
    # pandas has no null among whole numbers and would round them all: they travel as a number and a mark.
    marks = {c: f"no_{names[c]}" for c in names if types[c] in _WHOLE}
    sent = slim.withWatermark(time, delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("key_group"), *[F.col(c).isNull().alias(m) for c, m in marks.items()],
        *[(F.coalesce(c, F.lit(0).cast(types[c])) if c in marks else F.col(c)).alias(n) for c, n in names.items()],
    )

    def sent_as(columns: list[str]) -> list[str]:
        return [x for c in columns for x in ([marks[c], names[c]] if c in marks else [names[c]])]

    fields = ", ".join([*[f"{m} boolean" for m in marks.values()], *[f"{n} {types[c]}" for c, n in names.items()]])
    processor = _Affinity(sent_as(keys), [*marks.values(), *names.values()], names[time], sent_as(order), names["change"], start, _millis(tick))
    out = sent.groupBy("key_group").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{fields}, old_affinity double, new_affinity double", outputMode="Append", timeMode="EventTime")
    out = out.select(*[(F.when(~F.col(marks[c]), F.col(n)) if c in marks else F.col(n)).alias(c) for c, n in names.items()], "old_affinity", "new_affinity")
    old, new = affinity_level("old_affinity"), affinity_level("new_affinity")
    return out.withColumns({"old_level": old, "new_level": new, "level_changed": old != new})


# ---------------------------------------------------------------- logs and snapshots


def dialogue_log_stream(spark: SparkSession, path: str, sink: str, checkpoint: str, **options: object):
    """Writer that parses what is appended to the log files of a folder and rebuilds the sessions of the files it touched.

    The events of batch n lie in ``sink/events/batch=n``. A dialogue may go on in a later batch, so the sessions of the files that a batch touches are made from all their
    events; they lie in ``sink/sessions/batch=n``, and for each file those of its last batch count: :func:`latest_sessions`. A batch that runs again
    replaces itself. ``options``: those of :mod:`recollect.sources.growing`.
    """

    def store(batch: DataFrame, number: int) -> None:
        events = f"{sink}/events"
        # A task reads pieces of files in their order, so what it writes is sorted; range borders would need a sample, for which every line is read and parsed once more.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        parse_dialogue_log(batch).where(F.col("kind").isNotNull()).coalesce(tasks).write.mode("overwrite").parquet(f"{events}/batch={number}")
        # The names are those of one batch's files; as a filter they reach the Parquet scan of the earlier events.
        touched = [r["file"] for r in spark.read.parquet(f"{events}/batch={number}").select("file").distinct().collect()]
        known = spark.read.parquet(events).where(F.col("file").isin(touched) & (F.col("batch") <= number)).drop("batch")
        dialogue_sessions(known).write.mode("overwrite").parquet(f"{sink}/sessions/batch={number}")

    return growing_lines(spark, path, **options).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def latest_sessions(spark: SparkSession, sink: str) -> DataFrame:
    """The sessions of all files that :func:`dialogue_log_stream` has read, each file's as of the last batch that touched it."""
    sessions = spark.read.parquet(f"{sink}/sessions")
    events = spark.read.parquet(f"{sink}/events")
    last = events.groupBy("file").agg(F.max("batch").alias("batch"))
    return sessions.join(last, ["file", "batch"], "left_semi").drop("batch")


def snapshot_stream(stream: DataFrame, key: str, seq: str, value: str, ts: str, sink: str, checkpoint: str, every: str = "30 seconds", once: bool = False):
    """Writer that replaces a snapshot of the latest value per key, with its age, at every trigger.

    The latest values of a batch are merged with the snapshot before it, and the result becomes the next version of the stored table ``sink``
    (:func:`recollect.sources.versions.read_version`). Two versions are kept, so none is read and removed at once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if number <= last_batch(spark, sink):
            return
        latest = batch.select(key, value, seq, ts)
        read = current_version(spark, sink)
        if read:
            latest = latest.unionByName(read_version(spark, sink, read).select(key, value, seq, ts))
        latest = latest.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq), F.max_by(ts, seq).alias(ts))
        newest = latest.agg(F.max(ts)).scalar()
        commit(latest.withColumn("age_seconds", F.timestamp_diff("SECOND", F.col(ts), newest)), sink, read, number)
        vacuum(spark, sink, 2)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)

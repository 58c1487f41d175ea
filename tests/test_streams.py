"""Streams over several batches against their batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import sequences as Q
from recollect.operators import tables as T
from recollect.sources import versions as V
from recollect.sources.growing import Piece, growing_lines, last_line_end, lines_between
from recollect.streaming import jobs as J

START = dt.datetime(2024, 1, 1)
SCHEMA = "owner string, seq long, importance double, created_at timestamp, change double"


def run(frame, out, check, mode):
    def store(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = frame.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def arrivals(spark, tmp_path, batches):
    """One micro-batch per list of rows."""
    path = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def event(owner, seq, minute, importance=0.5, change=1.0):
    return (owner, seq, importance, START + dt.timedelta(minutes=minute), change)


def current(spark, out):
    held = spark.read.parquet(out)
    newest = held.groupBy("owner").agg(F.max("newest").alias("newest"))
    return sorted(tuple(r) for r in held.join(newest, ["owner", "newest"], "left_semi").select("owner", "seq").collect())


def test_keyed_state_over_batches(spark, tmp_path):
    """Rows out of order within the delay; a hot owner; several ticks and batches; equal to the batch form."""
    J.use_state_store(spark)
    rng = random.Random(5)
    data = [event("hot" if i % 2 else f"o{i % 5}", 10 * i, i, rng.random(), float(rng.randint(-40, 40))) for i in range(600)]
    shuffled = sorted(data, key=lambda r: r[1] + rng.uniform(0, 250))  # up to 25 minutes late
    closing = [event("closing", 10**6, 10**5)]
    stream = arrivals(spark, tmp_path, [shuffled[:200], shuffled[200:450], shuffled[450:], closing])
    df = spark.createDataFrame(data, SCHEMA)

    out = str(tmp_path / "memory")
    query = run(J.working_memory_stream(stream, "owner", 5, 60, delay="30 minutes", tick="20 minutes"), out, str(tmp_path / "c1"), "update")
    assert spark.read.parquet(out).select("batch").distinct().count() >= 3 and J.late_rows(query) == 0
    plain = df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert current(spark, out) == sorted(tuple(r) for r in T.replay_with_ttl(plain, "owner", 5, 60).select("owner", "seq").collect())

    out = str(tmp_path / "affinity")
    run(J.affinity_stream(stream, ["owner"], ["seq"], "created_at", delay="30 minutes", tick="20 minutes"), out, str(tmp_path / "c2"), "append")
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("owner", "seq", "old_affinity", "new_affinity").collect())
    assert got == sorted(tuple(r) for r in Q.running_affinity(df, ["owner"], ["seq"]).select("owner", "seq", "old_affinity", "new_affinity").collect())


def test_a_late_row_is_counted_and_left_out(spark, tmp_path):
    J.use_state_store(spark)
    batches = [[event("a", 1, 0), event("a", 2, 300)], [event("b", 3, 310)], [event("a", 4, 100), event("a", 5, 305)], [event("closing", 6, 10**5)]]
    out = str(tmp_path / "out")
    query = run(J.working_memory_stream(arrivals(spark, tmp_path, batches), "owner", 5, 10**4, delay="10 minutes", tick="10 minutes"), out, str(tmp_path / "c"), "update")
    assert J.late_rows(query) == 1
    assert current(spark, out) == [("a", 1), ("a", 2), ("a", 5), ("b", 3)]


def test_idle_owners_leave_the_state(spark, tmp_path):
    J.use_state_store(spark)
    many = [event(f"o{k}", k, k % 30) for k in range(200)]
    batches = [many, [event("x", 500, 10_000)], [event("x", 501, 20_000)], [event("o7", 502, 20_001)], [event("x", 503, 10**5)]]
    out = str(tmp_path / "out")
    query = run(J.working_memory_stream(arrivals(spark, tmp_path, batches), "owner", 5, 60, delay="10 minutes", tick="10 minutes"), out, str(tmp_path / "c"), "update")
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(sizes) >= 200 and sizes[-1] <= 12
    # An owner that comes back starts anew, as the batch form drops what has expired.
    assert [r for r in current(spark, out) if r[0] == "o7"] == [("o7", 502)]


def test_affinity_of_many_keys_in_few_groups(spark, tmp_path):
    """Null keys and numbers that doubles cannot tell apart; a tick that three batches fill; the state has entries per group, not per key."""
    J.use_state_store(spark)
    schema = "owner string, player long, seq long, created_at timestamp, change double"
    rng = random.Random(7)
    data = [
        (rng.choice(["a", "b", None]), rng.choice([None, 2**53 + 1, 2**53, *range(200)]), 2**53 + i, START + dt.timedelta(minutes=i // 30), float(rng.randint(-40, 40)))
        for i in range(1500)
    ]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    closing = [("closing", -1, -1, START + dt.timedelta(days=9), 0.0)]
    for batch in [data[::3], data[1::3], data[2::3], closing]:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = run(J.affinity_stream(stream, ["owner", "player"], ["created_at", "seq"], "created_at", delay="60 minutes", tick="20 minutes", groups=4), out, str(tmp_path / "c"), "append")
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) < 100
    values, want = {}, []
    for owner, player, seq, _, change in data:
        old = values.get((owner, player), 50.0)
        values[owner, player] = new = min(100.0, max(0.0, old + change))
        want.append((owner, player, seq, change, old, new))
    got = spark.read.parquet(out).select("owner", "player", "seq", "change", "old_affinity", "new_affinity")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_snapshots_replace_each_other(spark, tmp_path):
    schema = "k int, seq int, v string, ts timestamp_ntz"
    path, out, check = (str(tmp_path / n) for n in ("in", "out", "c"))
    for k, data in enumerate([[(1, 1, "a", START), (2, 2, "b", START + dt.timedelta(seconds=5))], [(1, 3, "c", START + dt.timedelta(minutes=1))], [(3, 4, "d", START)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
        J.snapshot_stream(spark.readStream.schema(schema).parquet(path), "k", "seq", "v", "ts", out, check, once=True).start().awaitTermination()
        assert V.current_version(spark, out) == k + 1
    assert [(r.k, r.v, r.age_seconds) for r in V.read_version(spark, out).orderBy("k").collect()] == [(1, "c", 0), (2, "b", 55), (3, "d", 60)]
    assert len(list((tmp_path / "out" / "data").iterdir())) == 2  # two versions are kept


def test_notes_of_tasks_are_merged(spark, tmp_path):
    path = str(tmp_path / "notes")
    notes = lambda rows: spark.createDataFrame(rows, "task_id int, note_id string, seq long")
    for batch, rows in enumerate([[(1, "a", 1), (2, "b", 2)], [(1, "c", 5), (3, "d", 3)], [(1, "old", 4)]]):
        for _ in range(2):  # a batch that runs again
            V.merge_notes(spark, path, notes(rows), batch)
    assert V.current_version(spark, path) == 3
    got = J.attach_notes(spark.createDataFrame([(1,), (3,), (9,)], "task_id int"), V.read_version(spark, path))
    assert sorted((r.task_id, r.note_id) for r in got.collect()) == [(1, "c"), (3, "d"), (9, None)]


# ---------------------------------------------------------------- stored tables


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda data: spark.createDataFrame(data, "id int, x string, v int")
    V.upsert_table(spark, path, rows([(1, "a", 1), (2, "b", 1)]), "id", "v")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(V, "put_manifest", crash)
        for act in (lambda: V.upsert_table(spark, path, rows([(1, "z", 1)]), "id", "v"), lambda: V.clear_table(spark, path)):
            with pytest.raises(RuntimeError, match="lost"):
                act()
    assert sorted(tuple(r) for r in V.read_version(spark, path).collect()) == [(1, "a"), (2, "b")] and V.current_version(spark, path) == 1
    V.upsert_table(spark, path, rows([(2, "c", 1), (2, "d", 2), (3, "e", 1)]), "id", "v")
    assert sorted(tuple(r) for r in V.read_version(spark, path).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(tuple(r) for r in V.read_version(spark, path, 1).collect()) == [(1, "a"), (2, "b")]  # the version before is still there
    V.vacuum(spark, path)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1
    assert V.clear_table(spark, path) == 3 and V.read_version(spark, path).count() == 0


def test_one_of_two_writers_gets_a_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1,)], "id int")
    assert V.commit(one, path, 0) == 1
    with pytest.raises(V.Conflict):
        V.commit(one, path, 0)
    # A change that meets another writer's commit is made again from the new version.
    calls = []

    def make(old):
        if not calls:
            V.commit(old.union(spark.createDataFrame([(7,)], "id int")), path, 1)
        calls.append(1)
        return old.union(spark.createDataFrame([(8,)], "id int"))

    assert V.change(spark, path, make) == 3 and len(calls) == 2
    assert sorted(r.id for r in V.read_version(spark, path).collect()) == [1, 7, 8]


# ---------------------------------------------------------------- growing files


def test_appended_lines_arrive_once(spark, tmp_path):
    folder, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()

    def trigger():
        run(growing_lines(spark, str(folder), pieceBytes=64), out, check, "append")

    want, open_end = {"a.log": [], "b.log": ["one", "two", ""]}, ""
    for k in range(4):
        lines = [f"line {k} {i} äö" * (i % 4) for i in range(20)]
        want["a.log"] += [open_end + lines[0], *lines[1:]]
        open_end = "not yet " if k % 2 else ""  # ends in the next round
        with open(folder / "a.log", "ab") as f:
            f.write(("".join(f"{x}\n" for x in lines) + open_end).encode())
        if k == 2:
            (folder / "b.log").write_bytes(b"one\r\ntwo\n\nunfinished")
        trigger()
    got = spark.read.parquet(out).orderBy("file", "line").collect()
    for name, lines in want.items():
        assert [r.value for r in got if r.file.endswith(name)] == lines
    assert len({(r.file, r.line) for r in got}) == len(got)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_pieces_share_the_lines(tmp_path, size):
    text = b"\n\nab\nlonger line here\n" + b"x" * 30 + b"\nend\n"
    path = tmp_path / "f"
    path.write_bytes(text + b"tail")
    with open(path, "rb") as f:
        end = last_line_end(f, 0, len(text) + 4)
        assert end == len(text) and last_line_end(f, end, len(text) + 4) == end
        for begin in (0, 2, 5):
            got = [x for at in range(begin, end, size) for x in lines_between(f, Piece("f", at, min(at + size, end), begin, end))]
            assert [v for _, v in got] == text[begin:end].decode().split("\n")[:-1]


def test_sessions_over_a_border_are_rebuilt(spark, tmp_path):
    folder, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()
    first = ["08:00:00 - 💬 对话开始: A <-> 玩家", "08:00:00 - 📝 玩家消息: hi", "08:00:02 - 💬 A回复: yo"]
    rest = ["08:00:04 - 📈 好感度变化: 50.0 -> 52.0 (+2.0)", "08:00:06 - ✅ 对话完成", "08:01:00 - 💬 对话开始: B <-> 玩家", "08:01:00 - 📝 玩家消息: hey"]

    def trigger(lines, name):
        with open(folder / name, "a") as f:
            f.write("".join(f"{x}\n" for x in lines))
        J.dialogue_log_stream(spark, str(folder), out, check).trigger(availableNow=True).start().awaitTermination()
        return sorted(((r.subject, r.message, r.reply, r.change, r.total_seconds, r.complete) for r in J.latest_sessions(spark, out).collect()), key=repr)

    assert trigger(first, "a.log") == [("A", "hi", "yo", None, 2, False)]
    assert trigger(first, "b.log") == [("A", "hi", "yo", None, 2, False)] * 2
    assert trigger(rest, "a.log") == [("A", "hi", "yo", 2.0, 6, True), ("A", "hi", "yo", None, 2, False), ("B", "hey", None, None, 0, False)]


def test_a_batch_of_log_lines_is_read_and_parsed_once(spark, tmp_path):
    """Pieces of several files; no sample for range borders reads them again, and the filter on the kind matches no pattern again."""
    from recollect.sources.logs import parse_dialogue_log

    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    for name in ("a.log", "b.log"):
        lines = [x for k in range(40) for x in (f"08:{k:02d}:00 - 💬 对话开始: {name} <-> 玩家", f"08:{k:02d}:00 - 📝 玩家消息: m{k}", "", f"08:{k:02d}:03 - ✅ 对话完成")]
        (folder / name).write_text("".join(f"{x}\n" for x in lines))
    query = J.dialogue_log_stream(spark, str(folder), out, str(tmp_path / "c"), pieceBytes=500).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == 2 * 40 * 4
    got = sorted((r.subject, r.message, r.total_seconds) for r in J.latest_sessions(spark, out).collect())
    assert got == sorted((name, f"m{k}", 3) for name in ("a.log", "b.log") for k in range(40))

    plan = parse_dialogue_log(spark.createDataFrame([("f", 0, "08:00:00 - x")], "file string, line long, value string")).where(F.col("kind").isNotNull())
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(value") == 1


def test_lines_of_a_growing_file_are_cut_once(monkeypatch):
    """Lines over the borders of pieces and blocks; every block of bytes is searched once, whatever number of lines it holds."""
    import io

    from recollect.sources import growing

    monkeypatch.setattr(growing, "TAIL", 64)
    rng = random.Random(3)
    data = "".join("é" * rng.choice([0, 1, 5, 90]) + rng.choice(["\n", "\r\n"]) for _ in range(300)).encode()
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line.decode().removesuffix("\r")))
        at += len(line) + 1
    for size in (1, 33, 500, len(data)):
        pieces = [Piece("f", a, min(a + size, len(data)), 0, len(data)) for a in range(0, len(data), size)]
        assert [x for p in pieces for x in lines_between(io.BytesIO(data), p)] == want
    reader = growing.GrowingReader({"path": "unused"})
    monkeypatch.setattr(growing, "LINES", 100)

    class Files:
        def open_input_file(self, file):
            return io.BytesIO(data)

    monkeypatch.setattr(growing, "_file_system", lambda path: (Files(), None))
    batches = list(reader.read(Piece("f", 0, len(data), 0, len(data))))
    assert [b.num_rows for b in batches] == [100, 100, 100]
    assert [x for b in batches for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())] == want


def test_a_value_is_asked_for_once():
    import pickle

    class Map:
        def __init__(self):
            self.held, self.asked = {(3,): (pickle.dumps([(1,)]),)}, 0

        def getValue(self, key):
            self.asked += 1
            return self.held.get(key)

        def containsKey(self, key):
            raise AssertionError("asked twice")

    ticks = J._Ticks([], "t", [], 1)
    ticks.waiting = Map()
    assert ticks._rows(3) == [(1,)] and ticks._rows(4) == [] and ticks.waiting.asked == 2

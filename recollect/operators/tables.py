"""Look-ups, filters, statistics and life-cycle changes of the memory, episode, document and note tables."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions.ordered import BLOCK, PART_BYTES, ordered_blocks, row_numbers, text_parts
from recollect.functions.ranking import first_per_key, top_per_key
from recollect.functions.replay import Held, insert
from recollect.session import cut

# ---------------------------------------------------------------- look-ups and filters


def resolve_ids(keys: DataFrame, table: DataFrame, id_col: str = "id", key_col: str = "key") -> DataFrame:
    """(key, id): the exact id, else the smallest id that starts with the key; keys without a match drop.

    Both tests become equi-joins: a key can only match ids that share its whole text as their prefix of that length.
    """
    keys = keys.select(F.col(key_col).cast("string").alias("key")).where(F.col("key") != "").distinct()
    ids = table.select(F.col(id_col).cast("string").alias("id"))
    lengths = keys.agg(F.sort_array(F.collect_set(F.length("key")))).scalar()
    sized = ids.select("id", F.explode(lengths).alias("_n")).where(F.col("_n") <= F.length("id"))
    prefixes = sized.select(F.substring("id", F.lit(1), F.col("_n")).alias("key"), "id")
    # An id equal to the key is the shortest one with that prefix, so it is also the smallest.
    # Short prefixes are shared by very many ids; they are reduced to one before they meet the keys.
    return prefixes.groupBy("key").agg(F.min("id").alias("id")).join(keys, "key", "left_semi")


def list_by_type(items: DataFrame, memory_type: str | None = None) -> DataFrame:
    """Items of one type (or all), newest first."""
    chosen = items if memory_type is None else items.where(F.col("memory_type") == memory_type)
    return chosen.orderBy(F.desc("created_at"), F.asc("id"))


def episodes_by_session(episodes: DataFrame, session_id) -> DataFrame:
    """Episodes of one session, newest first."""
    return episodes.where(F.col("session_id") == session_id).orderBy(F.desc("ts"), F.asc("episode_id"))


def list_sessions(episodes: DataFrame) -> DataFrame:
    return episodes.select("session_id").distinct().orderBy("session_id")


def filter_episodes(
    episodes: DataFrame,
    start: str | None = None,
    end: str | None = None,
    session_id=None,
    user_id: str | None = None,
    event_type: str | None = None,
    min_importance: float | None = None,
) -> DataFrame:
    """Episodes that pass every given test; both time bounds are inclusive.

    Importance, user and event type live in the context map; a missing importance counts as 0.5.
    """

    def context(name: str) -> Column:
        return F.try_element_at("context", F.lit(name))

    tests = []
    if start is not None:
        tests.append(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        tests.append(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if session_id is not None:
        tests.append(F.col("session_id") == session_id)
    if user_id is not None:
        tests.append(context("user_id") == user_id)
    if event_type is not None:
        tests.append(context("event_type") == event_type)
    if min_importance is not None:
        tests.append(F.coalesce(context("importance").try_cast("double"), F.lit(0.5)) >= min_importance)
    out = episodes
    for test in tests:
        out = out.where(test)
    return out


def search_notes(
    notes: DataFrame, query: str | None = None, type: str | None = None, tags: Sequence[str] | None = None
) -> DataFrame:
    """Notes of a type with any of the tags whose title and body hold the query text; newest update first."""
    out = notes
    if type and type.strip():
        out = out.where(F.col("type") == type)
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if query and query.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "title", "body")), F.lit(query.lower())))
    return out.orderBy(F.desc("updated_at"), F.asc("id"))


def list_important(items: DataFrame, types: Sequence[str], min_importance: float, limit: int) -> DataFrame:
    """Per type the newest items of enough importance, then the most important of all."""
    wanted = items.where(F.col("memory_type").isin(*types) & (F.col("importance") >= min_importance))
    newest = top_per_key(wanted, ["memory_type"], [F.desc("created_at"), F.asc("id")], limit, None)
    return newest.orderBy(F.desc("importance"), F.asc("id")).limit(limit)


def rank_by_missing(df: DataFrame, columns: Sequence[str], n: int, key: str) -> DataFrame:
    """Rows with the most missing or blank columns first."""
    missing = sum(F.when(F.col(c).isNull() | (X.strip(F.col(c).cast("string")) == ""), 1).otherwise(0) for c in columns)
    return df.withColumn("missing", missing).orderBy(F.desc("missing"), F.asc(key)).limit(n)


def recent(items: DataFrame, n: int, order: Sequence[Column], owner: str | None = None, col: str = "content", width: int = 60) -> DataFrame:
    """The newest n rows, of each owner or of all, with a short preview."""
    if owner:
        out = top_per_key(items, [owner], order, n)
    else:
        out = items.orderBy(*order).limit(n)
    return out.withColumn("preview", X.preview(col, width, one_line=False))


def filter_dimension(df: DataFrame, col: str, value: str) -> DataFrame:
    """Rows whose column equals the value, ignoring case."""
    return df.where(F.lower(F.col(col)) == value.lower())


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# ---------------------------------------------------------------- statistics


def memory_stats(items: DataFrame, group: str = "memory_type") -> DataFrame:
    """(group, n, share in percent, mean importance)."""
    total = items.agg(F.count("*")).scalar()
    grouped = items.groupBy(group).agg(F.count("*").alias("n"), F.avg("importance").alias("a"))
    return grouped.select(
        group, "n", F.round(F.col("n") * 100.0 / total, 6).alias("share"), F.round("a", 6).alias("avg_importance")
    )


def kb_stats(documents: DataFrame, chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, characters, chunks, chunks per document."""
    chunk_count = chunks.agg(F.count("*")).scalar()
    totals = documents.agg(F.count("*").alias("documents"), F.sum(F.length(text)).alias("characters"))
    counted = totals.select("documents", "characters", chunk_count.alias("chunks"))
    mean = F.when(F.col("documents") > 0, F.col("chunks") / F.col("documents")).otherwise(0.0)
    return counted.withColumn("chunks_per_document", F.round(mean, 6))


def list_documents(documents: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text", newest: str | None = None) -> DataFrame:
    """Documents with chunk count, length and an 80-character preview on one line, newest first."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    shown = documents.select(
        key, *[c for c in ("title",) if c in documents.columns], F.length(text).alias("characters"),
        X.preview(text, 80).alias("preview"), *([newest] if newest and newest != key else []),
    )
    joined = shown.join(counts, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return joined.orderBy(F.desc(newest or key), F.asc(key))


def distinct_types(notes: DataFrame) -> DataFrame:
    return notes.select("type").distinct()


def distinct_tags(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).distinct()


def counts_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def tool_call_counts(events: DataFrame, by: str = "tool", run: str | None = None) -> DataFrame:
    """Calls per tool (and run); the total is a further row with the tool ``*``."""
    keys = [run] if run else []
    per_tool = events.groupBy(*keys, by).agg(F.count("*").alias("calls"))
    total = per_tool.groupBy(*keys).agg(F.sum("calls").alias("calls")).withColumn(by, F.lit("*"))
    return per_tool.unionByName(total)


def session_report(events: DataFrame, session: str, ts: str, kind: str, counted: dict[str, str]) -> DataFrame:
    """Per session: start, duration in seconds, and how often each named kind of event occurred."""
    return events.groupBy(session).agg(
        F.min(ts).alias("started"),
        F.timestamp_diff("SECOND", F.min(ts), F.max(ts)).alias("duration_seconds"),
        *[F.count_if(F.col(kind) == value).alias(name) for name, value in counted.items()],
    )


def source_lists(results: DataFrame, task: str, rank: str = "rank", part_bytes: int = PART_BYTES) -> DataFrame:
    """(task, part, sources): ``* title : url`` lines in rank order, in parts that make the whole list; see :func:`text_parts`."""
    url = F.coalesce("url", F.lit(""))
    line = F.concat(F.lit("* "), F.coalesce("title", F.lit("")), F.when(X.strip(url) != "", F.concat(F.lit(" : "), url)).otherwise(""), F.lit("\n"))
    return text_parts(results, [task], [rank], line, "", part_bytes, "sources")


def report_rows(tasks: DataFrame) -> DataFrame:
    """(task_id, block, status_line) of every task; missing fields get their placeholder.

    One row per task, to be read in task order.
    """
    # The captions and placeholders of a task block.
    fields = [("标题", "title", "N/A"), ("意图", "intent", "N/A"), ("查询", "query", "N/A"), ("状态", "status", "pending"),
              ("总结", "summary", "暂无"), ("来源概要", "sources", "暂无")]
    lines = [F.lit("---"), F.concat(F.lit("任务 ID: "), F.col("task_id").cast("string"))]
    lines += [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(d))) for label, c, d in fields]
    block = F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n"))
    status = F.concat(F.lit("- **"), F.coalesce("title", F.lit("null")), F.lit("**: "), F.coalesce("status", F.lit("pending")))
    return tasks.select("task_id", block.alias("block"), status.alias("status_line")).orderBy("task_id")


# ---------------------------------------------------------------- changes


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str], version: str | None = None) -> DataFrame:
    """Insert or replace by key: the new row wins, and among new rows the highest version."""
    keys = [key] if isinstance(key, str) else list(key)
    latest = first_per_key(new, keys, [F.desc(version)]) if version else new.dropDuplicates(keys)
    return old.join(latest.select(*keys), keys, "left_anti").select(*old.columns).unionByName(latest.select(*old.columns))


def partial_update(items: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Apply (id, content, importance, metadata): null keeps the old value, metadata keys are merged, new ones win."""
    renamed = changes.select(
        "id", F.col("content").alias("_c"), F.col("importance").alias("_i"), F.col("metadata").alias("_m"), F.lit(True).alias("_hit")
    )
    joined = items.join(renamed, "id", "left")
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    new = F.coalesce("_m", F.create_map().cast("map<string,string>"))
    # Old keys that come again are dropped first, so the merge needs no duplicate-key setting.
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    changed = F.coalesce("_hit", F.lit(False))
    return joined.withColumns({
        "content": F.coalesce("_c", "content"),
        "importance": F.when(F.col("_i").isNotNull(), X.clamp("_i", 0.0, 1.0)).otherwise(F.col("importance")),
        "metadata": F.when(changed, merged).otherwise(F.col("metadata")),
        "updated_at": F.when(changed, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at")),
    }).select(*items.columns)


def delete_documents(
    documents: DataFrame, chunks: DataFrame, vectors: DataFrame, ids: DataFrame, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove documents with their chunks and the vectors of those chunks."""
    gone_chunks = chunks.join(ids.select(key), key, "left_semi").select("id")
    return (
        documents.join(ids.select(key), key, "left_anti"),
        chunks.join(ids.select(key), key, "left_anti").select(*chunks.columns),
        vectors.join(gone_chunks, "id", "left_anti").select(*vectors.columns),
    )


def consolidate(items: DataFrame, from_type: str, to_type: str, threshold: float, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Move items of enough importance to another type; returns the items and a one-row count of the moved."""
    moves = (F.col("memory_type") == from_type) & (F.col("importance") >= threshold)
    moved = items.agg(F.count_if(moves).alias("moved"))
    changed = items.withColumns({
        "memory_type": F.when(moves, F.lit(to_type)).otherwise(F.col("memory_type")),
        "updated_at": F.when(moves, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at")),
    })
    return changed, moved


def clear(store: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty tables of the same schema, and the row counts before."""
    counts = None
    for name, frame in store.items():
        row = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return {name: frame.limit(0) for name, frame in store.items()}, counts


def expire(items: DataFrame, as_of: str, max_age_minutes: float) -> DataFrame:
    """Drop rows older than the age at ``as_of``; rows without a time stay."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(int(max_age_minutes)))
    return items.where(F.col("created_at").isNull() | (F.col("created_at") >= cutoff))


def forget(
    items: DataFrame, strategy: str, threshold: float = 0.0, max_age_days: int = 0, as_of: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by importance, by age, or by capacity (keep the most important, then newest, then least id)."""
    if strategy == "importance":
        drop = F.coalesce(F.col("importance") < threshold, F.lit(False))
        return items.where(~drop), items.where(drop)
    if strategy == "age":
        cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(max_age_days))
        drop = F.coalesce(F.col("created_at") < cutoff, F.lit(False))
        return items.where(~drop), items.where(drop)
    if strategy == "capacity":
        if threshold <= 0:
            return items, items.limit(0)
        n = int(threshold)
        # Rows without importance or time come last; the ranks are found without bringing all rows into one task.
        least = items.withColumns({
            "_i": F.coalesce(-F.col("importance"), F.lit(float("inf"))),
            "_c": F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 63) - 1)),
        })
        numbered = cut(row_numbers(least, ["_i", "_c", "id"], "_n"))
        return tuple(numbered.where(test).select(*items.columns) for test in (F.col("_n") <= n, F.col("_n") > n))
    raise ValueError(f"unknown strategy {strategy!r}")


def replay_capacity(inserts: DataFrame, owner: str, capacity: int, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Rows left per owner after inserting in order, where a full memory first drops its least important, oldest row.

    The newcomer is never the one dropped. After n inserts the memory therefore holds the newest row and the best
    ``capacity - 1`` of all rows before it, whatever was dropped on the way: a row that was dropped had capacity - 1
    better rows beside it, and those, or better ones, stay. So the replay is two top-n steps and needs no row loop.
    """
    newest = first_per_key(inserts, [owner], [F.desc(c) for c in order])
    key = [owner, *order]
    rest = inserts.join(newest.select(*key), key, "left_anti").select(*inserts.columns)
    best = top_per_key(rest, [owner], [F.desc("importance"), F.desc("created_at"), *[F.desc(c) for c in order]], capacity - 1, None)
    return best.unionByName(newest.select(*inserts.columns))


def replay_with_ttl(
    inserts: DataFrame, owner: str, capacity: int, ttl_minutes: int, order: Sequence[str] = ("seq",), blocks: int | None = None
) -> DataFrame:
    """As :func:`replay_capacity`, with rows older than the time to live dropped first at every insert.

    A strong row that expires makes room that it took from weaker ones before, so the outcome is no top-n. The inserts
    are sorted over the cluster and every block is replayed with at most ``capacity`` rows of state. A block whose
    first owner goes on from the block before starts from that block's last state. All blocks run at once on the
    states known so far, and only those whose entering state has changed run again; the last states depend little on
    the entering ones, so this settles after a few rounds and ends, at the latest, after as many as the longest owner
    has blocks.
    """
    keys = ["created_at", *order]
    slim = inserts.select(owner, "importance", *keys)
    blocked = ordered_blocks(slim, [owner], keys, blocks)
    ttl = ttl_minutes * 60_000_000
    owner_type = inserts.schema[owner].dataType.simpleString()

    def rows_of(frame: pd.DataFrame):
        at = frame["created_at"].to_numpy("datetime64[us]").astype("int64").tolist()
        seqs = list(zip(*[frame[c].tolist() for c in order]))
        return zip(frame[owner].tolist(), frame["importance"].tolist(), at, seqs)

    def last_states(entering: dict):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = last = block = None
            held: list[Held] = []
            for frame in frames:
                if block is None:
                    block = int(frame[BLOCK].iat[0])
                    first = frame[owner].iat[0]
                    carried = entering.get(block)
                for who, importance, at, seq in rows_of(frame):
                    if who != last:
                        held = list(carried[1]) if last is None and carried and carried[0] == who else []
                        last = who
                    held = insert(held, Held(importance, at, seq), capacity, ttl)
            if block is not None:
                yield pd.DataFrame([(block, first, last, pickle.dumps([tuple(h) for h in held]))], columns=[BLOCK, "first", "last", "held"])

        return run

    schema = f"{BLOCK} int, first {owner_type}, last {owner_type}, held binary"
    known: dict[int, tuple] = {}
    entering: dict[int, tuple] = {}
    todo = blocked
    while True:
        # One row per block, and at most ``capacity`` held rows in it.
        for r in todo.mapInPandas(last_states(dict(entering)), schema).collect():
            known[r[BLOCK]] = (r["first"], r["last"], [Held(*h) for h in pickle.loads(r["held"])])
        changed, previous = [], None
        for block in sorted(known):
            if previous is not None and known[previous][1] == known[block][0]:
                state = (known[block][0], known[previous][2])
                if entering.get(block) != state:
                    entering[block] = state
                    changed.append(block)
            previous = block
        if not changed:
            break
        todo = blocked.where(F.col(BLOCK).isin(changed))

    following = sorted(known)
    goes_on = {b for b, n in zip(following, following[1:]) if known[b][1] == known[n][0]}

    def survivors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = block = None
        held: list[Held] = []
        for frame in frames:
            if block is None:
                block = int(frame[BLOCK].iat[0])
                carried = entering.get(block)
            done = []
            for who, importance, at, seq in rows_of(frame):
                if who != last:
                    if last is not None:
                        done += [(last, *h.seq) for h in held]
                    held = list(carried[1]) if last is None and carried and carried[0] == who else []
                    last = who
                held = insert(held, Held(importance, at, seq), capacity, ttl)
            if done:
                yield pd.DataFrame(done, columns=[owner, *order])
        if last is not None and block not in goes_on:
            yield pd.DataFrame([(last, *h.seq) for h in held], columns=[owner, *order])

    out = ", ".join(f"{c} {inserts.schema[c].dataType.simpleString()}" for c in (owner, *order))
    return inserts.join(blocked.mapInPandas(survivors, out), [owner, *order], "left_semi").select(*inserts.columns)


def turns_to_memories(turns: DataFrame) -> DataFrame:
    """Two working-memory rows per dialogue turn: the player's message and the reply.

    ``turns``: (turn_id, npc, player_id, message, reply, affinity, affinity_change, sentiment, ts).
    """
    def text(c: str) -> Column:
        return F.col(c).cast("string")

    shared = [F.lit("player_id"), text("player_id"), F.lit("timestamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
              F.lit("affinity"), text("affinity"), F.lit("sentiment"), F.coalesce("sentiment", F.lit("neutral")),
              F.lit("interaction_type"), F.lit("dialogue"), F.lit("npc_name"), text("npc")]
    player = F.struct(
        F.concat(text("turn_id"), F.lit(":player")).alias("id"), F.concat(F.lit("玩家说: "), "message").alias("content"),
        F.lit(0.5).alias("importance"),
        F.create_map(F.lit("speaker"), F.lit("player"), F.lit("affinity_change"), text("affinity_change"), *shared).alias("metadata"),
    )
    reply = F.struct(
        F.concat(text("turn_id"), F.lit(":npc")).alias("id"), F.concat(F.lit("我说: "), "reply").alias("content"),
        F.lit(0.6).alias("importance"), F.create_map(F.lit("speaker"), text("npc"), *shared).alias("metadata"),
    )
    return turns.select("ts", F.inline(F.array(player, reply))).select(
        "id", "content", F.lit("working").alias("memory_type"), "importance", "metadata", F.col("ts").alias("created_at")
    )

"""Registered queries: look-ups, statistics, ordered operators and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.operators import sequences as Q
from recollect.operators import tables as T
from recollect.plans import fixtures as fx
from recollect.plans.registry import query
from recollect.session import work_path
from recollect.sources import versions as V

_IMP = "round(importance, 6) AS importance"


def _imp():
    return F.round("importance", 6).alias("importance")


# ---------------------------------------------------------------- filters


@query("f01_resolve_ids", """WITH keys AS (SELECT CAST(doc_id // 10 AS VARCHAR) AS key FROM documents UNION SELECT CAST(doc_id + 500 AS VARCHAR) FROM documents),
ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents)
SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id <> key, id) AS r FROM keys JOIN ids ON starts_with(id, key)) WHERE r = 1""")
def f01(t):
    keys = t.documents.select(F.explode(F.array(F.floor(F.col("doc_id") / 10).cast("string"), (F.col("doc_id") + 500).cast("string"))).alias("key"))
    return T.resolve_ids(keys, t.documents, "doc_id")


@query("f02_list_by_type", f"WITH {fx.MEMORIES} SELECT id, content, {_IMP}, created_at FROM memories WHERE memory_type = 'semantic'")
def f02(t):
    return T.list_by_type(fx.memories(t), "semantic").select("id", "content", _imp(), "created_at")


@query("f03_episodes_by_session", f"WITH {fx.EPISODES} SELECT episode_id, ts, event_type AS content FROM episodes WHERE session_id = 7")
def f03(t):
    return T.episodes_by_session(fx.episodes(t), 7).select("episode_id", "ts", "content")


@query("f03_list_sessions", f"WITH {fx.EPISODES} SELECT DISTINCT session_id FROM episodes")
def f03_sessions(t):
    return T.list_sessions(fx.episodes(t))


@query("f04_filter_episodes", f"""WITH {fx.EPISODES} SELECT episode_id, session_id, ts FROM episodes
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND event_type = 'click' AND coalesce(importance, 0.5) >= 0.2""")
def f04(t):
    chosen = T.filter_episodes(fx.episodes(t), "2024-01-05 00:00:00", "2024-01-20 12:00:00", event_type="click", min_importance=0.2)
    return chosen.select("episode_id", "session_id", "ts")


@query("f05_search_notes", """SELECT doc_id AS id, source AS type, lang FROM documents
WHERE source = 'src1' AND lang IN ('en', 'fr') AND contains(lower('note ' || doc_id || ' ' || text), 'the')""")
def f05(t):
    return T.search_notes(fx.notes(t), "The", "src1", ["en", "fr"]).select("id", "type", F.get("tags", F.lit(0)).alias("lang"))


@query("f07_list_important", f"""WITH {fx.MEMORIES},
newest AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY created_at DESC, id) AS r FROM memories WHERE memory_type IN ('working', 'semantic', 'perceptual') AND importance >= 0.3)
SELECT id, memory_type, {_IMP} FROM newest WHERE r <= 20 ORDER BY newest.importance DESC, id LIMIT 20""")
def f07(t):
    return T.list_important(fx.memories(t), ["working", "semantic", "perceptual"], 0.3, 20).select("id", "memory_type", _imp())


_SPARSE_CUSTOMER = """sparse AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name,
  CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance FROM customer)"""


@query("f08_rank_by_missing", f"""WITH {_SPARSE_CUSTOMER}, m AS (SELECT c_custkey, CAST(name IS NULL AS INT) + CAST(trim(segment) = '' AS INT) + CAST(balance IS NULL AS INT) AS missing FROM sparse)
SELECT * FROM m ORDER BY missing DESC, c_custkey LIMIT 25""")
def f08(t):
    key = F.col("c_custkey")
    sparse = t.customer.select(
        "c_custkey", F.when(key % 3 != 0, F.col("c_name")).alias("name"), F.when(key % 5 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(key % 7 != 0, F.col("c_acctbal")).alias("balance"))
    return T.rank_by_missing(sparse, ["name", "segment", "balance"], 25, "c_custkey").select("c_custkey", "missing")


@query("f09_recent_per_owner", f"""WITH {fx.TURNS}
SELECT owner, id, rank, preview FROM (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY turn DESC) AS rank,
  CASE WHEN length(content) > 60 THEN substring(content, 1, 60) || '...' ELSE content END AS preview FROM turns) WHERE rank <= 3""")
def f09(t):
    return T.recent(fx.turns(t), 3, [F.desc("turn")], "owner").select("owner", "id", "rank", "preview")


@query("f10_filter_dimension", "SELECT event_id, event_type FROM events WHERE lower(event_type) = 'click'")
def f10(t):
    return T.filter_dimension(t.events, "event_type", "CLICK").select("event_id", "event_type")


@query("f10_distinct_values", "SELECT DISTINCT event_type FROM events")
def f10_values(t):
    return T.distinct_values(t.events, "event_type")


# ---------------------------------------------------------------- statistics


@query("a01_memory_stats", f"""WITH {fx.MEMORIES}
SELECT memory_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM memories), 6) AS share, round(avg(importance), 6) AS avg_importance FROM memories GROUP BY memory_type""")
def a01(t):
    return T.memory_stats(fx.memories(t))


@query("a02_kb_stats", """WITH chunks AS (SELECT unnest(string_split(text, chr(10))) AS c FROM documents)
SELECT documents, characters, chunks, round(chunks / documents, 6) AS chunks_per_document FROM
 (SELECT count(*) AS documents, sum(length(text)) AS characters FROM documents), (SELECT count(*) AS chunks FROM chunks)""")
def a02(t):
    return T.kb_stats(t.documents, _lines(t))


def _lines(t):
    """Lines of documents as chunks."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))


@query("a03_list_documents", """WITH chunks AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents)
SELECT doc_id, length(text) AS characters, replace(CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END, chr(10), ' ') AS preview, coalesce(chunks, 0) AS chunks
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS chunks FROM chunks WHERE length(c) > 40 GROUP BY doc_id) USING (doc_id)""")
def a03(t):
    return T.list_documents(t.documents, _lines(t).where(F.length("content") > 40))


@query("a04_distinct_types", "SELECT DISTINCT CASE WHEN source = 'src0' THEN 'blocker' ELSE source END AS type FROM documents")
def a04(t):
    return T.distinct_types(fx.notes(t))


@query("a04_distinct_tags", "SELECT DISTINCT lang AS tag FROM documents")
def a04_tags(t):
    return T.distinct_tags(fx.notes(t))


@query("a09_counts_by", "SELECT CASE label % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'audio' END AS modality, count(*) AS n FROM embeddings GROUP BY ALL")
def a09(t):
    kind = F.when(F.col("label") % 3 == 0, "text").when(F.col("label") % 3 == 1, "image").otherwise("audio")
    return T.counts_by(t.embeddings.select(kind.alias("modality")), "modality")


@query("a17_tool_call_counts", """WITH per AS (SELECT user_id AS run, event_type AS tool, count(*) AS calls FROM events GROUP BY ALL)
SELECT * FROM per UNION ALL SELECT run, '*', sum(calls) FROM per GROUP BY run""")
def a17(t):
    return T.tool_call_counts(t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("tool")), "tool", "run")


@query("a18_session_report", """SELECT user_id AS session, min(ts) AS started, date_diff('microsecond', min(ts), max(ts)) // 1000000 AS duration_seconds,
  count(*) FILTER (event_type = 'view') AS documents_loaded, count(*) FILTER (event_type = 'click') AS questions_asked, count(*) FILTER (event_type = 'purchase') AS notes_created
FROM events GROUP BY user_id""")
def a18(t):
    events = t.events.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    return T.session_report(events, "session", "ts", "event_type", {"documents_loaded": "view", "questions_asked": "click", "notes_created": "purchase"})


_ANCHOR = r'(?s)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
_LINKS = rf"""links AS (SELECT page_id, pos, url, title FROM (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, url, title FROM (
    SELECT page_id, generate_subscripts(us, 1) AS i, unnest(us) AS url, trim(regexp_replace(unnest(ts), '<[^>]+>', '', 'g')) AS title FROM (
      SELECT page_id, regexp_extract_all(html, '{_ANCHOR}', 1) AS us, regexp_extract_all(html, '{_ANCHOR}', 2) AS ts FROM pages)) WHERE title <> ''))"""


def _links(t):
    from recollect.sources.documents import extract_links

    return extract_links(t.pages)


@query("a19_source_lists", f"""WITH {_LINKS}
SELECT task_id, CAST(begun // 200 AS INTEGER) AS part, string_agg(line, '' ORDER BY pos) AS sources FROM (
  SELECT task_id, pos, line, sum(strlen(line)) OVER (PARTITION BY task_id ORDER BY pos) - strlen(line) AS begun FROM (
    SELECT page_id AS task_id, pos, '* ' || title || CASE WHEN trim(url) <> '' THEN ' : ' || url ELSE '' END || chr(10) AS line FROM links)) GROUP BY ALL""")
def a19(t):
    return T.source_lists(_links(t).withColumnRenamed("page_id", "task_id"), "task_id", "pos", 200)


@query("a20_report_rows", """SELECT doc_id AS task_id, '---' || chr(10) || '任务 ID: ' || doc_id || chr(10) || '标题: ' || source || chr(10) || '意图: ' || lang || chr(10) || '查询: ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN text END, 'N/A') || chr(10)
 || '状态: ' || CASE WHEN doc_id % 3 = 0 THEN 'completed' ELSE 'pending' END || chr(10) || '总结: ' || coalesce(CASE WHEN doc_id % 5 = 0 THEN text END, '暂无') || chr(10) || '来源概要: 暂无' || chr(10) AS block,
 '- **' || source || '**: ' || CASE WHEN doc_id % 3 = 0 THEN 'completed' ELSE 'pending' END AS status_line FROM documents""")
def a20(t):
    key = F.col("doc_id")
    tasks = t.documents.select(
        key.alias("task_id"), F.col("source").alias("title"), F.col("lang").alias("intent"), F.when(key % 2 == 0, F.col("text")).alias("query"),
        F.when(key % 3 == 0, "completed").alias("status"), F.when(key % 5 == 0, F.col("text")).alias("summary"), F.lit(None).cast("string").alias("sources"))
    return T.report_rows(tasks)


# ---------------------------------------------------------------- order


@query("w01_expire", f"WITH {fx.MEMORIES} SELECT id FROM memories WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10000 MINUTE")
def w01(t):
    return T.expire(fx.memories(t), "2024-01-15 00:00:00", 10000).select("id")


_INSERTS = "inserts AS (SELECT user_id AS owner, event_id AS seq, least(value, 100) / 100 AS importance, ts AS created_at FROM events)"


def _inserts(t):
    return t.events.select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), (F.least("value", F.lit(100.0)) / 100).alias("importance"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"))


def _replay_sql(capacity: int, alive: str) -> str:
    """The replay, one insert after the other, with the held rows in a list."""
    best = "list_sort(list_filter(m.held, lambda h: {0}))".format(alive)
    return f"""WITH RECURSIVE {_INSERTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at, seq) AS r FROM inserts),
run AS (
  SELECT owner, r, [{{'i': importance, 'c': created_at, 's': seq}}] AS held FROM numbered WHERE r = 1
  UNION ALL SELECT n.owner, n.r, list_append(CASE WHEN len({best}) >= {capacity} THEN {best}[2:] ELSE {best} END, {{'i': n.importance, 'c': n.created_at, 's': n.seq}})
  FROM run m JOIN numbered n ON n.owner = m.owner AND n.r = m.r + 1),
final AS (SELECT owner, unnest(arg_max(held, r)) AS h FROM run GROUP BY owner)
SELECT owner, h.s AS seq, round(h.i, 6) AS importance FROM final"""


@query("w02_replay_capacity", _replay_sql(5, "true"))
def w02(t):
    return T.replay_capacity(_inserts(t), "owner", 5).select("owner", "seq", _imp())


@query("w02_replay_with_ttl", _replay_sql(5, "h.c >= n.created_at - INTERVAL 2880 MINUTE"))
def w02_ttl(t):
    return T.replay_with_ttl(_inserts(t), "owner", 5, 2880).select("owner", "seq", _imp())


@query("w03_forget_by_importance", f"WITH {fx.MEMORIES} SELECT id, CAST(NOT importance < 0.3 AS BOOLEAN) AS kept FROM memories")
def w03_importance(t):
    return _both(T.forget(fx.memories(t), "importance", 0.3))


@query("w03_forget_by_age", f"WITH {fx.MEMORIES} SELECT id, NOT created_at < TIMESTAMP '{fx.AS_OF}' - INTERVAL 14 DAY AS kept FROM memories")
def w03_age(t):
    return _both(T.forget(fx.memories(t), "age", max_age_days=14, as_of=fx.AS_OF))


@query("w03_forget_by_capacity", f"WITH {fx.MEMORIES} SELECT id, row_number() OVER (ORDER BY importance DESC, created_at DESC, id) <= 100 AS kept FROM memories")
def w03_capacity(t):
    return _both(T.forget(fx.memories(t), "capacity", 100))


def _both(parts):
    kept, dropped = parts
    return kept.select("id", F.lit(True).alias("kept")).unionByName(dropped.select("id", F.lit(False).alias("kept")))


@query("w04_last_k", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5")
def w04(t):
    return Q.last_k(t.conversations, "conv_id", "turn", 5).select("conv_id", "turn", "role")


_LEVEL = "CASE WHEN {0} >= 80 THEN '挚友' WHEN {0} >= 60 THEN '亲密' WHEN {0} >= 40 THEN '友好' WHEN {0} >= 20 THEN '熟悉' ELSE '陌生' END"
AFFINITY = f"""{fx.CHANGES},
numbered AS (SELECT *, row_number() OVER (PARTITION BY npc, player ORDER BY ts, event_id) AS r FROM changes),
run AS (SELECT npc, player, event_id, change, r, CAST(50 AS DOUBLE) AS old_affinity, least(100.0, greatest(0.0, 50 + change))::DOUBLE AS new_affinity FROM numbered WHERE r = 1
  UNION ALL SELECT n.npc, n.player, n.event_id, n.change, n.r, m.new_affinity, least(100.0, greatest(0.0, m.new_affinity + n.change))::DOUBLE FROM run m JOIN numbered n ON n.npc = m.npc AND n.player = m.player AND n.r = m.r + 1)"""
AFFINITY_SQL = f"""WITH RECURSIVE {AFFINITY}
SELECT npc, player, event_id, change, old_affinity, new_affinity, {_LEVEL.format('old_affinity')} AS old_level, {_LEVEL.format('new_affinity')} AS new_level,
  {_LEVEL.format('old_affinity')} <> {_LEVEL.format('new_affinity')} AS level_changed FROM run"""


@query("w07_running_affinity", AFFINITY_SQL)
def w07(t):
    return Q.running_affinity(fx.affinity_changes(t), ["npc", "player"], ["ts", "event_id"]).drop("ts")


@query("w08_affinity_snapshot", f"""WITH RECURSIVE {AFFINITY},
last AS (SELECT npc || '/' || player AS pair, arg_max(new_affinity, r) AS affinity FROM run GROUP BY npc, player),
subjects AS (SELECT DISTINCT event_type || '/' || (user_id + d) AS pair FROM events, (VALUES (0), (100000)) AS x(d))
SELECT pair, coalesce(affinity, 50) AS affinity, {_LEVEL.format('coalesce(affinity, 50)')} AS level FROM subjects LEFT JOIN last USING (pair)""")
def w08(t):
    """The latest affinity of every pair; those that never met have the starting value."""
    pair = lambda a, b: F.concat_ws("/", a, b.cast("string")).alias("pair")
    run = Q.running_affinity(fx.affinity_changes(t), ["npc", "player"], ["ts", "event_id"])
    latest = run.groupBy(pair(F.col("npc"), F.col("player"))).agg(F.max_by("new_affinity", F.struct("ts", "event_id")).alias("affinity"))
    players = t.events.select("event_type", F.explode(F.array(F.col("user_id"), F.col("user_id") + 100000)).alias("player"))
    return Q.affinity_snapshot(latest, players.select(pair(F.col("event_type"), F.col("player"))), "pair")


@query("w10_dedup_keep_first", """WITH r AS (SELECT url, page_id, 0 AS strategy FROM pages UNION ALL SELECT url, page_id + 1000000, 1 FROM pages UNION ALL SELECT CASE WHEN page_id % 2 = 0 THEN url || '/b' ELSE '' END, page_id, 2 FROM pages)
SELECT url, page_id, strategy FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY strategy, page_id) AS r FROM r WHERE trim(url) <> '') WHERE r = 1""")
def w10(t):
    p = t.pages
    ranked = (
        p.select("url", "page_id", F.lit(0).alias("strategy"))
        .unionByName(p.select("url", (F.col("page_id") + 1000000).alias("page_id"), F.lit(1).alias("strategy")))
        .unionByName(p.select(F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/b"))).otherwise("").alias("url"), "page_id", F.lit(2).alias("strategy")))
    )
    return Q.dedup_keep_first(ranked, "url", ["strategy", "page_id"])


@query("w11_number_chunks", "SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS chunk_index FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) WHERE length(c) > 40")
def w11(t):
    lines = _lines(t).where(F.length("content") > 40)
    return Q.number_chunks(lines, "doc_id", ["line"]).select("doc_id", "line", "chunk_index")


@query("w12_latest_record", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def w12(t):
    return Q.latest_record(t.conversations, "conv_id", "turn", "role", "assistant", "text")


@query("w13_trajectory", """WITH shown AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '--- attempt ---' ELSE '--- feedback ---' END || chr(10) || text AS x FROM conversations WHERE role IN ('assistant', 'user')),
placed AS (SELECT *, row_number() OVER w AS i, sum(strlen(x) + 2) OVER w - strlen(x) - 2 AS begun FROM shown WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CAST(begun // 500 AS INTEGER) AS part, string_agg(CASE WHEN i > 1 THEN chr(10) || chr(10) ELSE '' END || x, '' ORDER BY i) AS trajectory FROM placed GROUP BY ALL""")
def w13(t):
    return Q.trajectory(t.conversations, "conv_id", "turn", "role", "text", {"assistant": "--- attempt ---", "user": "--- feedback ---"}, 500)


# ---------------------------------------------------------------- changes


@query("m03_upsert", f"""WITH {fx.MEMORIES}, old AS (SELECT * FROM memories WHERE id % 3 <> 0),
new AS (SELECT id, 'changed ' || content AS content, 1 AS v FROM memories WHERE id % 2 = 0 UNION ALL SELECT id, 'final ' || content, 2 FROM memories WHERE id % 4 = 0)
SELECT id, coalesce(n.content, o.content) AS content FROM old o FULL JOIN (SELECT id, arg_max(content, v) AS content FROM new GROUP BY id) n USING (id)""")
def m03(t):
    """Into a stored table: the old rows, then the changes as two versions of it."""
    items = fx.memories(t).select("id", "content")
    first = items.where(F.col("id") % 2 == 0).select("id", F.concat(F.lit("changed "), "content").alias("content"), F.lit(1).alias("v"))
    second = items.where(F.col("id") % 4 == 0).select("id", F.concat(F.lit("final "), "content").alias("content"), F.lit(2).alias("v"))
    path = work_path(t.spark, "memories")
    V.commit(items.where(F.col("id") % 3 != 0), path, 0)
    V.upsert_table(t.spark, path, first.unionByName(second), "id", "v")
    return V.read_version(t.spark, path)


@query("m04_partial_update", f"""WITH {fx.MEMORIES}
SELECT id, CASE WHEN id % 4 = 0 THEN 'new text' ELSE content END AS content, round(CASE WHEN id % 6 = 0 THEN 0.9 ELSE importance END, 6) AS importance,
  CASE WHEN id % 2 = 0 THEN 'update' ELSE content END AS source, CAST(session_id AS VARCHAR) AS user_id, CASE WHEN id % 2 = 0 THEN TIMESTAMP '{fx.AS_OF}' ELSE created_at END AS updated_at FROM memories""")
def m04(t):
    items = fx.stored_memories(t)
    changes = items.where(F.col("id") % 2 == 0).select(
        "id", F.when(F.col("id") % 4 == 0, "new text").alias("content"), F.when(F.col("id") % 6 == 0, 0.9).alias("importance"),
        F.create_map(F.lit("source"), F.lit("update")).alias("metadata"))
    done = T.partial_update(items, changes, fx.AS_OF)
    return done.select("id", "content", _imp(), F.col("metadata")["source"].alias("source"), F.col("metadata")["user_id"].alias("user_id"), "updated_at")


@query("m05_delete_documents", """WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), kept AS (SELECT doc_id FROM documents WHERE lang <> 'fr')
SELECT 'documents' AS part, count(*) AS n FROM kept UNION ALL SELECT 'chunks', count(*) FROM lines SEMI JOIN kept USING (doc_id) UNION ALL SELECT 'vectors', count(*) FROM lines SEMI JOIN kept USING (doc_id)""")
def m05(t):
    chunks = _lines(t).select("doc_id", F.concat_ws(":", "doc_id", "line").alias("id"))
    parts = T.delete_documents(t.documents, chunks, chunks.select("id"), t.documents.where(F.col("lang") == "fr"))
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, p in zip(("documents", "chunks", "vectors"), parts)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("m07_consolidate", f"""WITH {fx.MEMORIES}
SELECT id, CASE WHEN memory_type = 'working' AND importance >= 0.5 THEN 'episodic' ELSE memory_type END AS memory_type, CASE WHEN memory_type = 'working' AND importance >= 0.5 THEN TIMESTAMP '{fx.AS_OF}' ELSE created_at END AS updated_at FROM memories""")
def m07(t):
    return T.consolidate(fx.stored_memories(t), "working", "episodic", 0.5, fx.AS_OF)[0].select("id", "memory_type", "updated_at")


@query("m07_consolidated_count", f"WITH {fx.MEMORIES} SELECT count(*) FILTER (memory_type = 'working' AND importance >= 0.5) AS moved FROM memories")
def m07_count(t):
    return T.consolidate(fx.stored_memories(t), "working", "episodic", 0.5, fx.AS_OF)[1]


@query("m09_clear", "SELECT 'events' AS \"table\", count(*) AS n, 0 AS left_over FROM events UNION ALL SELECT 'documents', count(*), 0 FROM documents")
def m09(t):
    """Stored tables that are cleared, and what is read from them afterwards."""
    out = None
    for name in ("events", "documents"):
        path = work_path(t.spark, name)
        V.commit(getattr(t, name), path, 0)
        before = V.clear_table(t.spark, path)
        row = V.read_version(t.spark, path).agg(F.count("*").alias("left_over")).select(F.lit(name).alias("table"), F.lit(before).cast("long").alias("n"), "left_over")
        out = row if out is None else out.unionByName(row)
    return out


@query("m10_turns_to_memories", f"""WITH {fx.TURNS}, pairs AS (SELECT a.id, a.owner, a.content AS message, b.content AS reply, a.created_at FROM turns a JOIN turns b ON a.owner = b.owner AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT id || ':player' AS id, '玩家说: ' || message AS content, 0.5 AS importance, 'player' AS speaker, CAST(owner AS VARCHAR) AS player_id, created_at FROM pairs
UNION ALL SELECT id || ':npc', '我说: ' || reply, 0.6, 'npc', CAST(owner AS VARCHAR), created_at FROM pairs""")
def m10(t):
    turns = fx.turns(t)
    replies = turns.where(F.col("role") == "assistant").select("owner", (F.col("turn") - 1).alias("turn"), F.col("content").alias("reply"))
    pairs = turns.where(F.col("role") == "user").join(replies, ["owner", "turn"]).select(
        F.col("id").alias("turn_id"), F.lit("npc").alias("npc"), F.col("owner").alias("player_id"), F.col("content").alias("message"), "reply",
        F.lit(50.0).alias("affinity"), F.lit(0.0).alias("affinity_change"), F.lit("neutral").alias("sentiment"), F.col("created_at").alias("ts"))
    made = T.turns_to_memories(pairs)
    return made.select("id", "content", "importance", F.col("metadata")["speaker"].alias("speaker"), F.col("metadata")["player_id"].alias("player_id"), "created_at")


@query("x01_part_of_day", """SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 8 THEN 'early_morning' WHEN hour(ts) BETWEEN 9 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 13 THEN 'noon'
 WHEN hour(ts) BETWEEN 14 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 18 THEN 'evening' ELSE 'night' END AS part FROM events""")
def x01(t):
    return t.events.select("event_id", X.day_part("ts").alias("part"))

"""Tables derived from the given ones, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.graph import Graph
from recollect.operators.text_stats import document_frequency, hashed_vectors, term_frequency
from recollect.plans.registry import Tables
from recollect.session import cut

AS_OF = "2024-02-01 00:00:00"

# ---------------------------------------------------------------- memories from events

MEMORIES = """memories AS (
  SELECT event_id AS id, event_type AS content,
         CASE event_id % 4 WHEN 0 THEN 'working' WHEN 1 THEN 'episodic' WHEN 2 THEN 'semantic' ELSE 'perceptual' END AS memory_type,
         least(value, 100) / 100 AS importance, ts AS created_at, user_id AS session_id
  FROM events)"""


def memories(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 0, "working").when(F.col("event_id") % 4 == 1, "episodic").when(
        F.col("event_id") % 4 == 2, "semantic").otherwise("perceptual")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("content"), kind.alias("memory_type"),
        (F.least("value", F.lit(100.0)) / 100).alias("importance"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.col("user_id").alias("session_id"),
    )


def stored_memories(t: Tables) -> DataFrame:
    """Memories with metadata and an update time."""
    return memories(t).withColumns({
        "metadata": F.create_map(F.lit("user_id"), F.col("session_id").cast("string"), F.lit("source"), F.col("content")),
        "updated_at": F.col("created_at"),
    })


EPISODES = """episodes AS (
  SELECT event_id AS episode_id, ts, user_id AS session_id, event_type,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(value, 100) / 100 END AS importance
  FROM events)"""


def episodes(t: Tables) -> DataFrame:
    context = F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"),
        F.lit("importance"), F.when(F.col("event_id") % 3 != 0, (F.least("value", F.lit(100.0)) / 100).cast("string")),
    )
    return t.events.select(
        F.col("event_id").alias("episode_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("session_id"), F.col("event_type").alias("content"), context.alias("context"),
    )


# ---------------------------------------------------------------- turns of conversations

TURNS = """turns AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS owner, turn, role, text AS content,
         CAST(length(text) % 100 AS DOUBLE) / 100 AS importance,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id % 720 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at
  FROM conversations)"""


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("owner"), "turn", "role",
        F.col("text").alias("content"), ((F.length("text") % 100).cast("double") / 100).alias("importance"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(conv_id % 720), int(turn), 0)").alias("created_at"),
    )


# ---------------------------------------------------------------- queries

CENTROIDS = """centroids AS (
  SELECT query_id, list(v ORDER BY d) AS qv FROM (
    SELECT label AS query_id, d, avg(CAST(embedding[d] AS DOUBLE)) AS v
    FROM embeddings, generate_series(1, len(embedding)) AS g(d) GROUP BY label, d)
  GROUP BY query_id)"""


def label_centroids(t: Tables, *keys) -> DataFrame:
    """Mean vector per label (and further keys): one query per label over the whole vector table."""
    keys = keys or (F.col("label").alias("query_id"),)
    rows = t.embeddings.select(*keys, F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    names = [c for c in rows.columns if c not in ("d", "x")]
    means = rows.groupBy(*names, "d").agg(F.avg("x").alias("x"))
    # One row per dimension and key.
    return means.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("embedding"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def text_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


DIM = 256


def document_vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Hashed vectors of the documents and of the text queries, both on the document frequencies of the corpus."""
    tf = cut(term_frequency(t.documents))
    # The frequencies are a version of the corpus: written once, read by both sides.
    df = cut(document_frequency(tf))
    n = t.documents.agg(F.count("*")).scalar()
    docs = hashed_vectors(tf, df, n, "doc_id", DIM).withColumnRenamed("doc_id", "id")
    queries = hashed_vectors(term_frequency(text_queries(t), "query_id", "text"), df, n, "query_id", DIM)
    return docs, queries


WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def words_sql(col: str) -> str:
    return WORDS.format(col)


def hash_sql(term: str) -> str:
    """Absolute value of the signed 32-bit base-31 hash of an ASCII term."""
    u = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({term}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295)"
    return f"(CASE WHEN {u} < 2147483648 THEN {u} ELSE 4294967296 - {u} END)"


# Hashed vectors of documents (dvec) and text queries (qvec), normalised.
HASHED = f"""
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({words_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
terms AS (SELECT term FROM df UNION SELECT term FROM qtf),
slots AS (SELECT term, s1, (s1 * 31 + length(term)) % {DIM} AS s2 FROM (SELECT term, {hash_sql('term')} % {DIM} AS s1 FROM terms)),
dw AS (SELECT doc_id, term, tf * ln(1 + n / (1 + df)) AS w FROM tf JOIN df USING (term), n),
qw AS (SELECT query_id, term, tf * ln(1 + n / (1 + coalesce(df, 1))) AS w FROM qtf LEFT JOIN df USING (term), n),
draw AS (SELECT doc_id, slot, sum(w) AS w FROM (SELECT doc_id, s1 AS slot, w FROM dw JOIN slots USING (term) UNION ALL SELECT doc_id, s2, w / 2 FROM dw JOIN slots USING (term)) GROUP BY ALL),
qraw AS (SELECT query_id, slot, sum(w) AS w FROM (SELECT query_id, s1 AS slot, w FROM qw JOIN slots USING (term) UNION ALL SELECT query_id, s2, w / 2 FROM qw JOIN slots USING (term)) GROUP BY ALL),
dvec AS (SELECT doc_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM draw),
qvec AS (SELECT query_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qraw),
cos AS (SELECT query_id, doc_id AS id, round(sum(q.w * d.w), 6) AS cos FROM qvec q JOIN dvec d USING (slot) GROUP BY ALL HAVING round(sum(q.w * d.w), 6) > 0)"""


# ---------------------------------------------------------------- the event graph

GRAPH = """
mentions AS (
  SELECT DISTINCT entity_id, memory_id FROM (
    SELECT 'u' || user_id AS entity_id, event_id AS memory_id FROM events
    UNION ALL SELECT 't' || event_type, event_id FROM events
    UNION ALL SELECT 'k' || (props::JSON->>'k'), event_id FROM events WHERE value > 30)),
relations AS (
  SELECT DISTINCT * FROM (
    SELECT 'u' || user_id AS src, 'DID' AS predicate, 't' || event_type AS dst, event_id AS memory_id FROM events
    UNION ALL SELECT 't' || event_type, 'HAS', 'k' || (props::JSON->>'k'), event_id FROM events
    UNION ALL SELECT 'b' || p_brand, 'SELLS', 'tpurchase', -1 - p_partkey FROM part)),
entities AS (
  SELECT DISTINCT * FROM (
    SELECT 'u' || user_id AS entity_id, CAST(user_id AS VARCHAR) AS name, 'user' AS type FROM events
    UNION ALL SELECT 't' || event_type, event_type, 'type' FROM events
    UNION ALL SELECT 'k' || (props::JSON->>'k'), props::JSON->>'k', 'key' FROM events
    UNION ALL SELECT 'b' || p_brand, p_brand, 'brand' FROM part))"""


def event_graph(t: Tables) -> Graph:
    """Users, event types, property keys and brands; every event mentions its user and type, some their key.

    Event types are hot entities: each is mentioned by a large share of all memories. Brands are never mentioned.
    """
    e = t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"), F.concat(F.lit("t"), "event_type").alias("t"),
        F.get_json_object("props", "$.k").alias("key"), "event_id", "value", "user_id", "event_type",
    ).withColumn("k", F.concat(F.lit("k"), "key"))
    mentions = e.select(
        F.explode(F.array_compact(F.array("u", "t", F.when(F.col("value") > 30, F.col("k"))))).alias("entity_id"),
        F.col("event_id").alias("memory_id"),
    ).distinct()
    rel = e.select(F.inline(F.array(
        F.struct(F.col("u").alias("src"), F.lit("DID").alias("predicate"), F.col("t").alias("dst"), F.col("event_id").alias("memory_id")),
        F.struct(F.col("t").alias("src"), F.lit("HAS").alias("predicate"), F.col("k").alias("dst"), F.col("event_id").alias("memory_id")),
    )))
    brands = t.part.select(
        F.concat(F.lit("b"), "p_brand").alias("src"), F.lit("SELLS").alias("predicate"), F.lit("tpurchase").alias("dst"),
        (-1 - F.col("p_partkey")).alias("memory_id"),
    )
    ents = e.select(F.inline(F.array(
        F.struct(F.col("u").alias("entity_id"), F.col("user_id").cast("string").alias("name"), F.lit("user").alias("type")),
        F.struct(F.col("t").alias("entity_id"), F.col("event_type").alias("name"), F.lit("type").alias("type")),
        F.struct(F.col("k").alias("entity_id"), F.col("key").alias("name"), F.lit("key").alias("type")),
    )))
    brand_ents = t.part.select(F.concat(F.lit("b"), "p_brand").alias("entity_id"), F.col("p_brand").alias("name"), F.lit("brand").alias("type"))
    return Graph(ents.unionByName(brand_ents).distinct(), rel.unionByName(brands).distinct(), mentions)


QUERY_ENTITIES = """qe AS (
  SELECT DISTINCT user_id AS query_id, CAST(user_id AS VARCHAR) AS name, 'user' AS type FROM events
  UNION SELECT DISTINCT user_id, 'click', 'type' FROM events
  UNION SELECT DISTINCT user_id, 'unheard of', 'type' FROM events)"""


def query_entities(t: Tables) -> DataFrame:
    """One query per user: the user, a hot event type, and a name the graph does not know."""
    return t.events.select(F.col("user_id").alias("query_id")).distinct().select("query_id", F.inline(F.array(
        F.struct(F.col("query_id").cast("string").alias("name"), F.lit("user").alias("type")),
        F.struct(F.lit("click").alias("name"), F.lit("type").alias("type")),
        F.struct(F.lit("unheard of").alias("name"), F.lit("type").alias("type")),
    )))


# ---------------------------------------------------------------- tool events

TOOL_EVENTS = """tool_events AS (
  SELECT event_id AS seq, event_type AS agent, CASE WHEN event_id % 3 = 0 THEN 'note' ELSE event_type END AS tool,
         user_id AS task_id, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id END AS note_id FROM events)"""


def tool_events(t: Tables) -> DataFrame:
    """Events as tool calls; the task is named in a field, a tag or a title by turns, the note in text or JSON."""
    user = F.col("user_id").cast("string")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.col("user_id").alias("task_id"))))
        .when(F.col("event_id") % 4 == 1, F.to_json(F.struct(user.alias("task_id"))))
        .when(F.col("event_id") % 4 == 2, F.to_json(F.struct(F.array(F.lit("x"), F.concat(F.lit("task_"), user)).alias("tags"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("任务 "), user, F.lit(" 的笔记")).alias("title"))))
    )
    note = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    result = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("saved, ID: "), note, F.lit(" ok"))).otherwise(F.to_json(F.struct(note.alias("note_id"))))
    return t.events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("agent"),
        F.when(F.col("event_id") % 3 == 0, "note").otherwise(F.col("event_type")).alias("tool"),
        raw.alias("raw_parameters"), result.alias("result"), F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


CHANGES = """changes AS (
  SELECT event_type AS npc, user_id AS player, ts, event_id, CAST(CAST(trunc(value) AS INTEGER) % 24 - 15 AS DOUBLE) AS change FROM events)"""


def affinity_changes(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("npc"), F.col("user_id").alias("player"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id",
        (F.col("value").cast("int") % 24 - 15).cast("double").alias("change"),
    )


def notes(t: Tables) -> DataFrame:
    """Documents as notes: source as type (src0 blocks), language as tag."""
    kind = F.when(F.col("source") == "src0", "blocker").otherwise(F.col("source"))
    return t.documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("title"), kind.alias("type"),
        F.array("lang").alias("tags"), F.col("text").alias("body"), F.col("doc_id").alias("updated_at"),
    )

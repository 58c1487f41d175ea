"""Registered queries: retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import context as C
from recollect.operators import graph as G
from recollect.operators import retrieval as R
from recollect.operators import tables as T
from recollect.operators import text_stats as TS
from recollect.plans import fixtures as fx
from recollect.plans.registry import query
from recollect.session import stored

_COS = """cosv AS (
  SELECT query_id, vec_id AS id, label, round(list_sum(list_transform(list_zip(qv, CAST(embedding AS DOUBLE[])), lambda p: p[1] * p[2]))
    / (sqrt(list_sum(list_transform(qv, lambda x: x * x))) * sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))), 6) AS score
  FROM centroids, embeddings)"""


# Rankings use scores to twelve digits, so that equal vectors tie; results are given with six.
_FINE_COS = _COS.replace(", 6) AS score", ", 12) AS score")
_FINE_HASHED = fx.HASHED.replace(", 6)", ", 12)")


def given(sql: str) -> str:
    return f"SELECT * REPLACE (round(score, 6) AS score) FROM ({sql})"


@query("k01_topk_cosine", given(f"""WITH {fx.CENTROIDS}, {_FINE_COS}
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosv WHERE score > 0) WHERE rank <= 5"""))
def k01(t):
    return R.topk_cosine(fx.label_centroids(t), fx.vectors(t), 5)


@query("k02_all_hits", f"WITH {fx.CENTROIDS}, {_COS} SELECT query_id, id, score FROM cosv WHERE score > 0")
def k02(t):
    return R.all_hits(fx.label_centroids(t), fx.vectors(t))


@query("j02_similarity_pairs_sparse", f"WITH {fx.HASHED} SELECT query_id, id, cos AS score FROM cos")
def j02(t):
    """Exact cosines of all text queries with all documents."""
    docs, queries = fx.document_vectors(t)
    return R.all_hits(queries, docs)


@query("j02_sparse_join", f"""WITH tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({fx.words_sql('text')}) AS term FROM documents) GROUP BY ALL),
qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({fx.words_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
dw AS (SELECT id, term, tf * ln(n / (1 + df)) AS w FROM tf JOIN df USING (term), n), qw AS (SELECT query_id, term, tf * ln(n / (1 + coalesce(df, 1))) AS w FROM qtf LEFT JOIN df USING (term), n),
dn AS (SELECT id, sqrt(sum(w * w)) AS d FROM dw GROUP BY id), qn AS (SELECT query_id, sqrt(sum(w * w)) AS q FROM qw GROUP BY query_id)
SELECT query_id, id, round(sum(qw.w * dw.w) / (any_value(q) * any_value(d)), 6) AS score FROM qw JOIN dw USING (term) JOIN dn USING (id) JOIN qn USING (query_id)
GROUP BY query_id, id HAVING round(sum(qw.w * dw.w) / (any_value(q) * any_value(d)), 12) >= 0.3""")
def j02_sparse(t):
    """Term weights of the benchmark passages against those of all documents, from the term rows as they are."""
    tf = stored(TS.term_frequency(t.documents))
    df = stored(TS.document_frequency(tf))
    n = t.documents.agg(F.count("*")).scalar()
    vectors = TS.tfidf(tf, df, n, listed=TS.LISTED).withColumnRenamed("doc_id", "id")
    queries = TS.tfidf(TS.term_frequency(fx.text_queries(t), "query_id", "text"), df, n, "query_id", TS.LISTED)
    return R.sparse_join(queries, vectors, 0.3).withColumn("score", F.round("score", 6))


def _letters(rows):
    """Counts of the letters a to z, for texts with at least one b; others have none."""
    low = F.lower("text")
    counts = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: (F.length(low) - F.length(F.replace(low, F.char(c), F.lit("")))).cast("double"))
    return rows.select("key", F.when(F.contains(low, F.lit("b")), counts).alias("embedding"))


def _lengths(rows):
    """Two numbers of a text, in as many dimensions."""
    first = F.array(F.length("text").cast("double"), F.lit(1.0))
    return rows.select("key", F.concat(first, F.array_repeat(F.lit(0.0), 24)).alias("embedding"))


@query("k01_topk_by_embedders", given("""WITH texts AS (SELECT doc_id AS id, text, 'd' AS side FROM documents UNION ALL SELECT item_id, text, 'q' FROM benchmark),
vecs AS (SELECT id, side, CASE WHEN contains(lower(text), 'b') THEN list_transform(range(97, 123), lambda c: (length(lower(text)) - length(replace(lower(text), chr(c::INTEGER), '')))::DOUBLE)
  ELSE list_concat([length(text)::DOUBLE, 1.0::DOUBLE], list_transform(range(24), lambda c: 0.0::DOUBLE)) END AS v FROM texts),
unit AS (SELECT id, side, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vecs),
scored AS (SELECT q.id AS query_id, d.id, round(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) / (q.n * d.n), 12) AS score FROM unit q JOIN unit d ON q.side = 'q' AND d.side = 'd' WHERE q.n * d.n > 0)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5"""))
def k01_embedders(t):
    """Search with the caller's embedders: letter counts where a text has a b, its length otherwise."""
    docs = TS.embed_texts(t.documents.withColumnRenamed("doc_id", "id"), "id", "text", [_letters, _lengths])
    queries = TS.embed_texts(fx.text_queries(t), "query_id", "text", [_letters, _lengths])
    return R.topk_cosine(queries, docs, 5)


@query("k03_hybrid_search", given(f"""WITH {_FINE_HASHED},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS r FROM cos) WHERE r <= 30),
keys AS (SELECT item_id AS query_id, list_distinct(list_filter({fx.words_sql('text')}, lambda w: length(w) >= 2)) AS ks FROM benchmark),
scored AS (SELECT query_id, id, round(0.6 * cos + 0.4 * (CASE WHEN len(ks) = 0 THEN 0 ELSE len(list_filter(ks, lambda w: contains(lower(text), w))) / len(ks) END), 12) AS score
  FROM pool JOIN keys USING (query_id) JOIN documents ON doc_id = id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5"""))
def k03(t):
    docs, queries = fx.document_vectors(t)
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return R.hybrid_search(fx.text_queries(t), chunks, docs, queries, 5)


@query("k04_expanded_search", given(f"""WITH variants AS (
  SELECT query_id, variant, list(v ORDER BY d) AS qv FROM (
    SELECT label AS query_id, vec_id % 3 AS variant, d, avg(CAST(embedding[d] AS DOUBLE)) AS v
    FROM embeddings, generate_series(1, len(embedding)) AS g(d) GROUP BY ALL) GROUP BY ALL),
hits AS (SELECT query_id, variant, vec_id AS id, round(list_sum(list_transform(list_zip(qv, CAST(embedding AS DOUBLE[])), lambda p: p[1] * p[2]))
    / (sqrt(list_sum(list_transform(qv, lambda x: x * x))) * sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))), 12) AS score
  FROM variants, embeddings),
m AS (SELECT query_id, count(*) AS m FROM variants GROUP BY query_id),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS r FROM hits WHERE score > 0) JOIN m USING (query_id)
  WHERE r <= greatest(1, 20 // m) AND score >= 0.2),
best AS (SELECT query_id, id, max(score) AS score FROM cut GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best) WHERE rank <= 5"""))
def k04(t):
    variants = fx.label_centroids(t, F.col("label").alias("query_id"), (F.col("vec_id") % 3).alias("variant"))
    return R.expanded_search(variants, fx.vectors(t), 5, 4, 0.2)


@query("k05_apply_ranking", f"""WITH {fx.CENTROIDS}, {_COS},
cand AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosv WHERE score > 0) WHERE rank <= 10),
resp AS (SELECT query_id, unnest([(query_id * 7 + 3) % 12, 99, (query_id * 5) % 11, (query_id * 7 + 3) % 12]) AS num, unnest([1, 2, 3, 4]) AS pos FROM centroids),
firsts AS (SELECT query_id, num, min(pos) AS pos FROM resp GROUP BY ALL)
SELECT query_id, id, original_rank, rank FROM (
  SELECT c.query_id, id, rank AS original_rank, row_number() OVER (PARTITION BY c.query_id ORDER BY (f.pos IS NULL), f.pos, rank) AS rank
  FROM cand c LEFT JOIN firsts f ON c.query_id = f.query_id AND c.rank = f.num) WHERE rank <= 5""")
def k05(t):
    queries = fx.label_centroids(t)
    hits = R.topk_cosine(queries, fx.vectors(t), 10)
    q = F.col("query_id")
    first = ((q * 7 + 3) % 12).cast("string")
    responses = queries.select("query_id", F.concat(F.lit("["), first, F.lit(", 99, "), ((q * 5) % 11).cast("string"), F.lit(", "), first, F.lit("]")).alias("response"))
    return R.apply_ranking(hits, responses, 5)


_KW_SHARE = r"len(list_filter(regexp_split_to_array(lower(q.content), '\s+'), lambda w: contains(lower(v.content), w))) / len(regexp_split_to_array(lower(q.content), '\s+'))"


@query("k06_working_search", given(f"""WITH {fx.TURNS},
newest AS (SELECT owner, max(turn) AS turn FROM turns GROUP BY owner),
rest AS (SELECT t.*, row_number() OVER (PARTITION BY owner ORDER BY importance DESC, created_at DESC, turn DESC) AS r FROM turns t ANTI JOIN newest USING (owner, turn)),
items AS (SELECT id, owner, content, importance, created_at FROM rest WHERE r <= 49 UNION ALL SELECT t.id, owner, content, importance, created_at FROM turns t SEMI JOIN newest USING (owner, turn)),
vtf AS (SELECT owner, id, term, count(*) AS tf FROM (SELECT owner, id, unnest({fx.words_sql('content')}) AS term FROM items) GROUP BY ALL),
qtf AS (SELECT owner, id AS query_id, term, count(*) AS tf FROM (SELECT owner, id, unnest({fx.words_sql('content')}) AS term FROM turns WHERE role = 'user') GROUP BY ALL),
df AS (SELECT owner, term, count(*) AS df FROM vtf GROUP BY ALL),
n AS (SELECT owner, count(*) AS n FROM items GROUP BY ALL),
vw AS (SELECT owner, id, term, tf * ln(n / (1 + df)) AS w FROM vtf JOIN df USING (owner, term) JOIN n USING (owner)),
qw AS (SELECT owner, query_id, term, tf * ln(n / (1 + coalesce(df, 1))) AS w FROM qtf JOIN n USING (owner) LEFT JOIN df USING (owner, term)),
vn AS (SELECT id, sqrt(sum(w * w)) AS nv FROM vw GROUP BY id), qn AS (SELECT query_id, sqrt(sum(w * w)) AS nq FROM qw GROUP BY query_id),
cos AS (SELECT query_id, id, CASE WHEN nv * nq = 0 THEN 0 ELSE dot / (nv * nq) END AS cos FROM
  (SELECT query_id, id, sum(v.w * q.w) AS dot FROM qw q JOIN vw v USING (owner, term) GROUP BY ALL) JOIN vn USING (id) JOIN qn USING (query_id)),
scored AS (SELECT q.id AS query_id, q.owner, v.id, round((CASE WHEN round(coalesce(cos, 0), 12) > 0 THEN cos * 0.7 + 0.3 * {_KW_SHARE} ELSE {_KW_SHARE} END)
    * greatest(0.1, exp(-0.1 * (date_diff('second', v.created_at, TIMESTAMP '{fx.AS_OF}') // 60) / 60.0 / 24)) * (0.8 + 0.4 * v.importance), 12) AS score
  FROM turns q JOIN items v USING (owner) LEFT JOIN cos c ON c.query_id = q.id AND c.id = v.id WHERE q.role = 'user')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5"""))
def k06(t):
    turns = fx.turns(t)
    items = T.replay_capacity(turns, "owner", 50, ["turn"])
    queries = turns.where(F.col("role") == "user").select(F.col("id").alias("query_id"), "owner", F.col("content").alias("text"))
    return R.working_search(queries, items.select("owner", "id", "content", "importance", "created_at"), fx.AS_OF, 5)


_DOC_TIME = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER))"


def _documents_as_items(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), "lang", ((F.col("n_chars") % 100).cast("double") / 100).alias("importance"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(doc_id % 720), 0, 0)").alias("created_at"),
    )


@query("k07_episodic_search", given(f"""WITH {_FINE_HASHED},
pool AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS r FROM cos c JOIN documents ON doc_id = id WHERE lang = 'en') WHERE r <= 25),
scored AS (SELECT query_id, id, round((0.8 * cos + 0.2 * greatest(0.1, exp(-0.1 * (date_diff('second', {_DOC_TIME}, TIMESTAMP '{fx.AS_OF}') // 3600) / 24.0))) * (0.8 + 0.4 * (CAST(n_chars % 100 AS DOUBLE) / 100)), 12) AS score
  FROM pool JOIN documents ON doc_id = id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5"""))
def k07(t):
    docs, queries = fx.document_vectors(t)
    items = _documents_as_items(t)
    return R.episodic_search(queries, docs, items, fx.AS_OF, 5, items.where(F.col("lang") == "en"))


_GRAPH_SCORES = f"""{fx.GRAPH}, {fx.QUERY_ENTITIES},
matched AS (SELECT query_id, entity_id FROM qe JOIN entities USING (name, type)),
qsize AS (SELECT query_id, count(*) AS q FROM qe GROUP BY ALL),
msize AS (SELECT memory_id, count(*) AS m FROM mentions GROUP BY ALL),
direct AS (SELECT query_id, memory_id, count(*) AS shared FROM matched JOIN mentions USING (entity_id) GROUP BY ALL),
nb AS (SELECT src AS entity_id, dst AS other FROM relations UNION SELECT dst, src FROM relations),
near AS (SELECT DISTINCT query_id, m.memory_id FROM matched JOIN nb USING (entity_id) JOIN mentions m ON m.entity_id = nb.other),
hits AS (SELECT query_id, memory_id, shared FROM direct UNION ALL SELECT query_id, memory_id, 0 FROM near ANTI JOIN direct USING (query_id, memory_id)),
scored AS (SELECT query_id, memory_id AS id, shared, shared * shared / greatest(q + m - shared, 1) AS raw, round(shared * shared / greatest(q + m - shared, 1), 6) AS score FROM hits JOIN qsize USING (query_id) JOIN msize USING (memory_id)),
graph_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM scored) WHERE rank <= 10)"""


@query("k08_graph_search", f"WITH {_GRAPH_SCORES} SELECT query_id, id, shared, score, rank FROM graph_hits")
def k08(t):
    return G.graph_search(fx.query_entities(t), fx.event_graph(t), 5)


_EVENT_VECTOR = "[CAST(value AS DOUBLE), CAST(length(event_type) AS DOUBLE), CAST(hour(ts) AS DOUBLE), 10.0]"


def _semantic_sql(graph: str, own: str) -> str:
    """``own`` is the condition on the events that may be found."""
    return given(f"""WITH {graph},
ev AS (SELECT event_id AS id, user_id, {_EVENT_VECTOR} AS v, least(value, 100) / 100 AS importance FROM events),
mine AS (SELECT * FROM ev WHERE {own}),
qv AS (SELECT user_id AS query_id, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS q FROM ev GROUP BY user_id),
vs AS (SELECT query_id, id, round(list_sum(list_transform(list_zip(q, v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(q, lambda x: x * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))), 12) AS score FROM qv, mine),
vh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM vs WHERE score > 0) WHERE r <= 10),
both_hits AS (SELECT query_id, id, coalesce(v.score, 0) AS a, coalesce(g.score, 0) AS b FROM vh v FULL JOIN graph_hits g USING (query_id, id)),
final AS (SELECT query_id, id, round((0.7 * a + 0.3 * b) * (0.8 + 0.4 * importance), 12) AS score FROM both_hits JOIN mine USING (id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM final) WHERE rank <= 5""")


def _semantic(t, **user):
    e = t.events
    parts = [F.col("value"), F.length("event_type").cast("double"), F.hour("ts").cast("double"), F.lit(10.0)]
    vectors = e.select(
        F.col("event_id").alias("id"), F.array(*parts).alias("embedding"), (F.least("value", F.lit(100.0)) / 100).alias("importance"),
        (F.col("event_id") % 7).cast("string").alias("user_id"))
    queries = e.groupBy(F.col("user_id").alias("query_id")).agg(F.array(*[F.avg(p) for p in parts]).alias("embedding"))
    return R.semantic_search(queries, vectors, fx.query_entities(t), fx.event_graph(t), vectors.select("id", "importance", "user_id"), 5, **user)


@query("k09_semantic_search", _semantic_sql(_GRAPH_SCORES, "true"))
def k09(t):
    return _semantic(t)


_OWN_MENTIONS = _GRAPH_SCORES.replace("qsize AS (", "own AS (SELECT * FROM mentions WHERE memory_id % 7 = 3),\nqsize AS (").replace(
    "FROM matched JOIN mentions USING", "FROM matched JOIN own USING").replace("JOIN mentions m ON m.entity_id = nb.other", "JOIN own m ON m.entity_id = nb.other")


@query("k08_graph_search_of_user", f"WITH {_OWN_MENTIONS} SELECT query_id, id, shared, score, rank FROM graph_hits")
def k08_user(t):
    own = t.events.where(F.col("event_id") % 7 == 3).select(F.col("event_id").alias("memory_id"))
    return G.graph_search(fx.query_entities(t), fx.event_graph(t), 5, candidates=own)


@query("k09_semantic_search_of_user", _semantic_sql(_OWN_MENTIONS, "id % 7 = 3"))
def k09_user(t):
    """One user of seven owns the memories that are searched."""
    return _semantic(t, user_id="3")


_MODALITY = "CASE label % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'audio' END"
_VEC_TIME = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(vec_id % 720 AS INTEGER))"


@query("k10_modality_search", given(f"""WITH {fx.CENTROIDS}, {_FINE_COS},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM cosv WHERE score > 0 AND label % 3 = query_id % 3) WHERE r <= 25),
final AS (SELECT query_id, id, round((0.8 * score + 0.2 * greatest(0.1, exp(-0.1 * (date_diff('second', {_VEC_TIME}, TIMESTAMP '{fx.AS_OF}') // 3600) / 24.0))) * (0.8 + 0.4 * (CAST(vec_id % 100 AS DOUBLE) / 100)), 12) AS score
  FROM pool JOIN embeddings ON vec_id = id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM final) WHERE rank <= 5"""))
def k10(t):
    def kind(c):
        return F.when(F.col(c) % 3 == 0, "text").when(F.col(c) % 3 == 1, "image").otherwise("audio")

    vectors = fx.vectors(t).withColumn("modality", kind("label"))
    items = t.embeddings.select(
        F.col("vec_id").alias("id"), ((F.col("vec_id") % 100).cast("double") / 100).alias("importance"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(vec_id % 720), 0, 0)").alias("created_at"),
    )
    return R.modality_search(fx.label_centroids(t).withColumn("modality", kind("query_id")), vectors, items, fx.AS_OF, 5)


@query("f06_filter_hits", f"""WITH {fx.CENTROIDS}, {_COS}
SELECT query_id, id, score FROM cosv WHERE score > 0 AND label % 3 = 1 AND id % 5 <> 0""")
def f06(t):
    items = t.embeddings.select(F.col("vec_id").alias("id"), F.create_map(
        F.lit("modality"), F.when(F.col("label") % 3 == 1, "image").when(F.col("label") % 3 == 2, "audio"),
        F.lit("user_id"), F.when(F.col("vec_id") % 5 != 0, "ann").otherwise("bob")).alias("metadata"))
    return R.filter_hits(R.all_hits(fx.label_centroids(t), fx.vectors(t)), items, "ann", "image")


@query("k11_search_all", f"""WITH {fx.MEMORIES},
ranked AS (SELECT session_id AS query_id, id, memory_type, round(importance, 6) AS importance, row_number() OVER (PARTITION BY session_id, memory_type ORDER BY created_at DESC, id) AS r FROM memories)
SELECT * FROM (SELECT query_id, id, memory_type, importance, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, memory_type, id) AS rank FROM ranked WHERE r <= 10) WHERE rank <= 10""")
def k11(t):
    """Each type offers its newest memories of the session; the merge goes by importance."""
    from recollect.functions.ranking import top_per_key

    items = fx.memories(t).withColumn("importance", F.round("importance", 6)).withColumnRenamed("session_id", "query_id")
    branches = [
        top_per_key(items.where(F.col("memory_type") == kind), ["query_id"], [F.desc("created_at"), F.asc("id")], 10).select("query_id", "id", "memory_type", "importance", "rank")
        for kind in ("working", "episodic", "semantic", "perceptual")
    ]
    return R.search_all(branches, 10)


def _notes_sql(k: int, kind: str) -> str:
    """``kind`` is the condition on the notes that lead."""
    return f"""WITH notes AS (SELECT doc_id AS id, lower('note ' || doc_id || ' ' || text) AS target, {kind} AS leads FROM documents),
first AS (SELECT id FROM notes WHERE leads ORDER BY id DESC LIMIT {k}),
asked AS (SELECT item_id AS query_id, lower(text) AS text FROM benchmark UNION ALL SELECT 100000 + item_id, lower(substring(text, 3, 12)) FROM benchmark WHERE trim(substring(text, 3, 12)) <> ''),
hits AS (SELECT query_id, id, 0 AS p FROM asked, first UNION ALL SELECT query_id, id, 1 FROM asked JOIN notes ON contains(target, text)),
once AS (SELECT query_id, id, min(p) AS p FROM hits GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, p = 0 AS priority, row_number() OVER (PARTITION BY query_id ORDER BY p, id DESC) AS rank FROM once) WHERE rank <= {k}"""


def _note_queries(t):
    """The passages of the benchmark, and a dozen characters of each."""
    whole = fx.text_queries(t)
    part = whole.select((F.col("query_id") + 100000).alias("query_id"), F.substring("text", 3, 12).alias("text")).where(F.trim("text") != "")
    return whole.union(part)


@query("k12_notes_for_queries", _notes_sql(5, "source = 'src0'"))
def k12(t):
    """All notes of a source are blockers and lead."""
    return R.notes_for_queries(_note_queries(t), fx.notes(t), 5)


@query("k12_notes_without_blockers", _notes_sql(5, "false"))
def k12_plain(t):
    """No note is of the type that leads, so the text decides alone."""
    return R.notes_for_queries(_note_queries(t), fx.notes(t), 5, "none")


_TOKEN_SET = "list_distinct(list_filter(" + fx.words_sql("{0}") + ", lambda w: length(w) >= 2))"


def _jaccard_sql(a: str, b: str) -> str:
    x, y = _TOKEN_SET.format(a), _TOKEN_SET.format(b)
    return f"(CASE WHEN len({y}) = 0 THEN 0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END)"


@query("k14_jaccard_relevance", f"""WITH {fx.TURNS}
SELECT a.id, round({_jaccard_sql('b.content', 'a.content')}, 6) AS relevance FROM turns a JOIN turns b ON a.owner = b.owner AND b.turn = a.turn + 1 WHERE a.role = 'user'""")
def k14(t):
    turns = fx.turns(t)
    following = turns.select("owner", (F.col("turn") - 1).alias("turn"), F.col("content").alias("reply"))
    pairs = turns.where(F.col("role") == "user").join(following, ["owner", "turn"])
    return R.jaccard_relevance(pairs, "reply", "content").select("id", F.round("relevance", 6).alias("relevance"))


_APPROX = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
_LAST_USER = "lastq AS (SELECT owner AS query_id, max_by(content, turn) AS text FROM turns WHERE role = 'user' GROUP BY owner)"
_PACKETS = f"""{fx.TURNS}, {_LAST_USER},
packets AS (
  SELECT owner AS query_id, 'system' || owner AS packet_id, content, TIMESTAMP '{fx.AS_OF}' AS ts, {_APPROX.format('content')} AS tokens, 1.0::DOUBLE AS relevance, 'system_instruction' AS type FROM turns WHERE role = 'system'
  UNION ALL SELECT owner, 'memory:' || id, '[' || role || '] ' || content, TIMESTAMP '{fx.AS_OF}', {_APPROX.format('content')}, CASE WHEN turn % 2 = 0 THEN 0.5 ELSE importance END, 'memory' FROM turns WHERE role = 'assistant'
  UNION ALL SELECT owner, 'turn:' || turn, role || ': ' || content, created_at, {_APPROX.format('content')}, 0.6, 'conversation_history' FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY turn DESC) AS r FROM turns) WHERE r <= 5)"""


def _gathered(t):
    turns = fx.turns(t)
    queries = turns.where(F.col("role") == "user").groupBy(F.col("owner").alias("query_id")).agg(F.max_by("content", "turn").alias("text"))
    own = turns.withColumnRenamed("owner", "query_id")
    memories = own.where(F.col("role") == "assistant").select(
        "query_id", "id", "content", F.col("role").alias("memory_type"), F.when(F.col("turn") % 2 == 0, 0.5).otherwise(F.col("importance")).alias("importance"))
    history = own.select("query_id", "turn", "role", "content", F.col("created_at").alias("ts"))
    system = own.where(F.col("role") == "system").select("query_id", "content")
    return queries, C.gather_packets(fx.AS_OF, instructions=system, memories=memories, history=history)


@query("m01_gather_packets", f"WITH {_PACKETS} SELECT query_id, packet_id, content, ts, CAST(tokens AS INTEGER) AS tokens, relevance, type FROM packets")
def m01(t):
    return _gathered(t)[1]


_SCORED = f"""{_PACKETS},
rel AS (SELECT p.*, CASE WHEN abs(relevance - 0.5) < 0.001 AND type <> 'system_instruction' THEN {_jaccard_sql('content', "coalesce(text, '')")} ELSE relevance END AS rel FROM packets p LEFT JOIN lastq USING (query_id)),
scored AS (SELECT query_id, packet_id, content, ts, tokens, rel AS relevance, type,
    CASE WHEN type <> 'system_instruction' THEN round(0.7 * rel + 0.3 * least(1.0, greatest(0.1, exp(-0.1 * (date_diff('second', ts, TIMESTAMP '{fx.AS_OF}') / 3600.0) / 24))), 6) END AS score
  FROM rel WHERE type = 'system_instruction' OR rel >= 0.1)"""


@query("k13_score_packets", f"WITH {_SCORED} SELECT query_id, packet_id, type, CAST(tokens AS INTEGER) AS tokens, round(relevance, 6) AS relevance, score FROM scored")
def k13(t):
    queries, packets = _gathered(t)
    return C.score_packets(packets, queries, fx.AS_OF).select("query_id", "packet_id", "type", "tokens", F.round("relevance", 6).alias("relevance"), "score")


_BUDGET = 120
_FILLED = f"""{_SCORED},
used AS (SELECT query_id, sum(tokens) AS used FROM scored WHERE score IS NULL GROUP BY query_id),
ordered AS (SELECT s.*, {_BUDGET} - coalesce(used, 0) AS free, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, packet_id) AS r FROM scored s LEFT JOIN used USING (query_id) WHERE score IS NOT NULL),
fold AS (
  SELECT query_id, r, packet_id, free > 0 AND tokens <= free AS taken, CASE WHEN free > 0 AND tokens <= free THEN free - tokens ELSE free END AS left_over FROM ordered WHERE r = 1
  UNION ALL SELECT o.query_id, o.r, o.packet_id, o.free > 0 AND o.tokens <= f.left_over, CASE WHEN o.free > 0 AND o.tokens <= f.left_over THEN f.left_over - o.tokens ELSE f.left_over END
  FROM fold f JOIN ordered o ON o.query_id = f.query_id AND o.r = f.r + 1),
selected AS (SELECT s.* FROM scored s WHERE score IS NULL UNION ALL SELECT s.* FROM scored s JOIN fold f USING (query_id, packet_id) WHERE f.taken)"""


@query("w05_fill_budget", f"WITH RECURSIVE {_FILLED} SELECT query_id, packet_id, CAST(tokens AS INTEGER) AS tokens, score FROM selected")
def w05(t):
    queries, packets = _gathered(t)
    chosen = C.fill_budget(C.score_packets(packets, queries, fx.AS_OF), _BUDGET)
    return chosen.select("query_id", "packet_id", "tokens", "score")


@query("m02_assemble_context", f"""WITH RECURSIVE {_FILLED},
sys AS (SELECT query_id, '[Role & Policies]' || chr(10) || string_agg(content, chr(10) ORDER BY packet_id) AS s FROM selected WHERE type = 'system_instruction' GROUP BY ALL),
ctx AS (SELECT query_id, '[Context]' || chr(10) || string_agg(content, chr(10) ORDER BY score DESC, packet_id) AS s FROM selected WHERE type <> 'system_instruction' GROUP BY ALL)
SELECT query_id, concat_ws(chr(10) || chr(10), sys.s, '[Task]' || chr(10) || text, ctx.s, '[Output]' || chr(10) || '{C.CLOSING}') AS context
FROM lastq LEFT JOIN sys USING (query_id) LEFT JOIN ctx USING (query_id)""")
def m02(t):
    queries, packets = _gathered(t)
    return C.assemble_context(C.fill_budget(C.score_packets(packets, queries, fx.AS_OF), _BUDGET), queries)


@query("m02_numbered_sources", f"""WITH {fx.HASHED},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM cos) WHERE rank <= 3)
SELECT query_id, string_agg('【来源' || rank || '】' || CASE WHEN id % 2 = 0 THEN ' [章节: ' || lang || ']' ELSE '' END || chr(10) || text || chr(10), '' ORDER BY rank) AS context,
  string_agg('来源' || rank || ': ' || source, chr(10) ORDER BY rank) AS sources
FROM pool JOIN documents ON doc_id = id GROUP BY query_id""")
def m02_sources(t):
    docs, queries = fx.document_vectors(t)
    hits = R.topk_cosine(queries, docs, 3)
    info = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("heading_path"), F.col("text").alias("content"))
    return C.numbered_sources(hits.join(info, "id"))


@query("w06_compress_sections", r"""WITH parts AS (
  SELECT doc_id, text, unnest(string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '(\n\n)+$', ''), chr(10) || chr(10))) AS s,
         generate_subscripts(string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '(\n\n)+$', ''), chr(10) || chr(10)), 1) AS i FROM documents),
sized AS (SELECT *, len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) AS t FROM parts),
run AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM sized),
edge AS (SELECT doc_id, min(i) AS e FROM run WHERE total > 200 GROUP BY doc_id),
kept AS (SELECT r.doc_id, i, s FROM run r LEFT JOIN edge USING (doc_id) WHERE e IS NULL OR i < e
  UNION ALL SELECT r.doc_id, i, substring(s, 1, CAST(floor((200 - (total - t)) * (length(s) / t)) AS BIGINT)) || chr(10) || '[... 内容已压缩 ...]' FROM run r JOIN edge USING (doc_id) WHERE i = e AND 200 - (total - t) > 50),
short AS (SELECT doc_id, string_agg(s, chr(10) || chr(10) ORDER BY i) AS c FROM kept GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 200 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE coalesce(c, '') END AS compressed
FROM documents LEFT JOIN short USING (doc_id)""")
def w06(t):
    spread = t.documents.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return C.compress_sections(spread, "text", 200).select("doc_id", "compressed")


@query("j01_enrich_hits", f"""WITH {fx.HASHED},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM cos) WHERE rank <= 5)
SELECT query_id, id, cos AS score, n_chars, coalesce(CASE WHEN id % 3 <> 0 THEN source END, '(deleted)') AS title FROM pool JOIN documents ON doc_id = id WHERE id % 7 <> 0""")
def j01(t):
    """Some hits have lost their chunk and some chunks their document."""
    docs, queries = fx.document_vectors(t)
    hits = R.topk_cosine(queries, docs, 5)
    chunks = t.documents.where(F.col("doc_id") % 7 != 0).select(F.col("doc_id").alias("id"), "doc_id", "n_chars")
    titles = t.documents.where(F.col("doc_id") % 3 != 0).select("doc_id", F.col("source").alias("title"))
    return R.enrich_hits(hits, chunks, titles).select("query_id", "id", "score", "n_chars", "title")


@query("j08_combine_hits", f"""WITH {fx.CENTROIDS}, {_COS},
a AS (SELECT query_id, id, score FROM cosv WHERE score > 0.2), b AS (SELECT label AS query_id, vec_id AS id, CAST(vec_id % 10 AS DOUBLE) / 10 AS score FROM embeddings)
SELECT query_id, id, coalesce(a.score, 0) AS vector_score, coalesce(b.score, 0) AS graph_score FROM a FULL JOIN b USING (query_id, id)""")
def j08(t):
    v = R.all_hits(fx.label_centroids(t), fx.vectors(t)).where(F.col("score") > 0.2)
    g = t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), ((F.col("vec_id") % 10).cast("double") / 10).alias("score"))
    return R.combine_hits(v, g)


@query("j09_restrict_candidates", f"WITH {fx.CENTROIDS}, {_COS} SELECT query_id, id, score FROM cosv WHERE score > 0 AND label <> 0")
def j09(t):
    candidates = t.embeddings.where(F.col("label") != 0).select(F.col("vec_id").alias("id"))
    return R.restrict_candidates(R.all_hits(fx.label_centroids(t), fx.vectors(t)), candidates)

"""Registered queries: text to rows, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions import lexicon
from recollect.operators import sequences as Q
from recollect.operators import text_rows as TR
from recollect.operators import text_stats as TS
from recollect.operators.graph import Graph
from recollect.plans import fixtures as fx
from recollect.plans.lookup import _LINKS
from recollect.plans.registry import query
from recollect.session import cut, work_path
from recollect.sources import documents as D
from recollect.sources import logs as L
from recollect.sources import snapshots as S

# ---------------------------------------------------------------- term statistics


@query("a06_term_frequency", f"WITH w AS (SELECT doc_id, unnest({fx.words_sql('text')}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL")
def a06(t):
    return TS.term_frequency(t.documents)


@query("a05_document_frequency", f"WITH w AS (SELECT DISTINCT doc_id, unnest({fx.words_sql('text')}) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY ALL")
def a05(t):
    return TS.document_frequency(TS.term_frequency(t.documents))


@query("a07_tfidf", f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({fx.words_sql('text')}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents) / (1 + df)), 6) AS weight FROM tf JOIN df USING (term)""")
def a07(t):
    tf = cut(TS.term_frequency(t.documents))  # counted once, read for df and weights
    n = t.documents.agg(F.count("*")).scalar()
    return TS.tfidf(tf, TS.document_frequency(tf), n).withColumn("weight", F.round("weight", 6))


@query("a08_hashed_tfidf", f"WITH {fx.HASHED} SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(w, 6) AS weight FROM dvec")
def a08(t):
    tf = cut(TS.term_frequency(t.documents))
    n = t.documents.agg(F.count("*")).scalar()
    return TS.hashed_tfidf(tf, TS.document_frequency(tf), n, dim=fx.DIM).withColumn("weight", F.round("weight", 6))


@query("x02_approx_tokens", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS tokens FROM documents")
def x02(t):
    return t.documents.select("doc_id", X.approx_tokens("text").alias("tokens"))


@query("x03_memory_type", "SELECT conv_id, turn, CASE WHEN contains(x, '知识') THEN 'semantic' WHEN contains(x, '完成') THEN 'episodic' WHEN contains(x, '图片') THEN 'perceptual' WHEN turn % 2 = 0 THEN role ELSE 'working' END AS type FROM (SELECT *, CASE turn % 5 WHEN 0 THEN text || '知识' WHEN 1 THEN text || ' 完成 图片' WHEN 2 THEN '图片' ELSE text END AS x FROM conversations)")
def x03(t):
    """Turns, some with a keyword added; even ones have a type already."""
    k = F.col("turn") % 5
    text = F.when(k == 0, F.concat("text", F.lit("知识"))).when(k == 1, F.concat("text", F.lit(" 完成 图片"))).when(k == 2, "图片").otherwise(F.col("text"))
    current = F.when(F.col("turn") % 2 == 0, F.col("role"))
    return t.conversations.select("conv_id", "turn", X.memory_type(text, current).alias("type"))


@query("x04_note_type", "SELECT doc_id, CASE WHEN contains(x, 'bug') OR contains(x, 'block') THEN 'blocker' WHEN contains(x, 'plan') OR contains(x, 'todo') THEN 'action' ELSE 'conclusion' END AS type FROM (SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' BUG' WHEN 1 THEN ' a Plan' ELSE '' END) AS x FROM documents)")
def x04(t):
    added = F.when(F.col("doc_id") % 4 == 0, " BUG").when(F.col("doc_id") % 4 == 1, " a Plan").otherwise("")
    return t.documents.select("doc_id", X.note_type(F.concat("text", added)).alias("type"))


@query("x05_long_keyword_share", f"""WITH pairs AS (SELECT a.conv_id, a.turn, list_distinct(list_filter({fx.words_sql('a.text')}, lambda w: length(w) >= 2)) AS keys, lower(b.text) AS content FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(keys) = 0 OR trim(content) = '' THEN 0 ELSE len(list_filter(keys, lambda w: contains(content, w))) / len(keys) END, 6) AS share FROM pairs""")
def x05(t):
    """How much of each turn the next one takes up."""
    c = t.conversations
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.long_keyword_share("text", "next"), 6).alias("share"))


@query("x06_l2_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def x06(t):
    return t.embeddings.select("vec_id", F.round(X.l2_norm("embedding"), 6).alias("norm"))


@query("x07_json_map", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN props::JSON->>'k' END AS k, CASE WHEN event_id % 3 <> 0 THEN len(json_keys(props::JSON)) ELSE 0 END AS n FROM events")
def x07(t):
    """Metadata kept as JSON text, every third of it broken."""
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", S.read_json_map(broken).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.size("m").cast("long").alias("n"))


@query("a07_tfidf_by_tokenizer", r"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents) / (1 + df)), 6) AS weight FROM tf JOIN df USING (term)""")
def a07_tokenizer(t):
    """Term weights with a tokenizer of the caller: words as they are, between white space."""
    tf = cut(TS.term_frequency(t.documents, tokenizer=lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    n = t.documents.agg(F.count("*")).scalar()
    return TS.tfidf(tf, TS.document_frequency(tf), n).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- chunks and cleaning


def _markdown(t):
    """Documents with a heading and with lines as paragraphs."""
    body = F.regexp_replace("text", "\n", "\n\n")
    return t.documents.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), body).alias("text"))


_TEXT = "'# ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))"
_PARAGRAPHS = rf"""lines AS (SELECT doc_id, source, unnest(string_split({_TEXT}, chr(10))) AS l, generate_subscripts(string_split({_TEXT}, chr(10)), 1) AS n FROM documents),
spans AS (SELECT *, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM lines),
found AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, trim(l, ' ' || chr(9) || chr(13)) AS content, source AS heading_path, CAST(stop - length(l) - 1 AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop
  FROM spans WHERE trim(l, ' ' || chr(9) || chr(13)) <> '' AND NOT starts_with(trim(l), '#')),
paras AS (SELECT * FROM found UNION ALL SELECT doc_id, 1, {_TEXT}, NULL, 0, CAST(length({_TEXT}) AS INTEGER) FROM documents ANTI JOIN found USING (doc_id)),
sized AS (SELECT *, greatest(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')), 1) AS t FROM paras),
cum AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY i) - t AS before FROM sized)"""


@query("t01_split_paragraphs", f'WITH {_PARAGRAPHS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, content, heading_path, start, stop AS "end" FROM paras')
def t01(t):
    return TR.split_paragraphs(_markdown(t))


@query("t02_chunk", f"""WITH RECURSIVE {_PARAGRAPHS},
tails AS (SELECT a.doc_id, a.i, min(b.before) AS tail FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.before - b.before <= 50 GROUP BY ALL),
run AS (
  SELECT doc_id, i, before AS s FROM cum WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN c.before - r.s + c.t <= 500 THEN r.s WHEN c.before - greatest(tail, r.s) + c.t > 500 THEN c.before ELSE greatest(tail, r.s) END
  FROM run r JOIN cum c ON c.doc_id = r.doc_id AND c.i = r.i + 1 JOIN tails t ON t.doc_id = c.doc_id AND t.i = c.i),
pieces AS (SELECT doc_id, s, max(i) AS last FROM run GROUP BY ALL),
joined AS (SELECT p.doc_id, p.s, string_agg(content, chr(10) || chr(10) ORDER BY c.i) AS content, max(heading_path) AS heading_path, min(start) AS start, max(stop) AS stop
  FROM pieces p JOIN cum c ON c.doc_id = p.doc_id AND c.before >= p.s AND c.i <= p.last GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, content, heading_path, start, stop AS "end",
  CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS INTEGER) AS tokens FROM joined""")
def t02(t):
    return TR.chunk(_markdown(t))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
 '```[\s\S]*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '!\[.*?\]\(.*?\)', ' ', 'g'), '\[(.*?)\]\(.*?\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '\*{{1,3}}|_{{1,3}}', '', 'g')"""
_CLEAN = rf"trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g'))"


@query("t03_clean_markdown", f"SELECT page_id, {_CLEAN.format('html')} AS clean FROM pages")
def t03(t):
    return TR.clean_markdown(t.pages, "html").select("page_id", "clean")


@query("t03_clean_documents", f"SELECT doc_id, {_CLEAN.format('text')} AS clean FROM documents")
def t03_documents(t):
    return TR.clean_markdown(t.documents, "text").select("doc_id", "clean")


_CAPS = r"(regexp_matches(s, '(?:[^\p{L}]*\p{Lu}){3}') AND NOT regexp_matches(s, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]'))"
_PAGE = r"""lines AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)))) AS s, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS i FROM documents),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM lines WHERE s = '' OR NOT (
  regexp_matches(s, '^\d{1,4}(\s*[-–—]\s*\d{1,4})?$') OR regexp_matches(s, '^\[?\d{1,4}\]?$') OR regexp_matches(s, '(?i)^page\s*\d{1,4}$') OR regexp_matches(s, '^[-–—]{3,}$')
  OR (length(s) <= 1 AND NOT regexp_matches(s, '^\d$')) OR (regexp_matches(s, '^[[:punct:]\s]+$') AND length(s) <= 3) OR regexp_matches(s, '^[|]{2,}$') OR regexp_matches(s, '^[._\-·•]{2,}$'))),
typed AS (SELECT *, s LIKE '#%' AS heading, s <> '' AND NOT (s LIKE '#%' OR (length(s) <= 60 AND """ + _CAPS + r""")) AND length(s) < 60 AND NOT (
  (s LIKE '%.' AND length(s) > 2 AND NOT regexp_matches(s, '(?i)(^|\s)(al|fig|eg|etc|vs|dr|mr|mrs|ms|prof|dept|approx|vol|pp|no)\.$')) OR regexp_matches(s, '[。！？!?:：;；]$')) AS open FROM kept),
runs AS (SELECT *, sum(CASE WHEN open AND coalesce(lag_open, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY r) AS run FROM (SELECT *, lag(open) OVER (PARTITION BY doc_id ORDER BY r) AS lag_open FROM typed)),
merged AS (SELECT doc_id, run, string_agg(s, ' ' ORDER BY r) AS s, bool_or(heading) AS heading FROM runs GROUP BY ALL),
paras AS (SELECT *, sum(CASE WHEN s = '' OR coalesce(lag_h, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY run) AS p FROM (SELECT *, lag(heading) OVER (PARTITION BY doc_id ORDER BY run) AS lag_h FROM merged)),
texts AS (SELECT doc_id, p, string_agg(s, chr(10) ORDER BY run) AS x FROM paras WHERE s <> '' GROUP BY ALL)"""


@query("t04_clean_page_text", f"WITH {_PAGE} SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY p) AS clean FROM texts GROUP BY doc_id")
def t04(t):
    return TR.clean_page_text(t.documents, "text").select("doc_id", "clean").where(F.col("clean") != "")


@query("s12_html_to_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def s12(t):
    return D.html_to_text(t.pages).select("page_id", "text")


@query("s13_extract_links", f"WITH {_LINKS} SELECT page_id, pos, title, url, '' AS snippet FROM links WHERE pos < 5")
def s13(t):
    return D.extract_links(t.pages, 5)


_RESULTS = """found AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE 'Page ' || page_id END AS title, url, CASE WHEN page_id % 4 <> 0 THEN substring(html, 1, 30) END AS content, html AS raw_content FROM pages)"""
_CUT = "CASE WHEN length(raw_content) > 800 THEN substring(raw_content, 1, 800) || '... [truncated]' ELSE raw_content END"


def _found(t):
    i = F.col("page_id")
    return t.pages.select(
        i, F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("Page "), i.cast("string"))).alias("title"), "url",
        F.when(i % 4 != 0, F.substring("html", 1, 30)).alias("content"), F.col("html").alias("raw_content"))


@query("s16_normalise_results", f"WITH {_RESULTS} SELECT page_id, CASE WHEN trim(title) = '' THEN url ELSE title END AS title, url, coalesce(content, '') AS content, {_CUT} AS raw_content FROM found")
def s16(t):
    return D.normalise_results(_found(t), 200)


@query("w10_format_sources", f"""WITH {_RESULTS} SELECT page_id, '信息来源: ' || title || chr(10) || chr(10) || 'URL: ' || url || chr(10) || chr(10) || CASE WHEN trim(coalesce(content, '')) <> '' THEN '信息内容: ' || content || chr(10) || chr(10) ELSE '' END
 || '详细信息内容限制为 200 个 token: ' || {_CUT} || chr(10) || chr(10) AS block FROM found""")
def w10_sources(t):
    return D.format_sources(_found(t), 200).select("page_id", "block")


# ---------------------------------------------------------------- entities and relations


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DICT = "dict(name, type, pos) AS (VALUES " + ", ".join(f"({_quote(n)}, {_quote(k)}, {i})" for n, k, i in lexicon.dictionary()) + ")"
_SHORT = r"(length({0}) <= 4 AND regexp_matches({0}, '^[!-~]+$'))"
_ESCAPED = r"regexp_replace(lower({0}), '([+.#])', '\\\1', 'g')"


def _held(text: str, name: str) -> str:
    """A name occurs in a lower-cased text, short ones as a word."""
    return f"CASE WHEN {_SHORT.format(name)} THEN regexp_matches({text}, '(^|[^a-z0-9_])' || {_ESCAPED.format(name)} || '([^a-z0-9_]|$)') ELSE contains({text}, lower({name})) END"


_FOUND = f"{_DICT}, found AS (SELECT doc_id, name, type, pos FROM documents JOIN dict ON {_held('lower(text)', 'name')})"


@query("t05_dictionary_entities", f"WITH {_FOUND} SELECT doc_id, name, type FROM found")
def t05(t):
    return TR.dictionary_entities(t.documents)


_SIGN = r"regexp_replace(text, '([^\p{L}\p{N}_\s])', chr(1) || '\1' || chr(1), 'g')"
_NAME = r"'(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])'"
_CUE = " ".join(
    "WHEN " + " OR ".join(f"contains(near, {_quote(c)})" for c in cues) + f" THEN '{label}'" for label, cues in lexicon.NAME_CUES
)
# Signs inside a version are kept by working on the plain text; a version cannot touch another one.
_VERSION = r"'(?i)(?:^|[^\p{L}\p{N}_])(v?\d+\.\d+(?:\.\d+)?(?:[-.]?(?:alpha|beta|rc|release|SNAPSHOT|GA|LTS))?)(?:$|[^\p{L}\p{N}_])'"
_DATE = r"'(?:^|[^\p{L}\p{N}_])(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?)(?:$|[^\p{L}\p{N}_])'"
_DOUBLED = r"regexp_replace(text, '(\s)', '\1\1', 'g')"
_PATTERNS = rf"""names AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all({_SIGN}, {_NAME}, 1)) AS name FROM documents),
typed AS (SELECT doc_id, name, substring(lower(text), greatest(instr(lower(text), lower(name)) - 40, 1), instr(lower(text), lower(name)) + length(name) + 40 - greatest(instr(lower(text), lower(name)) - 40, 1)) AS near
  FROM names WHERE length(name) >= 5 AND name NOT IN (SELECT name FROM dict)),
patterns AS (SELECT doc_id, name, CASE {_CUE} ELSE 'concept' END AS type FROM typed
  UNION SELECT doc_id, unnest(regexp_extract_all({_DOUBLED}, {_VERSION}, 1)), 'tool' FROM documents
  UNION SELECT doc_id, unnest(regexp_extract_all({_DOUBLED}, {_DATE}, 1)), 'date' FROM documents)"""


@query("t06_pattern_entities", f"WITH {_DICT}, {_PATTERNS} SELECT * FROM patterns")
def t06(t):
    return TR.pattern_entities(t.documents)


def _near(name: str) -> str:
    """Place of a name in the lower-cased sentence, a short one as a word."""
    word = f"regexp_extract(' ' || l || ' ', '[^a-z0-9_]' || {_ESCAPED.format(name)} || '[^a-z0-9_]')"
    return f"CASE WHEN {_SHORT.format(name)} THEN instr(' ' || l || ' ', {word}) ELSE instr(l, lower({name})) END"


def _cues(cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains(near, {c if c.startswith('lower') else _quote(c)})" for c in cues) + ")"


_KIND_OF = _cues([f"lower(a) || {_quote(c)}" for c in lexicon.IS_A_AFTER_FIRST] + lexicon.IS_A_ANYWHERE + [f"lower(b) || {_quote(c)}" for c in lexicon.IS_A_AFTER_SECOND])
_PREDICATE = f"CASE WHEN {_KIND_OF} THEN 'IS_A' " + " ".join(f"WHEN {_cues(cs)} THEN '{k}'" for k, cs in lexicon.RELATION_CUES) + " ELSE 'CO_OCCURS_WITH' END"
_RANKED = rf"""seq AS (SELECT doc_id, name, type, 0 AS part, -length(name) AS x, pos AS y FROM found
  UNION ALL SELECT p.doc_id, p.name, p.type, CASE p.type WHEN 'tool' THEN 2 WHEN 'date' THEN 3 ELSE 1 END, instr(text, p.name), 0 FROM patterns p JOIN documents USING (doc_id)),
ents AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, x, y) AS i FROM seq),
parts AS (SELECT doc_id, string_split(regexp_replace(text, '([.。!！?？\n])\s*', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents SEMI JOIN ents USING (doc_id)),
sents AS (SELECT doc_id, s, lower(s) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS no FROM (SELECT doc_id, trim(unnest(ss)) AS s, generate_subscripts(ss, 1) AS n FROM parts) WHERE s <> ''),
held AS (SELECT s.doc_id, no, l, name, type, i FROM sents s JOIN ents e ON e.doc_id = s.doc_id AND {_held('l', 'name')}),
same AS (SELECT x.doc_id, 0 AS kind, x.no, x.l, x.name AS a, y.name AS b, x.type AS ta, y.type AS tb, x.i AS ai, y.i AS bi FROM held x JOIN held y ON x.doc_id = y.doc_id AND x.no = y.no AND x.i < y.i AND x.name <> y.name),
placed AS (SELECT *, {_near('a')} AS pa, {_near('b')} AS pb FROM same),
framed AS (SELECT *, substring(l, greatest(least(pa, pb) - 60, 1), greatest(pa, pb) + greatest(length(a), length(b)) + 60 - greatest(least(pa, pb) - 60, 1)) AS near FROM placed),
pairs AS (SELECT doc_id, kind, no, a, b, ta, tb, ai, bi, {_PREDICATE} AS p FROM framed
  UNION ALL SELECT x.doc_id, 1, x.no, x.name, y.name, x.type, y.type, x.i, y.i, 'RELATED_TO' FROM held x JOIN held y ON x.doc_id = y.doc_id AND y.no = x.no + 1 AND x.name <> y.name)"""


@query("t07_extract_relations", f"""WITH {_FOUND}, {_PATTERNS}, {_RANKED}
SELECT doc_id, a AS src, ta AS src_type, p AS predicate, b AS dst, tb AS dst_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, a, b ORDER BY kind, no, ai, bi) AS r FROM pairs) WHERE r = 1""")
def t07(t):
    return TR.extract_relations(t.documents)


# ---------------------------------------------------------------- model text


def _model_text(t):
    """Documents inside model answers: reasoning, tool marks with nested lists, and a plain tail."""
    d = F.col("doc_id")
    body = F.when(d % 3 == 0, F.concat(F.lit('{"q": "'), "lang", F.lit('", "ids": [1, [2, 3]], "n": "'), d.cast("string"), F.lit('"}'))).when(
        d % 3 == 1, F.concat(F.lit("q="), "lang", F.lit(", n="), d.cast("string"))).otherwise(F.col("lang"))
    plain = F.regexp_replace("text", r"[\[\]<>]", " ")
    return t.documents.select("doc_id", "lang", F.concat(
        F.lit("<think>one <think>two</think> three</think>"), plain, F.lit("[TOOL_CALL:search:"), body, F.lit("]"), F.lit(" [TOOL_CALL:open"),
    ).alias("answer"))


@query("t08_extract_tool_calls", """SELECT doc_id, 0 AS pos, 'search' AS tool, lang AS q, CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id AS VARCHAR) END AS n, CASE WHEN doc_id % 3 = 0 THEN '[1,[2,3]]' END AS ids FROM documents""")
def t08(t):
    calls = TR.extract_tool_calls(_model_text(t), "doc_id", "answer", {"search": [("q", "string"), ("n", "integer")]})
    return calls.select("doc_id", "pos", "tool", *[F.col("params")[c].alias(c) for c in ("q", "n", "ids")])


@query("t09_strip_markers", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\[\]<>]', ' ', 'g'), '^\s+', '') || ' [TOOL_CALL:open') AS clean FROM documents""")
def t09(t):
    return TR.strip_markers(_model_text(t), "answer").select("doc_id", "clean")


@query("t10_extract_tasks", """SELECT doc_id, CAST(i AS INTEGER) AS task_id, CASE i WHEN 1 THEN source ELSE CASE WHEN doc_id % 4 = 3 THEN 'second' ELSE CASE WHEN doc_id % 4 = 0 THEN '任务 2' ELSE 'second' END END END AS title,
 CASE i WHEN 1 THEN lang ELSE CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'why' END END AS intent, CASE i WHEN 1 THEN 'q' || doc_id ELSE CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'what' END END AS query, 'pending' AS status
FROM documents, (VALUES (1), (2)) AS x(i)""")
def t10(t):
    d = F.col("doc_id")
    first = F.struct(F.col("source").alias("title"), F.col("lang").alias("intent"), F.concat(F.lit("q"), d.cast("string")).alias("query"))
    rest = F.lit('{"title":"second","intent":"why","query":"what"}')
    full = F.concat(F.lit("["), F.to_json(first), F.lit(","), rest, F.lit("]"))
    bare = F.concat(F.lit("["), F.to_json(first), F.lit(",{}]"))
    table = F.concat(
        F.lit("intro\n| id | 标题 | 意图 | query |\n|---|---|---|---|\n| 1 | "), "source", F.lit(" | "), "lang", F.lit(" | `q"), d.cast("string"), F.lit("` |\n| 2 | second | why | what |\nend"))
    answer = (
        F.when(d % 4 == 0, F.concat(F.lit('<think>{"tasks": []}</think>Plan: {"tasks":'), bare, F.lit("} done")))
        .when(d % 4 == 1, F.concat(F.lit("Plan: "), full, F.lit(" done")))
        .when(d % 4 == 2, F.concat(F.lit('[TOOL_CALL:plan:{"tasks":'), full, F.lit("}]")))
        .otherwise(table)
    )
    return TR.extract_tasks(t.documents.select("doc_id", answer.alias("answer")), "doc_id", "answer")


@query("t13_extract_json", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'block' WHEN 2 THEN 'fields' ELSE 'default' END AS source, doc_id % 4 <> 3 AS should_change,
 CASE WHEN doc_id % 4 = 3 THEN 0.0 ELSE CAST(doc_id % 20 - 10 AS DOUBLE) END AS change_amount, CASE WHEN doc_id % 4 = 3 THEN 'unreadable' ELSE lang END AS reason FROM documents""")
def t13(t):
    d = F.col("doc_id")
    obj = F.to_json(F.struct(F.lit(True).alias("should_change"), (d % 20 - 10).alias("change_amount"), F.col("lang").alias("reason")))
    text = (
        F.when(d % 4 == 0, obj).when(d % 4 == 1, F.concat(F.lit("I think "), obj, F.lit(" fits.")))
        .when(d % 4 == 2, F.concat(F.lit("broken "), F.substring(obj, F.lit(1), F.length(obj) - 1), F.lit(', "x": ')))
        .otherwise("nothing to say")
    )
    fields = {"should_change": ("boolean", False), "change_amount": ("double", 0.0), "reason": ("string", "unreadable")}
    return TR.extract_json(t.documents.select("doc_id", text.alias("answer")), "answer", fields, "should_change").drop("answer")


@query("t15_title_variants", """WITH p AS (SELECT p_partkey AS id, p_name AS e FROM part)
SELECT id, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN e || ' game screenshot' WHEN 1 THEN e || ' gameplay screenshot' WHEN 2 THEN short || ' 游戏截图' WHEN 3 THEN short || ' Steam 截图' ELSE e || ' game' END AS phrase
FROM (SELECT id, e, CASE WHEN regexp_matches(e, '\\s+[A-Za-z0-9][A-Za-z0-9\\s:：\\-._]{2,}$') THEN regexp_replace(e, '\\s+[A-Za-z0-9][A-Za-z0-9\\s:：\\-._]{2,}$', '') ELSE e END AS short FROM p), (VALUES (0), (1), (2), (3), (4)) AS x(i)""")
def t15(t):
    return TR.title_variants(t.part.select(F.col("p_partkey").alias("id"), "p_name"), "id", "p_name")


@query("t17_infer_event_keys", f"WITH {fx.TOOL_EVENTS} SELECT seq, CAST(task_id AS INTEGER) AS task_id, note_id FROM tool_events")
def t17(t):
    return TR.infer_event_keys(fx.tool_events(t)).select("seq", "task_id", "note_id")


@query("j13_attach_notes", f"WITH {fx.TOOL_EVENTS}, last AS (SELECT task_id, arg_max(note_id, seq) AS note_id FROM tool_events WHERE note_id IS NOT NULL GROUP BY task_id) SELECT task_id, note_id, 'notes/note_' || note_id || '.md' AS note_path FROM (SELECT DISTINCT user_id AS task_id FROM events) LEFT JOIN last USING (task_id)")
def j13(t):
    from recollect.operators.events import attach_notes

    tasks = t.events.select(F.col("user_id").cast("int").alias("task_id")).distinct()
    return attach_notes(tasks, TR.infer_event_keys(fx.tool_events(t)))


# ---------------------------------------------------------------- sources and sinks

_VECTOR_CHECK = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings"


def _vector_check(vectors):
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return vectors.select("id", F.size("embedding").alias("n"), F.round(total, 6).alias("total"))


@query("s01_read_vectors", _VECTOR_CHECK)
def s01(t):
    """Snapshot objects, written bucket by bucket and read back."""
    path = work_path(t.spark, "vectors")
    S.write_vectors(fx.vectors(t).select(F.col("id").cast("string").alias("id"), "embedding"), path, "snapshot")
    return _vector_check(S.read_vectors(t.spark, path, "snapshot"))


@query("s02_write_vectors", _VECTOR_CHECK)
def s02(t):
    path = work_path(t.spark, "vectors")
    S.write_vectors(fx.vectors(t).select(F.col("id").cast("string").alias("id"), "embedding"), path)
    return _vector_check(S.read_vectors(t.spark, path))


@query("s03_graph_round_trip", f"WITH {fx.GRAPH} SELECT 'entities' AS part, count(*) AS n FROM entities UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'mentions', count(*) FROM mentions")
def s03(t):
    from recollect.operators.graph import graph_sizes

    path = work_path(t.spark, "graph")
    S.write_graph(fx.event_graph(t), path)
    return graph_sizes(S.read_graph(t.spark, path))


@query("s03_read_graph_snapshot", """WITH e AS (SELECT 'c' || conv_id AS entity_id, conv_id, turn FROM conversations) SELECT entity_id, CAST(turn AS VARCHAR) AS memory_id FROM e""")
def s03_snapshot(t):
    """One snapshot object per turn, read as one graph."""
    path = work_path(t.spark, "graph")
    c, m = F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn").cast("string")
    body = F.to_json(F.struct(
        F.array(F.struct(c.alias("id"), c.alias("name"), F.col("role").alias("type"))).alias("entities"),
        F.array(F.struct(m.alias("id"), c.alias("subjectId"), F.lit("SAID").alias("predicate"), F.col("role").alias("objectId"), m.alias("memoryId"))).alias("relations"),
        F.create_map(c, F.array(m)).alias("entityToMemories"), F.create_map(m, F.array(c)).alias("memoryToEntities")))
    t.conversations.select(body.alias("value")).write.text(path)
    return _jsonl_graph(t, path).mentions


def _jsonl_graph(t, path) -> Graph:
    return S.read_graph_snapshot(t.spark, path, multi_line=False)


@query("s04_open_store", """SELECT 'memory_items' AS "table", count(*) AS n FROM events UNION ALL SELECT 'episodes', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'chunks', sum(len(string_split(text, chr(10)))) FROM documents""")
def s04(t):
    path = work_path(t.spark, "store")
    memories = fx.stored_memories(t).select(F.col("id").cast("string").alias("id"), "content", "memory_type", "importance", "metadata", "created_at", "updated_at")
    episodes = fx.episodes(t).select(F.col("episode_id").cast("string").alias("episode_id"), F.col("session_id").cast("string").alias("session_id"), "ts", "content", "context")
    key = F.col("doc_id").cast("string")
    documents = t.documents.select(key.alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.create_map(F.lit("lang"), "lang").alias("metadata"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    chunks = t.documents.select(key.alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")).select(
        F.concat_ws(":", "doc_id", "chunk_index").alias("id"), "doc_id", "chunk_index", "content", F.lit(0).alias("start_char"), F.length("content").alias("end_char"), F.lit(None).cast("string").alias("heading_path"))
    S.save_store({"memory_items": memories, "episodes": episodes, "documents": documents, "chunks": chunks}, path)
    counts = [frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, frame in S.open_store(t.spark, path).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("s07_ingest_documents", r"""SELECT regexp_replace(text, '\s+', ' ', 'g') AS body FROM benchmark""")
def s07(t):
    """One text file per benchmark passage, each wrapped with its file name as heading."""
    path = work_path(t.spark, "files")
    t.benchmark.select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    got = D.ingest_documents(t.spark, path, "*.txt")
    body = F.regexp_replace(F.regexp_replace("content", r"^# \S+\n\n", ""), r"\s+", " ")
    return got.select(F.trim(body).alias("body"))


_PLAN_ROWS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag, l_linestatus, l_extendedprice, l_quantity, l_tax, l_discount, l_partkey, l_suppkey, l_shipdate FROM lineitem"


def _plans(t):
    """Line items as nested plans; fields are missing and meal types unknown now and then."""
    def meal(kind, name, cost):
        return F.struct(kind.alias("type"), name.alias("name"), cost.alias("cost"))

    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    day = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit(1).alias("day_index"),
        F.struct(F.col("l_suppkey").cast("string").alias("name"), F.col("l_tax").alias("price")).alias("hotel"),
        F.array(F.struct(F.col("l_partkey").cast("string").alias("name"), F.col("l_discount").alias("price"))).alias("attractions"),
        F.array(meal(F.when(flag == "A", "Dinner").when(flag == "N", "banquet"), F.col("l_linestatus"), F.col("l_extendedprice")),
                meal(F.lit("snack"), F.lit(None).cast("string"), F.when(q > 25, q))).alias("meals"))
    text, whole = F.lit(None).cast("string"), F.col("l_quantity").cast("int")
    weather = F.array(
        F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_linestatus").alias("day"), text.alias("night"), F.when(q > 25, whole).alias("temp")),
        F.struct(text.alias("date"), text.alias("day"), flag.alias("night"), F.lit(-1).alias("temp")))
    budget = F.struct(F.col("l_tax").alias("hotels"), F.col("l_extendedprice").alias("total"))
    return t.lineitem.select(F.to_json(F.struct(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(day).alias("days"), weather.alias("weather"), budget.alias("budget"))).alias("plan"))


@query("s08_flatten_meals", f"""WITH l AS ({_PLAN_ROWS})
SELECT id, 0 AS day, 0 AS pos, CASE l_returnflag WHEN 'A' THEN 'dinner' ELSE 'lunch' END AS type, l_linestatus AS name, l_extendedprice AS cost FROM l
UNION ALL SELECT id, 0, 1, 'snack', '', CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END FROM l""")
def s08(t):
    return D.flatten_plans(_plans(t), "plan")["meals"]


@query("s08_flatten_attractions", f"WITH l AS ({_PLAN_ROWS}) SELECT id, 0 AS day, 0 AS pos, CAST(l_partkey AS VARCHAR) AS name, '' AS address, 0 AS duration, l_discount AS price FROM l")
def s08_attractions(t):
    return D.flatten_plans(_plans(t), "plan")["attractions"]


@query("s08_flatten_weather", f"WITH l AS ({_PLAN_ROWS}) SELECT id, 0 AS pos, strftime(l_shipdate, '%Y-%m-%d') AS date, l_linestatus AS day, '' AS night, CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS temp FROM l UNION ALL SELECT id, 1, '', '', l_returnflag, -1 FROM l")
def s08_weather(t):
    return D.flatten_plans(_plans(t), "plan")["weather"]


@query("s08_flatten_hotels", f"WITH l AS ({_PLAN_ROWS}) SELECT id, 0 AS day, CAST(l_suppkey AS VARCHAR) AS name, '' AS address, l_tax AS price FROM l")
def s08_hotels(t):
    return D.flatten_plans(_plans(t), "plan")["hotels"]


@query("s08_flatten_days", f"WITH l AS ({_PLAN_ROWS}) SELECT id, 0 AS day, strftime(l_shipdate, '%Y-%m-%d') AS date, 1 AS day_index, '' AS description, '' AS transportation, '' AS accommodation FROM l")
def s08_days(t):
    return D.flatten_plans(_plans(t), "plan")["days"]


@query("s08_flatten_budget", f"WITH l AS ({_PLAN_ROWS}) SELECT id, 0.0 AS attractions, l_tax AS hotels, 0.0 AS meals, 0.0 AS transport, l_extendedprice AS total FROM l")
def s08_budget(t):
    return D.flatten_plans(_plans(t), "plan")["budget"]


def _note_rows(t):
    return t.benchmark.select(
        F.concat(F.lit("note_"), F.col("item_id").cast("string")).alias("id"), F.when(F.col("item_id") % 2 == 0, "a: \"quoted\" [title]").alias("title"),
        F.lit("").alias("type"), F.array(F.lit("x"), F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string"))).alias("tags"),
        F.lit("2024-01-01T00:00:00").alias("created_at"), F.lit("2024-01-02T00:00:00").alias("updated_at"),
        F.concat(F.lit("# Head "), F.col("item_id").cast("string"), F.lit("\n\n"), "text").alias("body"))


_NOTES_SQL = """SELECT 'note_' || item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'a: "quoted" [title]' ELSE 'Head ' || item_id END AS title, 'general' AS type, 'x,t' || item_id % 3 AS tags,
 '2024-01-01T00:00:00' AS created_at, '2024-01-02T00:00:00' AS updated_at, trim('# Head ' || item_id || chr(10) || chr(10) || text) AS body FROM benchmark"""


@query("s09_ingest_notes", _NOTES_SQL)
def s09(t):
    """Note texts of the whole table, parsed without a file between."""
    return D.parse_notes(D.note_text(_note_rows(t))).withColumn("tags", F.array_join("tags", ","))


@query("s10_write_notes", _NOTES_SQL)
def s10(t):
    path = work_path(t.spark, "notes")
    D.write_notes(_note_rows(t), path)
    return D.ingest_written_notes(t.spark, path).withColumn("tags", F.array_join("tags", ","))


# ---------------------------------------------------------------- dialogue logs


def _log_lines(t):
    """Every event as a dialogue in the log of its day; the start block of odd ones is written twice."""
    e = t.events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").cast("string").alias("u"), "value", F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).alias("ts"))

    def line(seconds, text):
        at = F.date_format(F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)), "HH:mm:ss")
        return F.concat(at, F.lit(" - "), text)

    rule = F.lit("=" * 60)
    start = [line(0, rule), line(0, F.concat(F.lit("💬 对话开始: n"), "u", F.lit(" <-> 玩家"))), line(0, rule), line(0, F.concat(F.lit("📝 玩家消息: hello "), F.col("event_id").cast("string")))]
    rest = [
        line(0, F.lit("💖 当前好感度: 50.0/100 (友好)")), line(1, F.lit("🧠 检索到2条相关记忆")), line(1, F.lit("🤖 正在生成回复...")),
        line(3, F.concat(F.lit("💬 n"), "u", F.lit("回复: fine: "), F.col("event_id").cast("string"))), line(3, F.lit("📊 正在分析好感度变化...")),
        F.when(F.col("event_id") % 3 == 0, line(5, F.lit("➡️ 好感度未变化 (当前: 50.0)"))).otherwise(line(5, F.lit("📈 好感度变化: 50.0 -> 52.0 (+2.0)"))),
        line(5, F.lit("  原因: polite")), line(5, F.lit("  情感: positive")), line(5, F.concat(F.lit("  💾 对话已保存到n"), "u", F.lit("的记忆中"))), line(6, F.lit("✅ 对话完成")), F.lit(""),
    ]
    lines = F.concat(F.array(*start), F.when(F.col("event_id") % 2 == 1, F.array(*start)).otherwise(F.array().cast("array<string>")), F.array(*rest))
    rows = e.select(F.concat(F.lit("log_"), "day").alias("file"), "event_id", F.posexplode(lines).alias("at", "value"))
    return rows.select("file", (F.col("event_id") * 100 + F.col("at")).alias("line"), "value")


_LOG = "talks AS (SELECT event_id, 'n' || user_id AS u, ts FROM events)"


@query("s11_dialogue_log_events", f"""WITH {_LOG}, kinds(kind, per) AS (VALUES ('start', 2), ('message', 2), ('affinity', 1), ('retrieval', 1), ('generating', 1), ('reply', 1), ('analysing', 1), ('reason', 1), ('sentiment', 1), ('saved', 1), ('end', 1))
SELECT kind, sum(CASE WHEN per = 2 AND event_id % 2 = 1 THEN 2 ELSE 1 END) AS n FROM talks, kinds GROUP BY kind
UNION ALL SELECT 'change', count(*) FROM talks WHERE event_id % 3 <> 0 UNION ALL SELECT 'unchanged', count(*) FROM talks WHERE event_id % 3 = 0""")
def s11(t):
    """Log files written from the events and read back, counted by kind of line."""
    path = work_path(t.spark, "log")
    lines = _log_lines(t)
    lines.repartitionByRange("file", "line").sortWithinPartitions("file", "line").select("value").write.text(path)
    events = L.read_dialogue_log(t.spark, path)
    return events.where(F.col("kind").isNotNull()).groupBy("kind").agg(F.count("*").alias("n"))


@query("w09_dialogue_sessions", f"""WITH {_LOG}
SELECT 'log_' || strftime(ts, '%Y-%m-%d') AS file, CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS INTEGER) AS dialogue, u AS subject, 'hello ' || event_id AS message, 'fine: ' || event_id AS reply,
 50.0 AS affinity, CASE WHEN event_id % 3 <> 0 THEN 2.0 END AS change, 2 AS retrieved, 'positive' AS sentiment, 1 AS retrieval_seconds, 2 AS reply_seconds, 2 AS analysis_seconds, 6 AS total_seconds, true AS complete FROM talks""")
def w09(t):
    return Q.line_sessions(_log_lines(t))

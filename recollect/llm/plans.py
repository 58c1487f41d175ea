"""The registered queries of the subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import chat, codes, decontaminate, hmm, jaccard, licenses, minhash, mixture, paragraphs, quality, suffixes, toxicity, whitening
from recollect.llm.common import held_out
from recollect.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader under a name."""

    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules")
def op1(table):
    return quality.quality_rules(table("documents"), table("labels"))


PLANTED_CHAT = "</s>[INST] ok [/INST]"

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), marked AS (
  SELECT *, bool_or(len(list_filter(['<s>', '</s>', '[INST]', '[/INST]', chr(92)], lambda m: contains(text, m) OR contains(role, m))) > 0
                    OR contains(role, chr(10)) OR contains(role, '~~') OR contains(role, '~n')) OVER (PARTITION BY conv_id) AS odd
  FROM rows
), escaped AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN odd THEN replace(replace(replace(replace(replace(text, chr(92), repeat(chr(92), 2)), '<s>', '<' || chr(92) || 's>'),
      '</s>', '<' || chr(92) || '/s>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]') ELSE text END AS shown,
    CASE WHEN odd THEN replace(replace(replace(replace(replace(replace(replace(role, chr(92), repeat(chr(92), 2)), '<s>', '<' || chr(92) || 's>'),
      '</s>', '<' || chr(92) || '/s>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'), '~', '~~'), chr(10), '~n') ELSE role END AS shown_role
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown_role) + length(shown) + 8)::BIGINT AS formatted_chars, true AS round_trip
FROM escaped GROUP BY conv_id
"""


@query("op6_chat_formatting", CHAT_SQL)
def op6(table):
    rows = table("conversations").select("conv_id", "turn", "role", "text")
    planted = rows.sparkSession.createDataFrame([(-7, 0, "user", PLANTED_CHAT), (-7, 1, "assistant", PLANTED_CHAT)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.with_loss_mask(chat.format_chats(rows.unionByName(planted))))


MIXTURE_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
), sources AS (
  SELECT s, sum(n_tokens)::DOUBLE AS tokens FROM sized GROUP BY s HAVING sum(n_tokens) > 0
), shares AS (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM sources) AS p FROM sources
), bisect AS (
  SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT k + 1, CASE WHEN even THEN mid ELSE low END, CASE WHEN even THEN high ELSE mid END
  FROM (SELECT k, low, high, (low + high) / 2 AS mid,
          (SELECT ln(sum(pow(p, (low + high) / 2))) - sum(pow(p, (low + high) / 2) * ln(pow(p, (low + high) / 2))) / sum(pow(p, (low + high) / 2))
                  >= 0.95 * ln(count(*)) - 1e-12 FROM shares) AS even
        FROM bisect WHERE k < 40)
), found AS (
  SELECT CASE WHEN (SELECT -sum(p * ln(p)) >= 0.95 * ln(count(*)) - 1e-12 FROM shares) THEN 1.0 ELSE round((SELECT max(low) FROM bisect WHERE k = 40), 9) END AS t
), weights AS (
  SELECT s, tokens, pow(p, t) / (SELECT sum(pow(p, t)) FROM shares, found) AS weight FROM shares, found
), placed AS (
  SELECT doc_id, source, s, n_tokens, weight, round(weight * (SELECT sum(tokens) FROM sources), 3) AS wanted,
         unnest(range(greatest(ceil(round(weight * (SELECT sum(tokens) FROM sources), 3) / tokens)::BIGINT, 1))) AS epoch
  FROM sized JOIN weights USING (s)
), hashed AS (SELECT *, md5('17-' || epoch || '-' || coalesce(doc_id::VARCHAR, '')) AS place FROM placed
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY s ORDER BY epoch, place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS begun FROM hashed
)
SELECT doc_id, source, epoch::INTEGER AS epoch, floor(begun / (weight * 1e6))::BIGINT AS block, place, n_tokens::BIGINT AS n_tokens,
       round(weight, 9) AS weight
FROM summed WHERE begun < wanted
"""


@query("op10_mixing_sources", MIXTURE_SQL)
def op10(table):
    return mixture.mix_sources(table("documents")).withColumn("weight", F.round("weight", 9))


LEAK_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), items AS (
  SELECT min(item_id) AS item_id, count(*) AS n_items,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark GROUP BY text
), item_shingles AS (
  SELECT DISTINCT item_id, n_items, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
widths AS (SELECT DISTINCT k FROM item_shingles),
doc_shingles AS (
  SELECT r, doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, widths WHERE len(w) >= k)
)
SELECT doc_id, item_id, any_value(n_items) AS n_items, any_value(n_shingles) AS n_shingles, count(DISTINCT s) AS n_found,
       count(DISTINCT s) / any_value(n_shingles) AS containment, min(i) - 1 AS first_word, max(i + k) - 2 AS last_word
FROM doc_shingles JOIN item_shingles USING (k, s) JOIN sizes USING (item_id)
GROUP BY r, doc_id, item_id HAVING count(DISTINCT s) >= 0.8 * any_value(n_shingles) - 1e-9
"""


@query("op9_benchmark_decontamination", LEAK_SQL)
def op9(table):
    return decontaminate.contaminated(table("documents"), table("benchmark"))


@query("op8_toxicity")
def op8(table):
    return toxicity.toxicity(table("documents"), table("labels"), held_out(F.col("doc_id"), 4, 2))


@query("op5_license_scans")
def op5(table):
    return licenses.license_scan(table("documents"))


JACCARD_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - least(len(w), 3) + 2),
         lambda i: array_to_string(w[i:i + least(len(w), 3) - 1], ' ')))) END AS s FROM docs
), classes AS (
  SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), held AS (
  SELECT c, n, unnest(s) AS g FROM classes
), linked AS (
  SELECT x.c AS a, y.c AS b FROM held x JOIN held y ON x.g = y.g AND x.c < y.c AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reached AS (
  SELECT a AS c, b AS r FROM edges UNION SELECT r.c, e.b FROM reached r JOIN edges e ON r.r = e.a
), least AS (SELECT c, min(r) AS r FROM reached GROUP BY c)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(least(least.r, classes.c), doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least USING (c)
"""


@query("op4_ngram_jaccard_join", JACCARD_SQL)
def op4(table):
    return jaccard.jaccard_components(table("documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_substring_dedup")
def op7(table):
    return paragraphs.paragraph_dedup(table("documents"))


@query("op2_lm_scoring")
def op2(table):
    return hmm.language_model_scores(table("documents"), held_out(F.col("doc_id"), 10, 0))


@query("op3_suffix_array_dedup")
def op3(table):
    return suffixes.repeated_bytes(table("documents"))


MINHASH_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - least(len(w), 2) + 2),
         lambda i: array_to_string(w[i:i + least(len(w), 2) - 1], ' ')))) END AS s FROM docs
), classes AS (
  SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), held AS (
  SELECT c, n, unnest(s) AS g FROM classes
), linked AS (
  SELECT x.c AS a, y.c AS b FROM held x JOIN held y ON x.g = y.g AND x.c < y.c AND 10 * least(x.n, y.n) >= 8 * greatest(x.n, y.n)
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reached AS (
  SELECT a AS c, b AS r FROM edges UNION SELECT r.c, e.b FROM reached r JOIN edges e ON r.r = e.a
), least AS (SELECT c, min(r) AS r FROM reached GROUP BY c)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(least(least.r, classes.c), doc_id) AS component_id,
       coalesce(least(least.r, classes.c), doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least USING (c)
"""


@query("op12_minhash_near_dedup", MINHASH_SQL)
def op12(table):
    return minhash.minhash_components(table("documents"))


def codes_sql() -> str:
    """Every part against every entry, twice to move the entries and once to assign."""
    rounds = []
    for k in range(3):
        rounds.append(f"""near{k} AS (
  SELECT vec_id, p, min({{'d': d, 'e': e}}) AS m
  FROM (SELECT x.vec_id, x.p, b.e, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS d FROM points x JOIN book{k} b ON x.p = b.p AND x.i = b.i GROUP BY x.vec_id, x.p, b.e)
  GROUP BY vec_id, p
)""")
        if k < 2:
            rounds.append(f"""book{k + 1} AS (
  SELECT b.p, b.e, b.i, coalesce(t.c, b.c) AS c
  FROM book{k} b LEFT JOIN (SELECT x.p, n.m.e AS e, x.i, floor(sum(x.c)::DOUBLE / count(*))::BIGINT AS c FROM points x JOIN near{k} n USING (vec_id, p) GROUP BY ALL) t
    ON b.p = t.p AND b.e = t.e AND b.i = t.i
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), points AS (
  SELECT vec_id, (i * 16) // len(v) AS p, i % (len(v) // 16) AS i, v[i + 1] AS c FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)
), firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (SELECT p, e, i, c FROM points JOIN firsts USING (vec_id)),
{", ".join(rounds)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query("op11_vector_codes", codes_sql())
def op11(table):
    return codes.vector_codes(table("embeddings"))


@query("op13_embedding_whitening")
def op13(table):
    return whitening.whitened(table("embeddings"))

"""Scored top-k retrieval for whole query tables.

Every operator takes a table of queries and returns at most k rows per query. Scores are rounded to six digits before
ranking and ties are broken by id, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions.ranking import first_per_key, top_per_key
from recollect.operators.graph import Graph, graph_search
from recollect.session import stored
from recollect.functions.matching import substring_hits
from recollect.functions.similarity import DIGITS, RANK_DIGITS, cosine_hits

DEFAULT_K = 5


def _k(k: int) -> int:
    return k if k > 0 else DEFAULT_K


def _rank(df: DataFrame, k: int, id_col: str = "id", score: str = "score") -> DataFrame:
    fine = df.withColumn(score, F.round(score, RANK_DIGITS))
    return top_per_key(fine, ["query_id"], [F.desc(score), F.asc(id_col)], k).withColumn(score, F.round(score, DIGITS))


def topk_cosine(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_K, **kw) -> DataFrame:
    """Best k positive cosines per query: (query_id, id, score, rank)."""
    return cosine_hits(queries, vectors, _k(k), **kw)


def all_hits(queries: DataFrame, vectors: DataFrame, **kw) -> DataFrame:
    """All positive cosines per query: (query_id, id, score)."""
    return cosine_hits(queries, vectors, None, **kw)


def sparse_pairs(queries: DataFrame, vectors: DataFrame, on: list[str]) -> DataFrame:
    """(query_id, id, score) of sparse vectors given as (…on, weight) rows; cosine > 0 only.

    ``on`` holds the term or slot column and, where retrieval is scoped, the owner columns before it.
    """
    scope = on[:-1]
    q = queries.select(*on, "query_id", F.col("weight").alias("_a"))
    v = vectors.select(*on, "id", F.col("weight").alias("_b"))
    q_norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("_a") * F.col("_a"))).alias("_qa"))
    v_norm = v.groupBy(*scope, "id").agg(F.sqrt(F.sum(F.col("_b") * F.col("_b"))).alias("_vb"))
    dots = q.join(v, on).groupBy(*scope, "query_id", "id").agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
    joined = dots.join(q_norm, "query_id").join(v_norm, [*scope, "id"])
    denominator = F.col("_qa") * F.col("_vb")
    score = F.when(denominator == 0, 0.0).otherwise(F.col("_dot") / denominator)
    return joined.select(*scope, "query_id", "id", score.alias("score")).where(F.round("score", RANK_DIGITS) > 0)


HOT_LIST = 10_000  # rows of a term from which on its list is spread
SALTS = 32
FEW = 1 << 18  # rows of the queries, or ids, that are broadcast


def sparse_join(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(query_id, id, score) of all sparse vectors with a cosine of at least ``least`` > 0; exact.

    ``queries``: (query_id, term, weight), ``vectors``: (id, term, weight), one row per term; the vectors are read twice. Both are scaled to length 1. A term's greatest weight in the vectors bounds
    what it can add to a query's cosine: of a query's terms, the most frequent ones first, as many as together stay below ``least`` are no reason to look at a
    vector, since a vector that shares only those cannot reach it. So the lists that are joined are those of a query's rarer terms. The products of these terms are summed at once, and only the
    pairs that can reach ``least`` with what the frequent terms may add to their sum are looked up in the lists of those.

    The rows of the vectors are shuffled once, by id, with a number for the term, and only those of terms that a query has. Queries of up to ``FEW`` rows travel to the lists; of more, lists and
    queries are shuffled, and lists of more than ``HOT_LIST`` rows are spread over ``SALTS`` keys.
    """
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("query_id")))
    scaled = queries.select("query_id", "term", "weight", norm.alias("_norm")).where("_norm > 0")
    q = stored(scaled.select("query_id", "term", (F.col("weight") / F.col("_norm")).alias("w")).where("w <> 0"))
    few = q.count() <= FEW
    small = F.broadcast if few else (lambda df: df)
    asked = stored(q.select("term").distinct().withColumn("_code", F.monotonically_increasing_id()))
    norms = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm")).where("_norm > 0")
    # A term that no query has adds nothing. Stored with the length beside it, the weights of a term are often the same.
    rows = stored(vectors.join(small(asked), "term").select("id", "_code", "weight").join(norms, "id"))
    v = rows.select("id", "_code", (F.col("weight") / F.col("_norm")).alias("_b")).where("_b <> 0")
    terms = stored(v.groupBy("_code").agg(F.max(F.abs("_b")).alias("_most"), F.count("*").alias("_n")))
    # The terms of one query, its most frequent first: what they and those before them can add at most.
    upto = Window.partitionBy("query_id").orderBy(F.desc("_n"), "_code").rowsBetween(Window.unboundedPreceding, 0)
    bounded = stored(q.join(asked, "term").join(terms, "_code").withColumns({
        "_can": F.sum(F.abs("w") * F.col("_most")).over(upto), "_long": F.sqrt(F.sum(F.col("w") * F.col("w")).over(upto))}))
    is_searched = F.col("_can") >= least * (1 - 1e-9)
    searched, others = bounded.where(is_searched), bounded.where(~is_searched)
    if few:
        products = v.join(F.broadcast(searched.select("query_id", "_code", "w")), "_code")
    else:
        keys = F.when(F.col("_n") > HOT_LIST, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        wanted = searched.select("query_id", "_code", "w", F.explode(keys).alias("_salt"))
        # A hot term's rows go to its salts by id; there are at most rows / HOT_LIST such terms.
        hot = F.broadcast(terms.where(F.col("_n") > HOT_LIST).select("_code", F.lit(True).alias("_hot")))
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
        products = wanted.join(v.join(hot, "_code", "left").select("id", "_code", "_b", salt.alias("_salt")), ["_code", "_salt"])
    sums = products.groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("_b")).alias("score"))
    more = others.groupBy("query_id").agg(F.least(F.max("_can"), F.max("_long")).alias("_more"))
    near = sums.join(more, "query_id", "left").where(F.col("score") + F.coalesce("_more", F.lit(0.0)) >= least * (1 - 1e-9))
    near = stored(near.select("query_id", "id", "score"))
    frequent = v.join(small(others.select("_code").distinct()), "_code", "left_semi")
    ids = stored(near.select("id").distinct())
    if ids.count() <= FEW:
        frequent = frequent.join(F.broadcast(ids), "id", "left_semi")
    added = near.select("query_id", "id").join(small(others.select("query_id", "_code", "w")), "query_id").join(frequent, ["id", "_code"])
    found = near.unionByName(added.select("query_id", "id", (F.col("w") * F.col("_b")).alias("score")))
    return found.groupBy("query_id", "id").agg(F.sum("score").alias("score")).where(F.round("score", RANK_DIGITS) >= least)


def enrich_hits(hits: DataFrame, chunks: DataFrame, documents: DataFrame, missing_title: str = "(deleted)") -> DataFrame:
    """Add chunk and document columns; a hit without its chunk drops, a missing document gets the placeholder."""
    docs = documents.select(F.col("doc_id"), F.col("title"))
    joined = hits.join(chunks, "id").join(docs, "doc_id", "left")
    return joined.withColumn("title", F.coalesce("title", F.lit(missing_title)))


def combine_hits(vector_hits: DataFrame, graph_hits: DataFrame) -> DataFrame:
    """(query_id, id, vector_score, graph_score) with 0 for the missing side."""
    v = vector_hits.select("query_id", "id", F.col("score").alias("vector_score"))
    g = graph_hits.select("query_id", "id", F.col("score").alias("graph_score"))
    joined = v.join(g, ["query_id", "id"], "full_outer")
    return joined.select(
        "query_id", "id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("graph_score", F.lit(0.0)).alias("graph_score"),
    )


def restrict_candidates(hits: DataFrame, candidates: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits whose id is a candidate."""
    return hits.join(candidates.select(id_col), id_col, "left_semi")


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5) -> DataFrame:
    """Pool of max(3k, 30) by cosine, then 0.6 cosine + 0.4 keyword share, best k.

    ``queries``: (query_id, text); ``chunks``: (id, content); vectors carry ``embedding``.
    """
    pool = topk_cosine(query_vectors, vectors, max(3 * k, 30), digits=RANK_DIGITS).select("query_id", "id", F.col("score").alias("cos"))
    keys = queries.select("query_id", X.long_words("text").alias("_keys"))
    joined = pool.join(chunks.select("id", "content"), "id").join(keys, "query_id")
    share = X.keyword_array_share("_keys", F.lower("content"))
    scored = joined.select("query_id", "id", (F.col("cos") * 0.6 + share * 0.4).alias("score"))
    return _rank(scored, k)


def expanded_search(
    variants: DataFrame, vectors: DataFrame, k: int = 5, pool_multiplier: int = 4, min_score: float | None = None
) -> DataFrame:
    """Search every variant of a query and keep the best score per hit.

    ``variants``: (query_id, variant, embedding) and, where known, text: blank texts and repeats of a text within a query
    are left out first, since they count among a query's m variants, each of which fetches
    max(1, max(k * multiplier, 20) div m) hits.
    """
    if "text" in variants.columns:
        plain = variants.withColumn("_text", X.strip("text")).where(F.col("_text") != "")
        variants = first_per_key(plain, ["query_id", "_text"], [F.asc("variant")]).drop("_text")
    pool = max(k * pool_multiplier, 20)
    counts = variants.groupBy("query_id").agg(F.count("*").alias("_m"))
    keyed = variants.withColumn("_vkey", F.to_json(F.struct("query_id", "variant")))
    hits = cosine_hits(keyed, vectors, pool, query_id="_vkey", digits=RANK_DIGITS)
    back = keyed.select("_vkey", "query_id")
    joined = hits.join(back, "_vkey").join(counts, "query_id")
    per_variant = F.greatest(F.lit(1), F.floor(F.lit(pool) / F.col("_m")))
    kept = joined.where(F.col("rank") <= per_variant)
    if min_score is not None:
        kept = kept.where(F.col("score") >= min_score)
    best = kept.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return _rank(best, k)


def apply_ranking(candidates: DataFrame, responses: DataFrame, k: int) -> DataFrame:
    """Reorder candidates by 1-based numbers found in a response text.

    ``candidates``: (query_id, id, rank); ``responses``: (query_id, response). Numbers out of range and repeats are
    dropped, and the original order fills up to k. A query with at most k candidates keeps its order.
    """
    totals = candidates.groupBy("query_id").agg(F.max("rank").alias("_n"))
    found = F.regexp_extract_all(F.coalesce("response", F.lit("")), F.lit(r"\d+"), F.lit(0))
    numbers = F.transform(found, lambda x: x.try_cast("long"))
    wanted = responses.select("query_id", F.array_distinct(numbers).alias("_numbers"))
    joined = candidates.join(totals, "query_id").join(wanted, "query_id", "left")
    position = F.when(F.col("_n") > k, F.array_position("_numbers", F.col("rank").cast("long")))
    placed = joined.withColumn("_pos", position)
    order = [F.asc(F.coalesce(F.col("_pos"), F.lit(0)) == 0), F.asc("_pos"), F.asc("rank")]
    ranked = top_per_key(placed, ["query_id"], order, k, "_new")
    return ranked.select("query_id", "id", F.col("rank").alias("original_rank"), F.col("_new").alias("rank"))


def working_search(queries: DataFrame, items: DataFrame, as_of: str, k: int = 5, owner: str = "owner") -> DataFrame:
    """Search each owner's working memory: (query_id, owner, text) against (owner, id, content, importance, created_at).

    Working memory is bounded by its capacity (see ``replay_capacity``), so a query meets a bounded number of items.
    """
    q_tf = _owner_tf(queries, owner, "query_id", "text")
    v_tf = _owner_tf(items, owner, "id", "content")
    df = v_tf.groupBy(owner, "term").agg(F.count("*").alias("df"))
    n = items.groupBy(owner).agg(F.count("*").alias("n"))

    def weigh(tf: DataFrame) -> DataFrame:
        joined = tf.join(n, owner).join(df, [owner, "term"], "left")
        idf = F.ln(F.col("n").cast("double") / (1 + F.coalesce("df", F.lit(1))))
        return joined.withColumn("weight", F.col("tf") * idf)

    cos = sparse_pairs(weigh(q_tf), weigh(v_tf), [owner, "term"]).withColumnRenamed("score", "cos")
    pairs = queries.join(items, owner).join(cos, [owner, "query_id", "id"], "left")
    kw = X.keyword_share("text", "content")
    base = F.when(F.col("cos") > 0, F.col("cos") * 0.7 + kw * 0.3).otherwise(kw)
    score = base * X.recency("created_at", as_of, "MINUTE") * X.importance_weight("importance")
    scored = pairs.select("query_id", owner, "id", score.alias("score"))
    return _rank(scored.where(F.round("score", RANK_DIGITS) > 0), _k(k))


def _owner_tf(df: DataFrame, owner: str, key: str, text: str) -> DataFrame:
    words = df.select(owner, key, F.explode(X.tokens(text)).alias("term"))
    return words.groupBy(owner, key, "term").agg(F.count("*").alias("tf"))


def _blend(hits: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """(0.8 cosine + 0.2 recency) * importance weight."""
    joined = hits.join(items.select("id", "importance", "created_at"), "id")
    base = F.col("score") * 0.8 + X.recency("created_at", as_of, "HOUR") * 0.2
    weight = X.importance_weight(F.coalesce("importance", F.lit(0.5)))
    return joined.select("query_id", "id", (base * weight).alias("score"))


def episodic_search(
    query_vectors: DataFrame,
    vectors: DataFrame,
    episodes: DataFrame,
    as_of: str,
    k: int = 5,
    candidates: DataFrame | None = None,
    filter_mode: str = "pre",
    user_id: str | None = None,
    user: str = "user_id",
) -> DataFrame:
    """Cosine pool of max(5k, 50) cut to 5k, structured filter, recency and importance blend, best k.

    ``candidates`` is the outcome of ``filter_episodes``. With ``filter_mode="pre"`` it limits the corpus before the
    pool is cut; with ``"post"`` it only removes rows of the pool and may leave fewer than k. The same holds for
    ``user_id``, the owner in the ``user`` column of the episodes: "post" applies it between the two cuts of the pool.
    """
    own = None if user_id is None else episodes.where(F.col(user) == user_id)
    corpus = vectors if own is None or filter_mode == "post" else restrict_candidates(vectors, own)
    if candidates is not None and filter_mode == "pre":
        corpus = restrict_candidates(corpus, candidates)
    # The larger pool matters only where the user filter sits between the two cuts.
    between = own is not None and filter_mode == "post"
    pool = topk_cosine(query_vectors, corpus, max(5 * _k(k), 50) if between else 5 * _k(k), digits=RANK_DIGITS).drop("rank")
    if between:
        pool = top_per_key(restrict_candidates(pool, own), ["query_id"], [F.desc("score"), F.asc("id")], 5 * _k(k), None)
    if candidates is not None and filter_mode == "post":
        pool = restrict_candidates(pool, candidates)
    return _rank(_blend(pool, episodes, as_of), _k(k))


def semantic_search(
    query_vectors: DataFrame,
    vectors: DataFrame,
    query_entities: DataFrame,
    graph: Graph,
    items: DataFrame,
    k: int = 5,
    user_id: str | None = None,
    user: str = "user_id",
) -> DataFrame:
    """Vector top 2k and graph top 2k, (0.7 vector + 0.3 graph) * importance weight, best k.

    With ``user_id`` both halves search the items of that owner only, so neither is cut before the owner's items are known.
    """
    candidates = None
    if user_id is not None:
        items = items.where(F.col(user) == user_id)
        vectors, candidates = restrict_candidates(vectors, items), items.select(F.col("id").alias("memory_id"))
    graph_hits = graph_search(query_entities, graph, k, candidates=candidates)
    hits = topk_cosine(query_vectors, vectors, 2 * _k(k), digits=RANK_DIGITS)
    both = combine_hits(hits, graph_hits)
    joined = both.join(items.select("id", "importance", F.lit(True).alias("_known")), "id", "left")
    base = F.col("vector_score") * 0.7 + F.col("graph_score") * 0.3
    score = base * X.importance_weight(F.coalesce("importance", F.lit(0.5)))
    ranked = _rank(joined.select("query_id", "id", score.alias("score"), "_known"), _k(k))
    # An item that no longer exists keeps its place in the ranking but is not returned.
    return ranked.where("_known").drop("_known")


def modality_search(
    query_vectors: DataFrame,
    vectors: DataFrame,
    items: DataFrame,
    as_of: str,
    k: int = 5,
    modality: str = "modality",
    user_id: str | None = None,
    user: str = "user_id",
) -> DataFrame:
    """Search within the query's modality: pool of 5k, then the recency and importance blend, best k.

    With ``user_id`` only vectors of that owner's items are searched.
    """
    if user_id is not None:
        vectors = restrict_candidates(vectors, items.where(F.col(user) == user_id))
    pool = cosine_hits(query_vectors, vectors, 5 * _k(k), scope=modality, digits=RANK_DIGITS).drop("rank")
    return _rank(_blend(pool, items, as_of), _k(k))


def filter_hits(hits: DataFrame, items: DataFrame, user_id: str | None = None, modality: str | None = None) -> DataFrame:
    """Hits whose item exists and has the wanted user and modality (missing modality means text)."""
    wanted = items
    if user_id is not None:
        wanted = wanted.where(F.try_element_at("metadata", F.lit("user_id")) == user_id)
    if modality is not None:
        actual = F.coalesce(F.try_element_at("metadata", F.lit("modality")), F.lit("text"))
        wanted = wanted.where(actual == modality)
    return hits.join(wanted.select("id"), "id", "left_semi")


def search_all(branches: list[DataFrame], k: int) -> DataFrame:
    """Merge ranked branches (query_id, id, memory_type, importance, rank): each up to max(k, 10), by importance."""
    per_type = max(k, 10)
    merged = branches[0].where(F.col("rank") <= per_type)
    for branch in branches[1:]:
        merged = merged.unionByName(branch.where(F.col("rank") <= per_type))
    order = [F.desc("importance"), F.asc("memory_type"), F.asc("id")]
    ranked = top_per_key(merged.withColumnRenamed("rank", "type_rank"), ["query_id"], order, k if k > 0 else 2**31 - 1)
    return ranked.select("query_id", "id", "memory_type", "importance", "rank")


def notes_for_queries(queries: DataFrame, notes: DataFrame, k: int, note_type: str = "blocker") -> DataFrame:
    """Up to k notes per query: notes of the priority type first, then notes holding the query text; newest first.

    ``queries``: (query_id, text); ``notes``: (id, title, type, body, updated_at).
    """
    newest = [F.desc("updated_at"), F.asc("id")]
    # The priority list is the same for every query and needs at most k rows.
    top = notes.where(F.col("type") == note_type).select("updated_at", "id").orderBy(*newest).limit(k)
    listed = top.agg(F.collect_list(F.struct("id", "updated_at")).alias("p")).scalar()
    first = queries.select("query_id", F.explode(listed).alias("n")).select("query_id", "n.id", "n.updated_at")
    target = F.lower(F.concat_ws(" ", "title", "body"))
    phrases = queries.where(~X.blank("text")).select("query_id", F.lower("text").alias("phrase"))
    hits = substring_hits(phrases, notes.select("id", target.alias("text")))
    dated = hits.join(notes.select("id", "updated_at"), "id")
    # k priority rows may repeat among the hits, so 2k hits are enough to fill k places.
    best_hits = top_per_key(dated, ["query_id"], newest, 2 * k, None)
    both = first.withColumn("_p", F.lit(0)).unionByName(best_hits.withColumn("_p", F.lit(1)))
    once = first_per_key(both, ["query_id", "id"], [F.asc("_p")])
    ranked = top_per_key(once, ["query_id"], [F.asc("_p"), *newest], k)
    return ranked.select("query_id", "id", (F.col("_p") == 0).alias("priority"), "rank")


def jaccard_relevance(pairs: DataFrame, a: str, b: str, out: str = "relevance") -> DataFrame:
    """Jaccard similarity of the token sets of two text columns."""
    return pairs.withColumn(out, X.jaccard(X.long_words(a), X.long_words(b)))


"""Assembling contexts for queries: gather packets, score them, fill a token budget, lay out sections.

packets: (query_id, packet_id, content, ts, tokens, relevance, type)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions.ranking import top_per_key

PACKET = ["query_id", "packet_id", "content", "ts", "tokens", "relevance", "type"]

# Relevance of a note by its type, and of the history.
NOTE_RELEVANCE = {"blocker": 0.9, "action": 0.8, "task_state": 0.75, "conclusion": 0.7}
OTHER_NOTE = 0.6
HISTORY_RELEVANCE = 0.6
HISTORY_ROWS = 5
SALTS = 16


@dataclass(frozen=True)
class ContextConfig:
    max_tokens: int = 3000
    reserve: float = 0.2
    min_relevance: float = 0.1
    recency_weight: float = 0.3
    relevance_weight: float = 0.7

    def __post_init__(self):
        if self.max_tokens <= 0 or not 0 <= self.reserve < 1:
            raise ValueError("max_tokens must be positive and reserve within [0, 1)")
        if abs(self.recency_weight + self.relevance_weight - 1) > 1e-6:
            raise ValueError("the two weights must add up to 1")

    @property
    def budget(self) -> int:
        return int(self.max_tokens * (1 - self.reserve))


def _packets(df: DataFrame, prefix: str, id_col: str, content: Column, ts: Column, relevance: Column, kind: str, tokens: Column | None = None) -> DataFrame:
    return df.select(
        "query_id", F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("packet_id"), content.alias("content"),
        ts.cast("timestamp_ntz").alias("ts"), X.approx_tokens(content if tokens is None else tokens).alias("tokens"),
        X.clamp(relevance, 0.0, 1.0).alias("relevance"), F.lit(kind).alias("type"),
    )


def gather_packets(
    as_of: str,
    instructions: DataFrame | None = None,
    memories: DataFrame | None = None,
    chunks: DataFrame | None = None,
    history: DataFrame | None = None,
    notes: DataFrame | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """One packet table from all sources; every source carries query_id.

    instructions (content), memories (id, content, memory_type, importance), chunks (id, content, score),
    history (turn, role, content, ts: the last five are taken), notes (id, title, type, body, updated_at), custom packets.
    """
    now = F.lit(as_of)
    parts = []
    if instructions is not None:
        parts.append(_packets(instructions.where(~X.blank("content")), "system", "query_id", F.col("content"), now, F.lit(1.0), "system_instruction"))
    if memories is not None:
        parts.append(_packets(memories, "memory:", "id", F.concat(F.lit("["), F.col("memory_type"), F.lit("] "), F.col("content")), now, F.col("importance"), "memory", F.col("content")))
    if chunks is not None:
        parts.append(_packets(chunks.where(~X.blank("content")), "chunk:", "id", F.col("content"), now, F.col("score"), "rag"))
    if history is not None:
        recent = top_per_key(history, ["query_id"], [F.desc("turn")], HISTORY_ROWS, None)
        parts.append(_packets(recent, "turn:", "turn", F.concat(F.col("role"), F.lit(": "), F.col("content")), F.col("ts"), F.lit(HISTORY_RELEVANCE), "conversation_history", F.col("content")))
    if notes is not None:
        by_type = F.create_map(*[F.lit(x) for kv in NOTE_RELEVANCE.items() for x in kv])
        # The captions of a note packet.
        content = F.concat(F.lit("[笔记:"), F.col("title"), F.lit("]\n类型: "), F.col("type"), F.lit("\n\n"), F.col("body"))
        parts.append(_packets(notes, "note:", "id", content, F.col("updated_at"), F.coalesce(F.try_element_at(by_type, F.col("type")), F.lit(OTHER_NOTE)), "note"))
    if custom is not None:
        parts.append(custom.select(*PACKET))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_packets(packets: DataFrame, queries: DataFrame, as_of: str, config: ContextConfig = ContextConfig()) -> DataFrame:
    """Add ``score`` and drop packets of too little relevance; system packets pass with a null score.

    A relevance at its default of 0.5, or a true ``force_recalc`` column, is replaced by the Jaccard similarity of
    packet and query.
    """
    texts = queries.select("query_id", X.long_words("text").alias("_q"))
    joined = packets.join(texts, "query_id", "left")
    asked = F.coalesce("_q", F.array().cast("array<string>"))
    recalc = F.abs(F.col("relevance") - 0.5) < 0.001
    if "force_recalc" in packets.columns:
        recalc = recalc | F.coalesce("force_recalc", F.lit(False))
    system = F.col("type") == "system_instruction"
    relevance = F.when(recalc & ~system, X.jaccard(X.long_words("content"), asked)).otherwise(F.col("relevance"))
    scored = joined.withColumn("relevance", relevance)
    score = F.col("relevance") * config.relevance_weight + X.recency("ts", as_of, "SECOND", 0.1) * config.recency_weight
    scored = scored.withColumn("score", F.when(~system, F.round(score, 6)))
    return scored.where(system | (F.col("relevance") >= config.min_relevance)).drop("_q")


def fill_budget(packets: DataFrame, budget: int, key: str = "query_id", id_col: str = "packet_id") -> DataFrame:
    """Take packets by score while they fit; one that does not fit is skipped and the next is tried.

    System packets (null score) come first and may use up the budget, and then nothing else is taken. Returns the
    selected packets.

    Once a packet of t tokens has been refused, every later one of t or more is refused too, so of the packets with
    t tokens only the first ``budget // t`` can ever be taken. That leaves a bounded number per query (budget times
    the harmonic sum of budget) for the fold, and packets without tokens always fit.
    """
    system = packets.where(F.col("score").isNull())
    others = packets.where(F.col("score").isNotNull())
    used = system.groupBy(key).agg(F.sum("tokens").alias("_used"))
    free = others.join(used, key, "left").withColumn("_left", F.lit(budget) - F.coalesce("_used", F.lit(0)))
    free = free.where((F.col("_left") > 0) & (F.col("tokens") <= F.col("_left"))).drop("_used")
    weightless = free.where(F.col("tokens") <= 0)
    weighted = free.where(F.col("tokens") > 0)
    order = [F.desc("score"), F.asc(id_col)]
    # Two steps, so that one query with very many packets of one size is first cut in salted parts.
    best = weighted.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    for group in ([key, "tokens", "_salt"], [key, "tokens"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        best = best.withColumn("_n", place).where(F.col("_n") <= F.floor(F.col("_left") / F.col("tokens")))
    listed = best.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col(id_col).alias("i"), F.col("tokens").alias("t")))).alias("ps"),
        F.first("_left").alias("_left"),
    )
    start = F.struct(F.col("_left").cast("long").alias("free"), F.array().cast("array<string>").alias("taken"))

    def take(state: Column, p: Column) -> Column:
        fits = p["t"] <= state["free"]
        return F.when(fits, F.struct(
            (state["free"] - p["t"]).cast("long").alias("free"), F.array_append(state["taken"], p["i"].cast("string")).alias("taken"),
        )).otherwise(state)

    taken = listed.select(key, F.explode(F.aggregate("ps", start, take)["taken"]).alias(id_col))
    columns = packets.columns
    chosen = weighted.select(*columns).join(taken, [key, id_col], "left_semi")
    return system.select(*columns).unionByName(weightless.select(*columns)).unionByName(chosen.select(*columns))


# The section titles, in order, and the closing request.
SECTIONS = ["[Role & Policies]", "[Task]", "[Evidence]", "[Context]", "[Output]"]
CLOSING = "请基于以上信息，提供准确、有据的回答。"


def assemble_context(packets: DataFrame, queries: DataFrame, id_col: str = "packet_id") -> DataFrame:
    """(query_id, context) with the sections in order; empty sections are left out.

    The packets are those a token budget selected, so the text of a query is bounded by it.
    """
    kind = F.col("type")
    group = F.when(kind == "system_instruction", 0).when(kind.isin("rag", "knowledge"), 2).otherwise(3)
    rows = packets.select("query_id", group.alias("g"), F.struct(
        (-F.coalesce("score", F.lit(0.0))).alias("o"), F.col(id_col).alias("i"), F.col("content").alias("c")).alias("p"))
    grouped = rows.groupBy("query_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("g") == g, F.col("p")))).alias(f"g{g}") for g in (0, 2, 3)
    ])
    joined = queries.select("query_id", "text").join(grouped, "query_id", "left")

    def section(title: str, col: str, sep: str) -> Column:
        texts = F.transform(F.col(col), lambda p: p["c"])
        return F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0, F.concat(F.lit(title + "\n"), F.array_join(texts, sep)))

    context = F.concat_ws(
        "\n\n",
        section(SECTIONS[0], "g0", "\n"),
        F.concat(F.lit(SECTIONS[1] + "\n"), F.col("text")),
        section(SECTIONS[2], "g2", "\n---\n"),
        section(SECTIONS[3], "g3", "\n"),
        F.lit(f"{SECTIONS[4]}\n{CLOSING}"),
    )
    return joined.select("query_id", context.alias("context"))


def numbered_sources(hits: DataFrame) -> DataFrame:
    """(query_id, context, sources): hits in rank order as numbered evidence with their chapter.

    ``hits``: top-k rows (query_id, rank, title, heading_path, content), so a query has at most k.
    """
    number = F.col("rank").cast("string")
    # The captions of a numbered source.
    chapter = F.when(F.col("heading_path").isNotNull(), F.concat(F.lit(" [章节: "), F.col("heading_path"), F.lit("]"))).otherwise("")
    text = F.concat(F.lit("【来源"), number, F.lit("】"), chapter, F.lit("\n"), F.col("content"), F.lit("\n"))
    source = F.when(F.col("title").isNotNull(), F.concat(F.lit("来源"), number, F.lit(": "), F.col("title")))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t"), source.alias("s")))).alias("r"))
    return rows.select(
        "query_id", F.array_join(F.transform("r", lambda x: x["t"]), "").alias("context"),
        F.array_join(F.transform("r", lambda x: x["s"]), "\n").alias("sources"),
    )


# Fixed value: the mark at the end of a shortened section.
CUT_MARK = "\n[... 内容已压缩 ...]"


def compress_sections(df: DataFrame, col: str, max_tokens: int, out: str = "compressed", sep: str = "\n\n") -> DataFrame:
    """Shorten a text of blank-line separated sections to the token limit.

    Sections are kept until one does not fit. That one is cut by its own characters-per-token ratio where more than 50
    tokens are left, and everything after it goes. The text of a row is the unit of work, so no shuffle is needed.
    """
    text = F.coalesce(F.col(col), F.lit(""))
    # Trailing empty sections do not count.
    parts = F.split(F.regexp_replace(text, f"({sep})+$", ""), sep)
    sized = F.transform(parts, lambda s: F.struct(s.alias("s"), X.approx_tokens(s).alias("t")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"), F.lit(False).alias("full"))

    def step(state: Column, p: Column) -> Column:
        fits = ~state["full"] & (state["total"] + p["t"] <= max_tokens)
        return F.struct(
            F.when(fits, state["n"] + 1).otherwise(state["n"]).alias("n"),
            F.when(fits, state["total"] + p["t"]).otherwise(state["total"]).alias("total"),
            (~fits).alias("full"),
        )

    measured = df.withColumns({"_parts": sized, "_whole": X.approx_tokens(text)}).withColumn("_fold", F.aggregate("_parts", start, step))
    n, left = F.col("_fold.n"), F.lit(max_tokens) - F.col("_fold.total")
    border = F.try_element_at("_parts", n + 1)
    chars = F.floor(left * (F.length(border["s"]) / border["t"])).cast("int")
    cut = F.when(border.isNotNull() & (left > 50), F.concat(F.substring(border["s"], F.lit(1), chars), F.lit(CUT_MARK)))
    kept = F.transform(F.slice("_parts", F.lit(1), n), lambda p: p["s"])
    short = F.array_join(F.concat(kept, F.when(cut.isNotNull(), F.array(cut)).otherwise(F.array().cast("array<string>"))), sep)
    return measured.withColumn(out, F.when(F.col("_whole") <= max_tokens, text).otherwise(short)).drop("_parts", "_whole", "_fold")

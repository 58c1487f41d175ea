"""Jobs that turn text into rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions import lexicon
from recollect.functions import markdown as md
from recollect.functions import markers

# ---------------------------------------------------------------- paragraphs and chunks


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


SLICE_BYTES = 1 << 20  # of text that a task turns into Python objects at once


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_BYTES``; a longer text is alone."""
    upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
        yield begin, end
        begin = end


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, text) of the batches in slices of a bounded size."""
    for batch in batches:
        for a, b in _cuts(batch.column(1)):
            yield batch.slice(a, b - a)


def split_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, content, heading_path, start, end) of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            rows = [
                (k, i, *p)
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for i, p in enumerate(md.paragraphs(t))
            ]
            if rows:
                yield _batch(rows, batch.schema.field(0).type, [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()],
                             [key, "pos", "content", "heading_path", "start", "end"])

    schema = f"{key} {_key_type(docs, key)}, pos int, content string, heading_path string, start int, end int"
    return docs.where(~X.blank(text)).select(key, text).mapInArrow(run, schema)


def chunk(docs: DataFrame, chunk_tokens: int = 500, overlap: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, content, heading_path, start, end, tokens) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            rows = [
                (k, i, *c)
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for i, c in enumerate(md.chunks(t, chunk_tokens, overlap))
            ]
            if rows:
                yield _batch(rows, batch.schema.field(0).type,
                             [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()],
                             [key, "chunk_index", "content", "heading_path", "start", "end", "tokens"])

    schema = (
        f"{key} {_key_type(docs, key)}, chunk_index int, content string, heading_path string, "
        "start int, end int, tokens int"
    )
    return docs.where(~X.blank(text)).select(key, text).mapInArrow(run, schema)


def _batch(rows, key_type, types, names) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, *types])], names=names)


# ---------------------------------------------------------------- cleaning


def clean_markdown(df: DataFrame, col: str, out: str = "clean") -> DataFrame:
    return df.withColumn(out, X.clean_markdown(col))


def clean_page_text(df: DataFrame, col: str, out: str = "clean") -> DataFrame:
    """Repair text extracted from pages: no page numbers or noise lines, broken lines joined, paragraphs rebuilt.

    Lines are classified one by one. Neighbouring short lines that do not end a sentence are joined; headings and
    capital lines stay alone; a heading closes its paragraph. Marks around the lines turn the joining into plain
    replacements, so the whole job stays one expression.
    """
    run_open, run_close, heading_end = "\u0001", "\u0002", "\u0003"
    text = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "\r\n?", "\n")

    def is_noise(s: Column) -> Column:
        # Page-number and noise-line patterns.
        number = (
            s.rlike(r"^\d{1,4}(\s*[-–—]\s*\d{1,4})?$")
            | s.rlike(r"^\[?\d{1,4}\]?$")
            | s.rlike(r"^(?i)page\s*\d{1,4}$")
            | s.rlike(r"^[-–—]{3,}$")
        )
        noise = (
            ((F.length(s) <= 1) & ~s.rlike(r"^\d$"))
            | (s.rlike(r"^[\p{Punct}\s]+$") & (F.length(s) <= 3))
            | s.rlike(r"^[|]{2,}$")
            | s.rlike(r"^[._\-·•]{2,}$")
        )
        return (s != "") & (number | noise)

    def mark(s: Column) -> Column:
        capitals = s.rlike(r"(?:[^\p{L}]*\p{Lu}){3}") & ~s.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")
        alone = s.rlike("^#") | ((F.length(s) <= 60) & capitals)
        # Abbreviations whose final dot does not end a sentence.
        short = s.rlike(r"(?i)(^|\s)(al|fig|eg|etc|vs|dr|mr|mrs|ms|prof|dept|approx|vol|pp|no)\.$")
        ends = (s.rlike(r"\.$") & (F.length(s) > 2) & ~short) | s.rlike("[。！？!?:：;；]$")
        return (
            F.when(s.rlike("^#"), F.concat(s, F.lit(heading_end)))
            .when((s == "") | alone | (F.length(s) >= 60) | ends, s)
            .otherwise(F.concat(F.lit(run_open), s, F.lit(run_close)))
        )

    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: X.strip(s)), lambda s: ~is_noise(s))
    joined = F.array_join(F.transform(lines, mark), "\n")
    joined = F.regexp_replace(joined, f"{run_close}\n{run_open}", " ")
    joined = F.regexp_replace(joined, f"[{run_open}{run_close}]", "")
    joined = F.regexp_replace(joined, heading_end, "\n")
    joined = F.regexp_replace(joined, "\n{2,}", "\n\n")
    return df.withColumn(out, F.regexp_replace(joined, "^\n+|\n+$", ""))


def strip_markers(df: DataFrame, col: str, out: str = "clean") -> DataFrame:
    """Remove reasoning blocks and tool-call marks; unclosed ones stay."""

    @F.arrow_udf("string")
    def strip(texts: pa.Array) -> pa.Array:
        parts = [
            pa.array([markers.strip_tool_calls(markers.strip_reasoning(t)) if t else "" for t in texts.slice(a, b - a).to_pylist()], pa.string())
            for a, b in _cuts(texts)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return df.withColumn(out, strip(F.col(col)))


# ---------------------------------------------------------------- entities


_WORD = r"\p{L}\p{N}_"
# Patterns of capitalised names, versions and dates.
_NAMES = rf"(?<![{_WORD}])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![{_WORD}])"
_VERSIONS = (
    rf"(?i)(?<![{_WORD}])v?\d+\.\d+(?:\.\d+)?(?:[-.]?(?:alpha|beta|rc|release|SNAPSHOT|GA|LTS))?(?![{_WORD}])"
)
_DATES = rf"(?<![{_WORD}])\d{{4}}[-/年]\d{{1,2}}[-/月]\d{{1,2}}日?(?![{_WORD}])"

ENTITY = "struct<name:string,type:string>"


def _entity(name: Column, kind: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"))


def dictionary_array(text: str | Column, terms: list[tuple[str, str, int]] | None = None) -> Column:
    """Known terms found in a text, longest first, as an array of (name, type).

    Long terms are plain substrings. Short ASCII terms must stand alone: the word-like ones are looked up among the
    words of the text, the others (with signs in them) by a fixed pattern each.
    """
    terms = terms or lexicon.dictionary()
    lower = F.lower(F.coalesce(X.col(text), F.lit("")))

    def row(n: str, t: str, i: int) -> Column:
        return F.struct(
            F.lit(-len(n)).alias("order"), F.lit(i).alias("at"), F.lit(n.lower()).alias("term"), F.lit(n).alias("name"),
            F.lit(t).alias("type"),
        )

    wordlike = [x for x in terms if lexicon.needs_boundary(x[0]) and x[0].replace("_", "a").isalnum()]
    signs = [x for x in terms if lexicon.needs_boundary(x[0]) and x not in wordlike]
    plain = [x for x in terms if x not in wordlike and x not in signs]

    def find(low: Column) -> Column:
        parts = []
        if plain:
            parts.append(F.filter(F.array(*[row(*x) for x in plain]), lambda e: F.contains(low, e["term"])))
        if wordlike:
            by_term = F.create_map(*[c for x in wordlike for c in (F.lit(x[0].lower()), row(*x))])
            short = F.array_intersect(
                F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), F.array(*[F.lit(x[0].lower()) for x in wordlike])
            )
            parts.append(F.transform(short, lambda w: by_term[w]))
        for x in signs:
            pattern = rf"(?<!\w)\Q{x[0].lower()}\E(?!\w)"
            parts.append(F.when(low.rlike(pattern), F.array(row(*x))).otherwise(F.slice(F.array(row(*x)), 1, 0)))
        return F.array_sort(F.concat(*parts))

    return F.transform(X.let(lower, find), lambda e: _entity(e["name"], e["type"]))


def pattern_array(text: str | Column) -> Column:
    """Capitalised names typed by their surroundings, then versions, then dates, each once."""
    source = F.coalesce(X.col(text), F.lit(""))
    known = [n for n, _, _ in lexicon.dictionary()]

    def typed(lower: Column, name: Column) -> Column:
        at = F.instr(lower, F.lower(name))
        start = F.greatest(at - 40, F.lit(1))
        near = F.substring(lower, start, at + F.length(name) + 40 - start)
        kind = None
        for label, cues in lexicon.NAME_CUES:
            hit = _any(near, cues)
            kind = F.when(hit, label) if kind is None else kind.when(hit, label)
        return _entity(name, kind.otherwise("concept"))

    names = F.filter(
        F.regexp_extract_all(source, F.lit(_NAMES), F.lit(0)), lambda n: (F.length(n) >= 5) & ~n.isin(known)
    )
    versions = F.regexp_extract_all(source, F.lit(_VERSIONS), F.lit(0))
    dates = F.regexp_extract_all(source, F.lit(_DATES), F.lit(0))
    return F.array_distinct(F.concat(
        X.let(F.lower(source), lambda low: F.transform(F.array_distinct(names), lambda n: typed(low, n))),
        F.transform(versions, lambda v: _entity(v, F.lit("tool"))),
        F.transform(dates, lambda d: _entity(d, F.lit("date"))),
    ))


def _any(text: Column, phrases: list) -> Column:
    out = None
    for p in phrases:
        hit = F.contains(text, p if isinstance(p, Column) else F.lit(p))
        out = hit if out is None else out | hit
    return out


def dictionary_entities(docs: DataFrame, key: str = "doc_id", text: str = "text", terms=None) -> DataFrame:
    return docs.select(key, F.inline(dictionary_array(text, terms)))


def pattern_entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.inline(pattern_array(text)))


def entity_array(text: str | Column) -> Column:
    """All entities of a text in the order used to direct relations."""
    return F.array_distinct(F.concat(dictionary_array(text), pattern_array(text)))


def extract_entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.inline(entity_array(text)))


# ---------------------------------------------------------------- relations


def sentences(text: str | Column) -> Column:
    parts = F.split(F.coalesce(X.col(text), F.lit("")), r"(?<=[.。!！?？\n])\s*")
    return F.filter(F.transform(parts, lambda s: X.strip(s)), lambda s: s != "")


def _position(lower: Column, name: Column, low_name: Column) -> Column:
    """Where a name begins in a lower-cased sentence, 0 if it does not occur; short ASCII names must stand by themselves."""
    alone = F.concat(F.lit(r"(?<!\w)\Q"), low_name, F.lit(r"\E(?!\w)"))
    return F.when(name.rlike(r"^[!-\x7e]{1,4}$"), F.regexp_instr(lower, alone)).otherwise(F.instr(lower, low_name))


def _predicate(low: Column, a: Column, b: Column) -> Column:
    """Relation of two names (name, low, at) of a lower-cased sentence by the text between them and 60 characters around."""
    start = F.greatest(F.least(a["at"], b["at"]) - 60, F.lit(1))
    end = F.greatest(a["at"], b["at"]) + F.greatest(F.length(a["name"]), F.length(b["name"])) + 60

    def decide(near: Column) -> Column:
        kind_of = (
            _any(near, [F.concat(a["low"], F.lit(c)) for c in lexicon.IS_A_AFTER_FIRST])
            | _any(near, lexicon.IS_A_ANYWHERE)
            | _any(near, [F.concat(b["low"], F.lit(c)) for c in lexicon.IS_A_AFTER_SECOND])
        )
        out = F.when(kind_of, "IS_A")
        for label, cues in lexicon.RELATION_CUES:
            out = out.when(_any(near, cues), label)
        return out.otherwise("CO_OCCURS_WITH")

    return X.let(F.substring(low, start, end - start), decide)


def extract_relations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, src, src_type, predicate, dst, dst_type): pairs within a sentence, then pairs over neighbouring sentences.

    The first occurrence of a pair of names decides. A pair is emitted in the order of the entity list.
    """
    # Explode keeps the costly arrays from being computed again in every later step.
    listed = docs.select(key, text, F.explode(F.array(entity_array(text))).alias("es")).where(F.size("es") > 1)
    numbered = F.transform("es", lambda e, i: F.struct(i.alias("i"), e["name"].alias("name"), e["type"].alias("type"), F.lower(e["name"]).alias("low")))
    lowered = F.transform(sentences(text), lambda s: F.lower(s))

    def places(s: Column) -> Column:
        """The entities of a sentence, each with its place: found once, whatever the number of pairs."""
        placed = F.transform("es", lambda e: F.struct(*[e[c].alias(c) for c in ("i", "name", "type", "low")], _position(s, e["name"], e["low"]).alias("at")))
        return F.filter(placed, lambda e: e["at"] > 0)

    held = listed.select(key, numbered.alias("es"), lowered.alias("ss")).select(
        key, F.transform("ss", lambda s: F.struct(s.alias("s"), places(s).alias("es"))).alias("ss")
    )
    # Each sentence with the one after it, inside the document's own row.
    spread = held.select(key, F.posexplode(F.arrays_zip(
        F.col("ss").alias("cur"), F.slice("ss", F.lit(2), F.size("ss")).alias("nxt")
    )).alias("no", "z")).select(key, "no", "z.cur.s", F.col("z.cur.es").alias("here"), F.col("z.nxt.es").alias("after"))
    a_rows = spread.where(F.size("here") > 0).select(key, "no", "s", "here", "after", F.explode("here").alias("a"))
    none = F.array().cast(a_rows.schema["here"].dataType)
    b_rows = F.concat(
        F.transform("here", lambda e: F.struct(F.lit(0).alias("kind"), e.alias("e"))),
        F.transform(F.coalesce("after", none), lambda e: F.struct(F.lit(1).alias("kind"), e.alias("e"))),
    )
    both = a_rows.select(key, "no", "s", "a", F.explode(b_rows).alias("b")).where(
        (F.col("a.name") != F.col("b.e.name")) & ((F.col("b.kind") == 1) | (F.col("a.i") < F.col("b.e.i")))
    )
    predicate = F.when(F.col("b.kind") == 1, "RELATED_TO").otherwise(_predicate(F.col("s"), F.col("a"), F.col("b.e")))
    found = both.select(key, "b.kind", "no", "a", F.col("b.e").alias("other"), predicate.alias("p"))

    pairs = found.groupBy(key, F.col("a.name").alias("src"), F.col("other.name").alias("dst"))
    first = pairs.agg(
        F.min(F.struct("kind", "no", F.col("a.i").alias("ai"), F.col("other.i").alias("bi"), "p",
                       F.col("a.type").alias("at"), F.col("other.type").alias("bt"))).alias("m")
    )
    return first.select(
        key, "src", F.col("m.at").alias("src_type"), F.col("m.p").alias("predicate"), "dst", F.col("m.bt").alias("dst_type")
    )


# ---------------------------------------------------------------- tool calls and tasks


def extract_tool_calls(
    df: DataFrame, key: str, col: str, declared: dict[str, list[tuple[str, str]]] | None = None
) -> DataFrame:
    """(key, pos, tool, body, params) of every ``[TOOL_CALL:name:body]`` mark.

    Bodies are JSON objects, ``k=v`` lists, or one value for the first declared parameter (else ``input``).
    ``declared`` gives (parameter, type) lists per tool; values given as text are brought into that type's form.
    """

    @F.pandas_udf("array<struct<tool:string,body:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"tool": n, "body": b} for n, b in markers.tool_calls(t)])

    marked = df.where(F.contains(F.col(col), F.lit(markers.TOOL_MARK))).select(key, find(F.col(col)).alias("calls"))
    calls = marked.select(key, F.posexplode("calls").alias("pos", "c")).select(key, "pos", "c.tool", "c.body")
    first = _declared_map({t: ps[0][0] for t, ps in (declared or {}).items() if ps})
    name = F.coalesce(F.try_element_at(first, F.col("tool")), F.lit("input"))
    pairs = F.filter(F.split("body", ","), lambda p: F.contains(p, F.lit("=")))
    as_pairs = F.map_from_entries(_last_wins(F.transform(pairs, lambda p: F.struct(
        X.strip(F.substring_index(p, "=", 1)).alias("key"),
        X.strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"),
    ))))
    is_json = F.col("body").startswith("{") & F.try_parse_json("body").isNotNull()
    params = (
        F.when(is_json, F.from_json("body", "map<string,string>"))
        .when(F.contains(F.col("body"), F.lit("=")), as_pairs)
        .otherwise(F.create_map(name, F.col("body")))
    )
    out = calls.withColumn("params", params)
    types = {f"{t}\u0001{p}": kind for t, ps in (declared or {}).items() for p, kind in ps}
    if not types:
        return out
    kinds = _declared_map(types)

    def typed(k: Column, v: Column) -> Column:
        kind = F.try_element_at(kinds, F.concat(F.col("tool"), F.lit("\u0001"), k))
        number = v.try_cast("double")
        whole = number == F.floor(number)
        return (
            F.when(kind == "integer", F.coalesce(v.try_cast("int").cast("string"), v))
            .when(kind.isin("number", "float", "double"),
                  F.coalesce(F.when(whole, number.try_cast("long").cast("string")).otherwise(number.cast("string")), v))
            .when(kind == "boolean", (F.lower(v) == "true").cast("string"))
            .otherwise(v)
        )

    return out.withColumn("params", F.transform_values("params", typed))


def _last_wins(entries: Column) -> Column:
    """Entries whose key does not come again later."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.filter(
        entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["key"])
    )


def _declared_map(values: dict[str, str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


_TASKS = "array<struct<title:string,intent:string,query:string>>"
_TASK_ROW = r"(?m)^\s*\|\s*(\d+)\s*\|\s*(.+?)\s*\|\s*(.+?)\s*\|\s*(.+?)\s*\|\s*$"


def extract_tasks(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, task_id, title, intent, query, status) from JSON, a tool payload, or a four-column table."""
    cleaned = strip_reasoning(df, col, "_c").select(key, "_c")
    text = F.col("_c")
    braces = _outer(text, "{", "}")
    brackets = _outer(text, "[", "]")
    wrapped = F.from_json(F.when(_one_json(braces), braces), f"tasks {_TASKS}")["tasks"]
    bare = F.when(~_one_json(braces) & _one_json(brackets), F.from_json(brackets, _TASKS))
    payload = F.regexp_extract(text, r"\[TOOL_CALL:[^:]+:([^\]]+)\]", 1)
    # A tool payload that holds a task list has nested brackets; its object is read from the outermost braces.
    from_tool = F.from_json(F.when(F.try_parse_json(payload).isNotNull(), payload), f"tasks {_TASKS}")["tasks"]
    listed = F.coalesce(wrapped, bare, from_tool)
    listed_rows = F.transform(listed, lambda t, i: F.struct(
        (i + 1).alias("task_id"),
        F.coalesce(t["title"], F.concat(F.lit("任务 "), (i + 1).cast("string"))).alias("title"),
        F.coalesce(t["intent"], F.lit("")).alias("intent"),
        F.coalesce(t["query"], F.lit("")).alias("query"),
    ))
    rows = F.regexp_extract_all(text, F.lit(_TASK_ROW), F.lit(0))
    table = F.transform(rows, lambda r: F.struct(
        F.regexp_extract(r, _TASK_ROW, 1).cast("int").alias("task_id"),
        X.strip(F.regexp_extract(r, _TASK_ROW, 2)).alias("title"),
        X.strip(F.regexp_extract(r, _TASK_ROW, 3)).alias("intent"),
        F.regexp_replace(X.strip(F.regexp_extract(r, _TASK_ROW, 4)), "`", "").alias("query"),
    ))
    table = F.filter(table, lambda r: ~(F.contains(r["title"], F.lit("标题")) & F.contains(r["intent"], F.lit("意图"))))
    chosen = F.when(listed.isNotNull(), listed_rows).otherwise(table)
    return cleaned.select(key, F.inline(chosen)).withColumn("status", F.lit("pending"))


def strip_reasoning(df: DataFrame, col: str, out: str = "clean") -> DataFrame:
    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: markers.strip_reasoning(t) if t else "")

    return df.withColumn(out, strip(F.col(col)))


def _one_json(text: Column) -> Column:
    """The text is one JSON value with nothing after it."""
    alone = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1
    return F.coalesce(F.try_parse_json(text).isNotNull() & alone, F.lit(False))


def _outer(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing sign, else null."""
    start = F.instr(text, opening)
    end = F.length(text) - F.instr(F.reverse(text), closing) + 1
    found = (start > 0) & F.contains(text, F.lit(closing)) & (end > start)
    return F.when(found, F.substring(text, start, end - start + 1))


# ---------------------------------------------------------------- samples and model text


def _json_text(v: Column) -> Column:
    return F.when(v.isNotNull() & (v != "null"), v)


def parse_call_samples(df: DataFrame, col: str = "value") -> DataFrame:
    """(id, question, functions, truth_name, truth_arguments) from one JSON object per row; bad rows drop.

    The truth is an object or a string that holds one.
    """
    ok = df.where(F.try_parse_json(col).isNotNull())
    body = F.from_json(
        F.col(col),
        "id string, question array<array<struct<role:string,content:string>>>, function array<string>, "
        "ground_truth string",
    )
    read = ok.select(body.alias("j"))
    # An object arrives as its JSON text, a string as its content: both are then read the same way.
    truth = F.from_json(F.col("j.ground_truth"), "name string, arguments map<string,string>")
    turns = F.transform("j.question", lambda turn: F.transform(turn, lambda m: F.struct(
        F.coalesce(m["role"], F.lit("user")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")
    )))
    return read.select(
        F.coalesce("j.id", F.lit("unknown")).alias("id"), turns.alias("question"),
        F.coalesce("j.function", F.array().cast("array<string>")).alias("functions"),
        truth["name"].alias("truth_name"), truth["arguments"].alias("truth_arguments"),
    )


def question_text(question: str | Column, width: int = 80) -> Column:
    """First user message of nested turns, cut to a preview."""
    messages = F.flatten(X.col(question))
    first = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"]
    return F.coalesce(X.preview(first, width, one_line=False), F.lit(""))


def parse_qa_samples(df: DataFrame, default_level: int = 1, col: str = "value") -> DataFrame:
    """(id, question, answer, level, file_name); ids and texts may come under either of two names.

    A level that is not a number makes the row drop, a missing one takes the default.
    """
    ok = df.where(F.try_parse_json(col).isNotNull())

    def get(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(F.col(col), f"$['{n}']") for n in names])

    level = F.get_json_object(F.col(col), "$.level")
    parsed = ok.select(
        F.coalesce(get("id", "task_id"), F.lit("unknown")).alias("id"),
        F.coalesce(get("question", "Question"), F.lit("")).alias("question"),
        F.coalesce(get("answer", "Answer"), F.lit("")).alias("answer"),
        F.when(level.isNull(), F.lit(default_level)).otherwise(level.try_cast("double").cast("int")).alias("level"),
        _json_text(F.get_json_object(F.col(col), "$.file_name")).alias("file_name"),
    )
    return parsed.where(F.col("level").isNotNull())


def json_block(text: str | Column, fenced: bool = False) -> Column:
    """Outermost ``{...}`` of a text, or ``{}``; with ``fenced`` the first fenced block goes first."""
    source = F.coalesce(X.col(text), F.lit(""))
    block = F.coalesce(_outer(source, "{", "}"), F.lit("{}"))
    if not fenced:
        return block
    fence = F.coalesce(
        F.nullif(X.strip(F.regexp_extract(source, r"(?s)```json(.*?)```", 1)), F.lit("")),
        F.nullif(X.strip(F.regexp_extract(source, r"(?s)```(.*?)```", 1)), F.lit("")),
    )
    return F.coalesce(fence, block)


def extract_json(df: DataFrame, col: str, fields: dict[str, tuple[str, object]], required: str, fenced: bool = False) -> DataFrame:
    """Read fields from model text: the whole text, its outermost object, single fields by pattern, or defaults.

    ``fields``: name -> (type, default) with types ``boolean``, ``double`` or ``string``. A JSON object only counts
    where it has the ``required`` field. Adds the fields and ``source`` (json, block, fields or default).
    """
    text = F.coalesce(F.col(col), F.lit(""))
    block = json_block(text, fenced)

    def has(candidate: Column) -> Column:
        return F.coalesce(F.get_json_object(F.when(_one_json(candidate), candidate), f"$.{required}").isNotNull(), F.lit(False))

    whole, inner = has(text), has(block)
    any_value = rf'(?i)"{required}"\s*:\s*(true|false|-?\d+(?:\.\d+)?|"[^"]+")'
    by_field = text.rlike(any_value)
    source = F.when(whole, "json").when(inner, "block").when(by_field, "fields").otherwise("default")
    out = df.withColumn("source", source)
    for name, (kind, default) in fields.items():
        patterns = {
            "boolean": rf'(?i)"{name}"\s*:\s*(true|false)',
            "double": rf'"{name}"\s*:\s*(-?\d+(?:\.\d+)?)',
            "string": rf'"{name}"\s*:\s*"([^"]+)"',
        }
        found = F.nullif(F.regexp_extract(text, patterns[kind], 1), F.lit(""))
        value = F.when(whole, F.get_json_object(text, f"$.{name}")).when(inner, F.get_json_object(block, f"$.{name}"))
        value = value.when(by_field, found)
        out = out.withColumn(name, F.coalesce(value.try_cast(kind), F.lit(default).cast(kind)))
    return out


# ---------------------------------------------------------------- training rows and phrases


def format_training(df: DataFrame, question: str, answer: str, form: str = "sft") -> DataFrame:
    """Prompt and completion columns for supervised (``sft``) or reward (``rl``) training."""
    q, a = F.col(question), F.col(answer)
    if form == "rl":
        # The chat marks of the prompt.
        prompt = F.concat(F.lit("<|im_start|>user\n"), q, F.lit("\n<|im_end|>\n<|im_start|>assistant\n"))
        return df.withColumns({
            "prompt": prompt, "ground_truth": hash_answer(a), "question": q, "full_answer": a,
        })
    prompt = F.concat(F.lit("Question: "), q, F.lit("\n\nLet's solve this step by step:\n"))
    return df.withColumns({"prompt": prompt, "completion": a, "text": F.concat(prompt, a)})


def hash_answer(c: str | Column) -> Column:
    """The number after ``####``, else the last line."""
    text = F.coalesce(X.col(c), F.lit(""))
    pattern = r"####\s*(-?[\d,.]+)"
    bare = X.strip(text)
    last = X.strip(F.element_at(F.split(bare, "\n"), -1))
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(last)


def short_name(c: str | Column) -> Column:
    """Title without bracketed notes, version marks, a trailing foreign name, or what follows a slash."""
    title = F.coalesce(X.col(c), F.lit(""))
    # The patterns of title notes.
    cleaned = F.regexp_replace(title, r"[（(]?(全DLC|数字豪华版|更新|v\d+\.\d+)[^）)]*[）)]?", "")
    cleaned = X.strip(F.regexp_replace(cleaned, r"[（(][^）)]*[）)]", ""))
    cut = F.regexp_replace(cleaned, r"\s+[A-Za-z0-9][A-Za-z0-9\s:：\-._]{2,}$", "")
    cut = X.strip(F.regexp_replace(cut, r"[/／].*", ""))
    whole = X.strip(F.element_at(F.split(title, "[/／]"), 1))
    return F.when(X.blank(title) | (cleaned == ""), F.lit("")).when(cut == "", whole).otherwise(cut)


def english_name(c: str | Column) -> Column:
    """English name given in brackets, after a slash, before a Han title, or as the whole title; else null."""
    title = F.coalesce(X.col(c), F.lit(""))

    def long_enough(v: Column) -> Column:
        return F.when(F.length(v) >= 3, v)

    in_brackets = F.regexp_replace(F.regexp_extract(title, r"[（(]([a-zA-Z0-9][^）)]{2,})[）)]", 1), r"[^a-zA-Z0-9\s:：\-._]", "")
    after_slash = F.regexp_replace(X.strip(F.regexp_extract(title, r"[/／]\s*([A-Za-z][A-Za-z0-9\s:：\-._]{2,})", 1)), r"[^a-zA-Z0-9\s:：\-_.]$", "")
    before_han = F.nullif(X.strip(F.regexp_extract(title, r"^([A-Za-z][A-Za-z0-9\s:：\-._]{3,}?)\s+[一-鿿]", 1)), F.lit(""))
    whole = F.when(title.rlike(r"^[A-Za-z0-9\s:：\-._]{3,}$"), X.strip(title))
    return F.when(~X.blank(title), F.coalesce(long_enough(X.strip(in_brackets)), long_enough(after_slash), before_han, whole))


def title_variants(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, pos, phrase): search phrases from a title, the most exact first."""
    named = df.select(key, short_name(col).alias("s"), english_name(col).alias("e"))
    has_short = F.col("s") != ""
    # The phrase endings.
    phrases = F.array_compact(F.array(
        F.concat("e", F.lit(" game screenshot")),
        F.concat("e", F.lit(" gameplay screenshot")),
        F.when(has_short, F.concat("s", F.lit(" 游戏截图"))),
        F.when(has_short, F.concat("s", F.lit(" Steam 截图"))),
        F.coalesce(F.concat("e", F.lit(" game")), F.when(has_short, F.col("s"))),
    ))
    return named.select(key, F.posexplode(phrases).alias("pos", "phrase"))


def label_samples(samples: DataFrame, generated: DataFrame, category: str | None = None, key: str = "id") -> DataFrame:
    """Join generated truths (key, name, arguments); an empty call where none exists or the category is irrelevance."""
    empty_args = F.lit("{}")
    joined = samples.join(generated.select(key, F.col("name").alias("_n"), F.col("arguments").alias("_a")), key, "left")
    keep = F.lit(category != "irrelevance") if category else F.coalesce(F.col("category") != "irrelevance", F.lit(True))
    return joined.withColumns({
        "truth_name": F.when(keep, F.coalesce("_n", F.lit(""))).otherwise(""),
        "truth_arguments": F.when(keep & F.col("_n").isNotNull(), F.coalesce("_a", empty_args)).otherwise(empty_args),
    }).drop("_n", "_a")


def infer_event_keys(events: DataFrame, params: str = "raw_parameters", result: str = "result", tool: str = "tool") -> DataFrame:
    """Add task_id (field, ``task_N`` tag, or numbered title) and, for the note tool, note_id from the result."""
    p = F.when(F.try_parse_json(params).isNotNull(), F.col(params))
    field = F.get_json_object(p, "$.task_id").try_cast("double").cast("int")
    tags = F.from_json(F.get_json_object(p, "$.tags"), "array<string>")
    by_tag = F.try_element_at(
        F.filter(F.transform(tags, lambda t: F.when(t.startswith("task_"), F.substring(t, F.lit(6), F.length(t)).try_cast("int"))), lambda x: x.isNotNull()),
        F.lit(1),
    )
    by_title = F.nullif(F.regexp_extract(F.coalesce(F.get_json_object(p, "$.title"), F.lit("")), r"任务\s*(\d+)", 1), F.lit("")).try_cast("int")
    text = F.coalesce(F.col(result), F.lit(""))
    marked = F.nullif(F.regexp_extract(text, r"ID:\s*([^\s\n]+)", 1), F.lit(""))
    from_json = F.get_json_object(F.when(F.try_parse_json(text).isNotNull(), text), "$.note_id")
    return events.withColumns({
        "task_id": F.coalesce(field, by_tag, by_title),
        "note_id": F.when(F.col(tool) == "note", F.coalesce(marked, from_json)),
    })

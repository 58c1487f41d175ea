"""Documents, notes, pages and nested plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schemas
from recollect.functions import exprs as X
from recollect.operators.text_rows import clean_page_text

# Endings of text and code files, of markup files, and of audio files.
TEXT_ENDINGS = [
    "txt", "md", "markdown", "csv", "tsv", "json", "yaml", "yml", "properties", "ini", "cfg", "conf", "log", "java", "py",
    "js", "ts", "jsx", "tsx", "c", "cpp", "h", "hpp", "go", "rs", "rb", "php", "swift", "kt", "scala", "sh", "bat", "sql",
    "r", "m", "lua", "css", "scss", "less", "toml", "lock", "gradle", "cmake", "dockerfile",
]
MARKUP_ENDINGS = ["html", "htm", "xml", "epub", "rtf"]
AUDIO_ENDINGS = ["mp3", "wav", "ogg", "flac", "aac", "m4a"]
MARKDOWN_ENDINGS = ["md", "markdown"]


def ingest_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc_id, title, content, metadata) of every readable file below a folder.

    Markdown passes through. Markup loses its tags, unknown text is repaired line by line, and whatever does not
    start with a heading gets the file name as one. Audio and blank files are left out. Bytes that are no UTF-8 are
    read as Latin-1.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", F.col("_metadata.file_name").alias("title"), "content")
    ending = F.lower(F.regexp_extract("title", r"\.([^.]+)$", 1))
    # A file that decodes without replacement marks is UTF-8.
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    read = files.select("path", F.url_decode("title").alias("title"), ending.alias("ending"), text.alias("raw")).where(
        ~F.col("ending").isin(AUDIO_ENDINGS)
    )
    repaired = clean_page_text(read, "raw", "_repaired")
    content = (
        F.when(F.col("ending").isin(MARKUP_ENDINGS), X.html_text("raw"))
        .when(F.col("ending").isin(TEXT_ENDINGS), F.col("raw"))
        .otherwise(F.col("_repaired"))
    )
    wrapped = F.when(
        F.col("ending").isin(MARKDOWN_ENDINGS) | F.col("_c").rlike(r"^\s*#"), F.col("_c")
    ).otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n"), "_c"))
    kept = repaired.withColumn("_c", content).where(~X.blank("_c"))
    return kept.select(
        F.sha2("path", 256).alias("doc_id"), "title", wrapped.alias("content"),
        F.create_map(F.lit("path"), "path", F.lit("ending"), "ending").alias("metadata"),
    )


# ---------------------------------------------------------------- notes


def parse_notes(files: DataFrame, raw: str = "value", fallback_id: str | None = None) -> DataFrame:
    """(id, title, type, tags, created_at, updated_at, body) from note texts with a front matter block."""
    text = F.coalesce(F.col(raw), F.lit(""))
    bare = X.strip(text)
    # The block opens at the start and closes at the next three dashes; without a close all of it is body.
    block = r"(?s)^---\n?(.*?)---(.*)$"
    has = bare.rlike(block)
    lines = F.split(F.when(has, F.regexp_extract(bare, block, 1)).otherwise(""), "\n")
    # An indented line continues the one before.
    folded = F.split(F.regexp_replace(F.array_join(lines, "\n"), r"\n[ \t]+", " "), "\n")
    usable = F.filter(folded, lambda x: F.contains(x, F.lit(":")) & ~x.rlike(r"^\s*#"))
    entries = F.transform(usable, lambda x: F.struct(
        X.strip(F.substring_index(x, ":", 1)).alias("k"),
        X.strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"),
    ))
    keys = F.transform(entries, lambda e: e["k"])
    unique = F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    meta = files.select("*", F.map_from_entries(unique).alias("_m"), has.alias("_has"), bare.alias("_bare"))

    def plain(v: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(v, r"^[\"']|[\"']$", ""), r'\\"', '"')

    def get(name: str, default: Column) -> Column:
        return F.coalesce(plain(F.try_element_at("_m", F.lit(name))), default)

    tags_text = F.coalesce(F.try_element_at("_m", F.lit("tags")), F.lit(""))
    inner = F.regexp_replace(tags_text, r"^\[|\]$", "")
    tags = F.filter(F.transform(F.split(inner, ","), lambda t: plain(X.strip(t))), lambda t: t != "")
    created = get("created_at", F.lit(""))
    return meta.select(
        get("id", F.col(fallback_id) if fallback_id else F.lit("unknown")).alias("id"),
        get("title", F.lit("Untitled")).alias("title"), get("type", F.lit("general")).alias("type"), tags.alias("tags"),
        created.alias("created_at"), get("updated_at", created).alias("updated_at"),
        X.strip(F.when(F.col("_has"), F.regexp_extract("_bare", block, 2)).otherwise(F.col("_bare"))).alias("body"),
    )


def ingest_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of every ``.md`` file below a folder; blank files drop."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return parse_notes(files.where(~X.blank("value")))


def note_title(c: str | Column) -> Column:
    """Text of the first ``# `` line."""
    return F.coalesce(F.nullif(X.strip(F.regexp_extract(F.coalesce(X.col(c), F.lit("")), r"(?m)^#\s+(.+)", 1)), F.lit("")), F.lit("Untitled"))


def note_text(notes: DataFrame) -> DataFrame:
    """(id, value): the file text of (id, title, type, tags, created_at, updated_at, body) rows."""

    def safe(v: Column) -> Column:
        risky = v.rlike(r'[:"#\[\]]')
        return F.when(v.isNull(), "null").when(risky, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(v)

    title = F.when(X.blank("title"), note_title("body")).otherwise(F.col("title"))
    kind = F.when(X.blank("type"), "general").otherwise(F.col("type"))
    tags = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), safe), ", "), F.lit("]"))
    lines = [F.lit("---"), F.concat(F.lit("id: "), F.col("id").cast("string")), F.concat(F.lit("title: "), safe(title)),
             F.concat(F.lit("type: "), kind), F.concat(F.lit("tags: "), tags),
             F.concat(F.lit("created_at: "), F.col("created_at").cast("string")),
             F.concat(F.lit("updated_at: "), F.col("updated_at").cast("string")), F.lit("---"), F.coalesce("body", F.lit(""))]
    return notes.select(F.col("id").cast("string").alias("id"), F.concat_ws("\n", *lines).alias("value"))


def write_notes(notes: DataFrame, path: str) -> None:
    """One file per note, in a folder named by its id."""
    note_text(notes).write.mode("overwrite").partitionBy("id").text(path)


def ingest_written_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes that :func:`write_notes` wrote."""
    return parse_notes(spark.read.text(path, wholetext=True, recursiveFileLookup=True))


# ---------------------------------------------------------------- pages and search results


def html_to_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    return pages.withColumn(out, X.html_text(html))


def extract_links(
    pages: DataFrame, max_results: int | None = None, key: str = "page_id", html: str = "html", link_class: str | None = None, snippet_class: str | None = None
) -> DataFrame:
    """(key, pos, title, url, snippet): anchors with a title, in page order, with the snippet of the same position.

    All of them, or the first ``max_results``. With ``link_class`` and ``snippet_class`` only anchors of these classes are links and snippets.
    """
    mark = rf'class="{link_class}"[^>]*' if link_class else ""
    anchor = rf'(?s)<a\b[^>]*{mark}href="([^"]*)"[^>]*>(.*?)</a>'
    urls = F.regexp_extract_all(html, F.lit(anchor), F.lit(1))
    titles = F.regexp_extract_all(html, F.lit(anchor), F.lit(2))

    def bare(v: Column) -> Column:
        return X.strip(F.regexp_replace(v, "<[^>]+>", ""))

    links = F.filter(
        F.zip_with(urls, titles, lambda u, t: F.struct(X.strip(u).alias("url"), bare(t).alias("title"))), lambda x: x["title"] != ""
    )
    if max_results is not None:
        links = F.slice(links, 1, max_results)
    if snippet_class:
        pattern = rf'(?s)<a[^>]*class="{snippet_class}"[^>]*>(.*?)</a>'
        snippets = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), bare)
    else:
        snippets = F.array().cast("array<string>")
    rows = pages.select(key, snippets.alias("_s"), F.posexplode(links).alias("pos", "_l"))
    return rows.select(key, "pos", "_l.title", "_l.url", F.coalesce(F.get("_s", F.col("pos")), F.lit("")).alias("snippet"))


def normalise_results(df: DataFrame, max_tokens: int, title: str = "title", url: str = "url", content: str = "content", raw: str = "raw_content") -> DataFrame:
    """(title, url, content, raw_content): a blank title becomes the url, raw text is cut at four characters per token."""
    limit = max_tokens * 4
    text = F.coalesce(F.col(raw), F.lit(""))
    # Fixed value: the mark at the end of a cut text.
    short = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("... [truncated]"))).otherwise(text)
    keep = [c for c in df.columns if c not in (title, url, content, raw)]
    return df.select(
        *keep, F.when(X.blank(title), F.coalesce(F.col(url), F.lit(""))).otherwise(F.col(title)).alias("title"),
        F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(content), F.lit("")).alias("content"), short.alias("raw_content"),
    )


def format_sources(results: DataFrame, max_tokens: int, full_page: bool = True) -> DataFrame:
    """Add ``block``: the prompt text of one source."""
    limit = max_tokens * 4
    raw = F.coalesce("raw_content", F.lit(""))
    # The captions of a source block.
    parts = [F.concat(F.lit("信息来源: "), F.coalesce("title", "url"), F.lit("\n\nURL: "), "url", F.lit("\n\n")),
             F.when(~X.blank("content"), F.concat(F.lit("信息内容: "), "content", F.lit("\n\n"))).otherwise("")]
    if full_page:
        cut = F.when(F.length(raw) > limit, F.concat(F.substring(raw, 1, limit), F.lit("... [truncated]"))).otherwise(raw)
        parts.append(F.when(~X.blank("raw_content"), F.concat(F.lit(f"详细信息内容限制为 {max_tokens} 个 token: "), cut, F.lit("\n\n"))).otherwise(""))
    return results.withColumn("block", F.concat(*parts))


# ---------------------------------------------------------------- nested plans


def flatten_plans(df: DataFrame, json_col: str) -> dict[str, DataFrame]:
    """Fact tables of nested plan JSON: days, attractions, meals, hotels, weather, budget. Missing fields take defaults."""
    # Explode keeps the text from being parsed once per column that is used later.
    plan = df.select(F.explode(F.array(F.from_json(json_col, schemas.PLAN))).alias("p")).select("p.*")

    def text(c: str) -> Column:
        return F.coalesce(c, F.lit(""))

    def number(c: str) -> Column:
        return F.coalesce(c, F.lit(0.0))

    day = plan.select("id", F.posexplode("days").alias("day", "d"))
    days = day.select("id", "day", text("d.date").alias("date"), F.coalesce("d.day_index", F.lit(0)).alias("day_index"),
                      text("d.description").alias("description"), text("d.transportation").alias("transportation"),
                      text("d.accommodation").alias("accommodation"))
    attractions = day.select("id", "day", F.posexplode("d.attractions").alias("pos", "a")).select(
        "id", "day", "pos", text("a.name").alias("name"), text("a.address").alias("address"),
        F.coalesce("a.duration", F.lit(0)).alias("duration"), number("a.price").alias("price"))
    kind = F.lower(F.coalesce("m.type", F.lit("lunch")))
    # The known meal types.
    meals = day.select("id", "day", F.posexplode("d.meals").alias("pos", "m")).select(
        "id", "day", "pos", F.when(kind.isin("breakfast", "lunch", "dinner", "snack"), kind).otherwise("lunch").alias("type"),
        text("m.name").alias("name"), number("m.cost").alias("cost"))
    hotels = day.where(F.col("d.hotel").isNotNull()).select(
        "id", "day", text("d.hotel.name").alias("name"), text("d.hotel.address").alias("address"), number("d.hotel.price").alias("price"))
    weather = plan.select("id", F.posexplode("weather").alias("pos", "w")).select(
        "id", "pos", text("w.date").alias("date"), text("w.day").alias("day"), text("w.night").alias("night"), F.coalesce("w.temp", F.lit(0)).alias("temp"))
    budget = plan.where(F.col("budget").isNotNull()).select(
        "id", *[number(f"budget.{c}").alias(c) for c in ("attractions", "hotels", "meals", "transport", "total")])
    return {"days": days, "attractions": attractions, "meals": meals, "hotels": hotels, "weather": weather, "budget": budget}

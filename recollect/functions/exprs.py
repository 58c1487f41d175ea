"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character ranges counted as one token each.
HAN = "\\u4E00-\\u9FFF\\u3400-\\u4DBF\\uF900-\\uFAFF"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once; inside a lambda an outer expression would run again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


# The white space that patterns call \s.
SPACE = " \t\n\x0b\f\r"


def blank(c: str | Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def words(c: str | Column) -> Column:
    """ASCII word tokens of the lower-cased text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def strip(c: str | Column) -> Column:
    """Text without white space of any kind at both ends, in one pass from each end; F.trim removes blanks only."""
    return F.btrim(col(c), F.lit(SPACE))


def han_tokens(c: str | Column) -> Column:
    """Single Han characters followed by their bigrams, the rule used where no segmenter is given."""
    han = F.regexp_replace(col(c), f"[^{HAN}]", "")
    chars = F.split(han, "")
    singles = F.filter(chars, lambda x: x != "")
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(han), F.lit(1))), lambda i: i < F.length(han)),
        lambda i: F.substring(han, i, F.lit(2)),
    )
    return F.concat(singles, pairs)


def tokens(c: str | Column, han: bool = True) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    if not han:
        return words(text)
    # The Han branch costs nothing for texts without such characters.
    return F.when(F.regexp_like(text, F.lit(f"[{HAN}]")), F.concat(words(text), han_tokens(text))).otherwise(
        words(text)
    )


def long_words(c: str | Column) -> Column:
    """Distinct tokens of at least two characters."""
    return F.filter(F.array_distinct(tokens(c)), lambda w: F.length(w) >= 2)


def approx_tokens(c: str | Column) -> Column:
    """Han characters plus whitespace words that hold anything else."""
    text = F.coalesce(col(c), F.lit(""))
    # Han characters vanish inside their word; words made only of them become empty and are filtered out.
    rest = F.regexp_replace(text, f"[{HAN}]", "")
    han = F.length(text) - F.length(rest)
    return (han + F.size(F.filter(F.split(rest, r"\s+"), lambda w: w != ""))).cast("int")


def java_hash(c: str | Column) -> Column:
    """Signed 32-bit polynomial string hash (base 31), for ASCII terms."""
    codes = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    unsigned = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(4294967295)))
    return F.when(unsigned < 2147483648, unsigned).otherwise(unsigned - 4294967296)


def keyword_share(query: str | Column, content: str | Column) -> Column:
    """Share of the whitespace words of the query that occur in the content."""
    def share(q: Column) -> Column:
        hit = let(F.lower(col(content)), lambda low: F.size(F.filter(q, lambda w: F.contains(low, w))))
        return hit / F.size(q)

    return F.when(blank(query), F.lit(0.0)).otherwise(let(F.split(F.lower(col(query)), r"\s+"), share))


def long_keyword_share(query: str | Column, content: str | Column) -> Column:
    """Share of the distinct query words of at least two characters that occur in the content."""
    return keyword_array_share(long_words(query), F.lower(col(content)))


def keyword_array_share(keywords: str | Column, lower_content: str | Column) -> Column:
    keys, text = col(keywords), col(lower_content)
    hit = let(text, lambda low: F.size(F.filter(keys, lambda w: F.contains(low, w))))
    return F.when((F.size(keys) == 0) | blank(text), F.lit(0.0)).otherwise(hit / F.size(keys))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of two token arrays; 0 where the second (the query) is empty."""
    x, y = col(a), col(b)
    both = F.size(F.array_intersect(x, y))
    either = F.size(F.array_union(x, y))
    return F.when(F.size(y) == 0, F.lit(0.0)).otherwise(both / either)


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def importance_weight(c: str | Column) -> Column:
    return F.lit(0.8) + F.lit(0.4) * col(c)


def recency(ts: str | Column, as_of: str | Column, unit: str = "HOUR", missing: float = 0.5) -> Column:
    """max(0.1, exp(-0.1 * age in days)), with the age first floored to ``unit``."""
    now = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    per_hour = {"HOUR": 1.0, "MINUTE": 60.0, "SECOND": 3600.0}[unit]
    hours = F.timestamp_diff(unit, col(ts).cast("timestamp_ntz"), now) / F.lit(per_hour)
    score = F.greatest(F.lit(0.1), F.exp(F.lit(-0.1) * hours / F.lit(24.0)))
    if unit == "SECOND":
        score = F.least(F.lit(1.0), score)
    return F.when(col(ts).isNull(), F.lit(missing)).otherwise(score)


def preview(c: str | Column, width: int, marker: str = "...", one_line: bool = True) -> Column:
    text = col(c)
    cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(marker))).otherwise(text)
    return F.regexp_replace(cut, "\n", " ") if one_line else cut


def band(c: str | Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound is reached; ``steps`` go from high to low."""
    value = col(c)
    out = None
    for bound, label in steps:
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return out.otherwise(otherwise)


def modality(path: str | Column) -> Column:
    """Modality by file extension; moving pictures count as images."""
    # Extensions per modality.
    lower = F.lower(col(path))
    return (
        F.when(lower.rlike(r"\.(png|jpg|jpeg|gif|bmp|webp|svg|tiff)$"), "image")
        .when(lower.rlike(r"\.(mp4|avi|mov|mkv|webm|flv)$"), "image")
        .when(lower.rlike(r"\.(mp3|wav|ogg|flac|aac|m4a)$"), "audio")
        .otherwise("text")
    )


def _any_of(c: str | Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(col(c), F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def memory_type(content: str | Column, current: str | Column | None = None) -> Column:
    """Memory type by keywords of the content; without one the current type, or else working."""
    # Keywords per type, in the order they are tried.
    return (
        F.when(_any_of(content, ["知识", "定义", "概念", "原理"]), "semantic")
        .when(_any_of(content, ["事件", "经历", "完成", "发生"]), "episodic")
        .when(_any_of(content, ["图片", "截图", "音频", "视频"]), "perceptual")
        .otherwise(F.lit("working") if current is None else F.coalesce(col(current), F.lit("working")))
    )


def note_type(text: str | Column) -> Column:
    """Note type by keywords of what the user wrote."""
    # Keywords per type, in the order they are tried.
    return (
        F.when(_any_of(text, ["问题", "阻塞", "错误", "bug", "block"]), "blocker")
        .when(_any_of(text, ["计划", "下一步", "任务", "plan", "todo"]), "action")
        .otherwise("conclusion")
    )


def day_part(ts: str | Column) -> Column:
    """Part of the day by hour."""
    h = F.hour(col(ts))
    return (
        F.when((h >= 6) & (h < 9), "early_morning")
        .when((h >= 9) & (h < 12), "morning")
        .when((h >= 12) & (h < 14), "noon")
        .when((h >= 14) & (h < 17), "afternoon")
        .when((h >= 17) & (h < 19), "evening")
        .otherwise("night")
    )


def clean_markdown(c: str | Column) -> Column:
    """Plain text for embedding: no code, images, link targets, tags or emphasis; blanks squeezed."""
    text = F.coalesce(col(c), F.lit(""))
    text = F.regexp_replace(text, r"```[\s\S]*?```", " ")
    text = F.regexp_replace(text, r"`[^`]+`", " ")
    text = F.regexp_replace(text, r"!\[.*?\]\(.*?\)", " ")
    text = F.regexp_replace(text, r"\[(.*?)\]\(.*?\)", "$1")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"\*{1,3}|_{1,3}", "")
    return strip(F.regexp_replace(text, r"\s+", " "))


def html_text(c: str | Column) -> Column:
    """Visible text of a page: script, style and comments go first, because they may hold tag-like text."""
    text = F.coalesce(col(c), F.lit(""))
    text = F.regexp_replace(text, r"(?is)<script\b.*?</script\s*>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return strip(F.regexp_replace(text, r"\s+", " "))


def final_answer(c: str | Column) -> Column:
    """What follows the answer marker up to the line end, else the last non-blank line, else the text."""
    text = F.coalesce(col(c), F.lit(""))
    marker = r"(?is)FINAL\s*ANSWER\s*:\s*(.+?)(?:\n|$)"
    marked = strip(F.regexp_extract(text, marker, 1))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")
    return F.when(F.regexp_like(text, F.lit(marker)), marked).otherwise(
        F.coalesce(F.try_element_at(lines, F.lit(-1)), strip(text))
    )


def normalise_answer(c: str | Column) -> Column:
    text = strip(F.lower(F.coalesce(col(c), F.lit(""))))
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"(\d),(\d)", "$1$2")
    text = F.regexp_replace(text, r"\.$", "")
    text = F.regexp_replace(text, "[\"']", "")
    return F.regexp_replace(text, r"^(a|an|the)\s+", "")


def l2_norm(c: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(c), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

"""Row helpers for markdown: paragraphs under their headings, and chunks of paragraphs. Run inside Arrow tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_HAN = re.compile("[一-鿿㐀-䶿豈-﫿]")
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")  # white space as in the column expressions


class Paragraph(NamedTuple):
    content: str
    heading_path: str | None
    start: int
    end: int


class Chunk(NamedTuple):
    content: str
    heading_path: str | None
    start: int
    end: int
    tokens: int


def approx_tokens(text: str) -> int:
    """Han characters, plus whitespace words that hold anything else."""
    bare, han = _HAN.subn("", text)
    return han + len(_WORD.findall(bare))


def paragraphs(text: str) -> Iterator[Paragraph]:
    """Paragraphs end at blank lines and headings and know the path of headings above them."""
    path: list[str] = []
    lines: list[str] = []
    start = offset = found = 0

    def close(end: int) -> Iterator[Paragraph]:
        content = "\n".join(lines).strip()
        lines.clear()
        if content:
            yield Paragraph(content, " > ".join(path) if path else None, start, end)

    for line in text.split("\n"):
        bare = line.strip()
        heading = bare.startswith("#")
        if heading or not bare:
            for p in close(offset):
                found += 1
                yield p
        if heading:
            title = bare.lstrip("#")
            del path[len(bare) - len(title) - 1 :]
            path.append(title.strip())
        elif bare:
            if not lines:
                start = offset
            lines.append(line)
        offset += len(line) + 1
    for p in close(offset):
        found += 1
        yield p
    if not found:
        yield Paragraph(text, None, 0, len(text))


def _join(part: list[Paragraph]) -> Chunk:
    content = "\n\n".join(p.content for p in part)
    heading = next((p.heading_path for p in reversed(part) if p.heading_path is not None), None)
    return Chunk(content, heading, part[0].start, part[-1].end, approx_tokens(content))


def chunks(text: str, budget: int, overlap: int) -> Iterator[Chunk]:
    """Fill chunks up to the token budget; the last short paragraphs of a chunk open the next one.

    The overlap is dropped where it does not fit beside the next paragraph, so every chunk brings a new paragraph.
    """
    part: list[Paragraph] = []
    sizes: list[int] = []
    for p in paragraphs(text):
        size = max(approx_tokens(p.content), 1)
        if part and sum(sizes) + size > budget:
            yield _join(part)
            keep, kept = len(part), 0
            while keep > 0 and kept + sizes[keep - 1] <= overlap:
                keep -= 1
                kept += sizes[keep]
            if kept + size > budget:
                keep = len(part)
            part, sizes = part[keep:], sizes[keep:]
        part.append(p)
        sizes.append(size)
    if part:
        yield _join(part)

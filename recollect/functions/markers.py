"""Row helpers for nested marks in model text, which regular expressions cannot match."""

from __future__ import annotations

import re

TOOL_MARK = "[TOOL_CALL:"
_THINK = re.compile("<think>|</think>")


def strip_reasoning(text: str) -> str:
    """Text without ``<think>`` blocks, nested ones included; an unclosed block stays as it is."""
    if not text.strip() or "<think>" not in text and "</think>" not in text:
        return text
    kept, depth, position = [], 0, 0
    for tag in _THINK.finditer(text):
        if tag.group() == "<think>":
            if depth == 0:
                kept.append(text[position : tag.start()])
                position = tag.start()
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                position = tag.end()
    # Below zero a closing mark came without an opening one; what is left after it is then dropped.
    if depth >= 0:
        kept.append(text[position:])
    return "".join(kept).strip()


# What can matter inside a body: a quoted string as a whole, a quote that is never closed, and brackets.
_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|["\[\]{}]', re.DOTALL)
_MARK = re.compile(r"\[TOOL_CALL:([^:]*):")


def _closing(text: str, begin: int) -> int | None:
    """Where the square bracket stands that closes a body beginning at ``begin``."""
    inside = 0
    for piece in _PIECES.finditer(text, begin):
        kind = piece.group()
        if kind == '"':
            return None
        inside += (kind in ("[", "{")) - (kind in ("]", "}"))
        if inside < 0 and kind == "]":
            return piece.start()
    return None


def _marks(text: str):
    """(match of the head, position of the closing bracket or None) of every tool mark.

    The search goes on behind a closed mark, and behind the head of an unclosed one.
    """
    head = _MARK.search(text)
    while head:
        close = _closing(text, head.end())
        yield head, close
        head = _MARK.search(text, head.end() if close is None else close + 1)


def strip_tool_calls(text: str) -> str:
    """Text without tool marks; from an unclosed mark on everything stays."""
    if not text.strip():
        return text
    kept, position = [], 0
    for head, close in _marks(text):
        if close is None:
            break
        kept.append(text[position : head.start()])
        position = close + 1
    kept.append(text[position:])
    return "".join(kept).strip()


def tool_calls(text: str | None) -> list[tuple[str, str]]:
    """(name, body) of every closed mark, also of those behind an unclosed one."""
    return [(head.group(1).strip(), text[head.end() : close].strip()) for head, close in _marks(text or "") if close is not None]

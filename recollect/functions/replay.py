"""Row helper: a bounded memory with a time to live, replayed insert by insert."""

from __future__ import annotations

from typing import NamedTuple


class Held(NamedTuple):
    importance: float
    at: int  # microseconds
    seq: tuple


def insert(held: list[Held], row: Held, capacity: int, ttl: int | None) -> list[Held]:
    """Drop what is too old at the row's time, then the least important and oldest if full, then add the row."""
    if ttl is not None and held:
        held = [h for h in held if h.at >= row.at - ttl]
    if len(held) >= capacity:
        held = list(held)
        held.remove(min(held))
    return [*held, row]

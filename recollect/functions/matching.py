"""Substring search of many phrases in many texts: one pass over the texts for a bounded block of phrases.

The phrases are written once and travel to the tasks in blocks of a bounded size (:mod:`recollect.functions.blocks`); no text is shuffled, split into
words or written. A phrase is looked up by the hash of one of its windows, so many bytes in a row, of those the one that the fewest windows of the
block equal. The hashes of all windows of the texts are compared with them, and every text that holds such a window is checked for
the whole phrase. UTF-8 makes a match of bytes a match of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.blocks import block_match
from recollect.session import cut

WIDTHS = (*range(1, 9), 12, 16, 32)  # bytes of a window; a phrase takes the widest that fits
BLOCK_PHRASES = 1 << 17
STEP = 1 << 18  # bytes of text looked at together, and most rows of a result batch
ODD = np.uint64(0x9E3779B97F4A7C15)


def _windows(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes in a row; of up to 8 bytes, different ones for different windows."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    if width < 8:
        for k in range(width):
            out |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        return out * ODD
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    for at in sorted({*range(0, width - 7, 8), width - 8}):
        out ^= out >> np.uint64(32)
        out = (out ^ eight[at : at + n]) * ODD
    return out


class Phrases:
    """Phrases (bytes, none empty), found in texts by the hash of one window each."""

    def __init__(self, phrases: list[bytes]):
        self.phrases = phrases
        widest = np.array([max(w for w in WIDTHS if w <= len(p)) for p in phrases], int)
        self.tables = []
        for width in np.unique(widest).tolist():
            own = np.flatnonzero(widest == width)
            hashes = [_windows(np.frombuffer(phrases[k], np.uint8), width) for k in own]
            every, owner = np.concatenate(hashes), np.repeat(own, [len(h) for h in hashes])
            _, place, count = np.unique(every, return_inverse=True, return_counts=True)
            order = np.lexsort((every, count[place], owner))
            first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]  # a phrase's rarest window
            first = first[np.argsort(every[first], kind="stable")]
            keys, starts = np.unique(every[first], return_index=True)
            bits = max(16, int(len(keys)).bit_length() + 4)
            known = np.zeros(1 << bits, bool)
            known[keys >> np.uint64(64 - bits)] = True
            self.tables.append((width, keys, np.split(owner[first], starts[1:]), np.uint64(64 - bits), known))

    def found(self, raw: np.ndarray, ends: np.ndarray, step: int = STEP) -> Iterator[tuple[list[int], list[int]]]:
        """(phrases, texts), each pair once, of texts that lie one behind the other in ``raw`` and begin and end at ``ends``."""
        phrase, text = [], []
        for width, keys, owners, shift, known in self.tables:
            pairs = [np.zeros(0, np.int64)]
            for begin in range(0, len(raw), step):
                hashes = _windows(raw[begin : begin + step + width - 1], width)
                at = np.flatnonzero(known[hashes >> shift])
                key = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
                same = keys[key] == hashes[at]
                inside = np.searchsorted(ends, begin + at[same], side="right") - 1
                pairs.append(np.unique(inside * len(keys) + key[same]))
            last, held = -1, b""
            for pair in np.unique(np.concatenate(pairs)).tolist():
                k, key = divmod(pair, len(keys))
                if k != last:
                    last, held = k, raw[ends[k] : ends[k + 1]].tobytes()
                for p in owners[key].tolist():
                    if self.phrases[p] in held:
                        phrase.append(p)
                        text.append(k)
                if len(phrase) >= STEP:
                    yield phrase, text
                    phrase, text = [], []
        if phrase:
            yield phrase, text


def substring_hits(
    phrases: DataFrame, texts: DataFrame, phrase_id: str = "query_id", phrase: str = "phrase", text_id: str = "id", text: str = "text"
) -> DataFrame:
    """(phrase_id, text_id) for every text that contains the phrase; both sides are compared as given. Blank phrases find nothing.

    Equal phrases are searched once. The texts are read once per ``BLOCK_PHRASES`` phrases or 16 MB of them.
    """
    named = phrases.select(F.col(phrase_id).alias("_q"), F.col(phrase).alias("_p")).where(F.regexp_like("_p", F.lit(r"\S")))
    once = cut(named.select("_p").distinct().withColumn("_n", F.monotonically_increasing_id()))
    t = texts.select(F.col(text_id).alias("_t"), F.col(text).alias("_x")).where("_x IS NOT NULL")

    def prepare(block: pa.Table) -> tuple[Phrases, np.ndarray]:
        return Phrases(block["_p"].cast(pa.binary()).to_pylist()), block["_n"].to_numpy()

    def match(state: tuple[Phrases, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = state
        for batch in batches:
            column = batch.column("_x").cast(pa.large_string())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            for p, k in known.found(raw, ends - ends[0]):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[p]), batch.column("_t").take(pa.array(k))], names=["_n", "_t"])

    hits = block_match(once, t, "_n", prepare, match, f"_n long, _t {t.schema['_t'].dataType.simpleString()}", F.octet_length("_p"), BLOCK_PHRASES)
    return named.join(once, "_p").join(hits, "_n").select(F.col("_q").alias(phrase_id), F.col("_t").alias(text_id))

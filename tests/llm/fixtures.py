"""Small tables with the odd cases: nulls, empty and very long texts, copies, near copies, shared passages, extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, node long, score double, text_key string, key string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    plain = [". ".join(sentence(rng, rng.randint(5, 25)) for _ in range(rng.randint(2, 8))) for _ in range(25)]
    long = "\n".join(sentence(rng, 40) for _ in range(150))
    near = plain[0].split()
    near[len(near) // 2] = "changed"
    return [
        *plain,
        plain[1], plain[1], plain[2].upper(),
        " ".join(near),
        plain[3] + "\n" + shared + "\n" + sentence(rng, 30),
        plain[4] + " tail\n" + shared,
        long, long + "\nEnde äöü " + shared,
        "ß" * 150 + "ü" + "ß" * 150,
        "abab" * 120,
        None, None, "", " \t\r\n ", "one", "one", "one two", "\x0bone\x0c two\x1cthree",
        "Same Line here\nSame Line here\n\nSame Line here",
    ]


def rows(seed: int = 5) -> list[tuple]:
    out = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), i, -i, 0.5, "x", "y") for i, t in enumerate(texts(seed))]
    out[4] = (None, *out[4][1:])
    return [*out, out[3], out[5], (None, None, None, None, None, None, None, None, None, None)]


def documents(spark, seed: int = 5):
    return spark.createDataFrame(rows(seed), DOCS).repartition(3)


def plain(t: str | None) -> list[bytes]:
    return (t or "").encode().lower().split()

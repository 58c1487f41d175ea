"""License scans: an exact set-similarity join of text blocks with license templates, beside fixed phrases.

A block is a line, or for templates of ``WRAPPED_WORDS`` words also a paragraph of several lines (a run of lines that are not blank): a long
passage may be wrapped, while the few words of a short notice would be found scattered over a paragraph. A block matches a template if it holds at
least ``CONTAINMENT`` of the template's distinct words. Words are ordered globally by their frequency in the corpus, rarest first, and
the join uses three filters that lose no match: of a matching block's words one must be among the template's first
``n - needed + 1`` (prefix); a block with fewer words than needed cannot match (length); and where the first common word stands at places
i and j, no more than 1 + min(rest of the template, rest of the block) words can be common (position). The remaining
pairs are verified by counting.

The templates, their words and the frequencies of these words are bounded by the list of templates and not by the corpus, so they may be
broadcast or stand in the plan. Documents are read twice and never shuffled. Everything is DataFrame expressions.

Lower-casing concerns A-Z. Null and empty texts have no words, no label and the score 0. Equal lines are blocks by themselves but
give a label once. Repeated rows are scanned each, and other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import dropped_shuffles, let, lower_ascii, saved

CONTAINMENT = 0.9
WRAPPED_WORDS = 15  # templates of so many distinct words are also sought in paragraphs of several lines
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and characteristic passages of common licenses, with the method's labels.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(SEPARATORS, text.lower()) if w})


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often the corpus holds each word of the templates. Rows are added up before the shuffle, one per word."""
    found = docs.select(F.explode(words(F.lower("text"))).alias("w")).where(F.col("w").isin(vocabulary))
    with dropped_shuffles(docs.sparkSession):
        counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def needed(n: int, containment: float) -> int:
    """The least number of common words that makes the containment."""
    return max(1, -int(-(containment * n - 1e-9) // 1))


def blocks(text: Column) -> Column:
    """The distinct lines of a text and its paragraphs of several lines (wrapped)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x00-\x20]"))
    paragraphs = F.filter(F.split(text, r"\n[\x20\x09\x0B-\x0D]*\n"), lambda x: x.rlike(r"[^\x00-\x20][^\n]*\n[^\n]*[^\x00-\x20]"))
    as_rows = lambda x, wrapped: F.transform(F.array_distinct(x), lambda b: F.struct(b.alias("block"), F.lit(wrapped).alias("wrapped")))
    return F.concat(as_rows(lines, False), as_rows(paragraphs, True))


def ordered_templates(templates: list[tuple[str, str]], frequencies: dict[str, int], containment: float) -> list[tuple]:
    """(t, label, n, needed, ranks of the words, rarest first) of each template."""
    order = {w: i for i, w in enumerate(sorted(frequencies, key=lambda w: (frequencies[w], w)))}
    sets = [(label, sorted(order[w] for w in template_words(text))) for label, text in templates]
    return [(t, label, len(ids), needed(len(ids), containment), ids) for t, (label, ids) in enumerate(sets)]


def matching_blocks(texts: DataFrame, frequencies: dict[str, int], templates: list[tuple], containment: float) -> DataFrame:
    """_key, block, label, similarity: the (block, template) pairs of the texts (_key, _text) that reach the containment."""
    table = texts.sparkSession.createDataFrame(templates, "t int, label string, n int, needed int, ids array<int>")
    prefix = table.select("label", "n", "needed", "ids", F.posexplode(F.slice("ids", F.lit(1), F.col("n") - F.col("needed") + 1)).alias("i", "id"))
    order = sorted(frequencies, key=lambda w: (frequencies[w], w))
    ranks = F.create_map(*[F.lit(x) for k, w in enumerate(order) for x in (w, k)])
    block = texts.select("_key", F.inline(blocks(F.col("_text"))))
    # Words outside the templates can never be common; the others become their ranks in the global order.
    known = F.transform(F.array_distinct(words(lower_ascii(F.col("block")))), lambda w: F.try_element_at(ranks, w))
    probes = block.select("_key", "block", "wrapped", F.array_sort(F.filter(known, lambda x: x.isNotNull())).alias("own"))
    probes = probes.select("_key", "block", "wrapped", "own", F.posexplode("own").alias("j", "id"))
    # Prefix (the join), length and position; a pair that meets at several words is judged at its first common one.
    met = probes.join(F.broadcast(prefix), "id").where(
        (~F.col("wrapped") | (F.col("n") >= WRAPPED_WORDS))
        & (F.size("own") >= F.col("needed")) & (F.least(F.col("n") - F.col("i"), F.size("own") - F.col("j")) >= F.col("needed"))
    )
    common = met.withColumn("common", F.array_intersect("own", "ids")).where(F.get("common", F.lit(0)) == F.col("id"))
    return common.where(F.size("common") >= F.col("needed")).select("_key", "block", "label", (F.size("common") / F.col("n")).alias("similarity"))


def phrase_places(own: Column) -> Column:
    """The places of all phrases in a text's words: structs of start and label, in order."""
    def of_phrase(phrase: str, label: str) -> Column:
        parts = F.array(*[F.lit(w) for w in phrase.split()])
        n = len(phrase.split())
        starts = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: F.slice(own, i, n) == parts)
        return F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("start"), F.lit(label).alias("label")))

    return F.array_sort(F.concat(*[of_phrase(p, x) for p, x in PHRASES.items()]))


def license_scan(docs: DataFrame, containment: float = CONTAINMENT, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row.

    The score is 1 where a phrase stands, else the largest containment of a matching block, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    frequencies = word_frequencies(docs, sorted({w for _, t in templates for w in template_words(t)}))
    table = ordered_templates(templates, frequencies, containment)
    order = sorted(frequencies, key=lambda w: (frequencies[w], w))
    heads = sorted({order[i] for _, _, n, least, ids in table for i in ids[: n - least + 1]})
    # lower() changes more letters than A-Z, so it finds a superset of the texts worth a second look, and as many words.
    split = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), words(F.lower(F.coalesce("text", F.lit("")))).alias("_words"))
    joined = F.array_join("_words", " ")
    phrased = F.lit(False)
    for phrase in PHRASES:
        phrased = phrased | F.contains(joined, F.lit(phrase))
    hinted = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in heads]))
    marked = split.select("doc_id", F.size("_words").cast("long").alias("n_words"), phrased.alias("_phrased"), F.when(phrased | hinted, F.col("_text")).alias("_text"))
    places = F.when(F.col("_phrased"), let(words(lower_ascii(F.col("_text"))), phrase_places))
    keyed = marked.select("doc_id", "n_words", "_text", F.coalesce(places, F.expr("cast(array() as array<struct<start:bigint,label:string>>)")).alias("_places"))
    kept = saved(keyed.withColumn("_key", F.monotonically_increasing_id()), "license-texts")
    found = matching_blocks(kept.where(F.col("_text").isNotNull()).select("_key", "_text"), frequencies, table, containment)
    per_text = found.groupBy("_key").agg(F.collect_set("label").alias("_labels"), F.max("similarity").alias("_best"))  # at most one label per template
    both = kept.drop("_text").join(per_text, "_key", "left")
    base = F.transform("_places", lambda x: x["label"])
    every = F.concat(base, F.coalesce("_labels", F.expr("cast(array() as array<string>)")))
    return both.select(
        "doc_id",
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.get("_places", F.lit(0))["start"].alias("first_word"),
        F.get("_places", F.size("_places") - 1)["start"].alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )

"""Scores, models, mixtures and formats against brute force, held-out data or exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from recollect.llm import chat, hmm, licenses, mixture, quality, toxicity
from recollect.llm.common import held_out
from tests.llm.fixtures import DOCS, documents, plain, rows


def test_quality_base_rules(spark):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (2, 1), (None, 1), (999, 1), (5, None)], "doc_id long, quality int")
    got = quality.quality_rules(documents(spark), labels).collect()
    want = Counter()
    for r in rows():
        text = r[1] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got)


def test_quality_ratio_tells_junk(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(12)]
    good = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(60)]
    junk = [" ".join(w + "###" for w in rng.choices(vocabulary, k=80)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 80, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 80))
    same = quality.quality_rules(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(same) == (0.0, 0.0)


def test_base_scores_of_the_language_model(spark):
    got = hmm.language_model_scores(documents(spark), held_out(F.col("doc_id"), 10, 0)).collect()
    train, counts = 0, Counter()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for r in rows():
        if not out(r[0]):
            counts.update([*plain(r[1]), None])
    train = sum(counts.values())
    want = defaultdict(list)
    for r in rows():
        t = [*plain(r[1]), None]
        base = sum(math.log10((counts[x] + 0.1) / (train + 0.1 * (len(counts) + 1))) for x in t)
        want[r[0]].append((out(r[0]), len(t), sum(counts[x] > 0 for x in t), train, round(base, 6)))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
        assert r.score < 0
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_forward_recursion_and_counts_are_exact():
    rng = np.random.default_rng(1)
    start, moves, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T
    runs = [rng.integers(0, 6, n).astype(np.uint16) for n in (5, 3, 5, 1, 2)]

    def brute(seq):
        total, first, pairs, seen = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
        for path in np.ndindex(*[3] * len(seq)):
            p = start[path[0]] * emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= moves[path[t - 1], path[t]] * emit[seq[t], path[t]]
            total += p
            first[path[0]] += p
            for t in range(len(seq)):
                seen[seq[t], path[t]] += p
                if t:
                    pairs[path[t - 1], path[t]] += p
        return math.log10(total), first / total, pairs / total, seen / total

    each = [brute(r) for r in runs]
    for table, lengths, which in hmm.side_by_side(runs):
        assert np.allclose(hmm.log_likelihood(table, lengths, start, moves, emit), [each[i][0] for i in which])
        for got, want in zip(hmm.expected_counts(table, lengths, start, moves, emit), [sum(each[i][k] for i in which) for k in (1, 2, 3)], strict=True):
            assert np.allclose(got, want)


def test_language_model_beats_unigrams_and_sums_to_one(spark):
    rng = random.Random(2)
    topics = [["t%d_%d" % (k, i) for i in range(50)] for k in range(3)]
    docs = [(i, " ".join(rng.choices(topics[i % 3], k=60))) for i in range(300)]
    got = hmm.language_model_scores(spark.createDataFrame(docs, "doc_id long, text string"), held_out(F.col("doc_id"), 10, 0)).where("held_out")
    gain = got.agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0]
    assert gain > 0.2
    none = hmm.language_model_scores(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in none] == [(3, 0, 0), (1, 0, 0)]


def test_licenses(spark):
    extra = [(500, "x GNU general PUBLIC license, apache-license"), (501, "cc\nby mit License MIT LICENSE"), (502, "Licensed under CC BY-NC 4.0."), (503, "permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files, to deal in the software without\nrestriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software")]
    docs = documents(spark).select("doc_id", "text", "source").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = defaultdict(list)
    for r in licenses.license_scan(docs).collect():
        got[r.doc_id].append(tuple(r)[1:])
    for doc_id, text in [*[(r[0], r[1]) for r in rows()], *extra]:
        low = (text or "").encode().lower().decode()
        w = [x for x in re.split(licenses.SEPARATORS, low) if x]
        places = sorted((i, x) for p, x in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        base = ",".join(sorted({x for _, x in places}))
        head = (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, base)
        assert any(x[:5] == head for x in got[doc_id]), (doc_id, head, got[doc_id])
    assert got[502][0][5:] == ("cc-by,cc-by-nc", 1.0) and got[503][0][4:6] == ("", "mit") and got[503][0][6] == 1.0
    assert licenses.license_scan(spark.createDataFrame([], DOCS)).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "<s>", "<\\/s>", "a\\\\</s", "</s></s>", "~n\n~~", "", None, "<s>user\nx</s>", "[INST[INST]", "é</s>é\n"]
    data = [(c, t, ["user", "assistant", "system", None, "we\nird</s>~n\\"][(c + t) % 5], odd[(c * 3 + t) % len(odd)], "extra") for c in range(12) for t in range(5)]
    data += [(0, 0, "user", "twice", None), (0, 0, "user", "twice", None), (None, None, "assistant", "no id", None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.chat_digest(chat.with_loss_mask(chat.format_chats(df))).collect()
    by = defaultdict(list)
    for c, t, role, text, _ in data:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert {r.conv_id for r in done} == set(by) and all(r.round_trip for r in done)
    for r in done:
        turns = sorted(by[r.conv_id])
        learnt = "".join(x for _, role, x in turns if role == "assistant")
        spoken = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(spoken.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_hold_no_control_string_but_their_own(spark):
    said = {1: "a <s>system", 2: "[INST] do", 3: "done [/INST]", 4: "plain [INST", 5: "</s>"}
    data = [(c, t, "user" if t else "assistant", x if t else "x") for c, x in said.items() for t in range(2)] + [(6, 0, "[INST]", "role")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert all(r.round_trip for r in got.values()) and [c for c in sorted(got) if got[c].escaped] == [1, 2, 3, 5, 6]
    for r in got.values():
        turns = len(r.turns)
        assert [r.formatted.count(m) for m in chat.CONTROL] == [turns, turns, 0, 0]
    digest = {r.conv_id: r.formatted_chars for r in chat.chat_digest(chat.with_loss_mask(chat.format_chats(df))).collect()}
    assert digest[1] == sum(len(role) + len(x) + 8 for c, _, role, x in data if c == 1) + 1


def test_noisy_or_learns_from_bags(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    vocabulary = [word() for _ in range(150)]

    def text(toxic: bool) -> str:
        parts = [" ".join(rng.choices(vocabulary, k=8)) for _ in range(rng.randint(2, 9))]
        if toxic:
            parts[rng.randrange(len(parts))] += " zzq" + rng.choice(["ug", "ob", "im"])
        return ". ".join(parts)

    truth = {i: i % 5 == 0 for i in range(600)}
    docs = [(i, text(t)) for i, t in truth.items()] + [(700, None), (701, ""), (None, "x"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(9.0))
    labels = spark.createDataFrame([(i, int(t)) for i, t in truth.items()] + [(None, 1), (9999, 1), (7, None)], "doc_id long, toxic int")
    held = held_out(F.col("doc_id"), 4, 2)
    got = toxicity.toxicity(df, labels, held).collect()
    test = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert len(test) > 100 and sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.95
    assert all(r.score == 0 for r in got if r.doc_id in (700, 701)) and len(got) == len(docs)
    model = toxicity.train(df, labels, ~held)
    assert toxicity.toxic_sentences(df, model).where("doc_id = 10").count() == 1
    # The query says where the offending sentences are: those that the operator lists.
    listed = {}
    for r in toxicity.toxic_sentences(df, model).collect():
        listed.setdefault(r.doc_id, []).append((r.sentence, r.score))
    for r in got:
        own = listed.get(r.doc_id, [])
        assert r.n_toxic_sentences == len(own)
        if own:
            best = max(s for _, s in own)
            assert (r.worst_sentence, r.worst_score) == (min(k for k, s in own if s == best), best)
        assert r.worst_score is None or r.worst_score <= r.score + 1e-6
    blank = toxicity.toxicity(df, labels.limit(0), held)
    assert blank.agg(F.max("score")).first()[0] == 0


def test_mixture_meets_its_target(spark):
    sizes = {"a": 5000, "b": 600, "c": 300, "d": 100}
    docs = [(i, " ".join(["w"] * 10), s) for s, n in sizes.items() for i in range(n // 10)]
    docs += [(-1, None, "a"), (-2, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("weight", F.lit("clash"))
    got = mixture.mix_sources(df, evenness=0.8, max_epochs=4, block_tokens=1000).toPandas()
    per = got.groupby("source").agg(w=("weight", "first"), n=("n_tokens", "sum"))
    p = np.array([per.w[s] for s in sizes])
    share = np.array(list(sizes.values())) / 6000
    entropy = -(p * np.log(p)).sum() / math.log(4)
    assert abs(p.sum() - 1) < 1e-9
    most = max(per.n[s] / sizes[s] for s in sizes)
    assert entropy >= 0.8 - 1e-6 or most >= 3.9
    t = np.log(p / p[0])[1:] / np.log(share / share[0])[1:]
    assert np.allclose(t, t[0])
    assert all(abs(per.n[s] - per.w[s] * 6000) <= 10 for s in sizes) and most <= 4.05
    whole = got[(got.source == "b")].groupby(["epoch", "doc_id"]).size()
    assert whole.max() == 1
    one = got[(got.block == 1)].groupby("source").n_tokens.sum()
    assert all(abs(one.get(s, 0) - 1000 * per.w[s]) <= 10 for s in sizes)
    assert mixture.mix_sources(df.limit(0)).count() == 0


def test_noisy_or_and_its_gradient_against_brute_force():
    rng = np.random.default_rng(3)
    bags = np.array([2, 0, 1, 3])
    sizes = rng.integers(1, 5, bags.sum())
    words, stems = rng.integers(0, 6, sizes.sum()), toxicity.FEATURES // 2 + rng.integers(0, 4, sizes.sum())
    features = (words.astype(np.int64) << 32) | stems
    labels = np.array([1, 0, 0, 1])
    weights = np.zeros(toxicity.FEATURES)
    weights[:6], weights[toxicity.FEATURES // 2 :][:4] = rng.normal(size=6), rng.normal(size=4)

    def loss(w, bias):
        at, sentence, out, scores = 0, 0, 0.0, []
        for n, y in zip(bags, labels, strict=True):
            clean = 1.0
            for _ in range(n):
                k = sizes[sentence]
                z = bias + sum(w[words[i]] + w[stems[i]] for i in range(at, at + k))
                clean *= 1 - 1 / (1 + np.exp(-z))
                at, sentence = at + k, sentence + 1
            scores.append(1 - clean)
            out -= np.log(max(1 - clean, 1e-300)) if y else np.log(clean)
        return out, scores

    z = toxicity.sentence_logits(features, sizes, weights, -0.5)
    value, scores = loss(weights, -0.5)
    assert np.allclose(toxicity.noisy_or(z, bags), scores)
    grad, slope = toxicity.gradient(features, sizes, bags, labels, weights, -0.5)
    step = 1e-6
    assert np.isclose(slope, (loss(weights, -0.5 + step)[0] - loss(weights, -0.5 - step)[0]) / (2 * step), atol=1e-5)
    for k in [*range(6), *range(toxicity.FEATURES // 2, toxicity.FEATURES // 2 + 4)]:
        up, down = weights.copy(), weights.copy()
        up[k] += step
        down[k] -= step
        assert np.isclose(grad[k], (loss(up, -0.5)[0] - loss(down, -0.5)[0]) / (2 * step), atol=1e-5)


def test_chat_sql_escapes_as_the_formatter_does(spark):
    import duckdb

    from recollect.llm.plans import CHAT_SQL, PLANTED_CHAT

    data = [(k, turn, role, text) for k, text in enumerate(["plain", "<s>", "[INST] x", "x [/INST]", "a</s>b", "back\\slash", "~ tilde", ""]) for turn, role, text in ((0, "user", text), (1, "assistant", f"re: {text}"))]
    data += [(20, 0, "us\ner", "x"), (21, 0, "~u", "y"), (25, 0, "~n", "y"), (26, 0, "a~~", "y"), (22, 0, "[INST]", "z"), (22, 1, "assistant", "ok"), (23, 0, "us\\er", None), (24, 0, None, "<s>")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    want = sorted(con.execute(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({CHAT_SQL})").fetchall())
    planted = [(-7, 0, "user", PLANTED_CHAT), (-7, 1, "assistant", PLANTED_CHAT)]
    df = spark.createDataFrame(data + planted, "conv_id long, turn long, role string, text string")
    got = chat.chat_digest(chat.with_loss_mask(chat.format_chats(df)))
    assert sorted(tuple(r) for r in got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()) == want

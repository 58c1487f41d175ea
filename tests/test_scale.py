"""Skew-safe operators against plain loops, with hot keys and many blocks."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions.matching import substring_hits
from recollect.functions.ordered import running_sums
from recollect.functions.replay import Held, insert
from recollect.functions.similarity import cosine_hits
from recollect.operators import context as C
from recollect.operators import graph as G
from recollect.operators import retrieval as R
from recollect.operators import sequences as Q
from recollect.operators import tables as T
from recollect.sources import logs as L


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def test_large_query_tables_give_the_same_hits(spark):
    rng = random.Random(1)
    vec = [[rng.choice([0.0, 1.0, -1.0]) for _ in range(4)] for _ in range(3000)]
    q = spark.createDataFrame([(i, v, str(i % 2)) for i, v in enumerate(vec[:1500])], "query_id long, embedding array<double>, s string")
    v = spark.createDataFrame([(i, x, str(i % 2)) for i, x in enumerate(vec)], "id long, embedding array<double>, s string")
    small = cosine_hits(q, v, 3, scope="s")
    blocked = cosine_hits(q, v, 3, scope="s", block_rows=100)
    assert rows(small) == rows(blocked) and small.count() > 3000


def test_blocks_of_queries_are_fetched_one_by_one(spark, monkeypatch):
    """More than three blocks: the queries are computed once, and the plan of the result holds results only, no block and no corpus."""
    from recollect.functions import blocks

    runs = spark.sparkContext.accumulator(0)
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "query_id long, embedding array<double>").repartition(2)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "id long, embedding array<double>")
    held = []
    fetch = blocks.query_blocks

    def watched(*args):
        n, one = fetch(*args)
        return n, lambda k: held.append(k) or one(k)

    monkeypatch.setattr(blocks, "query_blocks", watched)
    hits = cosine_hits(q.mapInArrow(counted, q.schema), v, 3, block_rows=10)
    assert held == [0, 1, 2, 3, 4] and runs.value == 50
    assert "MapInArrow" not in hits._jdf.queryExecution().toString()
    assert rows(hits) == rows(cosine_hits(q, v, 3))


def test_substring_search(spark):
    rng = random.Random(4)
    words = ["ab", "abc", "b", "c", "hot", "äö", "x.y"]
    texts = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None), (501, ""), (502, "hot " * 400)]
    phrases = [(i, t[a : a + rng.randint(1, 14)]) for i in range(150) for t in [texts[rng.randrange(120)][1]] for a in [rng.randint(0, max(len(t) - 2, 0))]]
    phrases += [(900, "hot"), (901, "hot"), (902, " "), (903, ""), (904, None), (905, "no such words here"), (906, "b\nc"), (907, "t h"), (908, " hot")]
    got = substring_hits(spark.createDataFrame(phrases, "query_id long, phrase string"), spark.createDataFrame(texts, "id long, text string"))
    assert rows(got) == sorted((q, i) for q, p in phrases if p and p.strip() for i, t in texts if t and p in t)


def test_substring_search_writes_no_texts(spark, monkeypatch):
    """One pass over the texts: what is written on the way does not grow with them."""
    from recollect.functions import matching

    written, keep = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: written.append(df.count()) or keep(df))
    texts = spark.range(300).selectExpr("id", "concat_ws(' ', transform(sequence(0, 40), k -> concat('w', (id * 7 + k) % 90))) AS text")
    phrases = spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, "w8"), (3, "9 w5")], "query_id long, phrase string")
    got = substring_hits(phrases, texts)
    assert rows(got) == sorted((q, r.id) for q, p in [(1, "w1 w2 w3 w4"), (2, "w8"), (3, "9 w5")] for r in texts.collect() if p in r.text)
    assert max(written) <= 3


def test_phrases_are_found_across_steps():
    from recollect.functions.matching import Phrases

    rng = random.Random(7)
    texts = ["".join(rng.choice("abä ") for _ in range(rng.choice([0, 1, 5, 90]))).encode() for _ in range(200)]
    phrases = sorted({t[a : a + n] for t in texts for n in (1, 2, 4, 7, 8, 9, 12, 15, 16, 31, 33, 70) for a in [rng.randint(0, len(t))]} - {b""})
    ends = np.cumsum([0, *map(len, texts)])
    for step in (16, 1 << 18):
        got = [pair for p, k in Phrases(phrases).found(np.frombuffer(b"".join(texts), np.uint8), ends, step) for pair in zip(p, k, strict=True)]
        assert sorted(got) == [(p, k) for p, x in enumerate(phrases) for k, t in enumerate(texts) if x in t]


def test_parts_make_the_whole_text(spark):
    from recollect.functions.ordered import text_parts

    rng = random.Random(2)
    data = [(k, rng.randrange(30), "é" * rng.randint(0, 9)) for k in (1, 2) for _ in range(60)] + [(3, 1, "z" * 50), (4, 1, None)]
    df = spark.createDataFrame(data, "k int, at int, x string").repartition(4)
    for sep in ("", "\n\n"):
        for size in (1, 37, 1 << 20):
            parts = text_parts(df, ["k"], ["at"], F.col("x"), sep, size).orderBy("k", "part").collect()
            for k in (1, 2, 3):
                own = [r.text for r in parts if r.k == k]
                assert "".join(own) == sep.join(x for _, x in sorted((at, x) for key, at, x in data if key == k))
                assert all(len(x.encode()) <= size + 50 + len(sep) for x in own)
            assert {r.k for r in parts} == {1, 2, 3}


def test_vectors_of_unequal_length_do_not_meet(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0])], "query_id int, embedding array<double>")
    v = spark.createDataFrame([(7, [1.0, 1.0]), (8, [2.0, 0.0, 0.0]), (9, [-1.0, 0.0])], "id int, embedding array<double>")
    assert rows(R.all_hits(q, v)) == [(1, 7, 0.707107), (2, 8, 1.0)]


def test_running_sums_over_blocks(spark):
    data = [(0, i, i % 5) for i in range(1000)] + [(1 + i % 20, i, 1) for i in range(100)]
    got = running_sums(spark.createDataFrame(data, "k int, o int, v int"), ["k"], ["o"], {"s": "v"}, 16)
    want, total = [], {}
    for k, o, v in sorted(data):
        total[k] = total.get(k, 0) + v
        want.append((k, o, v, total[k]))
    assert rows(got) == want


def test_affinity_with_a_hot_key(spark):
    rng = random.Random(2)
    data = [("hot", i, float(rng.randint(-30, 30))) for i in range(3000)] + [(f"k{i % 40}", i, float(rng.randint(-60, 60))) for i in range(400)]
    got = Q.running_affinity(spark.createDataFrame(data, "k string, o long, change double"), ["k"], ["o"], blocks=24)
    want, at = [], {}
    for k, o, c in sorted(data):
        old = at.get(k, 50.0)
        at[k] = min(100.0, max(0.0, old + c))
        want.append((k, o, c, old, at[k]))
    assert rows(got.select("k", "o", "change", "old_affinity", "new_affinity")) == want


def loop(data, capacity, ttl):
    held = {}
    for owner, seq, imp, at in sorted(data, key=lambda r: (r[3], r[1])):
        micros = int(at.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
        held[owner] = insert(held.get(owner, []), Held(imp, micros, (seq,)), capacity, ttl)
    return sorted((o, h.seq[0]) for o, hs in held.items() for h in hs)


@pytest.mark.parametrize("seed", [1, 2])
def test_capacity_replay(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    data = [("hot" if i % 3 else f"o{i % 7}", i, rng.randint(0, 9) / 10, start + dt.timedelta(minutes=i + rng.randint(0, 1))) for i in range(1200)]
    df = spark.createDataFrame(data, "owner string, seq long, importance double, created_at timestamp_ntz")
    assert rows(T.replay_capacity(df, "owner", 6, ["created_at", "seq"]).select("owner", "seq")) == loop(data, 6, None)
    got = T.replay_with_ttl(df, "owner", 6, 45, blocks=20)
    assert rows(got.select("owner", "seq")) == loop(data, 6, 45 * 60_000_000)


def test_newcomer_survives(spark):
    start = dt.datetime(2024, 1, 1)
    data = [("a", i, imp, start + dt.timedelta(minutes=i)) for i, imp in enumerate([0.9, 0.5, 0.7, 0.1])]
    df = spark.createDataFrame(data, "owner string, seq long, importance double, created_at timestamp_ntz")
    assert [r.seq for r in T.replay_capacity(df, "owner", 3).orderBy("seq").collect()] == [0, 2, 3]


@pytest.mark.parametrize("seed", range(3))
def test_budget_fill(spark, seed):
    rng = random.Random(seed)
    data = [(i % 4 and 9 or 1, f"p{i:04d}", rng.randint(0, 40), round(rng.random(), 2), "x") for i in range(400)] + [(9, "sys", 30, None, "system_instruction"), (2, "big", 500, None, "system_instruction"), (2, "other", 1, 0.9, "x")]
    df = spark.createDataFrame(data, "query_id int, packet_id string, tokens int, score double, type string")
    want = []
    for q in {r[0] for r in data}:
        mine = [r for r in data if r[0] == q]
        used = sum(r[2] for r in mine if r[3] is None)
        want += [r for r in mine if r[3] is None]
        if used < 200:
            for r in sorted((r for r in mine if r[3] is not None), key=lambda r: (-r[3], r[1])):
                if used + r[2] <= 200:
                    want.append(r)
                    used += r[2]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in C.fill_budget(df, 200).collect())


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_graph_search(spark, hot):
    rng = random.Random(hot)
    ents = [(f"e{i}", f"n{i}", "t") for i in range(14)]
    mentions = sorted({(f"e{min(int(rng.expovariate(0.4)), 11)}", m) for m in range(60) for _ in range(rng.randint(1, 4))})
    rels = [(f"e{rng.randrange(14)}", "R", f"e{rng.randrange(14)}", 0) for _ in range(12)] + [("e13", "R", "e0", 0)]
    asked = sorted({(q, f"n{rng.randrange(16)}", "t") for q in range(12) for _ in range(3)} | {(50, "n13", "t"), (51, "n12", "t")})
    graph = G.Graph(
        spark.createDataFrame(ents, "entity_id string, name string, type string"),
        spark.createDataFrame(rels, "src string, predicate string, dst string, memory_id int"),
        spark.createDataFrame(mentions, "entity_id string, memory_id int"))
    got = rows(G.graph_search(spark.createDataFrame(asked, "query_id int, name string, type string"), graph, 3, hot).select("query_id", "id", "shared", "score", "rank"))
    by_name = {n: e for e, n, _ in ents}
    want = []
    for q in {a[0] for a in asked}:
        names = [n for x, n, _ in asked if x == q]
        mine = [by_name[n] for n in names if n in by_name]
        shared = {m: sum((e, m) in set(mentions) for e in mine) for m in range(60)}
        near = {m for e in mine for s, _, d, _ in rels for o in ([d] if s == e else []) + ([s] if d == e else []) for x, m in mentions if x == o}
        hits = []
        for m in range(60):
            if shared[m] or m in near:
                size = sum(x == m for _, x in mentions)
                hits.append((-(shared[m] ** 2 / max(len(names) + size - shared[m], 1)), m, shared[m]))
        want += [(q, m, s, round(-x, 6), i + 1) for i, (x, m, s) in enumerate(sorted(hits)[:6])]
    assert got == sorted(want)


def test_shortest_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 4), (7, 8), (1, 5), (5, 4)], "src int, dst int")
    pairs = spark.createDataFrame([(1, 4), (4, 1), (1, 8), (2, 2), (9, 9), (3, 5)], "src int, dst int")
    assert rows(G.shortest_hops(edges, pairs)) == [(1, 4, 2), (2, 2, 0), (3, 5, 2), (4, 1, 2)]
    # 1-5-4 is the only way of two edges; from 3 to 5 it goes over 4.
    assert rows(G.shortest_paths(edges, pairs)) == [(1, 4, 2, [1, 5, 4]), (2, 2, 0, [2]), (3, 5, 2, [3, 4, 5]), (4, 1, 2, [4, 5, 1])]


@pytest.mark.parametrize("seed", range(3))
def test_shortest_paths_with_ties(spark, seed):
    """Against a breadth-first search in which a node comes from the smallest node it can come from."""
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(k, k + 1) for k in range(100, 120)]
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(25)] + [(100, 120), (120, 103), (100, 5)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = []
    for a, b in set(pairs):
        if a not in near:
            continue
        come, ring = {a: None}, [a]
        while ring:
            new = {}
            for x in sorted(ring):
                for y in near[x]:
                    if y not in come:
                        new.setdefault(y, x)
            come |= new
            ring = list(new)
        if b in come:
            path = [b]
            while come[path[0]] is not None:
                path.insert(0, come[path[0]])
            want.append((a, b, len(path) - 1, path))
    got = G.shortest_paths(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(pairs, "src int, dst int"))
    assert rows(got) == sorted(want)


def test_json_arrays_over_many_lines(spark, tmp_path):
    """Four forms of one set, the last far larger than a split."""
    import json

    from recollect.sources.evaluation import read_eval_set

    rng = random.Random(1)
    samples = [{"id": i, "q": rng.choice(["plain", "a [b], {c}", 'say \\"]"', "back\\\\", "ä\\n"]) * (i % 3), "n": [i, [], {"x": [1, 2]}]} for i in range(300)]
    text = [json.dumps(x, ensure_ascii=False) for x in samples]
    forms = {
        "four lines": "[" + "\n,".join(text) + "\n]\n", "indented": " \n" + json.dumps(samples, indent=2), "one line": json.dumps(samples),
        "lines": "\n\n".join(text) + "\n", "array lines": "\n".join(f"[{x}]" for x in text), "commas": "[\n" + ",\n".join(text) + "\n]",
    }
    want = sorted(json.dumps(x, sort_keys=True) for x in samples)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name, body in forms.items():
            path = tmp_path / name
            path.write_text(body)
            good, bad = read_eval_set(spark, str(path))
            assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in good.collect()) == want, name
            assert bad.count() == 0, name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path = tmp_path / "broken"
    path.write_text('[\n{"id": 1},\n{broken},\n{"id": 3}\n]')
    good, bad = read_eval_set(spark, str(path))
    assert sorted(r.value for r in good.collect()) == ['{"id": 1}', '{"id": 3}'] and [r.value for r in bad.collect()] == ["{broken}"]
    # Files of several forms below one folder, and an empty array.
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("indented", "lines"):
        (folder / name).write_text(forms[name])
    (folder / "none").write_text("[\n]\n")
    good, bad = read_eval_set(spark, str(folder))
    assert good.count() == 600 and bad.count() == 0


def test_notes_of_a_folder(spark, tmp_path):
    from recollect.sources.documents import ingest_notes

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nid: n1\ntitle: One\ntype: blocker\ntags: [x, y]\n---\n\nbody\n")
    (tmp_path / "sub" / "b.md").write_text("# Head\n\ntext")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "c.txt").write_text("# no note")
    got = {r.title: r for r in ingest_notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"One", "Untitled"} and got["One"].id == "n1" and got["One"].tags == ["x", "y"] and got["One"].body == "body"


def test_strip_is_linear(spark):
    padded = "x" + " " * 100_000 + "\u2028y" + " \t\r\n" * 25_000
    df = spark.createDataFrame([(padded,), (" \x0b\f",), (None,)], "t string").select(X.strip("t").alias("s"), X.blank("t").alias("b"))
    df.collect()
    begin = time.perf_counter()
    got = df.collect()
    assert time.perf_counter() - begin < 3
    assert [(r.s, r.b) for r in got] == [(padded.rstrip(), False), ("", True), (None, True)]


def test_lines_are_sorted_before_they_are_parsed(spark):
    lines = []
    for k in range(40):
        at = f"{8 + k // 20:02d}:{k % 20 * 3:02d}:"
        lines += [f"{at}00 - 💬 对话开始: n{k} <-> 玩家", f"{at}00 - 📝 玩家消息: hi", f"{at}01 - no stage", f"{at}02 - ✅ 对话完成"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line long, value string").repartition(5)
    want = rows(Q.dialogue_sessions(L.parse_dialogue_log(df), 1))
    assert len(want) == 40
    for blocks in (1, 7):
        assert rows(Q.line_sessions(df, blocks)) == want


def test_dialogues_over_midnight(spark):
    start = ["💬 对话开始: 李四 <-> 玩家", "📝 玩家消息: hi"]
    talk = ["💖 当前好感度: 50.0/100 (友好)", "🧠 检索到0条相关记忆", "🤖 正在生成回复...", "💬 李四回复: yo", "📊 正在分析好感度变化...", "📉 好感度变化: 50.0 -> 48.5 (-1.5)", "  原因: r", "  情感: negative", "✅ 对话完成"]
    clock = ["23:59:5%d" % s for s in (0, 0, 0, 0, 0, 1, 2)] + ["00:00:01", "00:00:01", "00:00:03", "00:00:03", "00:00:03", "00:00:04"]
    lines = [f"{c} - {m}" for c, m in zip(clock, start + start + talk)] + [f"08:00:0{i % 10} - {m}" for i, m in enumerate(start)]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate([*lines, "noise"])], "file string, line long, value string")
    for blocks in (1, 5):
        got = [r.asDict() for r in Q.dialogue_sessions(L.parse_dialogue_log(df), blocks).orderBy("dialogue").collect()]
        assert len(got) == 2 and got[0]["subject"] == "李四" and got[0]["change"] == -1.5 and got[0]["sentiment"] == "negative"
        assert (got[0]["retrieval_seconds"], got[0]["reply_seconds"], got[0]["analysis_seconds"], got[0]["total_seconds"]) == (1, 9, 2, 14)
        assert got[0]["complete"] and not got[1]["complete"]


def test_expanded_search_splits_the_pool(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(40)], "id int, embedding array<double>")
    variants = spark.createDataFrame([(1, j, [1.0, float(j)]) for j in range(30)], "query_id int, variant int, embedding array<double>")
    # 20 // 30 is 0, so every variant still brings its best hit.
    assert R.expanded_search(variants, v, 5).count() == 5


def test_plans_push_filters_and_prune_columns(spark):
    df = T.filter_episodes(spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("user_id").alias("session_id")), session_id=7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan and "props" not in plan


def test_exact_search_needs_no_cartesian_product(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    v = spark.createDataFrame([(7, [1.0, 1.0])], "id int, embedding array<double>")
    plan = R.topk_cosine(q, v)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_deep_slices_and_large_capacities(spark):
    from recollect.sources import evaluation as S

    df = spark.range(500).withColumnRenamed("id", "k").repartition(7)
    assert rows(S.dataset_slice(df, "k", 20, 30)) == [(i,) for i in range(30, 50)]
    assert rows(S.dataset_slice(df, "k", 0, 490)) == [(i,) for i in range(490, 500)]
    start = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([(i, (i % 3) / 10, start + dt.timedelta(minutes=i % 5)) for i in range(60)], "id int, importance double, created_at timestamp_ntz")
    kept, dropped = T.forget(items, "capacity", 25)
    best = sorted(((i % 3) / -10, -(i % 5), i) for i in range(60))[:25]
    assert sorted(r.id for r in kept.collect()) == sorted(i for _, _, i in best) and dropped.count() == 35


def test_missing_importances_go_first(spark):
    items = spark.createDataFrame([(i, None if i < 4 else 0.1 * i, None) for i in range(8)], "id int, importance double, created_at timestamp_ntz")
    kept, dropped = T.forget(items, "capacity", 4)
    assert sorted(r.id for r in kept.collect()) == [4, 5, 6, 7] and sorted(r.id for r in dropped.collect()) == [0, 1, 2, 3]


def test_near_equal_cosines_are_ranked_unrounded(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    v = spark.createDataFrame([(0, [1.0, 5e-4]), (1, [1.0, 0.0]), (2, [1e-7, 1.0])], "id int, embedding array<double>")
    assert [r.id for r in cosine_hits(q, v, 3).orderBy("rank").collect()] == [1, 0, 2]


def test_long_paths_and_many_links(spark):
    from recollect.sources.documents import extract_links

    edges = spark.createDataFrame([(i, i + 1) for i in range(14)], "src int, dst int")
    assert rows(G.shortest_hops(edges, spark.createDataFrame([(0, 13)], "src int, dst int"))) == [(0, 13, 13)]
    page = "".join(f'<a href="u{i}">\n t{i}\t</a>' for i in range(1500)) + '<a href="x">\n\t</a>'
    found = extract_links(spark.createDataFrame([(1, page)], "page_id int, html string"))
    assert found.count() == 1500 and found.where("title = 't7'").count() == 1


def test_null_keys_carry_their_value(spark):
    changes = spark.createDataFrame([(None if i % 2 else 1, i, 5.0) for i in range(8)], "npc int, seq int, change double")
    got = Q.running_affinity(changes, ["npc"], ["seq"], start=50.0).orderBy("seq").collect()
    assert [r.new_affinity for r in got if r.npc is None] == [55, 60, 65, 70] and [r.new_affinity for r in got if r.npc == 1] == [55, 60, 65, 70]


def test_an_aborted_dialogue_stays_by_itself(spark):
    lines = ["08:00:00 - 💬 对话开始: A <-> 玩家", "08:00:01 - 📝 玩家消息: hi", "08:05:00 - 💬 对话开始: B <-> 玩家", "08:05:01 - 📝 玩家消息: yo", "08:05:06 - ✅ 对话完成"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line long, value string")
    for blocks in (1, 4):
        got = Q.dialogue_sessions(L.parse_dialogue_log(df), blocks).orderBy("dialogue").collect()
        assert [(r.subject, r.message, r.complete) for r in got] == [("A", "hi", False), ("B", "yo", True)]


def test_searches_of_one_user(spark):
    start = dt.datetime(2024, 1, 1)
    v = spark.createDataFrame([(i, [1.0, i / 100], "m") for i in range(60)], "id int, embedding array<double>, modality string")
    items = spark.createDataFrame([(i, 0.5, start, "a" if i % 10 == 9 else "b") for i in range(60)], "id int, importance double, created_at timestamp_ntz, user_id string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "m")], "query_id int, embedding array<double>, modality string")
    as_of = "2024-01-02 00:00:00"
    assert [r.id for r in R.episodic_search(q, v, items, as_of, 5, user_id="a").orderBy("rank").collect()] == [9, 19, 29, 39, 49]
    # Afterwards the filter sees the best 50 only.
    assert [r.id for r in R.episodic_search(q, v, items, as_of, 6, filter_mode="post", user_id="a").orderBy("rank").collect()] == [9, 19, 29, 39, 49]
    assert [r.id for r in R.modality_search(q, v, items, as_of, 2, user_id="a").orderBy("rank").collect()] == [9, 19]
    graph = G.Graph(
        spark.createDataFrame([("e", "n", "t")], "entity_id string, name string, type string"),
        spark.createDataFrame([], "src string, predicate string, dst string, memory_id int"),
        spark.createDataFrame([("e", i) for i in range(60)], "entity_id string, memory_id int"))
    asked = spark.createDataFrame([(1, "n", "t")], "query_id int, name string, type string")
    none = v.where("id < 0")
    assert {r.id for r in R.semantic_search(q, v, asked, graph, items, 20, user_id="a").collect()} == {9, 19, 29, 39, 49, 59}
    # One entity holds all memories: those of user a come far behind the 2k first, and are found all the same, by the graph alone as well.
    for hot in (10, 1000):
        own = items.where("user_id = 'a'").select(F.col("id").alias("memory_id"))
        assert {r.id for r in G.graph_search(asked, graph, 2, hot, own).collect()} == {9, 19, 29, 39}
    assert {r.id for r in R.semantic_search(q, none, asked, graph, items, 2, user_id="a").collect()} == {9, 19}


def test_blank_and_repeated_variants_do_not_count(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(40)], "id int, embedding array<double>")
    rows_ = [(1, 0, [1.0, 0.0], "x"), (1, 1, [1.0, 0.0], " x\n"), (1, 2, [0.0, 1.0], "\t")]
    variants = spark.createDataFrame(rows_, "query_id int, variant int, embedding array<double>, text string")
    assert R.expanded_search(variants, v, 20).count() == 20


@pytest.mark.parametrize("hot", [3, 10_000])
def test_sparse_join(spark, monkeypatch, hot):
    """Against all pairs, with terms in nearly every vector, negative weights, and vectors without a direction."""
    monkeypatch.setattr(R, "HOT_LIST", hot)
    rng = random.Random(hot)
    draw = lambda: {f"t{min(int(rng.expovariate(0.15)), 60)}": rng.choice([1.0, 2.0, 0.5, -0.5]) for _ in range(rng.randint(1, 9))}
    q, v = {i: draw() for i in range(40)}, {i: draw() for i in range(150)}
    q[90], v[900], v[901] = {"t0": 0.0}, {"t1": 0.0}, dict(q[3])
    frame = lambda data, key: spark.createDataFrame([(i, t, w) for i, own in data.items() for t, w in own.items()], f"{key} int, term string, weight double")
    length = lambda x: sum(w * w for w in x.values()) ** 0.5
    for least in (0.2, 0.7, 1.0):
        want = {}
        for i, a in q.items():
            for j, b in v.items():
                if length(a) and length(b):
                    score = sum(w * b.get(t, 0.0) for t, w in a.items()) / length(a) / length(b)
                    if round(score, 12) >= least:
                        want[i, j] = score
        got = {(r.query_id, r.id): r.score for r in R.sparse_join(frame(q, "query_id"), frame(v, "id"), least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and want


def test_embedders_in_order(spark):
    from recollect.operators.text_stats import embed_texts

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, text string")
    first = lambda rows: rows.where("text = 'a'").select("key", F.array(F.lit(1.0)).alias("embedding"))
    second = lambda rows: rows.select("key", F.when(F.col("text").isNotNull(), F.array(F.lit(2.0))).alias("embedding"))
    assert rows(embed_texts(df, "id", "text", [first, second])) == [(1, [1.0]), (2, [2.0])]


def test_snapshots_of_vectors_in_objects_of_bounded_size(spark, tmp_path):
    from recollect.sources import snapshots as S

    v = spark.createDataFrame([(str(i), [float(i), 0.5]) for i in range(100)], "id string, embedding array<float>")
    S.write_vectors(v, str(tmp_path / "v"), "snapshot", rows=10)
    assert 5 <= spark.read.text(str(tmp_path / "v")).count() <= 10
    assert rows(S.read_vectors(spark, str(tmp_path / "v"), "snapshot")) == rows(v)


def test_merged_entities(spark):
    graph = G.Graph(
        spark.createDataFrame([("a", "x", "t"), ("b", "x", "t"), ("c", "y", "t")], "entity_id string, name string, type string"),
        spark.createDataFrame([("a", "R", "c", 1), ("b", "R", "c", 1), ("c", "R", "gone", 2)], "src string, predicate string, dst string, memory_id int"),
        spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("gone", 3)], "entity_id string, memory_id int"))
    merged, ids = G.merge_entities(graph)
    new = {r.old: r.new for r in ids.collect()}
    assert new["a"] == new["b"] != new["c"] and merged.entities.count() == 2
    assert rows(merged.relations) == sorted([(new["a"], "R", new["c"], 1), (new["c"], "R", "gone", 2)])
    assert rows(merged.mentions) == sorted([(new["a"], 1), (new["a"], 2), ("gone", 3)])


def test_a_group_of_near_queries_looks_at_near_rows_only(monkeypatch):
    """The pruned search gives what all pairs give, with ties by id and nulls, and scores few of the pairs."""
    import numpy as np

    from recollect.functions import similarity as S

    rng = np.random.default_rng(3)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = unit(np.column_stack([rng.gamma(1.0, 30.0, 20_000).round(0), rng.integers(4, 9, 20_000), rng.integers(0, 24, 20_000), np.full(20_000, 10.0)]))
    rows[rng.integers(0, 20_000, 3000)] = rows[7]  # more equal rows than there are places
    rows[5], rows[6] = 0.0, np.nan
    queries = np.vstack([rows[rng.integers(10, 20_000, 2000)], unit(np.abs(rng.normal(size=(20, 4)))), np.zeros((1, 4))])
    ids = rng.permutation(20_000)
    scored = []
    merge = S._Best._merge
    monkeypatch.setattr(S._Best, "_merge", lambda self, a, b, x, i: (scored.append((b - a) * len(x)), merge(self, a, b, x, i))[1])
    best = S._Best(np.arange(len(queries)), queries, 5)
    for part in np.array_split(np.arange(20_000), 3):
        best.offer(rows[part], ids[part])
    got = sorted((int(q), -s, int(i)) for qs, found, scores in best.rows() for q, i, s in zip(qs, found, scores))
    want = []
    for q, x in enumerate(queries):
        scores = np.round(np.nan_to_num(rows @ x), S.RANK_DIGITS)
        for i in np.lexsort((ids, -scores))[:5]:
            if scores[i] > 0:
                want.append((q, -scores[i], int(ids[i])))
    assert [(q, i) for q, _, i in got] == [(q, i) for q, _, i in sorted(want)]
    assert sum(scored) < 0.6 * len(queries) * len(rows)


def test_all_hits_come_in_bounded_batches(spark, monkeypatch):
    from recollect.functions import similarity as S

    seen = []
    monkeypatch.setattr(S, "block_match", lambda q, v, key, prepare, match, schema, *a: (seen.append((prepare, match)), spark.createDataFrame([], schema))[1])
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "query_id long, embedding array<double>")
    v = spark.createDataFrame([(i, [2.0, float(i)]) for i in range(300)], "id long, embedding array<double>")
    cosine_hits(q, v, None)
    monkeypatch.setattr(S, "TILE", 400)
    prepare, match = seen[0]
    block = q.selectExpr("query_id AS q", "embedding AS v").toArrow()
    out = list(match(prepare(block), iter(v.selectExpr("id", "embedding AS v").toArrow().to_batches())))
    assert sum(b.num_rows for b in out) == 40 * 300 and max(b.num_rows for b in out) <= 400


def test_sparse_join_sums_frequent_terms_for_near_pairs_only(spark):
    import math

    rng = random.Random(8)
    def table(n, seed):
        return [(i, f"t{t}", rng.choice([1.0, 2.0, -1.0])) for i in range(n) for t in sorted({int(rng.random() ** 3 * 40) for _ in range(9)})]
    q, v = table(40, 1), table(200, 2)
    got = R.sparse_join(spark.createDataFrame(q, "query_id long, term string, weight double"), spark.createDataFrame(v, "id long, term string, weight double"), 0.3)
    def unit(data):
        out = {}
        for i, t, w in data:
            out.setdefault(i, {})[t] = w
        return {i: {t: w / math.sqrt(sum(x * x for x in d.values())) for t, w in d.items()} for i, d in out.items()}
    scores = {(a, b): sum(w * y.get(t, 0) for t, w in x.items()) for a, x in unit(q).items() for b, y in unit(v).items()}
    assert {(r.query_id, r.id): round(r.score, 9) for r in got.collect()} == {k: round(s, 9) for k, s in scores.items() if round(s, 12) >= 0.3}


@pytest.mark.parametrize("few", [10_000, 0])
def test_sparse_join_keeps_little_on_disk(spark, monkeypatch, few):
    """Rows of vectors that many queries ask for, by broadcast and by shuffle: what is kept of them, and the results against all pairs."""
    import math
    import pathlib

    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "HOT_LIST", 300)
    rng = random.Random(9)
    draw = lambda n, size: {(i, f"term_{int(rng.random() ** 2 * 400)}"): float(rng.randint(1, 5)) for i in range(n) for _ in range(size)}
    q, v = draw(30, 12), draw(1500, 40)
    frame = lambda data, key: spark.createDataFrame([(i, t, w) for (i, t), w in data.items()], f"{key} long, term string, weight double")
    kept = lambda: sum(f.stat().st_size for f in pathlib.Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if f.is_file())
    queries, vectors, before = frame(q, "query_id"), frame(v, "id"), kept()
    got = {(r.query_id, r.id): r.score for r in R.sparse_join(queries, vectors, 0.3).collect()}
    assert kept() - before < 10 * len(v)

    def unit(data):
        out = {}
        for (i, t), w in data.items():
            out.setdefault(i, {})[t] = w
        return {i: {t: w / math.sqrt(sum(x * x for x in own.values())) for t, w in own.items()} for i, own in out.items()}

    scores = {(a, b): sum(w * y.get(t, 0.0) for t, w in x.items()) for a, x in unit(q).items() for b, y in unit(v).items()}
    want = {k: s for k, s in scores.items() if round(s, 12) >= 0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and want


def test_listed_terms_give_the_same_weights(spark):
    """No, some or all terms in the broadcast list; a term whose count many share is in it with all of those or not at all."""
    from recollect.operators import text_stats as TS

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(12) if i % (j + 1) == 0) + f" u{i}") for i in range(30)], "doc_id int, text string")
    tf = TS.term_frequency(docs)
    weights = [sorted((r.doc_id, r.term, round(r.weight, 9)) for r in TS.tfidf(tf, TS.document_frequency(tf), F.lit(30), listed=k).collect()) for k in (0, 1, 5, 20, 1000)]
    assert weights[0] and all(w == weights[0] for w in weights)


def test_pairs_of_neighbours_are_dealt_out_by_memory(spark, monkeypatch):
    rng = random.Random(6)
    mentions = {("hot", m) for m in range(400)} | {(f"e{rng.randrange(9)}", rng.randrange(400)) for _ in range(300)} | {("hot", None), ("e1", None)}
    edges = {(f"e{i}", "hot") for i in range(9)} | {("e1", "e2"), ("e3", None)}
    frame = spark.createDataFrame(list(mentions) * 2, "entity_id string, memory_id long")
    relations = spark.createDataFrame(list(edges), "src string, dst string")
    wanted = spark.createDataFrame([(f"e{i}",) for i in range(4)] * 2, "entity_id string")
    monkeypatch.setattr(G, "TASK_MENTIONS", 100)
    near = edges | {(b, a) for a, b in edges}
    want = {(a, m) for a, b in near for e, m in mentions if a in {"e0", "e1", "e2", "e3"} and b == e and b is not None}
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    got = G.neighbour_memories(wanted, relations, frame)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((x for x in want if x[1] is None or x not in mentions), key=key)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, G.neighbour_memories(wanted, relations, frame, False).collect()), key=key) == sorted(want, key=key)

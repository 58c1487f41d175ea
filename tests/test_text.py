"""Golden and property tests of the text jobs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions import markdown as md
from recollect.functions import markers
from recollect.operators import text_rows as TR
from recollect.sources import documents as D


def words(n, w="w"):
    return " ".join([w] * n)


def test_overlap_that_does_not_fit_is_dropped():
    text = "\n\n".join(words(n) for n in (300, 40, 480))
    assert [c.tokens for c in md.chunks(text, 500, 50)] == [340, 480]


def test_overlap_is_carried():
    text = "\n\n".join([words(480, "a"), words(20, "b"), words(300, "c")])
    got = list(md.chunks(text, 500, 50))
    assert [c.tokens for c in got] == [500, 320] and got[1].content.startswith("b")


def test_heading_closes_the_paragraph_before():
    got = list(md.paragraphs("one\n# H\ntwo\n\n## S\nthree\n# T\nfour"))
    assert [(p.content, p.heading_path) for p in got] == [("one", None), ("two", "H"), ("three", "H > S"), ("four", "T")]
    assert list(md.paragraphs("# only")) == [md.Paragraph("# only", None, 0, 6)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "# A", "## B", "text"]), st.integers(1, 30)), min_size=1, max_size=25), st.integers(5, 40), st.integers(0, 10))
def test_chunks_cover_all_paragraphs_in_order(lines, budget, overlap):
    text = "\n".join(kind if kind != "text" else words(n, f"w{i}") for i, (kind, n) in enumerate(lines))
    if "text" not in {kind for kind, _ in lines}:
        return
    parts = [p.content for p in md.paragraphs(text)]
    chunks = list(md.chunks(text, budget, overlap))
    seen = []
    for c in chunks:
        inside = c.content.split("\n\n")
        assert c.tokens <= budget or len(inside) == 1
        seen += [p for p in inside if p not in seen]
    assert seen == list(dict.fromkeys(parts)) and len(chunks) <= len(parts)


def test_split_and_chunk_frames(spark):
    docs = spark.createDataFrame([(1, "# H\n\none two\n\nthree"), (2, "  "), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in TR.split_paragraphs(docs).orderBy("pos").collect()] == [
        (1, 0, "one two", "H", 5, 13), (1, 1, "three", "H", 14, 20)]
    assert [tuple(r) for r in TR.chunk(docs, 500, 50).collect()] == [(1, 0, "one two\n\nthree", "H", 5, 20, 3)]


def test_markers():
    assert markers.strip_reasoning("a<think>b<think>c</think>d</think>e") == "ae"
    assert markers.strip_reasoning("a<think>open") == "a<think>open"
    assert markers.strip_tool_calls('x [TOOL_CALL:s:{"q":"]","l":[1,[2]]}] y') == "x  y"
    assert markers.strip_tool_calls("x [TOOL_CALL:s:{open") == "x [TOOL_CALL:s:{open"
    assert markers.tool_calls("[TOOL_CALL:a:{open [TOOL_CALL:b:x]") == [("b", "x")]
    assert markers.tool_calls(r'[TOOL_CALL:a:{"q":"\"]"}]') == [("a", r'{"q":"\"]"}')]
    assert markers.tool_calls('[TOOL_CALL:a:{"k":[1]}][TOOL_CALL: b :x=1]') == [("a", '{"k":[1]}'), ("b", "x=1")]


def test_tool_call_types(spark):
    df = spark.createDataFrame([(1, '[TOOL_CALL:t:n=07, f=2.0, b=TRUE, s=x][TOOL_CALL:t:alone][TOOL_CALL:u:v]')], "id int, a string")
    rows = TR.extract_tool_calls(df, "id", "a", {"t": [("n", "integer"), ("f", "number"), ("b", "boolean"), ("s", "string")]}).orderBy("pos").collect()
    assert [r.params for r in rows] == [{"n": "7", "f": "2", "b": "true", "s": "x"}, {"n": "alone"}, {"input": "v"}]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_han_tokens(spark):
    assert one(spark, X.tokens, "Java 是语言 ok") == ["java", "ok", "是", "语", "言", "是语", "语言"]
    assert one(spark, X.approx_tokens, "Java 是语言 ok x是") == 7
    assert md.approx_tokens("Java 是语言 ok x是") == 7


def test_page_text(spark):
    text = "Title\n\nINTRODUCTION PART\nthis line is\nbroken here\nand ends now.\n42\n- \nas Smith et al.\nfound it.\n# Head\nnext"
    got = TR.clean_page_text(spark.createDataFrame([(text,)], "t string"), "t").first().clean
    assert got == "Title\n\nINTRODUCTION PART\nthis line is broken here\nand ends now.\nas Smith et al.\nfound it.\n# Head\n\nnext"


def test_entities_and_relations(spark):
    text = "Spring Boot uses Java. Redis is a database! 我们使用Python和MySQL。Released v1.2.0 on 2024-05-01 by Acme Widgets company"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {(r.name, r.type) for r in TR.extract_entities(docs).collect()}
    assert got == {("Spring Boot", "framework"), ("Spring", "framework"), ("Java", "language"), ("Redis", "database"), ("Python", "language"),
                   ("MySQL", "database"), ("v1.2.0", "tool"), ("2024-05-01", "date"), ("Acme Widgets", "organization")}
    rel = {(r.src, r.predicate, r.dst) for r in TR.extract_relations(docs).collect()}
    assert ("Spring Boot", "USES", "Java") in rel and ("Python", "USES", "MySQL") in rel
    assert ("Java", "RELATED_TO", "Redis") in rel and ("Redis", "RELATED_TO", "Python") in rel
    assert not any(a == "SQL" or b == "SQL" for a, _, b in rel)


def test_relations_against_a_loop(spark):
    """A plain restatement over texts with repeated sentences and hot pairs."""
    import itertools
    import random

    from recollect.functions import lexicon

    rng = random.Random(3)
    names = ["Java", "Python", "Docker", "Go", "Redis", "C++"]
    cues = [" uses ", " is a ", " and ", " runs on ", " built on "]
    texts = ["".join(f"{rng.choice(names)}{rng.choice(cues)}{rng.choice(names)}. " for _ in range(rng.randint(1, 6))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kinds, place = {n: k for n, k, _ in lexicon.dictionary()}, {n: i for n, _, i in lexicon.dictionary()}

    def find(text, name):
        import re

        short = lexicon.needs_boundary(name)
        m = re.search(rf"(?<!\w){re.escape(name.lower())}(?!\w)" if short else re.escape(name.lower()), text.lower())
        return m.start() if m else -1

    want = set()
    for i, text in enumerate(texts):
        ents = sorted((n for n in kinds if find(text, n) >= 0), key=lambda n: (-len(n), place[n]))
        parts = [s.strip() for s in text.split(".") if s.strip()]
        parts = [s + "." for s in parts]
        held = [[e for e in ents if find(s, e) >= 0] for s in parts]
        seen = {}
        for s, es in zip(parts, held):
            for a, b in itertools.combinations(es, 2):
                pa, pb = find(s, a), find(s, b)
                near = s[max(0, min(pa, pb) - 60) : max(pa, pb) + max(len(a), len(b)) + 60].lower()
                if f"{a.lower()} is a " in near or f"{b.lower()} is a " in near:
                    p = "IS_A"
                else:
                    p = next((k for k, cs in lexicon.RELATION_CUES if any(c in near for c in cs)), "CO_OCCURS_WITH")
                seen.setdefault((a, b), p)
        for x, y in zip(held, held[1:]):
            for a in x:
                for b in y:
                    if a != b:
                        seen.setdefault((a, b), "RELATED_TO")
        want |= {(i, a, kinds[a], p, b, kinds[b]) for (a, b), p in seen.items()}
    got = {tuple(r) for r in TR.extract_relations(docs).collect()}
    assert got == want


def test_notes(spark):
    texts = [
        "---\nid: a\ntitle: \"x: y\"\ntype: blocker\ntags: [p, \"q\"]\ncreated_at: 2024\n---\nbody",
        "plain body", "---\nid: b\nno end", "---\nid: c\ntags: m, n\nupdated_at: u\n---\n\nrest\n",
    ]
    notes = D.parse_notes(spark.createDataFrame([(t,) for t in texts], "value string"))
    got = [tuple(r) for r in notes.select("id", "title", "type", "tags", "created_at", "updated_at", "body").collect()]
    assert got == [
        ("a", "x: y", "blocker", ["p", "q"], "2024", "2024", "body"), ("unknown", "Untitled", "general", [], "", "", "plain body"),
        ("unknown", "Untitled", "general", [], "", "", "---\nid: b\nno end"), ("c", "Untitled", "general", ["m", "n"], "", "u", "rest"),
    ]


def test_titles(spark):
    df = spark.createDataFrame([("a", "星露谷（Stardew Valley）"), ("b", "传说/Legend Quest"), ("c", "Portal Two")], "id string, t string")
    got = {(r.id, r.pos): r.phrase for r in TR.title_variants(df, "id", "t").collect()}
    assert got["a", 0] == "Stardew Valley game screenshot" and got["a", 2] == "星露谷 游戏截图"
    assert got["b", 0] == "Legend Quest game screenshot" and got["b", 2] == "传说 游戏截图" and got["c", 4] == "Portal Two game"


def test_documents_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("just text")
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.html").write_text("<p>hi <b>there</b></p><script>x</script>")
    (tmp_path / "d.mp3").write_bytes(b"abc")
    (tmp_path / "e.txt").write_text("# own\nline")
    got = {r.title: r.content for r in D.ingest_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "just text", "b.txt": "# b.txt\n\ncafé", "c.html": "# c.html\n\nhi there", "e.txt": "# own\nline"}


def test_white_space_of_any_kind_is_stripped(spark):
    df = spark.createDataFrame([("\t42\n",)], "a string")
    assert df.select(X.strip("a")).first()[0] == "42"
    assert md.approx_tokens("a\u3000b c") == 2


def test_terms_of_unique_documents_are_counted_without_a_shuffle(spark):
    from recollect.operators import text_stats as TS

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    once = spark.createDataFrame([(1, "a b a"), (2, None), (None, "b")], "doc_id long, text string")
    counted = TS.term_frequency(once)
    assert "Exchange" not in plan(counted)
    assert sorted(map(tuple, counted.collect()), key=str) == sorted([(1, "a", 2), (1, "b", 1), (None, "b", 1)], key=str)
    twice = once.union(once)
    assert sorted(map(tuple, TS.term_frequency(twice).collect()), key=str) == sorted([(1, "a", 4), (1, "b", 2), (None, "b", 2)], key=str)


def test_weights_of_frequent_and_rare_terms(spark, monkeypatch):
    import math

    from pyspark.sql import functions as F
    from recollect.operators import text_stats as TS

    monkeypatch.setattr(TS, "HOT_DF", 3)
    docs = spark.createDataFrame([(i, f"all w{i % 5} x{i}") for i in range(20)], "doc_id long, text string")
    tf = TS.term_frequency(docs)
    got = {(r.doc_id, r.term): r.weight for r in TS.tfidf(tf, TS.document_frequency(tf), F.lit(20)).collect()}
    want = {(i, t): math.log(20 / (1 + df)) for i in range(20) for t, df in (("all", 20), (f"w{i % 5}", 4), (f"x{i}", 1))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_texts_become_objects_in_slices(spark, monkeypatch):
    import pyarrow as pa

    from recollect.operators import text_rows as TR

    monkeypatch.setattr(TR, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abcd", "abcd", None, "x" * 50, "", "abcdefghij"])], names=["k", "t"])
    parts = [b.column(1).to_pylist() for b in TR._small(iter([batch, batch.slice(0, 0)]))]
    assert parts == [["abcd", "abcd", None], ["x" * 50], ["", "abcdefghij"]]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a <think>b</think> c", None, "", "[TOOL_CALL:x:y] z"] * 3)], "i int, t string")
    assert [r.clean for r in TR.strip_markers(texts, "t").orderBy("i").collect()] == ["a  c", "", "", "z"] * 3


def test_a_mark_in_front_decides_which_pattern_a_log_line_meets(spark):
    from recollect.sources import logs as L

    lines = ["💬 对话开始: a <-> 玩家", "💬 a回复: 💬 对话开始: b", "📉 好感度变化: 3 -> 1 (-2.0)", "📈 好感度变化: 1 -> 2 (+1)", "➡️ 好感度未变化 (当前: 5.0)", "x 情感: y", "情感: y"]
    df = spark.createDataFrame([("f", i, f"01:02:0{i} - {x} ") for i, x in enumerate(lines)], "file string, line long, value string")
    parsed = L.parse_dialogue_log(df)
    got = [(r.seconds, r.kind, r.subject, r.number, r.text) for r in parsed.orderBy("line").collect()]
    assert got == [
        (3720, "start", "a", None, None), (3721, "reply", None, None, "💬 对话开始: b"), (3722, "change", None, -2.0, None), (3723, "change", None, 1.0, None),
        (3724, "unchanged", None, 5.0, None), (3725, None, None, None, None), (3726, "sentiment", None, None, "y")]
    assert "startswith(" in parsed._jdf.queryExecution().analyzed().toString().lower()

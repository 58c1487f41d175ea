"""The pipeline's stages: schemas, effects, and the registration of its queries."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from __spark_entry__ import oracle_sql, queries
from recollect.llm import decontaminate, toxicity
from recollect.llm.common import held_out
from recollect.llm.plans import MIXTURE_SQL
from tests.llm.fixtures import plain, rows, sentence
from tests.llm.test_pairs import brute_components, runs

#: Columns of names that the stages might use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, _key string, _row long, row int, score double, _score double, text_key string, cut string, node long"


def test_every_operator_is_registered_once():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


def test_stages_take_effect(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if stage is P.STAGES[-1][1]:
            assert {"doc_id", "source", "block", "weight"} <= set(docs.columns) and docs.count() > 0
            break
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
        if name.startswith("benchmark"):
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
        if name.startswith("suffix"):
            assert docs.where("n_chars <> length(text)").count() == 0
    assert toxicity.THRESHOLD == 0.3


def test_near_copies_of_the_stage_share_four_fifths_of_five_word_shingles(spark):
    words = [f"w{i}" for i in range(100)]
    changed = lambda *at: " ".join("new%d" % i if i in at else w for i, w in enumerate(words))
    # Similarity at five words: 86/106 with two words changed, 81/111 with three; at three words both are below 0.9.
    docs = spark.createDataFrame([(1, " ".join(words)), (2, changed(30, 60)), (3, changed(20, 50, 80))], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def odd_documents(spark):
    """Null ids, null and blank texts, copies, near copies, repeated rows, and columns with clashing names."""
    rng = random.Random(8)
    data = [r[:5] for r in rows(5)]
    base = sentence(rng, 120).split()
    for k in range(6):
        data.append((300 + k, " ".join("new" if i == 40 + k else w for i, w in enumerate(base)), "en", "src1", 1))
    item = sentence(rng, 30)
    data += [(400, f"{sentence(rng, 50)} {item} {sentence(rng, 50)}", "en", "src2", 1), (401, item, "de", None, None), (402, sentence(rng, 200), None, "", 0)]
    data = [(*r, "k", "y", i, -i, 0.5, 0.25, "t", "c", 7) for i, r in enumerate(data)]
    return data, item


def rest(r):
    """A row but for its text and the number of its characters."""
    return (r[0], r[2], r[3], *r[5:])


def test_near_copies_against_brute_force(spark):
    data, _ = odd_documents(spark)
    got = P.drop_near_copies(spark, spark.createDataFrame(data, ODD).repartition(3), "")
    assert got.columns == [c.split()[0] for c in ODD.split(", ")]
    sets, label = brute_components(data, 5, 80)
    groups = {}
    for k, (s, c) in enumerate(zip(sets, label, strict=True)):
        groups.setdefault(c if s else f"alone {k}", []).append(k)
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len(groups) and not Counter(kept) - Counter(map(tuple, data))
    first = lambda k: (data[k][0] is None, data[k][0] or 0)
    assert Counter(r[0] for r in kept) == Counter(data[min(own, key=first)][0] for own in groups.values())


def test_cut_repeats_against_brute_force(spark):
    data, _ = odd_documents(spark)
    texts = [(r[1] or "").encode() for r in data]
    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    want = Counter()
    for r, b in zip(data, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        text = None if r[1] is None else np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        want[(*rest(r), text, None if text is None else len(text))] += 1
    got = P.cut_repeats(spark, spark.createDataFrame(data, ODD).repartition(3), "")
    assert got.columns == [c.split()[0] for c in ODD.split(", ")]
    assert Counter((*rest(r), r.text, r.n_chars) for r in got.collect()) == want


def test_benchmark_against_brute_force(spark, tmp_path):
    data, item = odd_documents(spark)
    other = plain(data[30][1])[3:40] if data[30][1] else []
    items = [(1, item), (2, None), (3, ""), (4, b" ".join(plain(data[2][1])[:25]).decode() + " and some more words that stand nowhere else at all"), (5, b" ".join(other).decode())]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sets = [runs(plain(t), 5) for _, t in items if plain(t)]
    clean = [r for r in data if not any(len(s & runs(plain(r[1]), 5)) >= 0.8 * len(s) - 1e-9 for s in sets)]
    got = P.drop_benchmark(spark, spark.createDataFrame(data, ODD).repartition(3), str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(clean) and len(clean) < len(data)


def test_toxicity_against_brute_force(spark, tmp_path):
    data, _ = odd_documents(spark)
    rng = random.Random(1)
    bad = [(1000 + i, sentence(rng, 30) + (". zzqob zzqug" if i % 3 == 0 else ""), "en", "s", 1, *data[0][5:]) for i in range(150)]
    data = data + bad
    spark.createDataFrame([(r[0], 0, int(r[0] % 3 == 1)) for r in bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(data, ODD).repartition(3)
    weights, bias = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), ~held_out(F.col("doc_id"), 4, 2))
    half, kept = toxicity.FEATURES // 2, Counter()
    for r in data:
        clean = 1.0
        features, sizes = toxicity.encode(r[1], toxicity.FeatureIds())
        at = 0
        for n in sizes.tolist():
            z = bias + sum(float(weights[f >> 32]) + float(weights[f & 0xFFFFFFFF]) for f in features[at : at + n].tolist())
            clean, at = clean * (1 - 1 / (1 + np.exp(-z))), at + n
        assert all(f >> 32 < half <= f & 0xFFFFFFFF for f in features.tolist())
        if 1 - clean < toxicity.THRESHOLD:
            kept[r] += 1
    got = P.drop_toxic(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == kept
    assert 30 < len(data) - sum(kept.values()) < 70


def test_mixing_against_sql(spark, tmp_path):
    data = [r for r in odd_documents(spark)[0] if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    spark.createDataFrame(data, ODD).select("doc_id", "text", "source").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(f"SELECT doc_id, epoch, block, n_tokens FROM ({MIXTURE_SQL})").fetchall()
    got = P.mix(spark, spark.createDataFrame(data, ODD).repartition(3), "")
    assert Counter((r.doc_id, r.epoch, r.block, r.n_tokens) for r in got.collect()) == Counter(want) and want


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_stages_of_no_documents(spark, tmp_path, stage):
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = spark.createDataFrame([], ODD)
    got = stage(spark, none, str(tmp_path))
    assert got.count() == 0 and (stage is P.mix or got.columns == none.columns)


def test_run_is_its_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert Counter(map(str, P.run(spark, folder).collect())) == Counter(map(str, docs.collect()))

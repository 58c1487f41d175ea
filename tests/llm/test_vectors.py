"""Vector codes and whitening against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from recollect.llm import codes, whitening
from recollect.llm.plans import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x long, code string, place long, n long"
SF = "/root/testdata/sf0.001"


def vectors(spark, data):
    return spark.createDataFrame([(*r, 1, "c", 2, 3) for r in data], SCHEMA).repartition(3)


def odd_rows(dim: int = 32, seed: int = 3):
    rng = random.Random(seed)
    draw = lambda: [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dim)]
    data = [(i, draw(), rng.choice([None, 1, 2])) for i in range(0, 300, 2)]
    hot = draw()
    data += [(1000 + i, hot, 7) for i in range(150)]
    data += [(5, data[0][1], None), (5, draw(), 1), (None, draw(), 2), (None, None, 2)]
    data += [(401, None, 1), (403, [*draw()[:-1], None], 1), (405, [*draw()[:-1], math.nan], 1), (407, [*draw()[:-1], math.inf], 1)]
    return [*data, (409, [], 1), (411, draw()[:-2], 1), (413, [1e30, -1e30, *draw()[2:]], 3)]


def usable(data, scale, offset=0):
    sound = [r for r in data if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    length = len(min(sound, key=lambda r: (r[0] is None, r[0] or 0, -len(r[1])))[1]) if sound else 0
    edge = 1 << 27
    return [(r[0], [max(-edge, min(edge, math.floor(Fraction(c) * scale))) + offset for c in r[1]], r[2]) for r in sound if len(r[1]) == length]


def brute_codes(data, parts=16, entries=64, rounds=2, scale=256):
    rows = [(i, [*x, *[0] * (-len(x) % parts)], label) for i, x, label in usable(data, scale)]
    x = np.array([r[1] for r in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    cut = x.reshape(len(rows), parts, -1)
    book = cut[order].swapaxes(0, 1).copy()
    for step in range(rounds + 1):
        apart = ((cut.swapaxes(0, 1)[:, :, None] - book[:, None]) ** 2).sum(axis=3)
        near = apart.argmin(axis=2)
        for p in range(parts if step < rounds else 0):
            for e in range(book.shape[1]):
                own = cut[near[p] == e, p]
                if len(own):
                    book[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    error = apart.min(axis=2).sum(axis=0)
    per = defaultdict(int)
    for r, e in zip(rows, error, strict=True):
        per[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for v in book.ravel()).encode()).hexdigest()
    return Counter((r[0], "".join(f"{near[p, k]:02x}" for p in range(parts)), int(error[k]), per[r[2]], digest) for k, r in enumerate(rows))


@pytest.mark.parametrize("dim", [32, 16, 20])
def test_vector_codes(spark, dim):
    data = odd_rows(dim)
    got = codes.vector_codes(vectors(spark, data))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_codes(data)


def test_codes_of_few_rows_and_small_blocks(spark):
    few = [(3, [0.5] * 16, None), (1, [0.25] * 16, None), (2, None, 1)]
    assert Counter(map(tuple, codes.vector_codes(vectors(spark, few)).collect())) == brute_codes(few)
    data = odd_rows(32, 4)
    found, books = codes.compressed(vectors(spark, data), block=40)
    want = brute_codes(data)
    assert Counter((r.vec_id, r.code, r.error) for r in found.collect()) == Counter({k[:3]: n for k, n in want.items()})
    assert books.shape == (16, 64, 2)
    assert codes.vector_codes(vectors(spark, few).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_trees_give_what_all_pairs_give(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 900)), int(rng.integers(1, 65))
    x = rng.integers(-9, 9, (n, 3)).astype(np.int64)  # many ties
    entries = x[rng.integers(0, n, k)]
    full = np.concatenate([x, np.repeat(x[-1:], codes.padded(n, 16) - n, axis=0)])
    order = codes.tree_order(full, 16)
    walk = codes.Walk(full[order], entries)
    want = ((full[order][:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
    assert (walk.assigned(len(full)) == want).all()
    weight = (order < n).astype(np.int64)
    sums = walk.sums(full[order], weight, codes.totals(full[order], weight, 16), k)
    assert (sums[:, 3] == np.bincount(want, weight, k)).all() and (sums[:, :3].sum(axis=0) == x.sum(axis=0)).all()


def test_spread_points_are_assigned_by_nodes():
    rng = np.random.default_rng(0)
    x = (rng.integers(0, 8, (4096, 1)) * 1000 + rng.integers(-20, 20, (4096, 4))).astype(np.int64)
    entries = (np.arange(8)[:, None] * 1000 + np.zeros((8, 4))).astype(np.int64)
    walk = codes.Walk(x[codes.tree_order(x, 16)], entries)
    assert sum(len(nodes) * (4096 >> level) for level, nodes, _ in walk.whole) > 3600 and walk.compared < 4096 * 2


def check_whitening(data, got, components=16):
    rows = usable(data, 64, 1_000_000)
    fit = sorted({tuple(r[1]) for r in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums, strict=True)] for x in fit])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(rows) * k and {r.component for r in got} == set(range(1, k + 1))
    assert {r.n for r in got} == {n} and all(r.identity_error <= 1e-4 for r in got)
    exact = Counter((r[0], sum((n * x - s) ** 2 for x, s in zip(r[1], sums, strict=True))) for r in rows)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter({(i, x if x < 2**63 else None): m for (i, x), m in exact.items()})
    signs = {}
    by_id = {r[0]: r for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    for r in got:
        e = values[r.component - 1]
        assert abs(r.explained - e / np.trace(v)) <= 1e-9 * e / np.trace(v) + 1e-15
        if r.vec_id in by_id:
            at = np.array([float(Fraction(x) - Fraction(s, n)) for x, s in zip(by_id[r.vec_id][1], sums, strict=True)])
            want = float(at @ axes[:, r.component - 1]) / math.sqrt(e)
            if abs(want) > 1e-3:
                assert signs.setdefault(r.component, math.copysign(1, want * r.whitened)) == math.copysign(1, want * r.whitened)
            assert abs(abs(r.whitened) - abs(want)) <= 1e-6


@pytest.mark.parametrize("dim", [32, 5])
def test_whitening(spark, dim):
    data = [r for r in odd_rows(dim) if r[0] != 413]  # without the component that hides all others
    got = whitening.whitened(vectors(spark, data))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(data, got.collect())


def test_whitening_of_a_huge_component_and_of_nothing(spark):
    huge = whitening.whitened(vectors(spark, odd_rows()), components=1).collect()
    assert {r.deviation for r in huge if r.vec_id == 413} == {None} and all(abs(r.explained - 1) < 1e-6 for r in huge)
    same = vectors(spark, [(i, [0.5, 0.25], 1) for i in range(9)])
    assert whitening.whitened(same).count() == 0 and whitening.whitened(same.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_spectrum_against_eigh(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 40))
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(rng.choice([5, 3, 3, 1 + 1e-7, 1, 0.2, 0], d) * rng.choice([1, 1, 1 + 1e-5], d))[::-1]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    for shift in (0.1, 0.999, 1 + 5e-8, 4):
        assert whitening.count_above(v, shift) == (np.linalg.eigvalsh(v) > shift).sum()
    found = whitening.leading_spectrum(v, 16)
    k = min(16, int((values > 1e-9).sum()))
    assert np.allclose(found.values, values[:k], rtol=1e-11)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(k), atol=1e-9)
    assert np.allclose(v @ found.vectors, found.vectors * found.values, atol=1e-11)
    assert all(high < number <= low for number, (low, high) in enumerate(found.counts, 1))  # the counts certify the numbers


def test_queries_on_the_given_table(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    assert Counter(map(tuple, QUERIES["op11_vector_codes"](spark, SF).collect())) == brute_codes(rows)
    check_whitening(rows, QUERIES["op13_embedding_whitening"](spark, SF).collect())

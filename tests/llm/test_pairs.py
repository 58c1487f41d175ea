"""Near duplicates, repeats and contamination against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import common, decontaminate, jaccard, links, minhash, paragraphs, suffixes
from tests.llm.fixtures import DOCS, documents, plain, rows, sentence


def closed(n: int, pairs) -> list[int]:
    label = list(range(n))
    for a, b in pairs:
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    return label


def runs(words, width):
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if width else frozenset()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_divide_skip_counts_exactly(seed):
    rng = np.random.default_rng(seed)
    lists = [sorted(set(rng.integers(0, 30, rng.integers(1, 25)).tolist())) for _ in range(12)]
    counts = Counter(x for own in lists for x in own)
    for least in (1, 3, 6, 12):
        for long in (0, least // 2, least - 1):
            assert jaccard.divide_skip(lists, least, long) == {x: n for x, n in counts.items() if n >= least}


@pytest.mark.parametrize("seed", [5, 6])
def test_jaccard_components(spark, seed):
    data = rows(seed)
    sets = [runs(plain(r[1]), 3) for r in data]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(data)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    label = closed(len(data), pairs)
    least = {c: min((data[i][0] for i in range(len(data)) if label[i] == c and data[i][0] is not None), default=None) for c in set(label)}
    want = Counter((r[0], len(s), least[c] if s else r[0]) for r, s, c in zip(data, sets, label, strict=True))
    got = jaccard.jaccard_components(documents(spark, seed))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    kept = jaccard.one_of_each(documents(spark, seed))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert kept.count() == len({c for c, s in zip(label, sets, strict=True) if s}) + sum(not s for s in sets)


@pytest.mark.parametrize(("seed", "length"), [(5, 200), (6, 40)])
def test_repeated_bytes(spark, seed, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows(seed)]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    want = []
    for doc_id, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if len(b) else 0
        want.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffixes.repeated_bytes(documents(spark, seed), length)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    if length == 200:
        cut = suffixes.without_repeats(documents(spark, seed))
        assert cut.count() == len(data) and cut.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert cut.where("text is null").count() == sum(r[1] is None for r in rows(seed))


def brute_windows(words):
    """Windows of a text by the definition: the first least hash of every ``GAP`` places in a row begins one."""
    n = len(words) - paragraphs.WINDOW + 1
    if n < 1:
        return []
    hashes = paragraphs.mixed(paragraphs.run_hashes(paragraphs.word_hashes(words), 5))[:n].tolist()
    starts = {min(range(i, min(i + paragraphs.GAP, n)), key=lambda k: (hashes[k] >> int(paragraphs.PLACE_BITS), k)) for i in range(max(n - paragraphs.GAP + 1, 1))}
    return [(i, i + paragraphs.WINDOW, tuple(words[i : i + paragraphs.WINDOW])) for i in sorted(starts)]


def brute_passages(data):
    """doc_id, repeated, removed, as ranges of words, of rows (doc_id, text)."""
    lines, windows = [], []
    for k, (_, text) in enumerate(data):
        words = []
        for line in (text or "").split("\n"):
            begin = len(words)
            words += plain(line)
            if len(words) - begin >= paragraphs.LINE_WORDS:
                lines.append((k, begin, len(words), runs(words[begin:], 5)))
        windows += [(k, *w) for w in brute_windows(words)]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if len(lines[a][3] & lines[b][3]) >= 0.8 * len(lines[a][3] | lines[b][3]) - 1e-9]
    clusters = {}
    for line, c in zip(lines, closed(len(lines), pairs), strict=True):
        clusters.setdefault(c, []).append(line[:3])
    for k, a, b, words in windows:
        clusters.setdefault(words, []).append((k, a, b))
    cover = [(Counter(), Counter(), Counter()) for _ in data]
    for members in clusters.values():
        if len({m[0] for m in members}) > 1 or max(m[1] for m in members) >= min(m[2] for m in members):
            first = min(members, key=lambda m: (data[m[0]][0] is None, data[m[0]][0] or 0, m[0], m[1]))
            for k, a, b in members:
                cover[k][0].update((x, x + 0.5) for x in range(a, b))
                cover[k][0].update((x + 0.5, x + 1) for x in range(a, b))
                cover[k][1 if (k, a, b) == first else 2].update(range(a, b))

    def ranges(points):
        out = []
        for x in sorted(points):
            if out and out[-1][1] == x:
                out[-1][1] = x + 1
            else:
                out.append([x, x + 1])
        return tuple(map(tuple, out))

    return [(d[0], ranges({int(x) for x, _ in seen}), ranges(set(later) - set(first))) for d, (seen, first, later) in zip(data, cover, strict=True)]


def found_passages(df):
    return Counter((r.doc_id, tuple(map(tuple, r.repeated)), tuple(map(tuple, r.removed))) for r in df.collect())


def with_row_order(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("seed", [5, 6])
def test_paragraph_dedup(spark, seed):
    data = [(r[0], r[1]) for r in rows(seed)]
    got = paragraphs.paragraph_dedup(with_row_order(spark, data))
    assert got.columns == ["doc_id", "n_repeated", "n_removed", "removed_words", "repeated", "removed"]
    assert found_passages(got) == Counter(brute_passages(data))
    for r in got.collect():
        assert (r.n_repeated, r.n_removed, r.removed_words) == (len(r.repeated), len(r.removed), sum(s.end - s.start for s in r.removed))


def test_passages_inside_long_lines_and_short_lines(spark):
    rng = random.Random(9)
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    line, nineteen = sentence(rng, 6), sentence(rng, 19)
    passage, other, own = sentence(rng, 60), sentence(rng, 50), sentence(rng, 40).split()
    near = " ".join(["changed" if k == 1 else w for k, w in enumerate(own)])
    data = [
        (1, f"{sentence(rng, 90)} {passage} {sentence(rng, 80)}"),  # inside a long line ...
        (2, f"{sentence(rng, 70)} {passage} {sentence(rng, 100)}"),  # ... and another one
        (3, f"{sentence(rng, 30)}\n{wrap(passage, 7)}\n{line}"),  # wrapped
        (4, f"{sentence(rng, 30)}\n{line}\n{nineteen}\n{sentence(rng, 30)}"),  # short lines that are shared
        (5, f"{line}\n{sentence(rng, 30)}\n{nineteen}"),
        (6, f"{sentence(rng, 9)}\n{' '.join(own)}\n{sentence(rng, 9)}"),
        (7, f"{near}\n{sentence(rng, 9)}"),  # a near copy of a line
        (8, f"{sentence(rng, 13)} {other.upper()} {sentence(rng, 13)}"),
        (9, f"{sentence(rng, 3)} {other}"),
        (10, f"{wrap(sentence(rng, 200), 11)}"),
        (11, None),
    ]
    docs = with_row_order(spark, data)
    got = {r.doc_id: r for r in paragraphs.paragraph_dedup(docs).collect()}
    marked = {k for k, r in got.items() if r.n_repeated}
    assert marked == {1, 2, 3, 6, 7, 8, 9}
    assert {k for k, r in got.items() if r.n_removed} == {2, 3, 7, 9}
    assert found_passages(paragraphs.paragraph_dedup(docs)) == Counter(brute_passages(data))
    assert all(s.start >= begin and s.end <= begin + n for k, begin, n in ((1, 90, 60), (2, 70, 60), (8, 13, 50), (9, 3, 50)) for s in got[k].repeated)
    texts = {r.doc_id: r.text for r in paragraphs.without_passages(docs).collect()}
    assert all(texts[k] == t for k, t in data if k not in {2, 3, 7, 9})
    for k, t in data:
        gone = {x for s in got[k].removed for x in range(s.start, s.end)}
        assert (texts[k] or "").split() == [w for x, w in enumerate((t or "").split()) if x not in gone]
    assert texts[7] == "\n" + data[6][1].split("\n")[1]


@pytest.mark.parametrize("seed", range(8))
def test_every_shared_run_of_fifty_words_holds_an_equal_window(seed):
    rng = random.Random(seed)
    shared = sentence(rng, 50).split() if seed % 2 else [rng.choice("ab") for _ in range(50)]  # also with many equal shingles
    for _ in range(20):
        found = []
        for _ in range(2):
            before = sentence(rng, rng.randint(0, 60)).split()
            words = [w.encode() for w in [*before, *shared, *sentence(rng, rng.randint(0, 60)).split()]]
            shingles = paragraphs.run_hashes(paragraphs.word_hashes(words), 5)
            at, hashes = paragraphs.windows_of(shingles, len(words))
            assert [int(a) for a in at] == [w[0] for w in brute_windows(words)]
            inside = (at >= len(before)) & (at + paragraphs.WINDOW <= len(before) + 50)
            found.append({(int(a) - len(before), tuple(h.tolist())) for a, h in zip(at[inside], hashes[inside], strict=True)})
        assert found[0] & found[1]


def test_bands_find_similar_lines():
    """At a similarity of 0.8 the bands miss 2 in 1000 pairs, above it fewer; a recall of 0.99 leaves room for chance."""
    rng = np.random.default_rng(2)
    caught = total = 0
    for _ in range(600):
        n = int(rng.integers(40, 200))
        common = rng.integers(1, 2**63, n).astype(np.uint64)
        extra = int(n * 0.25 * rng.random())
        sets = [np.concatenate([common, rng.integers(1, 2**63, k).astype(np.uint64)]) for k in (extra // 2, extra - extra // 2)]
        least = paragraphs.minima(np.concatenate(sets), np.array([len(x) for x in sets]), paragraphs.BANDS * paragraphs.ROWS)
        keys, parts = paragraphs.band_keys(least, paragraphs.BANDS), paragraphs.signatures(least)
        apart = sum(bin(int(x))[2:].zfill(64).count("1") and sum(c != "0" for c in f"{int(x):016x}") for x in parts[0] ^ parts[1])
        caught += bool((keys[0] == keys[1]).any() and apart <= paragraphs.most_apart(paragraphs.BANDS * paragraphs.ROWS, 80))
        total += 1
    assert caught >= 0.99 * total


def test_parities_bound_what_stands_in_one_set_alone():
    rng = np.random.default_rng(4)
    sets = [rng.choice(rng.integers(1, 2**63, 60).astype(np.uint64), int(rng.integers(1, 80))) for _ in range(40)]  # with repeats
    bits, n = minhash.parities(np.concatenate(sets), np.array([len(x) for x in sets]), 128)
    assert n.tolist() == [len(set(x.tolist())) for x in sets]
    for a, b in itertools.combinations(range(40), 2):
        apart = sum(int(x).bit_count() for x in bits[a] ^ bits[b])
        alone = len(set(sets[a].tolist()) ^ set(sets[b].tolist()))
        assert apart <= alone and (alone - apart) % 2 == 0


def brute_components(data, width, percent):
    sets = [runs(plain(r[1]), width) for r in data]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(data)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, closed(len(data), pairs)


@pytest.mark.parametrize("seed", [5, 6])
def test_minhash_components(spark, seed):
    data = rows(seed)
    sets, label = brute_components(data, 2, 80)
    least = {c: min((data[i][0] for i in range(len(data)) if label[i] == c and data[i][0] is not None), default=None) for c in set(label)}
    want = Counter()
    for r, s, c in zip(data, sets, label, strict=True):
        own = least[c] if s else r[0]
        want[r[0], len(s), own, r[0] == own] += 1
    got = minhash.minhash_components(documents(spark, seed))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == want


def test_minhash_links_at_the_threshold(spark):
    """Chains of near copies, and pairs just below and at 80 percent."""
    words = [f"w{k}" for k in range(300)]
    exact = [*words[:90], "x"]  # 2-word shingles of words[:100]: 99; 89 in common with this of 90: 89 / 100
    chain = [" ".join([*words[:200], *[f"c{j}" for j in range(5 * i)]]) for i in range(20)]
    below = [" ".join(f"b{k}" for k in range(82)), " ".join([*[f"b{k}" for k in range(73)], *[f"z{k}" for k in range(10)]])]  # 72 of 91
    data = [(i, t) for i, t in enumerate([" ".join(words[:100]), " ".join(exact), *chain, *below])]
    _, label = brute_components(data, 2, 80)
    got = {r.doc_id: r.component_id for r in minhash.minhash_components(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(enumerate(label))
    assert got[len(data) - 1] == len(data) - 1 and len({got[i] for i in range(2, 22)}) == 1


def test_contamination(spark):
    data = rows()
    long = next(r[1] for r in data if r[1] and len(r[1]) > 20000)
    words = long.split()
    items = [(1, " ".join(words[700:740])), (2, " ".join(words[700:740])), (3, " ".join([*words[20:55], *"a b c d e f g h".split()])), (4, "one two"), (5, None), (6, ""), (None, "one"), (7, "never seen anywhere in these texts at all")]
    sets = {}
    for item_id, t in items:
        if plain(t):
            sets.setdefault(t, []).append(item_id)
    want = Counter()
    for r in data:
        w = plain(r[1])
        for t, ids in sets.items():
            width = min(5, len(plain(t)))
            own = runs(plain(t), 5)
            held = {x for x in own if any(tuple(w[i : i + width]) == x for i in range(len(w) - width + 1))} if len(w) >= width else set()
            if held and len(held) >= 0.8 * len(own) - 1e-9:
                want[r[0], min((i for i in ids if i is not None), default=None), len(ids), len(own), len(held)] += 1
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 64):
        got = decontaminate.contaminated(documents(spark), table, block_bytes=size).collect()
        assert Counter((r.doc_id, r.item_id, r.n_items, r.n_shingles, r.n_found) for r in got) == want
    clean = decontaminate.without_benchmark(documents(spark), table)
    assert clean.count() == len(data) - len({k for k, r in enumerate(data) if any(x[0] == r[0] for x in want) or plain(r[1])[:1] == [b"one"]})
    assert decontaminate.contaminated(documents(spark), table.limit(0)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    assert suffixes.repeated_bytes(none).count() == 0 and suffixes.without_repeats(none).count() == 0
    assert paragraphs.paragraph_dedup(none).count() == 0 and paragraphs.without_passages(none).count() == 0
    assert minhash.minhash_components(none).count() == 0


def linked_by_parity(offered):
    """A stand-in for the exact check: numbers of the same tens link if they are less than three apart."""

    def verify(pairs):
        offered.append(pairs.count())
        return pairs.where("floor(a / 10) = floor(b / 10) AND b - a < 3")

    return verify


def test_few_members_are_crossed_at_once(spark):
    """Groups of few members that do not link cost one round after the hubs, not a round of pivots each time that a few links are found."""
    rows = [(g, g * 10 + k) for g in range(300) for k in range(9)] + [(1000 + g, g * 10 + k) for g in range(299) for k in range(5, 15)]
    members = spark.createDataFrame(rows, "key long, node long")
    offered = []
    got = links.joined_components(members, F.lit(True), [], ["node"], linked_by_parity(offered))
    assert len(offered) == 2
    assert {r.node: r.component for r in got.collect() if r.component != r.node} == {g * 10 + k: g * 10 for g in range(300) for k in range(1, 10 if g < 299 else 9)}


def test_large_groups_are_joined_by_pivots(spark):
    members = spark.createDataFrame([(1, k) for k in range(400)] + [(2, 5), (2, 15), (2, 25)], "key long, node long")
    offered = []

    def verify(pairs):
        offered.append(pairs.count())
        return pairs.where("(a < 200) = (b < 200) AND pmod(xxhash64(a, b), 3) = 0")

    got = links.joined_components(members, F.lit(True), [], ["node"], verify).collect()
    assert {r.component for r in got} == {0, 200} and len(got) == 400
    assert sum(offered) < 400 * 399 / 2


def test_rounds_of_pivots_are_few(spark):
    """A large group whose members link slowly costs a fixed number of rounds, not one for each pivot."""
    members = spark.createDataFrame([(1, k) for k in range(400)], "key long, node long")
    offered = []

    def verify(pairs):
        offered.append(pairs.count())
        return pairs.where("pmod(xxhash64(a, b), 12) = 0")

    got = links.joined_components(members, F.lit(True), [], ["node"], verify).collect()
    assert {r.component for r in got} == {0} and len(got) == 400
    assert len(offered) <= links.TURNS + 2 and sum(offered) < 400 * 399 / 2


def test_large_groups_are_crossed_in_tiles(spark, monkeypatch):
    """Blocks of a group meet all others, and a test drops no pair that links; nothing of another group is offered."""
    monkeypatch.setattr(links, "BLOCK", 16)
    members = [(g, g * 1000 + k, k) for g in (1, 2) for k in range(100)]
    parts = spark.createDataFrame([(1000 + k, 1000) for k in range(3)], "node long, component long")
    apart = links.still_apart(spark.createDataFrame(members, "key long, node long, n long"), parts)
    near = lambda x, y: abs(x["n"] - y["n"]) <= 5
    want = {(g * 1000 + a, g * 1000 + b) for g in (1, 2) for a in range(100) for b in range(a + 1, min(a + 6, 100)) if g == 2 or b > 2}
    assert Counter((r.a, r.b) for r in links.large_crossing_pairs(apart, [near], ["n"]).collect()) == Counter(want)
    every = {(a, b) for a, b in itertools.combinations([m[1] for m in members], 2) if a // 1000 == b // 1000 and b != 1001 and (a, b) not in {(1000, 1002), (1001, 1002)}}
    assert {(r.a, r.b) for r in links.large_crossing_pairs(apart, [], []).collect()} == every
    pivots = {(r.a, r.b) for r in links.pivot_pairs(apart, [near], ["n"], 1).collect()}
    assert pivots and pivots <= want and len({x for p in pivots for x in p}) >= 2 * links.PIVOTS


def test_large_groups_meet_their_size_once(spark, monkeypatch):
    """No round joins the members of large groups with their group's size again, and tiles are dealt by their blocks, not by the group."""
    monkeypatch.setattr(links, "BLOCK", 64)
    plans = []
    for name in ("pivot_pairs", "large_crossing_pairs"):

        def noted(*args, make=getattr(links, name)):
            plans.append(make(*args))
            return plans[-1]

        monkeypatch.setattr(links, name, noted)
    members = spark.createDataFrame([(g, g * 1000 + k) for g in (1, 2) for k in range(300)], "key long, node long")
    got = links.joined_components(members, F.lit(True), [], ["node"], lambda pairs: pairs.where("(a + b) % 2 = 0 AND pmod(xxhash64(a, b), 8) = 0")).collect()
    assert {r.node: r.component for r in got} == {g * 1000 + k: g * 1000 + k % 2 for g in (1, 2) for k in range(300)}
    texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(texts) >= 3 and not any("Join" in t for t in texts)
    assert all(re.search(r"hashpartitioning\(key#\w+, lo#\w+, hi#\w+,", t) for t in texts)


def test_filters_in_arrays_agree_with_those_in_columns(spark):
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 90, dtype=np.uint64))
    sets = [np.unique(np.r_[base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 62, 6, dtype=np.uint64)]) for _ in range(24)]
    least = minhash.minima(np.concatenate(sets), np.array([len(x) for x in sets]), 40)
    bits, sizes = minhash.parities(np.concatenate(sets), np.array([len(x) for x in sets]), 128)
    values = np.concatenate([minhash.signatures(least), bits], axis=1).view(np.int64)
    names = [f"s{k}" for k in range(minhash.signature_words(40))] + ["p0", "p1"]
    rows = [(i, int(n), *map(int, v)) for i, (n, v) in enumerate(zip(sizes, values, strict=True))]
    df = spark.createDataFrame(rows, "node long, n long, " + ", ".join(f"{c} long" for c in names))
    both = df.crossJoin(df.toDF(*[f"{c}_h" for c in df.columns])).select("node", "node_h", minhash.parts_apart(3).alias("apart"), minhash.few_turned(128, 0.8).alias("few"))
    x = {"n": sizes.astype(np.int64)} | {c: values[:, k] for k, c in enumerate(names)}
    tall = {c: v[:, None] for c, v in x.items()}
    apart, few = minhash.parts_apart_in(tall, x, 3), minhash.few_turned_in(tall, x, 128, 0.8)
    assert 0 < few.sum() < few.size
    assert all((r.apart, r.few) == (apart[r.node, r.node_h], few[r.node, r.node_h]) for r in both.collect())


def test_rows_are_narrowed_before_a_join(spark):
    """Of many rows only the wanted ones, and few others, reach the join; no key is lost, not even 0, negative ones, text or bytes."""
    rows = spark.range(-5000, 5000).select("id", F.md5(F.col("id").cast("string")).alias("text_key"))
    rows = rows.withColumn("raw", F.unhex("text_key")).union(spark.createDataFrame([(None, None, None)], "id long, text_key string, raw binary"))
    wanted = rows.where("id % 100 = 0")
    for key in rows.columns:
        got = common.narrowed(rows, key, wanted.select(key))
        assert got.columns == rows.columns
        ids = Counter(r.id for r in got.collect())
        assert set(ids.values()) == {1} and ids.keys() >= set(range(-5000, 5000, 100)) and len(ids) < 120
        assert common.narrowed(rows, key, wanted.limit(0).select(key)).count() == 0


def test_stars_need_no_round(spark):
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    assert links.starred(frame([(3, 1), (4, 1), (9, 2)])) and links.starred(frame([]))
    assert not links.starred(frame([(3, 1), (3, 2)])) and not links.starred(frame([(3, 2), (2, 1)]))


def test_jaccard_joins_meet_only_like_sets(spark, monkeypatch):
    """Texts that share their rarest shingles but little else are kept apart inside the join; none that links is lost."""
    rng = random.Random(3)
    shared = " ".join(f"r{k}" for k in range(12))
    data = [(i, shared + " " + " ".join(f"c{rng.randrange(40)}" for _ in range(60))) for i in range(20)]
    data += [(100, "a b c " + data[0][1]), (101, data[5][1] + " y z")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    asked = []
    promising = jaccard.promising
    monkeypatch.setattr(jaccard, "promising", lambda pairs, *rest: asked.append(pairs.count()) or promising(pairs, *rest))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 3, 80).collect()}
    sets = {i: set(jaccard.shingle_set(t, 3).tolist()) for i, t in data}
    like = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert like == [(0, 100), (5, 101)] and got == {i: {100: 0, 101: 5}.get(i, i) for i in sets}
    assert sum(asked[1:]) <= len(like)

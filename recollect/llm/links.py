"""From candidate groups to components: hubs instead of all pairs, and connected components by alternating stars.

A group of m candidates has m^2/2 pairs. :func:`hub_pairs` offers only the pairs of each member with the group's first one. After these are
verified and joined to components, groups of up to ``FEW`` members are offered all their pairs of different components (:func:`crossing_pairs`): at most
``FEW / 2`` a member. Rounds of pivots (:func:`pivot_pairs`) are for the larger groups alone: each member meets a few pivots of other components, more in every round, as long as
that pays and the pairs left are many, in ``TURNS`` rounds at most. So a large group of near copies, of which any two link with some chance, grows together in a few rounds of linear size;
at the end it is offered all pairs that still lie in different components (:func:`large_crossing_pairs`), compared in tiles of two blocks of members, so no group meets in one task.
Together they lose no link: a pair that is never offered is already connected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import discard, saved, scratch

PIVOTS = 4  # of a group in the first round; as many times more in each round after it
TURNS = 3  # rounds of pivots at most; every round is a fixed number of jobs
LEAST_FOUND = 0.05  # of the pairs offered: with fewer links, another round of pivots does not pay
FEW = 32  # members of a group whose pairs are offered at once
BLOCK = 2048  # members of a larger group that are compared together
STEP = 32
#: Whether pairs may link, of the columns of their members as arrays that numpy broadcasts.
Test = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def starred(links: DataFrame) -> bool:
    """Whether links (a > b) are stars: each ``a`` has one ``b``, which is nobody's ``a``."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(links.select("b", F.lit(0)))
    each = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return each.where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (a, b). No node's neighbours meet in one row.

    Large stars tie every larger neighbour of a node to the smallest node around it, small stars every smaller one; both keep
    the components, and in a logarithmic number of rounds only stars around the smallest nodes are left.
    """
    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not starred(links):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = saved(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        discard(links)
        links = new
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def shared_members(members: DataFrame, name: str) -> DataFrame:
    """The members (key, ...) of groups of two or more. Most keys are alone; only they are counted, and nothing later meets the others."""
    several = group_sizes(members).where("_n > 1").select("key")
    return saved(members.join(several, "key", "left_semi"), name)


def hub_pairs(members: DataFrame, fits: Column, carried: list[str], order: list[str]) -> DataFrame:
    """a, b: each member of a group and the group's hub, its first member by ``order``; pairs that do not fit are left out.

    ``members``: key, node and the ``carried`` columns, which ``fits`` may name, with a ``_h`` behind them for the hub's. The hub is
    found by an aggregate that is combined before the shuffle; the join with it has one row per group on one side.
    """
    hub = members.groupBy("key").agg(F.min(F.struct(*order, *[c for c in ["node", *carried] if c not in order])).alias("h"))
    hub = hub.select("key", F.col("h.node").alias("node_h"), *[F.col(f"h.{c}").alias(f"{c}_h") for c in carried])
    met = members.join(hub, "key").where((F.col("node") != F.col("node_h")) & fits)
    return met.select(F.least("node", "node_h").alias("a"), F.greatest("node", "node_h").alias("b")).distinct()


def still_apart(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members, with their component as ``_part``, of the groups that lie in several components."""
    placed = members.join(parts.withColumnRenamed("component", "_part"), "node", "left").withColumn("_part", F.coalesce("_part", "node"))
    several = placed.groupBy("key").agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi")).where("_lo <> _hi").select("key")
    return saved(placed.join(several, "key", "left_semi"), "apart")


def crossing_pairs(apart: DataFrame, fits: Column, carried: list[str]) -> DataFrame:
    """a, b: all fitting pairs of members of a group in different components, for groups of few members."""
    other = apart.select("key", *[F.col(c).alias(f"{c}_h") for c in ["node", *carried, "_part"]])
    both = apart.join(other, "key").where((F.col("_part") != F.col("_part_h")) & fits & (F.col("node") < F.col("node_h")))
    return both.select(F.least("node", "node_h").alias("a"), F.greatest("node", "node_h").alias("b")).distinct()


def group_sizes(members: DataFrame) -> DataFrame:
    """key, _n: how many members each group has."""
    return members.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))


def in_blocks(apart: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The members of the groups (key, _n), or of all, with ``_blocks``, the number of blocks of about ``BLOCK`` members of their group, and ``_block``, their own.

    Members that have them stay as they are: a group lies apart as a whole or not at all, so its blocks hold for all rounds, and no round joins
    the members with their group's size again. Tiles then are dealt by what they are, not by the key of such a join, which brings a whole group to one task.
    """
    if "_blocks" in apart.columns:
        return apart
    sizes = (group_sizes(apart) if groups is None else groups).select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    return apart.join(sizes, "key").withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))


def tiled(rows: DataFrame, tests: Sequence[Test], carried: list[str]) -> DataFrame:
    """a, b: the pairs of different components that pass all tests, of the tiles (key, lo, hi): sides 0 and 1, or side 0 with itself if lo = hi.

    A tile has about two blocks of members; numpy compares ``STEP`` of them at once with the others, and each test looks only at the pairs that the ones before it have left.
    """
    names = ["node", "_part", *carried]

    def compare(tile: pa.Table) -> pa.Table:
        side = tile.column("side").to_numpy()
        alone = tile.column("lo")[0].as_py() == tile.column("hi")[0].as_py()
        values = {c: tile.column(c).to_numpy() for c in names}
        x, y = ({c: v[side == k] for c, v in values.items()} for k in (0, 0 if alone else 1))
        a, b = [], []
        for begin in range(0, len(x["node"]), STEP):
            part = {c: v[begin : begin + STEP] for c, v in x.items()}
            tall = {c: v[:, None] for c, v in part.items()}
            fit = tall["_part"] != y["_part"]
            if alone:
                fit &= tall["node"] < y["node"]
            for test in tests[:1]:
                fit &= test(tall, y)
            at, other = np.nonzero(fit)
            for test in tests[1:]:
                good = test({c: v[at] for c, v in part.items()}, {c: v[other] for c, v in y.items()})
                at, other = at[good], other[good]
            one, two = part["node"][at], y["node"][other]
            a.append(np.minimum(one, two))
            b.append(np.maximum(one, two))
        return pa.table({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})

    wanted = rows.select("key", "lo", "hi", "side", *[F.col(c).cast("long").alias(c) for c in names])
    return wanted.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def pivot_pairs(apart: DataFrame, tests: Sequence[Test], carried: list[str], turn: int) -> DataFrame:
    """a, b: each member with its group's pivots of this turn, four times as many as in the last. Groups of like members choose by one of ``PIVOTS`` orders."""
    place = F.xxhash64("node", F.lit(turn), F.pmod(F.xxhash64("key"), F.lit(PIVOTS)))
    blocks = in_blocks(apart)
    first = Window.partitionBy("key").orderBy(place, "node")
    pivots = blocks.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= PIVOTS**turn).drop("_place")
    sides = blocks.withColumn("lo", F.col("_block")).withColumn("side", F.lit(0)).unionByName(
        pivots.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("side", F.lit(1))
    )
    return tiled(sides.withColumn("hi", F.lit(-1)), tests, carried)


def large_crossing_pairs(apart: DataFrame, tests: Sequence[Test], carried: list[str]) -> DataFrame:
    """a, b: all pairs of members of a group in different components that pass the tests: every block of a group meets every other."""
    each = in_blocks(apart).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sides = each.withColumn("lo", F.least("_block", "_other")).withColumn("hi", F.greatest("_block", "_other"))
    return tiled(sides.withColumn("side", (F.col("_block") != F.col("lo")).cast("int")), tests, carried)


def many_crossings(apart: DataFrame) -> bool:
    """Whether the pairs of a group in different components are more than ``FEW / 2`` a member."""
    each = apart.groupBy("key", "_part").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("within"))
    n, twice = each.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") - F.col("within"))).first()
    return bool(n) and twice > FEW * n


def joined_components(
    members: DataFrame,
    fits: Column,
    carried: list[str],
    order: list[str],
    verify: Callable[[DataFrame], DataFrame],
    sketches: DataFrame | None = None,
    alike: Column | None = None,
    tests: Sequence[Test] = (),
) -> DataFrame:
    """node, component of the members (key, node and ``carried``) that :func:`verify` links; ``verify`` keeps of pairs (a, b) those that link.

    ``fits`` may name the carried columns, which have a ``_h`` behind them for the other one of a pair. ``alike`` may also name the columns of
    ``sketches`` (node, ...): what is too wide to carry for all members, and is given only to those of groups in several components.
    ``tests`` say the same as ``fits`` and ``alike``, or less, of columns in arrays, which hold whole numbers; the cheapest and closest comes first.
    """
    with scratch(members.sparkSession) as keep:
        return keep(_joined(members, fits, carried, order, verify, sketches, alike, tests), "components")


def _joined(
    members: DataFrame, fits: Column, carried: list[str], order: list[str], verify: Callable[[DataFrame], DataFrame], sketches: DataFrame | None, alike: Column | None, tests: Sequence[Test]
) -> DataFrame:
    done = saved(hub_pairs(members, fits, carried, order), "offered")
    links = verify(done)
    parts = components(links)
    apart = still_apart(members, parts)

    def linked(offered: DataFrame) -> tuple[int, int]:
        """Add the links among the pairs to the components; how many pairs were new, and how many of them link."""
        nonlocal done, parts
        offered = saved(offered.join(done, ["a", "b"], "left_anti"), "offered")
        asked = offered.count()
        if not asked:
            return 0, 0
        done = done.union(offered)
        new = verify(offered)
        found = new.count()
        if found:
            parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new))
        return asked, found

    if apart.isEmpty():
        return parts
    many = saved(group_sizes(apart).where(F.col("_n") > FEW), "groups")
    seen = apart
    if sketches is not None:
        seen, fits, carried = apart.join(sketches, "node"), fits & alike, [*carried, *[c for c in sketches.columns if c != "node"]]
    offered = crossing_pairs(seen.join(many, "key", "left_anti"), fits, carried)
    if many.isEmpty():
        linked(offered)
        return parts
    large = saved(in_blocks(seen, many), "apart")
    asked, found = linked(offered.union(pivot_pairs(large, tests, carried, 1)).distinct())
    discard(apart)
    for turn in range(2, TURNS + 2):
        if found:
            before, large = large, still_apart(large.drop("_part"), parts)
            discard(before)
        if turn > TURNS or found < max(1, LEAST_FOUND * asked) or not many_crossings(large):
            break
        asked, found = linked(pivot_pairs(large, tests, carried, turn))
    if not large.isEmpty():
        linked(large_crossing_pairs(large, tests, carried))
    return parts

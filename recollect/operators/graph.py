"""Entity graph: entities(entity_id, name, type), relations(src, predicate, dst, memory_id), mentions(entity_id, memory_id)."""

from __future__ import annotations

import itertools
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recollect.functions.ranking import top_per_key
from recollect.session import cut


class Graph(NamedTuple):
    entities: DataFrame
    relations: DataFrame
    mentions: DataFrame


SALTS = 32
TASK_MENTIONS = 100_000


def entity_key() -> Column:
    return F.sha2(F.concat_ws("\u0001", "name", "type"), 256)


def dedup_entities(entities: DataFrame) -> DataFrame:
    """One row per (name, type), with an id derived from both."""
    return entities.select("name", "type").distinct().select(entity_key().alias("entity_id"), "name", "type")


def merge_entities(graph: Graph) -> tuple[Graph, DataFrame]:
    """(graph, ids): entities with one name and type become one, and (old, new) tells which id became which.

    Relations and mentions are rewritten to the new ids in one pass each, and those that become equal are merged. The ends of
    relations and the mentions that name no entity keep their ids.
    """
    ids = graph.entities.select(F.col("entity_id").alias("old"), entity_key().alias("new")).distinct()
    entities = graph.entities.select(entity_key().alias("entity_id"), "name", "type").distinct()

    def renamed(df: DataFrame, c: str) -> DataFrame:
        both = df.join(ids.withColumnRenamed("old", c), c, "left")
        return both.withColumn(c, F.coalesce("new", c)).select(*df.columns)

    relations = renamed(renamed(graph.relations, "src"), "dst").distinct()
    return Graph(entities, relations, renamed(graph.mentions, "entity_id").distinct()), ids


def match_entities(query_entities: DataFrame, entities: DataFrame) -> DataFrame:
    """Graph entities with the same name and type as the query's: (query_id, entity_id, name, type)."""
    return query_entities.select("query_id", "name", "type").distinct().join(entities, ["name", "type"]).select(
        "query_id", "entity_id", "name", "type"
    )


def linked_memories(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    return entities.join(mentions, "entity_id").select("entity_id", "memory_id").distinct()


def memory_entities(memories: DataFrame, mentions: DataFrame) -> DataFrame:
    return memories.join(mentions, "memory_id").select("memory_id", "entity_id").distinct()


def neighbours(relations: DataFrame) -> DataFrame:
    """Undirected, distinct (entity_id, neighbour_id) pairs of the relation table."""
    forward = relations.select(F.col("src").alias("entity_id"), F.col("dst").alias("neighbour_id"))
    back = relations.select(F.col("dst").alias("entity_id"), F.col("src").alias("neighbour_id"))
    return forward.unionByName(back).distinct()


def neighbour_memories(
    entities: DataFrame, relations: DataFrame, mentions: DataFrame, exclude_linked: bool = True
) -> DataFrame:
    """Memories of the one-hop neighbours of each entity, without those linked to the entity itself."""
    near = entities.select("entity_id").distinct().join(neighbours(relations), "entity_id")
    links = mentions.select(F.col("entity_id").alias("neighbour_id"), "memory_id").distinct()
    # A hot neighbour's mentions are dealt out by memory; the pairs, which meet every part, are as many as the edges.
    spread = links.withColumn("_salt", F.pmod(F.xxhash64("memory_id"), F.lit(SALTS)).cast("int"))
    salted = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = salted.join(spread, ["neighbour_id", "_salt"]).select("entity_id", "memory_id")
    if not exclude_linked:
        return found.distinct()
    own = mentions.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").where("memory_id IS NOT NULL")
    both = found.withColumn("_own", F.lit(False)).unionByName(own.select("entity_id", "memory_id", F.lit(True).alias("_own")))
    # So many partitions that a task keeps the pairs of a bounded number of mentions, however many there are.
    parts = -(-mentions.count() // TASK_MENTIONS) or 1
    once = both.repartition(parts, "memory_id").groupBy("entity_id", "memory_id").agg(F.max("_own").alias("_own"))
    return once.where(~F.col("_own")).drop("_own")


def outgoing(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose subject is one of the entities."""
    return relations.join(entities.select(F.col("entity_id").alias("src")).distinct(), "src", "left_semi")


def incoming(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose object is one of the entities."""
    return relations.join(entities.select(F.col("entity_id").alias("dst")).distinct(), "dst", "left_semi")


def memories_by_entity(entities: DataFrame, mentions: DataFrame, memories: DataFrame) -> DataFrame:
    """(entity_id, memory columns) of all memories that mention the entity."""
    return linked_memories(entities, mentions).join(memories, "memory_id")


def orphan_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities without a mention."""
    mentioned = mentions.select("entity_id").distinct()  # a hot entity is one row here
    return entities.join(mentioned, "entity_id", "left_anti")


def prune_orphans(graph: Graph) -> Graph:
    """Drop entities without a mention, and every relation that touches one."""
    gone = orphan_entities(graph.entities, graph.mentions).select("entity_id")
    kept = graph.entities.join(gone, "entity_id", "left_anti")
    relations = graph.relations.join(gone.withColumnRenamed("entity_id", "src"), "src", "left_anti")
    relations = relations.join(gone.withColumnRenamed("entity_id", "dst"), "dst", "left_anti")
    return Graph(kept, relations.select(*graph.relations.columns), graph.mentions)


def unlink_memories(graph: Graph, memory_ids: DataFrame) -> Graph:
    """Remove the mentions of the given memories, then the entities left without one."""
    mentions = graph.mentions.join(memory_ids, "memory_id", "left_anti")
    return prune_orphans(Graph(graph.entities, graph.relations, mentions))


def graph_sizes(graph: Graph) -> DataFrame:
    """One row: number of entities, relations and mentions."""
    parts = [
        frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        for name, frame in zip(("entities", "relations", "mentions"), graph)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over an edge table (src, dst); a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def network_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, n) for nodes and edges."""
    return nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("part"), "n").unionByName(
        edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("part"), "n")
    )


def _search(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted, seen): the pairs (src, dst) whose source is a node, and (src, node, hops, parent) around their sources.

    A breadth-first search by joins, one job a hop: each round moves the frontier one edge on and is cut off from its history by a
    checkpoint, which also tells how many nodes are new. Edges have no direction, so a node next to the frontier is new unless it lies in this frontier or the
    one before: what was seen earlier is not read again. Sources whose targets are all found leave the search every few hops.
    """
    links = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = cut(links.distinct().select(F.col("src").alias("node"), F.col("dst").alias("next")))
    known = links.select("node").distinct()
    wanted = pairs.select("src", "dst").distinct()
    wanted = cut(wanted.join(known.withColumnRenamed("node", "src"), "src", "left_semi"))
    start = wanted.select("src", F.col("src").alias("node")).distinct()
    parent = F.lit(None).cast(links.schema["node"].dataType).alias("parent")
    rings = [cut(start.select("src", "node", F.lit(0).alias("hops"), parent))]
    left, frontier = wanted, rings[0]
    for hop in itertools.count(1):
        step = frontier.select("src", "node").join(links, "node").groupBy("src", F.col("next").alias("node")).agg(F.min("node").alias("parent"))
        for ring in rings[-2:]:
            step = step.join(ring.select("src", "node"), ["src", "node"], "left_anti")
        new = Observation()
        frontier = cut(step.select("src", "node", F.lit(hop).alias("hops"), "parent").observe(new, F.count(F.lit(1)).alias("n")))
        if not new.get["n"]:
            return wanted, reduce(DataFrame.unionByName, rings)
        rings.append(frontier)
        if hop % PRUNE == 0:
            found = reduce(DataFrame.unionByName, rings[-PRUNE:]).select("src", F.col("node").alias("dst"))
            left = cut(left.join(found, ["src", "dst"], "left_anti"))
            frontier = frontier.join(left.select("src").distinct(), "src", "left_semi")
    raise AssertionError("not reached")


PRUNE = 4


def shortest_hops(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, hops) of the shortest undirected path for each wanted pair; pairs without one are left out."""
    wanted, seen = _search(edges, pairs)
    return wanted.join(seen.withColumnRenamed("node", "dst"), ["src", "dst"]).select("src", "dst", "hops")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, hops, nodes): a shortest undirected path for each wanted pair, with its nodes from source to target.

    Of several shortest paths it is the one on which each node, seen from the target, comes from the smallest node it can come from. The search
    leaves a pointer from each node to the one before it; the paths are put together by pointer doubling: in each round every
    node takes over what its pointer's node has gathered and points where that one points, so a path of h hops needs about log2(h) rounds.
    """
    wanted, seen = _search(edges, pairs)
    walked = cut(seen.select("src", "node", "hops", F.col("parent").alias("to"), F.array("node").alias("nodes")))
    targets = wanted.withColumnRenamed("dst", "node")
    while not walked.join(targets, ["src", "node"], "left_semi").where(F.col("to").isNotNull()).isEmpty():
        ahead = walked.select("src", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("nodes").alias("_nodes"))
        joined = walked.join(ahead, ["src", "to"], "left")
        nodes = F.when(F.col("to").isNull(), F.col("nodes")).otherwise(F.concat("_nodes", "nodes"))
        walked = cut(joined.select("src", "node", "hops", F.col("_to").alias("to"), nodes.alias("nodes")))
    return targets.join(walked, ["src", "node"]).select("src", F.col("node").alias("dst"), "hops", "nodes")


HOT_MENTIONS = 1000


def graph_search(query_entities: DataFrame, graph: Graph, k: int = 5, hot: int = HOT_MENTIONS, candidates: DataFrame | None = None) -> DataFrame:
    """Best 2k memories per query by shared entities times the Jaccard similarity of the entity sets.

    Returns (query_id, id, shared, score, rank). A memory reached only over a neighbour scores 0 but may fill a place. With ``candidates``
    (memory_id), such as one user's memories, only those are ranked, so that the 2k best of them are complete.

    With s shared entities, q asked and m in the memory the score is s * s / (q + m - s). It grows with s and falls
    with m, which keeps the work bounded without losing a result:

    * Entities with at most ``hot`` mentions are joined as they are.
    * For the others memories are grouped by the set of hot entities they hold. Of one such group a query can only
      need the 2k best by (m, id), because every member shares at least what the others share; and of the groups only
      the 2k whose best members come first. Queries that ask for the same hot entities, and as many entities in all, are one here.
    * Memories of neighbours come after all direct ones, so only queries with fewer than 2k direct hits look for
      them, and per entity only its 4k smallest such ids can matter.
    """
    limit = 2 * (k if k > 0 else 5)
    asked = query_entities.select("query_id", "name", "type").distinct()
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("q"))
    matched = asked.join(graph.entities, ["name", "type"]).select("query_id", "entity_id").distinct()
    mentions = graph.mentions.select("entity_id", "memory_id").distinct()
    if candidates is not None:
        mentions = mentions.join(candidates.select("memory_id").distinct(), "memory_id", "left_semi")
    busy = mentions.groupBy("entity_id").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("entity_id", F.lit(True).alias("_hot"))

    # One row per memory: its size and its hot entities. A memory holds the entities of one text.
    flagged = mentions.join(busy, "entity_id", "left")
    memories = flagged.groupBy("memory_id").agg(
        F.count("*").alias("m"), F.sort_array(F.collect_list(F.when(F.col("_hot"), F.col("entity_id")))).alias("hot_ids")
    )
    asked_hot = matched.join(busy, "entity_id", "left")
    queries = asked_hot.groupBy("query_id").agg(F.collect_list(F.when(F.col("_hot"), F.col("entity_id"))).alias("q_hot")).join(sizes, "query_id")

    def score(s: Column, m: Column) -> Column:
        return s * s / F.greatest(F.col("q") + m - s, F.lit(1))

    rare = asked_hot.where(F.col("_hot").isNull()).join(mentions, "entity_id").groupBy("query_id", "memory_id").agg(F.count("*").alias("rare"))
    by_rare = rare.join(memories, "memory_id").join(queries, "query_id").select(
        "query_id", "memory_id", (F.col("rare") + F.size(F.array_intersect("q_hot", "hot_ids"))).alias("shared"), "m", "q"
    )
    groups = memories.where(F.size("hot_ids") > 0).withColumn("group", F.sha2(F.concat_ws(",", "hot_ids"), 256))
    members = top_per_key(groups.select("group", "memory_id", "m"), ["group"], [F.asc("m"), F.asc("memory_id")], limit, "_place")
    best = members.where(F.col("_place") == 1).select("group", F.col("m").alias("best_m"), F.col("memory_id").alias("best_id"))
    group_rows = groups.select("group", "hot_ids").dropDuplicates(["group"]).select("group", F.explode("hot_ids").alias("entity_id"))
    asking = queries.where(F.size("q_hot") > 0).select("query_id", "q", F.sort_array("q_hot").alias("q_hot"))
    kinds = asking.groupBy("q_hot", "q").agg(F.min("query_id").alias("kind"))
    met = kinds.select("kind", F.explode("q_hot").alias("entity_id")).join(group_rows, "entity_id").groupBy("kind", "group").agg(F.count("*").alias("s"))
    placed = met.join(best, "group").join(kinds.select("kind", "q"), "kind").withColumn("_score", score(F.col("s"), F.col("best_m")))
    chosen = top_per_key(placed, ["kind"], [F.desc("_score"), F.asc("best_id")], limit, None)
    hot_hits = top_per_key(
        chosen.select("kind", "group", "s", "q").join(members, "group").withColumn("_score", score(F.col("s"), F.col("m"))),
        ["kind"], [F.desc("_score"), F.asc("memory_id")], limit, None,
    )
    by_hot = asking.join(kinds, ["q_hot", "q"]).select("query_id", "kind").join(hot_hits, "kind").select(
        "query_id", "memory_id", F.col("s").alias("shared"), "m", "q"
    )
    # A memory found both ways shares more than its hot entities; the larger count is the whole one.
    direct = by_rare.unionByName(by_hot).groupBy("query_id", "memory_id", "m", "q").agg(F.max("shared").alias("shared"))
    direct = direct.select("query_id", "memory_id", "shared", score(F.col("shared"), F.col("m")).alias("score"))

    counted = direct.groupBy("query_id").agg(F.count("*").alias("_c"))
    short = matched.join(counted, "query_id", "left").where(F.coalesce("_c", F.lit(0)) < limit).select("query_id", "entity_id")
    first_ids = top_per_key(mentions, ["entity_id"], [F.asc("memory_id")], 2 * limit, None)
    near = short.select("entity_id").distinct().join(neighbours(graph.relations), "entity_id")
    near = near.join(first_ids.withColumnRenamed("entity_id", "neighbour_id"), "neighbour_id").select("entity_id", "memory_id").distinct()
    near = top_per_key(near, ["entity_id"], [F.asc("memory_id")], 2 * limit, None)
    only_near = short.join(near, "entity_id").select("query_id", "memory_id").distinct()
    only_near = only_near.join(direct, ["query_id", "memory_id"], "left_anti").select(
        "query_id", "memory_id", F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("score")
    )
    ranked = top_per_key(direct.unionByName(only_near), ["query_id"], [F.desc("score"), F.asc("memory_id")], limit)
    return ranked.select("query_id", F.col("memory_id").alias("id"), "shared", F.round("score", 6).alias("score"), "rank")

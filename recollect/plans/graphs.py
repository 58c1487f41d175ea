"""Registered queries: the entity graph and network operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import graph as G
from recollect.plans import fixtures as fx
from recollect.plans.registry import query

_G = f"WITH {fx.GRAPH}"
_TYPES = "picked AS (SELECT entity_id FROM entities WHERE type = 'user')"


def _users(t):
    g = fx.event_graph(t)
    return g, g.entities.where(F.col("type") == "user")


@query("j03_match_entities", f"{_G}, {fx.QUERY_ENTITIES} SELECT query_id, entity_id, name, type FROM qe JOIN entities USING (name, type)")
def j03(t):
    return G.match_entities(fx.query_entities(t), fx.event_graph(t).entities)


@query("j04_linked_memories", f"{_G}, {_TYPES} SELECT entity_id, memory_id FROM picked JOIN mentions USING (entity_id)")
def j04(t):
    g, users = _users(t)
    return G.linked_memories(users, g.mentions)


@query("j04_memory_entities", f"{_G} SELECT event_id AS memory_id, entity_id FROM events JOIN mentions ON memory_id = event_id WHERE event_type = 'error'")
def j04_back(t):
    wanted = t.events.where(F.col("event_type") == "error").select(F.col("event_id").alias("memory_id"))
    return G.memory_entities(wanted, fx.event_graph(t).mentions)


@query("j05_neighbour_memories", f"""{_G}, picked AS (SELECT entity_id FROM entities WHERE type IN ('type', 'brand')),
nb AS (SELECT src AS entity_id, dst AS other FROM relations UNION SELECT dst, src FROM relations)
SELECT DISTINCT entity_id, m.memory_id FROM picked JOIN nb USING (entity_id) JOIN mentions m ON m.entity_id = other WHERE NOT EXISTS (SELECT 1 FROM mentions x WHERE x.entity_id = picked.entity_id AND x.memory_id = m.memory_id)""")
def j05(t):
    g = fx.event_graph(t)
    return G.neighbour_memories(g.entities.where(F.col("type").isin("type", "brand")), g.relations, g.mentions)


@query("j06_outgoing", f"{_G}, {_TYPES} SELECT r.* FROM relations r JOIN picked ON src = entity_id")
def j06(t):
    g, users = _users(t)
    return G.outgoing(users, g.relations)


@query("j06_incoming", f"{_G} SELECT r.* FROM relations r JOIN entities ON dst = entity_id WHERE type = 'key'")
def j06_in(t):
    g = fx.event_graph(t)
    return G.incoming(g.entities.where(F.col("type") == "key"), g.relations)


@query("j07_memories_by_entity", f"{_G}, {fx.MEMORIES} SELECT entity_id, m.memory_id, content FROM mentions m JOIN memories ON id = m.memory_id WHERE entity_id IN (SELECT entity_id FROM entities WHERE type = 'key')")
def j07(t):
    g = fx.event_graph(t)
    items = fx.memories(t).select(F.col("id").alias("memory_id"), "content")
    return G.memories_by_entity(g.entities.where(F.col("type") == "key"), g.mentions, items)


@query("j10_orphan_entities", f"{_G} SELECT entity_id, name, type FROM entities ANTI JOIN mentions USING (entity_id)")
def j10(t):
    g = fx.event_graph(t)
    return G.orphan_entities(g.entities, g.mentions)


@query("j10_pruned_relations", f"{_G}, gone AS (SELECT entity_id FROM entities ANTI JOIN mentions USING (entity_id)) SELECT * FROM relations WHERE src NOT IN (SELECT entity_id FROM gone) AND dst NOT IN (SELECT entity_id FROM gone)")
def j10_prune(t):
    return G.prune_orphans(fx.event_graph(t)).relations


@query("m06_unlink_memories", f"""{_G}, m2 AS (SELECT * FROM mentions WHERE memory_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')),
kept AS (SELECT * FROM entities SEMI JOIN m2 USING (entity_id)) SELECT entity_id, name, type FROM kept""")
def m06(t):
    gone = t.events.where(F.col("event_type") == "error").select(F.col("event_id").alias("memory_id"))
    return G.unlink_memories(fx.event_graph(t), gone).entities


@query("m08_dedup_entities", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS name, event_type AS type, sha256(user_id || chr(1) || event_type) AS entity_id FROM events")
def m08(t):
    return G.dedup_entities(t.events.select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("type")))


def _split_graph(t):
    """The event graph as several writers would leave it: the mentions and relations of odd events name entities of their own."""
    g = fx.event_graph(t)
    odd = lambda c: F.when(F.col("memory_id") % 2 == 1, F.concat(F.lit("o-"), c)).otherwise(F.col(c)).alias(c)
    entities = g.entities.union(g.entities.select(F.concat(F.lit("o-"), "entity_id"), "name", "type"))
    return G.Graph(entities, g.relations.select(odd("src"), "predicate", odd("dst"), "memory_id"), g.mentions.select(odd("entity_id"), "memory_id"))


_NEW_ID = "SELECT entity_id AS old, sha256(name || chr(1) || type) AS new FROM entities"


@query("m08_identity_map", f"{_G}, ids AS ({_NEW_ID}) SELECT old, new FROM ids UNION ALL SELECT 'o-' || old, new FROM ids")
def m08_ids(t):
    return G.merge_entities(_split_graph(t))[1]


@query("m08_merged_relations", f"{_G}, ids AS ({_NEW_ID}) SELECT DISTINCT coalesce(a.new, src) AS src, predicate, coalesce(b.new, dst) AS dst, memory_id FROM relations LEFT JOIN ids a ON a.old = src LEFT JOIN ids b ON b.old = dst")
def m08_relations(t):
    return G.merge_entities(_split_graph(t))[0].relations


@query("m08_merged_mentions", f"{_G}, ids AS ({_NEW_ID}) SELECT DISTINCT new AS entity_id, memory_id FROM mentions JOIN ids ON old = entity_id")
def m08_mentions(t):
    return G.merge_entities(_split_graph(t))[0].mentions


@query("m06_unlinked_graph", f"""{_G}, m2 AS (SELECT * FROM mentions WHERE memory_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')),
gone AS (SELECT entity_id FROM entities ANTI JOIN m2 USING (entity_id))
SELECT 'relation' AS part, src AS a, dst AS b, memory_id FROM relations WHERE src NOT IN (SELECT entity_id FROM gone) AND dst NOT IN (SELECT entity_id FROM gone) UNION ALL SELECT 'mention', entity_id, NULL, memory_id FROM m2""")
def m06_graph(t):
    """What is left of relations and mentions, by value."""
    gone = t.events.where(F.col("event_type") == "error").select(F.col("event_id").alias("memory_id"))
    left = G.unlink_memories(fx.event_graph(t), gone)
    relations = left.relations.select(F.lit("relation").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), "memory_id")
    return relations.union(left.mentions.select(F.lit("mention"), "entity_id", F.lit(None).cast("string"), "memory_id"))


@query("a09_graph_sizes", f"{_G} SELECT 'entities' AS part, count(*) AS n FROM entities UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'mentions', count(*) FROM mentions")
def a09(t):
    return G.graph_sizes(fx.event_graph(t))


@query("a10_degrees", f"{_G} SELECT node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node FROM relations) GROUP BY node")
def a10(t):
    return G.degrees(fx.event_graph(t).relations)


@query("a10_network_counts", f"{_G} SELECT 'nodes' AS part, count(*) AS n FROM entities UNION ALL SELECT 'edges', count(*) FROM relations")
def a10_counts(t):
    g = fx.event_graph(t)
    return G.network_counts(g.entities, g.relations)


_WALK = """nodes AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn FROM conversations),
edges AS (SELECT a.id AS s, b.id AS d FROM nodes a JOIN nodes b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 UNION ALL SELECT a.id, b.id FROM nodes a JOIN nodes b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 WHERE a.turn % 3 = 0),
und AS (SELECT s, d FROM edges UNION SELECT d, s FROM edges),
pairs AS (SELECT conv_id * 1000 + max(turn) AS src, conv_id * 1000 AS dst, count(*) AS n FROM conversations GROUP BY conv_id),
walk AS (SELECT src, src AS node, 0 AS hops, n FROM pairs UNION SELECT w.src, u.d, w.hops + 1, n FROM walk w JOIN und u ON u.s = w.node WHERE w.hops < w.n),
dist AS (SELECT src, node, min(hops) AS hops FROM walk GROUP BY ALL)"""


def _follow_ons(t):
    """From the last turn of each conversation to its first, over follow-on edges and some shortcuts."""
    c = t.conversations
    node = F.col("conv_id") * 1000 + F.col("turn")
    here = c.select("conv_id", "turn", node.alias("src"))

    def after(step):
        return c.select("conv_id", (F.col("turn") - step).alias("turn"), node.alias("dst"))

    edges = here.join(after(1), ["conv_id", "turn"]).unionByName(here.where(F.col("turn") % 3 == 0).join(after(2), ["conv_id", "turn"])).select("src", "dst")
    pairs = c.groupBy("conv_id").agg((F.first("conv_id") * 1000 + F.max("turn")).alias("src")).select("src", (F.col("conv_id") * 1000).alias("dst"))
    return edges, pairs


@query("j14_shortest_hops", f"""WITH RECURSIVE {_WALK}
SELECT p.src, p.dst, hops FROM pairs p JOIN dist d ON d.src = p.src AND d.node = p.dst WHERE p.src IN (SELECT s FROM und)""")
def j14(t):
    return G.shortest_hops(*_follow_ons(t))


@query("j14_shortest_paths", f"""WITH RECURSIVE {_WALK},
back AS (SELECT d.src, d.node, min(u.s) AS parent FROM dist d JOIN und u ON u.d = d.node JOIN dist e ON e.src = d.src AND e.node = u.s AND e.hops = d.hops - 1 GROUP BY ALL),
path AS (SELECT p.src, p.dst, hops, p.dst AS node, [p.dst] AS nodes FROM pairs p JOIN dist d ON d.src = p.src AND d.node = p.dst WHERE p.src IN (SELECT s FROM und)
  UNION ALL SELECT path.src, dst, hops, parent, list_prepend(parent, nodes) FROM path JOIN back ON back.src = path.src AND back.node = path.node)
SELECT src, dst, hops, nodes FROM path WHERE node = src""")
def j14_paths(t):
    return G.shortest_paths(*_follow_ons(t))

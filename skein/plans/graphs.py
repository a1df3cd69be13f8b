"""Queries over graphs, with their SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import centrality, community, dealt, graph, traverse
from skein.operators.base import settle, together
from skein.sources import adapters as A

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {A.ENTITIES_SQL}, {A.OWNERSHIP_SQL}
SELECT 'entity' AS part, entity_type AS kind, count(*) AS n FROM entities GROUP BY 2
UNION ALL SELECT 'relationship', relationship_type, count(*) FROM ownership GROUP BY 2""")
def graph_stats_by_type(spark, d):
    return graph.counts_by_type(A.entities(spark, d), A.ownership(spark, d))


@query(f"""WITH {A.OWNERSHIP_SQL}, per AS (SELECT node, count(*) AS c FROM (SELECT source_id AS node FROM ownership UNION ALL SELECT target_id FROM ownership) GROUP BY 1)
SELECT count(*) AS n_nodes, (sum(c) / 2)::BIGINT AS n_edges, min(c) AS min_degree, max(c) AS max_degree, round(sum(c) / count(*)::DOUBLE, 4) AS avg_degree,
  round(sum(c)::DOUBLE / (count(*) * (count(*) - 1)), 6) AS density FROM per""")
def degree_stats_density(spark, d):
    return graph.degree_statistics(A.ownership(spark, d))


@query(f"""WITH {A.OWNERSHIP_SQL} SELECT source_id AS node, target_id AS nbr, relationship_type, relationship_id FROM ownership
UNION ALL SELECT target_id, source_id, relationship_type, relationship_id FROM ownership""")
def adjacency(spark, d):
    return graph.adjacency(A.ownership(spark, d))


@query(f"WITH {A.OWNERSHIP_SQL} SELECT * FROM ownership WHERE source_id = 'customer-00007' OR target_id = 'customer-00007'")
def incident_edges(spark, d):
    return graph.incident_edges(A.ownership(spark, d), "customer-00007")


@query(f"WITH {A.PAYMENTS_SQL} SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM payments")
def simple_edges_collapse(spark, d):
    return graph.simple_edges(A.payments(spark, d))


@query(f"WITH {A.PAYMENTS_SQL} SELECT DISTINCT source_id, target_id FROM payments")
def directed_transfer_graph(spark, d):
    return graph.directed_edges(A.payments(spark, d))


@query(f"WITH {A.OWNERSHIP_SQL} SELECT * FROM ownership WHERE relationship_type IN ('LOCATED_AT', 'ASSOCIATED_WITH')")
def type_filter_subset(spark, d):
    from skein.functions.scalar import words_in

    return A.ownership(spark, d).where(F.col("relationship_type").isin(words_in("LOCATED_AT, ASSOCIATED_WITH,")))


CASE_SQL = f"""{A.OWNERSHIP_SQL},
region1 AS (SELECT printf('nation-%05d', n_nationkey) AS entity_id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'region-00001'),
members AS (SELECT entity_id FROM region1 UNION SELECT printf('customer-%05d', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
  UNION SELECT printf('supplier-%05d', s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)"""


def _members(spark, d):
    """The region taken as a case, its nations and who is located there."""
    own = A.ownership(spark, d)
    core = graph.case_members(own.where("relationship_type = 'ASSOCIATED_WITH'"), "region-00001")
    near = own.where("relationship_type = 'LOCATED_AT'").join(core.select(F.col("entity_id").alias("_c")), F.col("target_id") == F.col("_c"), "left_semi").select(F.col("source_id").alias("entity_id"))
    return core.unionByName(near).distinct()


@query(f"WITH {CASE_SQL} SELECT o.* FROM ownership o WHERE source_id IN (SELECT entity_id FROM members) AND target_id IN (SELECT entity_id FROM members)")
def induced_subgraph(spark, d):
    return graph.induced(A.ownership(spark, d), _members(spark, d))


@query(f"""WITH {CASE_SQL}, {A.ENTITIES_SQL} SELECT e.entity_id, entity_type, name, (SELECT count(*) FROM ownership) AS graph_edges FROM entities e
WHERE entity_id IN (SELECT entity_id FROM members)""")
def case_network(spark, d):
    total = A.ownership(spark, d).agg(F.count("*").alias("graph_edges"))
    return A.entities(spark, d).join(_members(spark, d), "entity_id", "left_semi").crossJoin(F.broadcast(total))


@query(f"""WITH {CASE_SQL}, inside AS (SELECT o.* FROM ownership o SEMI JOIN members m ON o.source_id = m.entity_id SEMI JOIN members t ON o.target_id = t.entity_id)
SELECT relationship_type, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM inside GROUP BY 1""")
def case_scope_analysis(spark, d):
    inside = graph.induced(A.ownership(spark, d), _members(spark, d))
    return inside.groupBy("relationship_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


@query(f"""WITH {A.OWNERSHIP_SQL}, e AS (SELECT source_id AS u, target_id AS v FROM ownership WHERE relationship_type IN ('LOCATED_AT', 'ASSOCIATED_WITH') UNION SELECT target_id, source_id FROM ownership WHERE relationship_type IN ('LOCATED_AT', 'ASSOCIATED_WITH')),
one AS (SELECT u AS start, v AS node, u || '>' || v AS path FROM e WHERE u LIKE 'supplier-%')
SELECT start, node, 1 AS hops, path FROM one
UNION ALL SELECT start, e.v, 2, path || '>' || e.v FROM one JOIN e ON e.u = one.node WHERE e.v <> start""")
def typed_two_hop(spark, d):
    starts = A.table(spark, d, "supplier").select(A.entity_id("supplier", "s_suppkey").alias("entity_id"))
    walks = graph.typed_walks(A.ownership(spark, d), starts, ["LOCATED_AT", "ASSOCIATED_WITH"], 2)
    return walks.withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {A.BACKBONE_SQL} SELECT u AS entity_id, count(*) AS degree, round(count(*) / 24.0::DOUBLE, 6) AS degree_centrality FROM both_ways GROUP BY 1
UNION ALL SELECT printf('nation-%05d', n_nationkey), 0, 0.0 FROM nation WHERE printf('nation-%05d', n_nationkey) NOT IN (SELECT u FROM both_ways)""")
def degree_centrality(spark, d):
    return centrality.degree_centrality(A.backbone(spark, d), A.nations(spark, d))


@query(f"""WITH {A.OWNERSHIP_SQL}, e AS (SELECT source_id AS u, target_id AS v FROM ownership UNION SELECT target_id, source_id FROM ownership), n AS (SELECT count(DISTINCT u) AS n FROM e)
SELECT u AS entity_id, count(*) AS degree, round(count(*) / ((SELECT n FROM n) - 1)::DOUBLE, 6) AS degree_centrality FROM e GROUP BY 1""")
def degree_centrality_ownership(spark, d):
    own = A.ownership(spark, d)
    return centrality.degree_centrality(own, graph.endpoints(own))


@query(f"""WITH {A.BACKBONE_SQL}, deg AS (SELECT u AS entity_id, count(*) AS degree FROM both_ways GROUP BY 1)
SELECT entity_id, degree, row_number() OVER (ORDER BY degree DESC, entity_id)::INTEGER AS position FROM deg
WHERE degree >= 2 AND degree > (SELECT sum(degree) / 25.0 FROM deg) ORDER BY degree DESC, entity_id LIMIT 5""")
def top_connected(spark, d):
    return centrality.top_connected(A.backbone(spark, d), A.nations(spark, d))


def _root(spark):
    return spark.createDataFrame([("nation-00003",)], "entity_id string")


BFS_SQL = f"""WITH RECURSIVE {A.BACKBONE_SQL}, walk AS (SELECT 'nation-00003' AS entity_id, 0 AS depth UNION SELECT v, depth + 1 FROM walk JOIN both_ways ON u = entity_id WHERE depth < 3),
reached AS (SELECT entity_id, min(depth) AS depth FROM walk GROUP BY 1)"""


@query(f"{BFS_SQL} SELECT entity_id, depth FROM reached")
def bfs_neighborhood(spark, d):
    return traverse.neighbourhood(A.backbone(spark, d), _root(spark), 3)


@query(f"""{BFS_SQL}, adj AS (SELECT source_id AS u, target_id AS v, relationship_id FROM backbone UNION ALL SELECT target_id, source_id, relationship_id FROM backbone)
SELECT relationship_id, u AS source_id, v AS target_id, 'TRANSFERRED_TO' AS relationship_type FROM reached JOIN adj ON u = entity_id WHERE depth < 3""")
def bfs_edges(spark, d):
    rels = A.backbone(spark, d)
    return traverse.neighbourhood_edges(rels, traverse.neighbourhood(rels, _root(spark), 3), 3)


@query(f"""WITH {A.OWNERSHIP_SQL}, e AS (SELECT source_id AS u, target_id AS v FROM ownership UNION SELECT target_id, source_id FROM ownership),
a AS (SELECT DISTINCT v FROM e WHERE u = 'region-00002'), b AS (SELECT DISTINCT e.v FROM e JOIN a ON e.u = a.v WHERE e.v <> 'region-00002' AND e.v NOT IN (SELECT v FROM a))
SELECT 'region-00002' AS entity_id, 0 AS depth UNION ALL SELECT v, 1 FROM a UNION ALL SELECT v, 2 FROM b""")
def bfs_ownership(spark, d):
    return traverse.neighbourhood(A.ownership(spark, d), spark.createDataFrame([("region-00002",)], "entity_id string"), 2)


PATH_SQL = f"""WITH RECURSIVE {A.BACKBONE_SQL}, walk AS (SELECT 'nation-00003' AS entity_id, 0 AS length, ['nation-00003'] AS path
  UNION ALL SELECT v, length + 1, list_append(path, v) FROM walk JOIN both_ways ON u = entity_id WHERE length < 6 AND NOT list_contains(path, v)),
best AS (SELECT entity_id, min(length) AS length FROM walk GROUP BY 1),
paths AS (SELECT w.entity_id, w.length, min(w.path) AS path FROM walk w JOIN best b USING (entity_id, length) GROUP BY 1, 2)"""


@query(f"{PATH_SQL} SELECT entity_id, length, array_to_string(path, '>') AS path FROM paths")
def shortest_path(spark, d):
    return traverse.shortest_paths(A.backbone(spark, d), "nation-00003").withColumn("path", F.array_join("path", ">"))


@query(f"""{PATH_SQL}, hops AS (SELECT entity_id AS target_id, unnest(range(1, length + 1)) AS position, path FROM paths),
steps AS (SELECT target_id, position::INTEGER AS position, path[position] AS from_id, path[position + 1] AS to_id FROM hops),
edge AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, min(relationship_id) AS relationship_id FROM backbone GROUP BY 1, 2)
SELECT s.target_id, s.position, from_id, to_id, 'Location' AS to_type, n_name AS to_name, relationship_id, 'TRANSFERRED_TO' AS relationship_type
FROM steps s JOIN edge ON a = least(from_id, to_id) AND b = greatest(from_id, to_id) JOIN nation ON to_id = printf('nation-%05d', n_nationkey)""")
def path_enriched(spark, d):
    rels = A.backbone(spark, d)
    return traverse.enriched_path(rels, A.nations(spark, d), traverse.shortest_paths(rels, "nation-00003"), ["TRANSFERRED_TO"])


@query(f"""WITH {A.OWNERSHIP_SQL}, {A.ENTITIES_SQL}, e AS (SELECT source_id AS u, target_id AS v FROM ownership UNION SELECT target_id, source_id FROM ownership),
ids AS (SELECT 'region-00002' AS id UNION SELECT v FROM e WHERE u = 'region-00002' UNION SELECT b.v FROM e a JOIN e b ON b.u = a.v WHERE a.u = 'region-00002'),
nodes AS (SELECT entity_id FROM entities WHERE entity_id IN (SELECT id FROM ids) AND entity_type IN ('Location', 'Case', 'Organization') ORDER BY entity_id LIMIT 200)
SELECT * FROM ownership WHERE source_id IN (SELECT entity_id FROM nodes) AND target_id IN (SELECT entity_id FROM nodes) ORDER BY relationship_id LIMIT 400""")
def bounded_subgraph(spark, d):
    root = spark.createDataFrame([("region-00002",)], "entity_id string")
    return traverse.bounded_subgraph(A.ownership(spark, d), A.entities(spark, d), root, 2, kinds=["Location", "Case", "Organization"])[1]


CHAIN_SQL = f"""WITH RECURSIVE {A.BACKBONE_SQL}, walk AS (SELECT [source_id, target_id] AS path, [relationship_id] AS evidence, target_id AS last, 1 AS hops FROM backbone
  UNION ALL SELECT list_append(path, b.target_id), list_append(evidence, b.relationship_id), b.target_id, hops + 1 FROM walk JOIN backbone b ON b.source_id = last WHERE hops < 4 AND NOT list_contains(path, b.target_id)),
chains AS (SELECT hops AS hop_count, path[1] AS source_account, last AS destination_account, array_to_string(path, '>') AS path, array_to_string(evidence, ',') AS evidence FROM walk WHERE hops >= 2)"""


@query(f"{CHAIN_SQL} SELECT * FROM chains")
def transfer_chains(spark, d):
    return traverse.transfer_chains(A.backbone(spark, d))


@query(f"""{CHAIN_SQL} SELECT *, printf('chain-%03d', row_number() OVER (ORDER BY hop_count, source_account, destination_account, path) - 1) AS chain_id
FROM chains ORDER BY hop_count, source_account, destination_account, path LIMIT 20""")
def transfer_chains_top(spark, d):
    return traverse.transfer_chains(A.backbone(spark, d), limit=20)


@query(f"{CHAIN_SQL.replace('hops >= 2', 'hops BETWEEN 1 AND 3')} SELECT * FROM chains WHERE source_account = 'nation-00001' AND destination_account IN (SELECT destination_account FROM chains WHERE source_account = 'nation-00001' ORDER BY 1 LIMIT 1)")
def account_to_account(spark, d):
    rels = A.backbone(spark, d)
    found = traverse.transfer_chains(rels, 1, 3).where("source_account = 'nation-00001'")
    return found.join(F.broadcast(found.agg(F.min("destination_account").alias("destination_account"))), "destination_account")


TIMED_SQL = f"""WITH RECURSIVE {A.ACCOUNTS_SQL}, hops AS (SELECT * FROM accounts WHERE source_id <> target_id AND amount > 0),
walk AS (SELECT [source_id, target_id] AS path, [relationship_id] AS evidence, target_id AS last, ts, amount, 1 AS hops FROM hops
  UNION ALL SELECT list_append(path, h.target_id), list_append(evidence, h.relationship_id), h.target_id, h.ts, h.amount, w.hops + 1 FROM walk w JOIN hops h ON h.source_id = w.last
    AND h.ts > w.ts AND h.ts <= w.ts + 30 AND h.amount <= w.amount AND h.amount >= w.amount * 0.9 AND NOT list_contains(w.path, h.target_id) WHERE w.hops < 4),
chains AS (SELECT hops AS hop_count, path[1] AS source_account, last AS destination_account, array_to_string(path, '>') AS path, array_to_string(evidence, ',') AS evidence FROM walk WHERE hops >= 2)"""


@query(f"{TIMED_SQL} SELECT * FROM chains")
def timed_chains(spark, d):
    return traverse.timed_chains(A.account_payments(spark, d, settle(A.paid(spark, d))))


@query(f"""{TIMED_SQL} SELECT *, printf('chain-%03d', row_number() OVER (ORDER BY hop_count, source_account, destination_account, path, evidence) - 1) AS chain_id
FROM chains ORDER BY hop_count, source_account, destination_account, path, evidence LIMIT 20""")
def timed_chains_top(spark, d):
    return traverse.timed_chains(A.account_payments(spark, d, settle(A.paid(spark, d))), limit=20)


def _labels_sql(rounds: int, start: str) -> str:
    out = [start]
    for i in range(1, rounds + 1):
        out.append(f"l{i} AS (SELECT a.id, least(a.c, coalesce(min(b.c), a.c)) AS c FROM l{i - 1} a LEFT JOIN e ON e.u = a.id LEFT JOIN l{i - 1} b ON b.id = e.v GROUP BY a.id, a.c)")
    return ", ".join(out)


@query(f"""WITH {A.BACKBONE_SQL}, e AS (SELECT * FROM both_ways), {_labels_sql(9, "l0 AS (SELECT id, id AS c FROM nodes)")}
SELECT c AS component, count(*) AS size, array_to_string((array_agg(id ORDER BY id))[1:5], ',') AS members FROM l9 GROUP BY 1""")
def connected_components(spark, d):
    return graph.component_sizes(graph.components(graph.neighbours(A.backbone(spark, d))))


@query(f"""WITH {A.OWNERSHIP_SQL}, e AS (SELECT source_id AS u, target_id AS v FROM ownership UNION SELECT target_id, source_id FROM ownership),
{_labels_sql(8, "l0 AS (SELECT DISTINCT u AS id, u AS c FROM e)")} SELECT c AS component, count(*) AS size FROM l8 GROUP BY 1""")
def components_ownership(spark, d):
    return graph.components(graph.neighbours(A.ownership(spark, d))).groupBy("component").agg(F.count("*").alias("size"))


DIST_SQL = f"""WITH RECURSIVE {A.BACKBONE_SQL}, walk AS (SELECT id AS src, id AS node, 0 AS dist FROM nodes UNION SELECT src, v, dist + 1 FROM walk JOIN both_ways ON u = node WHERE dist < 12),
dist AS (SELECT src, node, min(dist) AS dist FROM walk GROUP BY 1, 2)"""


@query(f"{DIST_SQL} SELECT src, node, dist FROM dist")
def all_pairs_distance(spark, d):
    return centrality.hops(A.backbone(spark, d))


@query(f"""{DIST_SQL}, per AS (SELECT src AS entity_id, count(*) - 1 AS r, sum(dist)::DOUBLE AS t FROM dist GROUP BY 1)
SELECT entity_id, round(CASE WHEN t > 0 THEN (r / t) * (r / ((SELECT count(*) FROM nodes) - 1)::DOUBLE) ELSE 0e0 END, 6) AS closeness FROM per""")
def closeness(spark, d):
    dist = settle(centrality.hops(A.backbone(spark, d)))
    return centrality.closeness(dist, dist.select("src").distinct().count())


SIGMA_SQL = f"""{DIST_SQL}, s0 AS (SELECT src, node, 1::BIGINT AS sigma FROM dist WHERE dist = 0)""" + "".join(
    f", s{i} AS (SELECT d.src, d.node, sum(p.sigma)::BIGINT AS sigma FROM dist d JOIN both_ways b ON b.v = d.node JOIN s{i - 1} p ON p.src = d.src AND p.node = b.u WHERE d.dist = {i} GROUP BY 1, 2)" for i in range(1, 13)
) + ", sig AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(13)) + "), ds AS (SELECT src, node, dist, sigma FROM dist JOIN sig USING (src, node))"


@query(f"""{SIGMA_SQL}, dep AS (SELECT a.node AS id, sum(a.sigma * b.sigma / c.sigma::DOUBLE) AS s FROM ds a JOIN ds b ON b.src = a.node JOIN ds c ON c.src = a.src AND c.node = b.node
  WHERE a.dist > 0 AND b.dist > 0 AND a.dist + b.dist = c.dist GROUP BY 1)
SELECT n.id AS entity_id, round(coalesce(s, 0) / (((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2)), 6) AS betweenness FROM nodes n LEFT JOIN dep ON dep.id = n.id""")
def betweenness(spark, d):
    rels = A.backbone(spark, d)
    dist = centrality.distances(rels)
    return centrality.betweenness(rels, dist, dist.select("src").distinct().count())


def _pagerank_sql(rounds: int) -> str:
    out = ["deg AS (SELECT u, count(*) AS k FROM both_ways GROUP BY 1)", "alln AS (SELECT printf('nation-%05d', n_nationkey) AS id FROM nation)", "r0 AS (SELECT id, 1e0 / 25 AS r FROM alln)"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS (SELECT a.id, 0.15e0 / 25 + 0.85e0 * coalesce((SELECT sum(r) FROM r{i - 1} WHERE id NOT IN (SELECT u FROM deg)), 0) / 25 + 0.85e0 * coalesce(sum(p.r / d.k), 0) AS r FROM alln a LEFT JOIN both_ways b ON b.v = a.id LEFT JOIN r{i - 1} p ON p.id = b.u LEFT JOIN deg d ON d.u = b.u GROUP BY a.id)")
    return ", ".join(out)


@query(f"WITH {A.BACKBONE_SQL}, {_pagerank_sql(10)} SELECT id AS entity_id, round(r, 6) AS pagerank FROM r10")
def pagerank_fixed_iters(spark, d):
    return centrality.pagerank(A.backbone(spark, d), A.nations(spark, d), rounds=10, tolerance=None)


@query()
def pagerank(spark, d):
    own = A.ownership(spark, d)
    return centrality.pagerank(own, graph.endpoints(own))


@query(f"""WITH RECURSIVE {A.BACKBONE_SQL}, walk AS (
  SELECT n.id AS gone, m.id AS start, m.id AS node FROM nodes n, nodes m WHERE n.id <> m.id
  UNION SELECT gone, start, v FROM walk JOIN both_ways ON u = node WHERE v <> gone),
parts AS (SELECT gone, count(DISTINCT low) AS k FROM (SELECT gone, start, min(node) AS low FROM walk GROUP BY 1, 2) GROUP BY 1),
whole0 AS (SELECT id AS start, id AS node FROM nodes UNION SELECT start, v FROM whole0 JOIN both_ways ON u = node),
whole AS (SELECT count(DISTINCT low) AS k FROM (SELECT start, min(node) AS low FROM whole0 GROUP BY 1))
SELECT gone AS entity_id FROM parts WHERE k > (SELECT k FROM whole)""")
def articulation_points(spark, d):
    return community.articulation_points(A.backbone(spark, d))


# This graph is a forest, where every inner node is an articulation point.
@query(f"""WITH {A.OWNERSHIP_SQL}, e AS (SELECT DISTINCT source_id AS u, target_id AS v FROM ownership)
SELECT id AS entity_id FROM (SELECT u AS id FROM e UNION ALL SELECT v FROM e) GROUP BY 1 HAVING count(*) >= 2""")
def articulation_points_ownership(spark, d):
    return community.articulation_points(A.ownership(spark, d))


def _lpa_sql(rounds: int) -> str:
    out = ["votes AS (SELECT u, v, count(*) AS w FROM (SELECT source_id AS u, target_id AS v FROM backbone UNION ALL SELECT target_id, source_id FROM backbone) GROUP BY 1, 2)", "p0 AS (SELECT printf('nation-%05d', n_nationkey) AS node, printf('nation-%05d', n_nationkey) AS label FROM nation)"]
    for i in range(1, rounds + 1):
        out.append(f"c{i} AS (SELECT u, label, sum(w) AS w FROM votes JOIN p{i - 1} ON node = v GROUP BY 1, 2), b{i} AS (SELECT u, label FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, label) AS k FROM c{i}) WHERE k = 1), p{i} AS (SELECT p.node, coalesce(b.label, p.label) AS label FROM p{i - 1} p LEFT JOIN b{i} b ON b.u = p.node)")
    return ", ".join(out)


@query(f"WITH {A.BACKBONE_SQL}, {_lpa_sql(6)} SELECT node, label FROM p6")
def label_propagation(spark, d):
    return community.label_propagation(A.backbone(spark, d), A.nations(spark, d), rounds=6)


@dataclass
class Scored:
    """Frequent payments with their analytics, each settled once."""

    rels: DataFrame
    between: DataFrame
    cuts: DataFrame
    labels: DataFrame
    bridges: DataFrame


def scored(spark, d, rows: DataFrame | None = None) -> Scored:
    rels = settle(A.frequent_payments(spark, d, rows))
    between, cuts, labels = together(
        lambda: settle(centrality.every_betweenness(rels)), lambda: settle(community.articulation_points(rels)), lambda: community.modularity_communities(rels)
    )
    return Scored(rels, between, cuts, labels, settle(community.bridge_candidates(rels, cuts, between, labels)))


@query()
def modularity_communities(spark, d):
    rels = settle(A.frequent_payments(spark, d))
    return community.community_table(rels, community.modularity_communities(rels))


@query()
def label_propagation_turns(spark, d):
    rels = settle(A.frequent_payments(spark, d))
    return community.label_propagation_in_turns(rels, graph.endpoints(rels))


@query()
def betweenness_sampled(spark, d):
    return centrality.sampled_betweenness(settle(A.frequent_payments(spark, d)))


@query()
def closeness_sampled(spark, d):
    return centrality.sampled_closeness(settle(A.frequent_payments(spark, d)))


@query(f"WITH {A.FREQUENT_SQL} SELECT relationship_id, source_id, target_id, relationship_type, ts::TIMESTAMP AS ts, confidence FROM frequent")
def frequent_payments(spark, d):
    return A.frequent_payments(spark, d)


@query()
def bridge_candidates(spark, d):
    return scored(spark, d).bridges


# The queries above that have SQL run on the backbone; these run the same operators on every edge.
@query()
def transfer_chains_whole(spark, d):
    return traverse.transfer_chains(settle(A.trade_edges(spark, d)))


@query()
def all_pairs_distance_whole(spark, d):
    """Every pair of nodes that reach each other, so as many rows as the square of the nodes."""
    return centrality.every_distance(settle(A.numbered_network(spark, d)), A.name_of)


@query()
def closeness_whole(spark, d):
    """Of every node by its distances to all others."""
    return centrality.every_closeness(settle(A.numbered_network(spark, d))).withColumn("entity_id", A.name_of("entity_id"))


@query()
def betweenness_whole(spark, d):
    sources = A.table(spark, d, "nation").select(A.number("nation", "n_nationkey").alias("entity_id"))
    return centrality.betweenness_from(A.numbered_network(spark, d), sources).withColumn("entity_id", A.name_of("entity_id"))


@query()
def bfs_neighborhood_whole(spark, d):
    return traverse.neighbourhood(graph.links(A.network(spark, d)), _root(spark), 3)


@query()
def shortest_path_whole(spark, d):
    return traverse.shortest_paths(graph.links(A.network(spark, d)), "nation-00003").withColumn("path", F.array_join("path", ">"))


@query()
def path_enriched_whole(spark, d):
    rels = settle(A.network(spark, d))
    return traverse.enriched_path(rels, A.entities(spark, d), traverse.shortest_paths(rels, "nation-00003"), ["TRANSFERRED_TO"])


@query()
def connected_components_whole(spark, d):
    return graph.component_sizes(graph.components(graph.simple_edges(A.network(spark, d)).select(F.col("a").alias("u"), F.col("b").alias("v"))))


def _dealt(spark, d):
    """Every edge of payments and ownership, dealt to parts by customer."""
    return dealt.deal(*A.numbered_edges(spark, d), size=A.table(spark, d, "lineitem").count())


@query()
def pagerank_fixed_iters_whole(spark, d):
    return dealt.pagerank(_dealt(spark, d), A.numbered_entities(spark, d), rounds=10).withColumn("entity_id", A.name_of("entity_id"))


@query()
def articulation_points_whole(spark, d):
    return community.articulation_points(A.numbered_network(spark, d)).select(A.name_of("entity_id").alias("entity_id"))


@query()
def label_propagation_whole(spark, d):
    found = dealt.label_propagation(_dealt(spark, d), A.numbered_entities(spark, d), rounds=6, order=A.order_of)
    return found.select(A.name_of("node").alias("node"), A.name_in_order("label").alias("label"))


@query(f"""WITH {A.OWNERSHIP_SQL}, adj AS (SELECT source_id AS node FROM ownership UNION ALL SELECT target_id FROM ownership), deg AS (SELECT node, count(*) AS degree FROM adj GROUP BY 1)
SELECT node AS entity_id, degree FROM deg ORDER BY degree DESC, node LIMIT 10""")
def hub_preview(spark, d):
    return graph.adjacency(A.ownership(spark, d)).groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "entity_id").limit(10)


@query()
def full_analysis(spark, d):
    """Counts, degrees and density, components and communities of frequent payments as one row."""
    rels = settle(A.frequent_payments(spark, d))
    labels = graph.components(graph.neighbours(rels)).agg(F.countDistinct("component").alias("n_components"))
    groups = community.modularity_communities(rels).agg(F.countDistinct("community").alias("n_communities"))
    return graph.degree_statistics(rels).crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(groups))

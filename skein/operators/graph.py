"""Adjacency, simple and directed graphs, statistics, induced and case-scoped subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.base import settle


def adjacency(rels: DataFrame) -> DataFrame:
    """(node, nbr, relationship_type, relationship_id) in both directions; parallel edges stay."""
    ahead = rels.select(F.col("source_id").alias("node"), F.col("target_id").alias("nbr"), "relationship_type", "relationship_id")
    back = rels.select(F.col("target_id").alias("node"), F.col("source_id").alias("nbr"), "relationship_type", "relationship_id")
    return ahead.unionByName(back)


def simple_edges(rels: DataFrame) -> DataFrame:
    """(a, b) with a < b: undirected, parallel edges and self-loops gone."""
    return rels.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()


def directed_edges(rels: DataFrame, kind: str = "TRANSFERRED_TO") -> DataFrame:
    return rels.where(F.col("relationship_type") == kind).select("source_id", "target_id").distinct()


def neighbours(rels: DataFrame) -> DataFrame:
    """(u, v) of the simple graph, both ways."""
    a, b = F.col("a"), F.col("b")
    return simple_edges(rels).select(F.inline(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v")))))


def links(rels: DataFrame) -> DataFrame:
    """(source_id, target_id) of the simple graph, settled: enough for what reads neither ids, types nor numbers of edges."""
    return settle(simple_edges(rels).select(F.col("a").alias("source_id"), F.col("b").alias("target_id")))


def incident_edges(rels: DataFrame, entity: str) -> DataFrame:
    return rels.where((F.col("source_id") == entity) | (F.col("target_id") == entity))


def endpoints(rels: DataFrame) -> DataFrame:
    return rels.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct()


def counts_by_type(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """(part, kind, n): entities by type and relationships by type."""
    e = ents.groupBy(F.col("entity_type").alias("kind")).count().select(F.lit("entity").alias("part"), "kind", F.col("count").alias("n"))
    r = rels.groupBy(F.col("relationship_type").alias("kind")).count().select(F.lit("relationship").alias("part"), "kind", F.col("count").alias("n"))
    return e.unionByName(r)


def degree_statistics(rels: DataFrame) -> DataFrame:
    """One row: nodes, edges, lowest, highest and mean number of incident edges, density of the multigraph."""
    per = adjacency(rels).groupBy("node").count()
    nodes = per.agg(F.count("*").alias("n_nodes"), F.min("count").alias("min_degree"), F.max("count").alias("max_degree"), F.sum("count").alias("ends"))
    m = F.col("ends") / 2
    return nodes.select("n_nodes", m.cast("long").alias("n_edges"), "min_degree", "max_degree", F.round(F.col("ends") / F.col("n_nodes"), 4).alias("avg_degree"), F.round(F.col("ends") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 6).alias("density"))


def induced(rels: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Edges with both ends among ids: two left-semi joins."""
    s, t = ids.select(F.col(key).alias("_s")), ids.select(F.col(key).alias("_t"))
    return rels.join(s, F.col("source_id") == F.col("_s"), "left_semi").join(t, F.col("target_id") == F.col("_t"), "left_semi")


def case_members(links: DataFrame, case: str) -> DataFrame:
    """Ids that a case touches through its membership links, the case among them."""
    touching = incident_edges(links, case)
    return endpoints(touching)


#: Walks that stand at one node, and neighbours of it, that meet in one bucket; longer walks that one task makes.
BUCKET, WALKS_A_TASK = 2048, 4_000_000


def _extended(walk: DataFrame, adj: DataFrame) -> DataFrame:
    """Each walk with each neighbour (nbr) of the node where it stands.

    A hub's walks and neighbours are dealt to buckets, each of some BUCKET of both, and buckets to as many tasks as
    the number of longer walks asks for: a task holds some BUCKET neighbours at once, makes some WALKS_A_TASK rows
    and writes them walk by walk, so that rows of like paths stand near each other.
    """
    stand, near = walk.groupBy("node").agg(F.count("*").alias("_w")), adj.groupBy("node").agg(F.count("*").alias("_n"))
    hubs = settle(stand.join(near, "node"))
    tasks = 1 + (hubs.agg(F.sum(F.col("_w") * F.col("_n"))).first()[0] or 0) // WALKS_A_TASK
    deal = lambda col, n: F.pmod(F.xxhash64(col), 1 + F.expr(f"{n} div {BUCKET}"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{n} div {BUCKET}")))
    key = ["node", "_i", "_j"]
    w = walk.join(hubs, "node").select("node", "start", "path", deal("path", "_w").alias("_i"), each("_n").alias("_j"))
    n = adj.join(hubs, "node").select("node", "nbr", each("_w").alias("_i"), deal("nbr", "_n").alias("_j"))
    return w.repartition(tasks, *key).join(n.repartition(tasks, *key), key)


def typed_walks(rels: DataFrame, start: DataFrame, kinds: list[str], hops: int, key: str = "entity_id") -> DataFrame:
    """(start, node, hops, path): simple walks of 1..hops over edges of the given types, either way."""
    adj = settle(adjacency(rels.where(F.col("relationship_type").isin(kinds))).select("node", "nbr").distinct())
    walk = start.select(F.col(key).alias("start"), F.col(key).alias("node"), F.lit(0).alias("hops"), F.array(key).alias("path"))
    out = None
    for n in range(1, hops + 1):
        longer = _extended(walk, adj).where(~F.array_contains("path", F.col("nbr"))).select("start", F.col("nbr").alias("node"), F.lit(n).alias("hops"), F.concat("path", F.array("nbr")).alias("path"))
        walk = settle(longer) if n < hops else longer
        out = walk if out is None else out.unionByName(walk)
    return out


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for links (u, v) in either order; component is its smallest node.

    Each round takes the smallest label among neighbours and then that label's own label;
    labels are checkpointed, and rounds end when their aggregate no longer changes.
    """
    both = settle(pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component")))
    before = None
    for _ in range(rounds):
        seen = both.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("_n")).agg(F.min("component").alias("_m"))
        lower = labels.join(seen, F.col("node") == F.col("_n")).select("node", F.least("component", "_m").alias("component"))
        own = lower.select(F.col("node").alias("_k"), F.col("component").alias("_up"))
        labels = settle(lower.join(own, F.col("component") == F.col("_k")).select("node", F.least("component", "_up").alias("component")))
        now = tuple(labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first())
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def sizes_and_firsts(labels: DataFrame, group: str, sample: int = 5) -> DataFrame:
    """(group, size, members): members are the first ids, comma-joined. The rank filter is pushed below the
    shuffle, so a giant group sends a few ids from each task and is not sorted in one."""
    firsts = labels.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("node"))).where(F.col("_k") <= sample)
    named = firsts.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"))
    return labels.groupBy(group).agg(F.count("*").alias("size")).join(named, group)


def component_sizes(labels: DataFrame, sample: int = 5) -> DataFrame:
    """Components by their smallest member: size and the first members."""
    return sizes_and_firsts(labels, "component", sample)

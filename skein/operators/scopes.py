"""Analytics of many scopes in one pass: the whole graph, cases, and neighbourhoods of roots.

The edges of all scopes become one graph of separate parts: an end's id is its scope, a
slash and its id. Operators whose results stay within a component then serve all scopes at
once; only counts that belong to a whole graph are taken by scope. An edge is copied once for
each scope that holds it, so the work is that of all scopes together, whatever their sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import short_hash
from skein.operators import centrality, community, graph, temporal, traverse
from skein.operators.base import settle, together
from skein.operators.derived import neutral
from skein.operators.strength import relationship_strength

#: Nodes and edges of a root's neighbourhood.
MAX_NODES, MAX_EDGES = 200, 400
KINDS = ("bridge", "burst", "chain", "strength")


def scope_of(c: str) -> Column:
    return F.substring_index(F.col(c), "/", 1)


def bare(c: str) -> Column:
    """The id after its scope; scopes hold no slash, ids may."""
    return F.expr(f"substr(`{c}`, instr(`{c}`, '/') + 1)")


def first_of(df: DataFrame, k: int, *order: str | Column, by: str = "scope") -> DataFrame:
    """The first k rows of each scope; Spark drops the others before the shuffle, so a scope that holds most rows gathers k rows a task."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def neighbourhoods(rels: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(scope, entity_id) of each root (scope, entity_id): the nodes within depth of it, the MAX_NODES smallest ids of them. Roots without an edge have themselves alone."""
    adj = settle(graph.neighbours(rels))
    near = front = settle(roots.select("scope", "entity_id").distinct())
    for _ in range(depth):
        nxt = front.select("scope", F.col("entity_id").alias("_at")).join(adj, F.col("_at") == F.col("u")).select("scope", F.col("v").alias("entity_id")).distinct()
        front = settle(nxt.join(near, ["scope", "entity_id"], "left_anti"))
        near = near.unionByName(front)
    return settle(first_of(near, MAX_NODES, "entity_id"))


def scoped_edges(rels: DataFrame, members: DataFrame, bounded: Column | None = None) -> DataFrame:
    """rels of each scope of members (scope, entity_id), both ends inside and named by the scope.

    Of scopes for which `bounded` (over the column scope) holds, only the MAX_EDGES smallest
    edge ids stay. The scope `global` needs no members and takes every edge.
    """
    s, t = (members.select(F.col("scope").alias(f"_{n}"), F.col("entity_id").alias(n)).distinct() for n in ("source_id", "target_id"))
    inside = rels.join(s, "source_id").join(t, "target_id").where("_source_id = _target_id").withColumnRenamed("_source_id", "scope").drop("_target_id")
    if bounded is not None:
        inside = inside.where(~bounded).unionByName(first_of(inside.where(bounded), MAX_EDGES, "relationship_id"))
    all_ = rels.withColumn("scope", F.lit("global")).unionByName(inside)
    return all_.withColumns({c: F.concat("scope", F.lit("/"), c) for c in ("source_id", "target_id")})


def bursts(edges: DataFrame, hours: int = 24, z: float = 2.0) -> DataFrame:
    """temporal.bursts of each scope, windows from that scope's first time; entity is bare, a type's windows are of type:name."""
    kinds = F.when(F.col("relationship_type").isin("CALLED", "TRANSFERRED_TO"), F.concat("scope", F.lit("/type:"), "relationship_type"))
    times = edges.where("ts IS NOT NULL").select("scope", F.explode(F.array_compact(F.array("source_id", "target_id", kinds))).alias("entity"), temporal.micros("ts").alias("us"))
    first = edges.where("ts IS NOT NULL").groupBy("scope").agg(F.min(temporal.micros("ts")).alias("_first"))
    found = temporal.over_threshold(times.join(first, "scope"), hours, z)
    return found.withColumns({"scope": scope_of("entity"), "entity": bare("entity")})


def betweenness(edges: DataFrame, k: int = 64) -> DataFrame:
    """(scope, entity_id, betweenness), ids named by their scope: from k pivots of each scope, exact where a scope has no more nodes."""
    nodes = settle(graph.endpoints(edges).withColumn("scope", scope_of("entity_id")))
    some = settle(first_of(nodes, k, F.xxhash64("entity_id"), "entity_id"))
    sizes = nodes.groupBy("scope").agg(F.count("*").alias("n")).join(some.groupBy("scope").agg(F.count("*").alias("k")), "scope")
    sums = centrality.dependencies(edges, centrality.distances(edges, some))
    held = nodes.join(sums, F.col("entity_id") == F.col("node"), "left").join(some.select("entity_id", F.lit(1).alias("_own")), "entity_id", "left").join(sizes, "scope")
    others = (F.col("k") - F.coalesce("_own", F.lit(0))) * (F.col("n") - 2)
    share = F.when(others > 0, F.coalesce("sum", F.lit(0.0)) / others).otherwise(0.0)
    return held.select("scope", "entity_id", F.round(share, 6).alias("betweenness"))


@dataclass
class Analyses:
    """Six analytics of all scopes, each with a column scope and bare ids."""

    central: DataFrame
    communities: DataFrame
    bridges: DataFrame
    bursts: DataFrame
    chains: DataFrame
    strengths: DataFrame


def chains(edges: DataFrame) -> DataFrame:
    """traverse.timed_chains of each scope; edges need an amount."""
    found = traverse.timed_chains(edges)
    nodes = F.transform(F.split("path", ">"), lambda x: F.substr(x, F.position(F.lit("/"), x) + 1))
    return found.withColumns({"scope": scope_of("source_account"), "path": F.array_join(nodes, ">"), "source_account": bare("source_account"), "destination_account": bare("destination_account")})


def strengths(edges: DataFrame) -> DataFrame:
    tied = relationship_strength(edges)
    return tied.withColumns({"scope": scope_of("source_id"), "source_id": bare("source_id"), "target_id": bare("target_id")})


def analyses(edges: DataFrame) -> Analyses:
    """The analytics of scoped edges (see scoped_edges); the independent ones run side by side."""
    between, cuts, labels, found, paths = together(
        lambda: settle(betweenness(edges)), lambda: settle(community.articulation_points(edges)), lambda: community.modularity_communities(edges, moves=0, part=scope_of),
        lambda: settle(bursts(edges)), lambda: settle(chains(edges)),
    )
    degrees = graph.neighbours(edges).groupBy(F.col("u").alias("entity_id")).agg(F.count("*").alias("degree"))
    sizes = between.groupBy("scope").agg(F.count("*").alias("_n"))
    central = between.join(degrees, "entity_id", "left").join(sizes, "scope")
    share = F.when(F.col("_n") > 1, F.round(F.coalesce("degree", F.lit(0)) / (F.col("_n") - 1), 6)).otherwise(0.0)
    central = central.select("scope", bare("entity_id").alias("entity_id"), F.coalesce("degree", F.lit(0)).alias("degree"), share.alias("degree_centrality"), "betweenness")
    groups = labels.groupBy(scope_of("community").alias("scope"), bare("community").alias("community")).agg(F.count("*").alias("size"))
    near = community.bridge_rows(edges, cuts, between.select("entity_id", "betweenness"), labels)
    near = near.withColumn("scope", scope_of("entity_id")).withColumn("entity_id", bare("entity_id"))
    return Analyses(settle(central), settle(groups), settle(first_of(near, 10, F.desc("score"), "entity_id")), found, paths, strengths(edges))


def _shaped(df: DataFrame, kind: str, ids: Column, edges: Column, score: Column, text: Column) -> DataFrame:
    return df.select("scope", F.lit(kind).alias("finding_type"), ids.alias("entity_ids"), edges.alias("relationship_ids"), score.cast("double").alias("score"), text.alias("description"))


def observed_findings(burst: DataFrame, chain: DataFrame, tied: DataFrame) -> DataFrame:
    """Of each scope two bursts, two chains and the strongest relationship of 0.6 or more."""
    b = first_of(burst, 2, F.desc("observed"), "win", "entity")
    c = first_of(chain, 2, "hop_count", "source_account", "destination_account", "path", "evidence")
    s = first_of(tied.where("interaction_strength >= 0.6"), 1, F.desc("interaction_strength"), "relationship_id")
    return (
        _shaped(b, "burst", F.col("entity"), F.lit(""), F.lit(0.5), F.format_string("%s has %d interactions in one window", "entity", "observed"))
        .unionByName(_shaped(c, "chain", F.replace(F.col("path"), F.lit(">"), F.lit(",")), F.col("evidence"), F.round(F.col("hop_count") / 4, 4), F.concat(F.lit("transfers along "), "path")))
        .unionByName(_shaped(s, "strength", F.concat_ws(",", "source_id", "target_id"), F.col("relationship_id"), F.col("interaction_strength"), F.concat(F.lit("frequent relationship "), "relationship_id")))
    )


def bridge_findings(bridges: DataFrame) -> DataFrame:
    b = first_of(bridges, 2, F.desc("score"), "entity_id")
    return _shaped(b, "bridge", F.col("entity_id"), F.col("evidence"), F.col("score"), F.concat("entity_id", F.lit(" connects groups by "), "metric"))


def numbered(found: DataFrame, names: DataFrame) -> DataFrame:
    """found with finding_id, one row a scope and id, at most 20 a scope.

    names (scope, rank, case_id): an id is made of the sorted entities, the kind and the
    case, so that a root's finding has the id of the same finding in the whole graph.
    """
    ordered = F.array_join(F.array_sort(F.split("entity_ids", ",")), "|")
    rows = found.join(names, "scope").withColumn("finding_id", F.concat(F.lit("finding-"), short_hash(ordered, F.col("finding_type"), F.coalesce("case_id", F.lit("global")))))
    one = rows.groupBy("scope", "finding_id").agg(*[F.min_by(c, F.struct("finding_type", "relationship_ids", "description")).alias(c) for c in ("rank", "finding_type", "entity_ids", "relationship_ids", "score", "description")])
    return neutral(first_of(one, 20, "finding_id"), "description")


def explained(found: DataFrame, asked: DataFrame) -> DataFrame:
    """A record for each asked id: the finding in the first scope that has it, whole graph before cases before roots, or that none has."""
    first = found.groupBy("finding_id").agg(F.min(F.struct("rank", "scope", "finding_type", "entity_ids", "relationship_ids", "score", "description")).alias("f"))
    j = asked.select(F.col("id")).distinct().join(first, F.col("id") == F.col("finding_id"), "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return j.select(
        F.concat(F.lit("expl-finding-"), "id", F.lit("-"), short_hash(F.col("id"))).alias("explanation_id"), "id", text("f.scope").alias("scope"),
        F.coalesce(F.concat(F.lit("Finding "), "f.finding_type", F.lit(": "), "f.description"), F.concat(F.lit("finding "), "id", F.lit(" not found"))).alias("summary"),
        text("f.entity_ids").alias("contributing_entities"), text("f.relationship_ids").alias("contributing_relationships"), F.col("f.score").alias("score"),
    )

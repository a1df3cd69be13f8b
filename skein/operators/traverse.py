"""Bounded traversal: neighbourhoods, shortest paths, subgraphs, transfer chains."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.base import ranked, settle
from skein.operators.graph import adjacency, directed_edges, induced, neighbours

MAX_DEPTH = 6


def neighbourhood(rels: DataFrame, roots: DataFrame, depth: int, key: str = "entity_id") -> DataFrame:
    """(entity_id, depth): nodes within `depth` steps of any root with their first-reach depth.

    Only the frontier is joined to the adjacency in each round, and nodes already reached
    are removed by an anti join, so a round's cost follows the frontier.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be in 0..{MAX_DEPTH}")
    adj = neighbours(rels).select(F.col("u").alias("node"), F.col("v").alias("nbr"))
    reached = frontier = roots.select(F.col(key).alias("entity_id"), F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        nxt = frontier.select(F.col("entity_id").alias("_f")).join(adj, F.col("_f") == F.col("node")).select(F.col("nbr").alias("entity_id")).distinct()
        frontier = settle(nxt.join(reached.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(d).alias("depth")))
        reached = reached.unionByName(frontier)
    return reached


def neighbourhood_edges(rels: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Edges as met from each node short of the last depth, pointing outward from it; an edge between two such nodes shows twice."""
    return reached.where(F.col("depth") < depth).join(adjacency(rels), F.col("entity_id") == F.col("node")).select("relationship_id", F.col("node").alias("source_id"), F.col("nbr").alias("target_id"), "relationship_type")


def shortest_paths(rels: DataFrame, root: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(entity_id, length, path): for every node within `depth` of root, its lexicographically smallest shortest path.

    A root that no edge touches is unknown and has no path, not even to itself. The paths of
    a length are ranked, so that a round compares numbers; each node's path is written once.
    """
    adj = settle(neighbours(rels))
    last = settle(adj.where(F.col("u") == root).limit(1).select(F.lit(root).alias("entity_id"), F.lit(0).alias("length"), F.array(F.lit(root)).alias("path"), F.lit(0).cast("long").alias("rank")))
    paths = last
    for d in range(1, depth + 1):
        met = last.select(F.col("entity_id").alias("u"), "rank").join(adj, "u").groupBy(F.col("v").alias("entity_id")).agg(F.min("rank").alias("_from"))
        new = ranked(met.join(paths.select("entity_id"), "entity_id", "left_anti"), "_from", "entity_id")
        before = last.select(F.col("rank").alias("_from"), F.col("path").alias("_p"))
        last = settle(new.join(before, "_from").select("entity_id", F.lit(d).alias("length"), F.concat("_p", F.array("entity_id")).alias("path"), "rank"))
        if not last.limit(1).count():
            break
        paths = paths.unionByName(last)
    return paths.drop("rank")


def enriched_path(rels: DataFrame, ents: DataFrame, path: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """Hops of (entity_id, path): from, to, names and types (Unknown without a record), and for each hop the edge of
    a preferred type and smallest id."""
    steps = F.transform(F.slice("path", 2, F.size("path")), lambda to, i: F.struct((i + 1).alias("position"), F.get("path", i).alias("from_id"), to.alias("to_id")))
    hops = path.select("entity_id", F.inline(steps))
    wanted = F.col("relationship_type").isin(preferred) if preferred else F.lit(True)
    edges = rels.select(F.least("source_id", "target_id").alias("_a"), F.greatest("source_id", "target_id").alias("_b"), "relationship_id", "relationship_type", wanted.alias("_wanted"))
    best = edges.groupBy("_a", "_b").agg(F.min(F.struct((~F.col("_wanted")).alias("w"), "relationship_id", "relationship_type")).alias("_e"))
    joined = hops.join(best, (F.least("from_id", "to_id") == F.col("_a")) & (F.greatest("from_id", "to_id") == F.col("_b")), "left")
    names = ents.select(F.col("entity_id").alias("_id"), F.col("entity_type"), F.col("name"))
    return joined.join(names, F.col("to_id") == F.col("_id"), "left").select(
        F.col("entity_id").alias("target_id"), "position", "from_id", "to_id", F.coalesce("entity_type", F.lit("Unknown")).alias("to_type"), F.coalesce("name", F.col("to_id")).alias("to_name"), F.col("_e.relationship_id").alias("relationship_id"), F.col("_e.relationship_type").alias("relationship_type")
    )


def bounded_subgraph(rels: DataFrame, ents: DataFrame, root: DataFrame, depth: int, max_nodes: int = 200, max_edges: int = 400, kinds: list[str] | None = None, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around the root: cut to a case's members and entity types, ordered by id, truncated to the bounds, edges closed over the nodes."""
    reached = neighbourhood(rels, root, depth)
    nodes = reached.join(ents, "entity_id")
    nodes = nodes.join(members, "entity_id", "left_semi") if members is not None else nodes
    nodes = nodes.where(F.col("entity_type").isin(kinds)) if kinds else nodes
    nodes = settle(nodes.orderBy("entity_id").limit(max_nodes))
    return nodes, induced(rels, nodes).orderBy("relationship_id").limit(max_edges)


def transfer_chains(rels: DataFrame, min_hops: int = 2, max_hops: int = 4, limit: int | None = None) -> DataFrame:
    """Simple directed paths of min_hops..max_hops transfers with the smallest edge id of each hop.

    Chains are numbered by (hops, source, destination, path) only under a limit, a top-k.
    """
    hop = rels.where("relationship_type = 'TRANSFERRED_TO' AND source_id <> target_id").groupBy("source_id", "target_id").agg(F.min("relationship_id").alias("edge"))
    walk = hop.select(F.array("source_id", "target_id").alias("path"), F.array("edge").alias("evidence"), F.col("target_id").alias("_end"))
    out = walk if min_hops <= 1 else None
    for n in range(2, max_hops + 1):
        nxt = walk.join(hop, F.col("_end") == F.col("source_id")).where(~F.array_contains("path", F.col("target_id")))
        walk = nxt.select(F.concat("path", F.array("target_id")).alias("path"), F.concat("evidence", F.array("edge")).alias("evidence"), F.col("target_id").alias("_end"))
        if n >= min_hops:
            out = walk if out is None else out.unionByName(walk)
    found = out.select((F.size("path") - 1).alias("hop_count"), F.col("path")[0].alias("source_account"), F.col("_end").alias("destination_account"), F.array_join("path", ">").alias("path"), F.array_join("evidence", ",").alias("evidence"))
    if limit is None:
        return found
    top = found.orderBy("hop_count", "source_account", "destination_account", "path").limit(limit)
    w = Window.orderBy("hop_count", "source_account", "destination_account", "path")
    return top.withColumn("chain_id", F.format_string("chain-%03d", F.row_number().over(w) - 1))


def timed_chains(pay: DataFrame, days: int = 30, keep: float = 0.9, min_hops: int = 2, max_hops: int = 4, limit: int | None = None) -> DataFrame:
    """Simple directed paths of min_hops..max_hops payments, each made up to `days` days after the one before it and of `keep` to all of its amount.

    pay: relationship_id, source_id, target_id, ts (a date) and amount (a decimal above 0;
    others join no chain); it is read several times, so settle what is costly. Only payments
    by accounts that are paid can follow others, and only payments to accounts that pay can
    be followed. The two meet by account, by cell of time and by cell of the logarithm of the
    amount, so that an account that holds a third of all payments is many keys; the smaller
    side is copied to the neighbouring cells. Under a limit chains are numbered by (hops,
    source, destination, path, evidence), and no longer chains are sought once the shorter
    ones fill it.
    """
    step, share = -math.log(keep), Decimal(str(keep))
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01"))
    hop = pay.where("source_id <> target_id AND amount > 0 AND ts IS NOT NULL").select("relationship_id", "source_id", "target_id", day.alias("day"), "amount")
    ends = [hop.select(F.col(c).alias("_both")).distinct() for c in ("source_id", "target_id")]
    both = settle(ends[0].join(ends[1], "_both", "left_semi"))
    later = settle(hop.join(both, F.col("source_id") == F.col("_both"), "left_semi"))
    first = hop.join(both, F.col("target_id") == F.col("_both"), "left_semi")

    def cells(of: DataFrame, t: str, m: str, spread: tuple[int, int, float, float] | None = None) -> DataFrame:
        """of with _t and _m, its cell or, if spread, all cells from days and logarithms before it to those after it."""
        at = lambda n: F.floor((F.col(t) + n) / days)
        size = lambda eps: F.floor((F.log(F.col(m).cast("double")) + F.lit(eps)) / step)
        if spread is None:
            return of.withColumns({"_t": at(0), "_m": size(0.0)})
        a, b, low, high = spread
        return of.withColumn("_t", F.explode(F.sequence(at(a), at(b)))).withColumn("_m", F.explode(F.sequence(size(low), size(high))))

    nxt = later.select(F.col("source_id").alias("_end"), F.col("target_id").alias("_to"), F.col("day").alias("_day"), F.col("amount").alias("_amount"), F.col("relationship_id").alias("_id"))
    walk = first.select("source_id", F.array().cast("array<string>").alias("mid"), F.col("target_id").alias("_end"), F.array().cast("array<string>").alias("ids"), F.col("relationship_id").alias("id"), "day", "amount")
    shape = lambda df: df.select(F.concat(F.array("source_id"), "mid", F.array("_end")).alias("path"), F.concat("ids", F.array("id")).alias("evidence"), "_end")
    out, found = (shape(hop.select("source_id", F.array().cast("array<string>").alias("mid"), F.col("target_id").alias("_end"), F.array().cast("array<string>").alias("ids"), F.col("relationship_id").alias("id"))) if min_hops <= 1 else None), 0
    many = nxt.count()
    for n in range(2, max_hops + 1):
        if walk.count() <= many:
            asked, given = cells(walk, "day", "amount", (1, days, -step - 1e-9, 1e-9)), cells(nxt, "_day", "_amount")
        else:
            asked, given = cells(walk, "day", "amount"), cells(nxt, "_day", "_amount", (-days, -1, -1e-9, step + 1e-9))
        near = (F.col("_day") > F.col("day")) & (F.col("_day") <= F.col("day") + days) & (F.col("_amount") <= F.col("amount")) & (F.col("_amount") >= F.col("amount") * F.lit(share))
        met = asked.join(given, ["_end", "_t", "_m"]).where(near & (F.col("_to") != F.col("source_id")) & (F.col("_to") != F.col("_end")) & ~F.array_contains("mid", F.col("_to")))
        walk = settle(met.select("source_id", F.concat("mid", F.array("_end")).alias("mid"), F.col("_to").alias("_end"), F.concat("ids", F.array("id")).alias("ids"), F.col("_id").alias("id"), F.col("_day").alias("day"), F.col("_amount").alias("amount")))
        if n >= min_hops:
            out = shape(walk) if out is None else out.unionByName(shape(walk))
            found += walk.count() if limit is not None else 0
            if limit is not None and found >= limit:
                break
    shaped = out.select((F.size("path") - 1).alias("hop_count"), F.col("path")[0].alias("source_account"), F.col("_end").alias("destination_account"), F.array_join("path", ">").alias("path"), F.array_join("evidence", ",").alias("evidence"))
    if limit is None:
        return shaped
    order = ["hop_count", "source_account", "destination_account", "path", "evidence"]
    return shaped.orderBy(*order).limit(limit).withColumn("chain_id", F.format_string("chain-%03d", F.row_number().over(Window.orderBy(*order)) - 1))


def chains_between(rels: DataFrame, source: str, target: str, max_hops: int = 3) -> DataFrame:
    return transfer_chains(rels, 1, max_hops).where((F.col("source_account") == source) & (F.col("destination_account") == target))


__all__ = ["bounded_subgraph", "chains_between", "directed_edges", "enriched_path", "neighbourhood", "neighbourhood_edges", "shortest_paths", "timed_chains", "transfer_chains"]

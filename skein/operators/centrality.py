"""Degree, closeness, betweenness and PageRank as joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.base import ranked, settle
from skein.operators.graph import endpoints, neighbours, simple_edges


def degree_centrality(rels: DataFrame, nodes: DataFrame, key: str = "entity_id") -> DataFrame:
    """Distinct neighbours over n - 1; n counts isolated nodes; 0 for a single node."""
    near = neighbours(rels).groupBy("u").agg(F.count("*").alias("degree"))
    ids = nodes.select(F.col(key).alias("entity_id")).unionByName(near.select(F.col("u").alias("entity_id"))).distinct()
    n = ids.count()
    return ids.join(near, F.col("entity_id") == F.col("u"), "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.coalesce("degree", F.lit(0)) / max(1, n - 1), 6).alias("degree_centrality"))


def distances(rels: DataFrame, sources: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(src, node, dist, sigma): breadth-first distances from each source and the number of shortest paths, to the end unless depth bounds them.

    Its size is sources times reachable nodes: give a sample of sources on a large graph.
    """
    adj = settle(neighbours(rels))
    roots = adj.select(F.col("u").alias("src")).distinct() if sources is None else sources.select(F.col(sources.columns[0]).alias("src"))
    front = reached = settle(roots.select("src", F.col("src").alias("node"), F.lit(0).alias("dist"), F.lit(1).cast("long").alias("sigma")))
    d = 0
    while depth is None or d < depth:
        d += 1
        nxt = front.join(adj, front["node"] == adj["u"]).groupBy("src", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma"))
        front = settle(nxt.join(reached.select("src", "node"), ["src", "node"], "left_anti").select("src", "node", F.lit(d).alias("dist"), "sigma"))
        if not front.limit(1).count():
            break
        reached = reached.unionByName(front)
    return settle(reached)


def hops(rels: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, node, dist): breadth-first distances from each source (None: every node) to all it reaches, without numbers of paths.

    Sources are dealt into blocks of 64. A row of a round is a node with the sources of a
    block that reach it first in that round, as bits of one number, so that an edge is met
    once for 64 sources; pairs are only spread out in the result.
    """
    adj = settle(neighbours(rels))
    roots = adj.select(F.col("u").alias("src")) if sources is None else sources.select(F.col(sources.columns[0]).alias("src"))
    named, levels, _ = _levels(adj, roots)
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("mask"), i) == 1)
    return settle(levels).select("block", "node", "dist", F.explode(bits).alias("bit")).join(F.broadcast(named) if sources is not None else named, ["block", "bit"]).select("src", "node", "dist")


def _levels(adj: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of roots (src): (src, block, bit), and (block, node, dist, mask) of the rounds of hops(), the last of which reached nothing new; their number."""
    named = settle(ranked(roots.distinct(), "src").select("src", F.floor(F.col("rank") / 64).alias("block"), (F.col("rank") % 64).cast("int").alias("bit")))
    front = settle(named.select("block", F.col("src").alias("node"), F.lit(0).alias("dist"), F.expr("shiftleft(1L, bit)").alias("mask")))
    levels, d = front, 0
    while front.limit(1).count():
        d += 1
        nxt = adj.join(front.select("block", F.col("node").alias("u"), "mask").hint("shuffle_hash"), "u").groupBy("block", F.col("v").alias("node")).agg(F.bit_or("mask").alias("mask"))
        seen = levels.groupBy("block", "node").agg(F.bit_or("mask").alias("_seen"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        front = settle(nxt.join(seen, ["block", "node"], "left").select("block", "node", F.lit(d).alias("dist"), fresh.alias("mask")).where("mask <> 0"))
        levels = levels.unionByName(front)
    return named, levels, d


#: Fixed value: sources that stand together in one row of every_distance().
TOGETHER = 1024


@dataclass
class Trimmed:
    """A simple graph without its nodes of one neighbour: adj (u, v) of the rest, both ways, and members (node, core, off): each node's own or only neighbour's core and how far it is."""

    adj: DataFrame
    members: DataFrame


def trimmed(links: DataFrame) -> Trimmed:
    """Of links (source_id, target_id), each pair once and no loop. Of two nodes that have only each other the smaller stays, as a core without an edge."""
    ends = links.select(F.inline(F.array(F.struct(F.col("source_id").alias("u"), F.col("target_id").alias("v")), F.struct(F.col("target_id").alias("u"), F.col("source_id").alias("v")))))
    deg = settle(ends.groupBy(F.col("u").alias("node")).agg((F.count("*") == 1).alias("single"), F.min("v").alias("only")))
    single = deg.where("single").select("node", "only")
    alone = single.alias("a").join(single.alias("b"), (F.col("a.only") == F.col("b.node")) & (F.col("a.node") < F.col("a.only"))).select(F.col("a.node").alias("node"))
    hung = single.join(alone, "node", "left_anti")
    members = deg.join(hung.select("node"), "node", "left_anti").select("node", F.col("node").alias("core"), F.lit(0).alias("off")).unionByName(hung.select("node", F.col("only").alias("core"), F.lit(1).alias("off")))
    gone = settle(single.select("node"))
    inner = links.join(gone.select(F.col("node").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("node").alias("target_id")), "target_id", "left_anti")
    adj = inner.select(F.inline(F.array(F.struct(F.col("source_id").alias("u"), F.col("target_id").alias("v")), F.struct(F.col("target_id").alias("u"), F.col("source_id").alias("v")))))
    return Trimmed(settle(adj), settle(members))


def every_distance(links: DataFrame, name: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(src, node, dist): hops() from every node of the simple graph links (source_id, target_id) to all it reaches; name writes a node's id.

    Its size is the square of the nodes that reach each other. Distances are found between
    cores alone, nodes of one neighbour being one step further; the pairs are spread out in
    the last stage, TOGETHER sources at a time, and never shuffled.
    """
    g = trimmed(links)
    named, levels, _ = _levels(g.adj, g.members.select(F.col("core").alias("src")))
    members = g.members.select("core", "off", name(F.col("node")).alias("name"))
    dealt = ranked(named.join(members, F.col("src") == F.col("core")).select("block", "bit", "off", "name"), "block", "name")
    groups = settle(dealt.groupBy("block", F.floor(F.col("rank") / TOGETHER).alias("_group")).agg(F.collect_list(F.struct("bit", "off", "name")).alias("sources")))
    ends = settle(levels).join(members.withColumnsRenamed({"core": "node", "off": "_off"}), "node").select("block", "mask", "name", (F.col("dist") + F.col("_off")).alias("dist"))
    met = ends.join(groups, "block").select("mask", F.col("name").alias("node"), "dist", F.explode("sources").alias("s")).where(F.call_function("getbit", F.col("mask"), F.col("s.bit")) == 1)
    return met.select(F.col("s.name").alias("src"), "node", F.when(F.col("s.name") == F.col("node"), 0).otherwise(F.col("dist") + F.col("s.off")).alias("dist"))


def every_closeness(links: DataFrame) -> DataFrame:
    """(entity_id, closeness): closeness() of every node of the simple graph links (source_id, target_id) from its distances to all others, which are summed as they are found.

    Distances run both ways alike, so a core sums those from all sources that reach it, each
    counted with the nodes that hang on it; a node of one neighbour is a step further from all.
    """
    g = trimmed(links)
    weight = g.members.groupBy(F.col("core").alias("src")).agg(F.count("*").alias("w"))
    named, levels, _ = _levels(g.adj, weight.select("src"))
    by_bit = named.join(weight, "src").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bit", "w"))).alias("_w"))
    weights = settle(by_bit.select("block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("_w", i), F.lit(0).cast("long"))).alias("weights")))
    met = settle(levels).join(weights, "block").select("node", "dist", "mask", F.posexplode("weights").alias("bit", "w")).where(F.call_function("getbit", F.col("mask"), F.col("bit")) == 1)
    sums = settle(met.groupBy(F.col("node").alias("core")).agg(F.sum("w").alias("r"), F.sum(F.col("dist") * F.col("w") + F.col("w") - 1).alias("t")))
    n, others = g.members.count(), F.col("r") - 1
    total = F.col("t") + F.when(F.col("off") == 1, F.col("r") - 2).otherwise(0)
    score = F.when(total > 0, (others / total) * (others / F.lit(float(max(1, n - 1))))).otherwise(0.0)
    return g.members.join(sums, "core").select(F.col("node").alias("entity_id"), F.round(score, 6).alias("closeness"))


def closeness(dist: DataFrame, n: int) -> DataFrame:
    """((r - 1) / total distance) * ((r - 1) / (n - 1)) with r nodes reached; 0 when alone."""
    per = dist.groupBy(F.col("src").alias("entity_id")).agg((F.count("*") - 1).alias("reached"), F.sum("dist").alias("total"))
    score = F.when(F.col("total") > 0, (F.col("reached") / F.col("total")) * (F.col("reached") / F.lit(float(max(1, n - 1))))).otherwise(0.0)
    return per.select("entity_id", F.round(score, 6).alias("closeness"))


def pivots(nodes: DataFrame, k: int, key: str = "entity_id") -> DataFrame:
    """The k nodes of smallest hash: a sample that does not depend on the order of rows."""
    return nodes.select(key).distinct().orderBy(F.xxhash64(key), key).limit(k)


def sampled_closeness(rels: DataFrame, k: int = 64) -> DataFrame:
    """(entity_id, closeness, error): estimates from the distances to k pivots, exact where the graph has no more nodes.

    The mean distance to the pivots stands for that to all nodes, the share of pivots
    reached for that of nodes. error is the closeness's standard error through that of the
    mean distance, with the correction for a finite population.
    """
    near = settle(endpoints(rels))
    n, some = near.count(), settle(pivots(near, k))
    sample = min(n, k)
    dist = hops(rels, some).where("dist > 0").groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("r"), F.avg("dist").alias("mean"), F.coalesce(F.stddev_samp("dist"), F.lit(0.0)).alias("s"))
    held = near.join(some.withColumn("_own", F.lit(1)), "entity_id", "left").join(dist, "entity_id", "left")
    others = F.lit(sample) - F.coalesce("_own", F.lit(0))  # pivots besides the node itself
    share, spread = F.col("r") / others, F.sqrt(F.lit((n - sample) / max(1, n - 1)))
    close = F.when(others > 0, F.coalesce(share / F.col("mean"), F.lit(0.0))).otherwise(0.0)
    error = F.coalesce(close * F.col("s") / F.col("mean") / F.sqrt("r") * spread, F.lit(0.0))
    return held.select("entity_id", F.round(close, 6).alias("closeness"), F.round(error, 6).alias("error"))


def sampled_betweenness(rels: DataFrame, k: int = 64) -> DataFrame:
    """(entity_id, betweenness, error): estimates from the shortest paths that start at k pivots, exact where the graph has no more nodes.

    error is the standard error of the mean over the pivots, with the correction for a
    finite population.
    """
    near = settle(endpoints(rels))
    n, some = near.count(), settle(pivots(near, k))
    return betweenness(rels, distances(rels, some), n, errors=True)


def dependencies(rels: DataFrame, dist: DataFrame) -> DataFrame:
    """(node, sum, squares): each node's dependency over the sources of dist, and that of its squares; summed from the far end, level by level."""
    adj = neighbours(rels)
    deepest = dist.agg(F.max("dist")).first()[0] or 0
    steps = settle(
        dist.alias("d").join(adj, F.col("d.node") == F.col("u"))
        .select(F.col("d.src").alias("src"), F.col("u").alias("parent"), F.col("v").alias("child"), F.col("d.dist").alias("dist"), F.col("d.sigma").alias("ps"))
        .join(dist.select(F.col("src").alias("_s"), F.col("node").alias("_c"), F.col("dist").alias("_d"), F.col("sigma").alias("cs")), (F.col("src") == F.col("_s")) & (F.col("child") == F.col("_c")) & (F.col("_d") == F.col("dist") + 1))
        .select("src", "parent", "child", "dist", "ps", "cs")
    )
    level = dist.where(F.col("dist") == deepest).select("src", "node", F.lit(0.0).alias("delta"))
    total = level
    for d in range(deepest - 1, 0, -1):
        come = steps.where(F.col("dist") == d).join(level.select(F.col("src").alias("_s"), F.col("node").alias("_n"), "delta"), (F.col("src") == F.col("_s")) & (F.col("child") == F.col("_n")))
        given = come.groupBy("src", F.col("parent").alias("node")).agg(F.sum(F.col("ps") / F.col("cs") * (1 + F.col("delta"))).alias("delta"))
        rest = dist.where(F.col("dist") == d).select("src", "node")
        level = settle(rest.join(given, ["src", "node"], "left").select("src", "node", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        total = total.unionByName(level)
    return total.groupBy("node").agg(F.sum("delta").alias("sum"), F.sum(F.col("delta") ** 2).alias("squares"))


def betweenness(rels: DataFrame, dist: DataFrame, n: int, errors: bool = False) -> DataFrame:
    """Shares of shortest paths through each of the n nodes, ends excluded, over all pairs whose start is a source of dist.

    Dependencies are summed from the far end, level by level. errors: also the standard error
    of that share over the sources, as a sample of all n nodes.
    """
    adj = neighbours(rels)
    sources = dist.select(F.col("src").alias("_src")).distinct()
    k = sources.count()
    of_source, of_other = (1.0 / (x * (n - 2)) if x > 0 and n > 2 else 0.0 for x in (k - 1, k))
    per = dependencies(rels, dist)
    ids = adj.select(F.col("u").alias("entity_id")).unionByName(sources.select(F.col("_src").alias("entity_id"))).distinct()
    scale = F.when(F.col("_src").isNotNull(), of_source).otherwise(of_other)
    held = ids.join(per, F.col("entity_id") == F.col("node"), "left").join(sources, F.col("entity_id") == F.col("_src"), "left")
    share = F.round(F.coalesce("sum", F.lit(0.0)) * scale, 6).alias("betweenness")
    if not errors:
        return held.select("entity_id", share)
    times = F.lit(float(k)) - F.when(F.col("_src").isNotNull(), 1).otherwise(0)
    variance = F.greatest(F.lit(0.0), (F.col("squares") - F.col("sum") ** 2 / times) / (times - 1)) / (max(1, n - 2) ** 2)
    error = F.when((times > 1) & F.col("sum").isNotNull(), F.sqrt(variance / times * max(0.0, (n - k) / max(1, n - 1)))).otherwise(0.0)
    return held.select("entity_id", share, F.round(error, 6).alias("error"))


def betweenness_from(rels: DataFrame, sources: DataFrame) -> DataFrame:
    """betweenness() from distances() of few sources (ids in the first column) to a whole large graph, without a row for each edge and source.

    Nodes get numbers. Nodes of one neighbour, sources aside, lie on no path between others:
    they are taken off and counted as ends at their neighbour. hops() then tells, as bits of
    one number, for which sources an edge leads from one distance to the next, and a round
    moves only those pairs of an edge and a source: numbers of paths away from the sources,
    dependencies back to them.
    """
    links = settle(simple_edges(rels))
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("node"), F.col("a").alias("nbr")))))
    own = sources.select(F.col(sources.columns[0]).alias("node")).distinct().withColumn("source", F.lit(True))
    deg = ends.groupBy("node").agg(F.count("*").alias("deg"), F.min("nbr").alias("only")).join(own, "node", "left")
    named = settle(deg.select("node", F.monotonically_increasing_id().alias("id"), (F.coalesce("source", F.lit(False)) | (F.col("deg") > 1)).alias("inner"), F.coalesce("source", F.lit(False)).alias("source"), "only"))
    n, inner = named.count(), named.where("inner").select("node", "id")
    pairs = links.join(inner.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(inner.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    adj = settle(pairs.select(F.inline(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.col("y").alias("u"), F.col("x").alias("v"))))))
    hung = settle(named.where("NOT inner").groupBy("only").agg(F.count("*").alias("hung")).join(inner, F.col("only") == F.col("node")).select(F.col("id").alias("node"), "hung"))
    per = _carried(adj, named.where("source").select(F.col("id").alias("src")), hung)
    k = own.count()
    of_source, of_other = (1.0 / (x * (n - 2)) if x > 0 and n > 2 else 0.0 for x in (k - 1, k))
    ids = named.select("node", "id", "source").unionByName(own.join(named, "node", "left_anti").select("node", F.lit(None).cast("long").alias("id"), "source"))
    scale = F.when(F.col("source"), of_source).otherwise(of_other)
    return ids.join(per.select(F.col("node").alias("id"), "sum"), "id", "left").select(F.col("node").alias("entity_id"), F.round(F.coalesce("sum", F.lit(0.0)) * scale, 6).alias("betweenness"))


def every_betweenness(rels: DataFrame) -> DataFrame:
    """(entity_id, betweenness): betweenness() from every node of the simple graph, exact.

    Nodes of one neighbour are taken off: each is a source and an end more at its neighbour,
    which all its paths pass. Rounds go as in betweenness_from(); pairs of nodes of two
    neighbours or more that reach each other are the largest table.
    """
    links = settle(simple_edges(rels))
    named = settle(endpoints(links.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))).withColumn("id", F.monotonically_increasing_id()))
    of = lambda end, c: named.select(F.col("entity_id").alias(end), F.col("id").alias(c))
    g = trimmed(settle(links.join(of("a", "source_id"), "a").join(of("b", "target_id"), "b").select("source_id", "target_id")))
    n, weight = named.count(), settle(g.members.groupBy(F.col("core").alias("node")).agg(F.count("*").cast("double").alias("w")))
    hung = settle(weight.where("w > 1").select("node", (F.col("w") - 1).alias("hung")))
    per = _carried(g.adj, weight.select(F.col("node").alias("src"), "w"), hung)
    held = weight.join(per, "node", "left").withColumns({"sum": F.coalesce("sum", F.lit(0.0)), "reach": F.col("w") + F.coalesce("reach", F.lit(0.0))})
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    scores = held.select(F.col("node").alias("id"), ((F.col("sum") + (F.col("w") - 1) * (F.col("reach") - 2)) * scale).alias("_b"))
    return named.join(scores, "id", "left").select("entity_id", F.round(F.coalesce("_b", F.lit(0.0)), 6).alias("betweenness"))


def _carried(adj: DataFrame, roots: DataFrame, hung: DataFrame) -> DataFrame:
    """(node, sum, reach): each node's dependencies over the other sources, with those of roots (src), and how many reach it; both are counted w times where roots has (src, w). hung: nodes off the graph that are ends at a node."""
    weighted = "w" in roots.columns
    w, kept = (F.col("w"), ["w"]) if weighted else (F.lit(1.0), [])
    starts, levels, rounds = _levels(adj, roots.select("src"))
    steps = settle(_steps(adj, settle(levels)))
    holds = F.call_function("getbit", F.col("mask"), F.col("bit")) == 1
    first = starts.join(roots, "src") if weighted else starts
    counts = [settle(first.select("block", F.col("src").alias("node"), "bit", F.lit(1.0).alias("sigma"), *kept))]
    for d in range(rounds - 1):
        here = counts[-1].withColumnRenamed("node", "u")
        sent = steps.where(F.col("dist") == d).join(here, ["block", "u"]).where(holds)
        counts.append(settle(sent.groupBy("block", F.col("v").alias("node"), "bit").agg(F.sum("sigma").alias("sigma"), *[F.max(c).alias(c) for c in kept])))
    total = level = None
    for d in range(len(counts) - 1, 0, -1):
        rows = counts[d].join(hung, "node", "left").withColumn("hung", F.coalesce("hung", F.lit(0)).cast("double"))
        if level is not None:
            far = level.select("block", F.col("node").alias("v"), "bit", ((w + F.col("delta")) / F.col("sigma")).alias("share"))
            back = steps.where(F.col("dist") == d).join(far, ["block", "v"]).where(holds)
            rows = rows.join(back.groupBy("block", F.col("u").alias("node"), "bit").agg(F.sum("share").alias("share")), ["block", "node", "bit"], "left")
        else:
            rows = rows.withColumn("share", F.lit(0.0))
        level = settle(rows.select("block", "node", "bit", "sigma", *kept, (w * F.col("hung") + F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")))
        total = level if total is None else total.unionByName(level)
    if total is None:
        return hung.select("node", F.lit(0.0).alias("sum"), F.lit(0.0).alias("reach")).where("false")
    return total.groupBy("node").agg(F.sum("delta").alias("sum"), F.sum(w).alias("reach"))


def _steps(adj: DataFrame, levels: DataFrame) -> DataFrame:
    """(block, dist, u, v, mask): edges of (u, v) that lead from a node at dist to one at dist + 1, with the sources (bits) for which they do."""
    reached = levels.groupBy("block", "node").agg(F.map_from_entries(F.collect_list(F.struct("dist", "mask"))).alias("at"))
    of = lambda c, at: reached.select("block", F.col("node").alias(c), F.col("at").alias(at))
    met = adj.join(of("u", "_from"), "u").join(of("v", "_to"), ["block", "v"])
    shared = F.transform(F.map_entries("_from"), lambda x: F.struct(x["key"].alias("dist"), x["value"].bitwiseAND(F.coalesce(F.try_element_at("_to", x["key"] + 1), F.lit(0).cast("long"))).alias("mask")))
    return met.select("block", "u", "v", F.inline(F.filter(shared, lambda x: x["mask"] != 0)))


def pagerank(rels: DataFrame, nodes: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, key: str = "entity_id") -> DataFrame:
    """PageRank on the simple undirected graph; rank of nodes without edges is spread over all.

    Rounds end when the summed change is under n * tolerance. The edges, with 1 / degree,
    are settled once and partitioned by their source, so a round shuffles the ranks alone.
    """
    pairs = neighbours(rels)
    deg = pairs.groupBy("u").agg(F.count("*").alias("_deg"))
    edges = settle(pairs.join(deg, "u").select("u", "v", (1.0 / F.col("_deg")).alias("share")).repartition("u"), partitioned=True)
    ids = settle(nodes.select(F.col(key).alias("id")).unionByName(edges.select(F.col("u").alias("id"))).distinct())
    n = ids.count()
    if not n:
        return ids.select(F.col("id").alias("entity_id"), F.lit(0.0).alias("pagerank"))
    linked = edges.select(F.col("u").alias("id")).distinct()
    ranks = ids.select("id", F.lit(1.0 / n).alias("rank"))
    alone = ids.join(linked, "id", "left_anti").count()
    for r in range(1, rounds + 1):
        loose = ranks.join(linked, "id", "left_anti").agg(F.sum("rank")).first()[0] if alone else 0.0
        sent = edges.join(ranks, F.col("u") == F.col("id")).groupBy("v").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        nxt = ranks.join(sent, F.col("id") == F.col("v"), "left").select("id", (F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.abs(F.col("rank") - F.lit((1 - damping) / n + damping * loose / n) - damping * F.coalesce("got", F.lit(0.0))).alias("change"))
        if tolerance is not None or r % 5 == 0 or r == rounds:
            nxt = settle(nxt)
        ranks = nxt.select("id", "rank")
        if tolerance is not None and (nxt.agg(F.sum("change")).first()[0] or 0.0) < n * tolerance:
            break
    return ranks.select(F.col("id").alias("entity_id"), F.round("rank", 6).alias("pagerank"))


def top_connected(rels: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of highest degree that have at least two neighbours and more than the average."""
    scored = degree_centrality(rels, nodes)
    mean = scored.agg(F.avg("degree").alias("_mean"))
    return scored.crossJoin(F.broadcast(mean)).where("degree >= 2 AND degree > _mean").orderBy(F.desc("degree"), "entity_id").limit(k).select("entity_id", "degree", F.row_number().over(Window.orderBy(F.desc("degree"), "entity_id")).alias("position"))

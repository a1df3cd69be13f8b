"""Communities, articulation points and bridge candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.base import ranked, settle
from skein.operators.graph import adjacency, components, neighbours, simple_edges, sizes_and_firsts


def label_propagation(rels: DataFrame, nodes: DataFrame, rounds: int = 12, key: str = "entity_id") -> DataFrame:
    """(node, label): synchronous label propagation, votes weighted by parallel edges, ties to the smallest label.

    All nodes vote at once, not one after another, so that a round is one join and two
    aggregations; results can differ from the one-by-one order.
    """
    pairs = rels.groupBy("source_id", "target_id").agg(F.count("*").alias("w"))
    ends = F.array(F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("nbr")), F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("nbr")))
    votes = settle(pairs.select("w", F.inline(ends)).groupBy("node", "nbr").agg(F.sum("w").alias("w")))
    labels = nodes.select(F.col(key).alias("node")).unionByName(votes.select("node")).distinct().select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        cast = votes.join(labels.select(F.col("node").alias("_n"), "label"), F.col("nbr") == F.col("_n")).groupBy("node", "label").agg(F.sum("w").alias("w"))
        won = cast.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("_best")).select(F.col("node").alias("_k"), F.col("_best.label").alias("_new"))
        nxt = settle(labels.join(won, F.col("node") == F.col("_k"), "left").select("node", F.coalesce("_new", "label").alias("label"), (F.coalesce("_new", "label") != F.col("label")).alias("moved")))
        labels = nxt.select("node", "label")
        if not nxt.where("moved").limit(1).count():
            break
    return labels


def label_propagation_in_turns(rels: DataFrame, nodes: DataFrame, rounds: int = 12, key: str = "entity_id") -> DataFrame:
    """(node, colour, label): label propagation where nodes of one colour, which share no edge, vote together and colours vote in turn.

    The result is that of nodes voting one after another in the order (colour, id); labels
    cannot swing to and fro between two sides of an edge. Votes are weighted by parallel
    edges, self-loops give none, ties go to the smallest label. Rounds end when no label moves.
    """
    colours = settle(colouring(rels, nodes, key))
    votes = settle(adjacency(rels).where("node <> nbr").groupBy("node", "nbr").agg(F.count("*").alias("w")).join(colours, "node"))
    labels = colours.select("node", F.col("node").alias("label"))
    top = colours.agg(F.max("colour")).first()[0]
    for _ in range(rounds if top is not None else 0):
        before = labels
        for c in range(top + 1):
            cast = votes.where(F.col("colour") == c).join(labels.select(F.col("node").alias("nbr"), "label"), "nbr").groupBy("node", "label").agg(F.sum("w").alias("w"))
            won = cast.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("_best")).select("node", F.col("_best.label").alias("_new"))
            labels = labels.join(won, "node", "left").select("node", F.coalesce("_new", "label").alias("label"))
            labels = settle(labels) if c == top or c % 4 == 3 else labels
        if not labels.exceptAll(before).limit(1).count():
            break
    return labels.join(colours, "node").select("node", "colour", "label")


def colouring(rels: DataFrame, nodes: DataFrame, key: str = "entity_id") -> DataFrame:
    """(node, colour): colours from 0 on, different at the two ends of every edge.

    In each round the nodes whose hash is above that of all their uncoloured neighbours
    take the smallest colour that no neighbour has; no two of them are neighbours.
    """
    adj = settle(neighbours(rels))
    left = settle(nodes.select(F.col(key).alias("node")).unionByName(adj.select(F.col("u").alias("node"))).distinct().select("node", F.struct(F.xxhash64("node").alias("h"), "node").alias("rank")))
    done = None
    while left.limit(1).count():
        other = left.select(F.col("node").alias("v"), F.col("rank").alias("_of"))
        beaten = adj.join(other, "v").groupBy(F.col("u").alias("node")).agg(F.max("_of").alias("_most"))
        ready = left.join(beaten, "node", "left").where("_most IS NULL OR rank > _most").select("node")
        if done is None:
            chosen = ready.withColumn("colour", F.lit(0))
        else:
            used = ready.join(adj, F.col("node") == F.col("u")).join(done.select(F.col("node").alias("v"), "colour"), "v").groupBy("node").agg(F.collect_set("colour").alias("_used"))
            free = F.filter(F.sequence(F.lit(0), F.size("_used")), lambda c: ~F.array_contains("_used", c))
            chosen = ready.join(used, "node", "left").select("node", F.when(F.col("_used").isNull(), 0).otherwise(F.array_min(free)).alias("colour"))
        chosen = settle(chosen)
        done = chosen if done is None else done.unionByName(chosen)
        left = settle(left.join(chosen.select("node"), "node", "left_anti"))
    return nodes.select(F.col(key).alias("node"), F.lit(0).alias("colour")).where("false") if done is None else done


def modularity_communities(rels: DataFrame, moves: int = 5, part: Callable[[str], Column] | None = None) -> DataFrame:
    """(node, community): agglomeration on the simple graph, then moves of single nodes; a community is named by its smallest node.

    Communities are the nodes of a weighted graph that is contracted after each round, so
    rounds shrink. Of the pairs whose merger raises modularity, a community prefers that of
    most edges for its degrees; pairs that tie are ordered by a hash that differs by round,
    so that many equal pairs merge at once. Mutual choices merge, and with them communities
    with a single neighbour, where modularity rises even if all that neighbour's others come
    too. At last, up to `moves` times, nodes that gain most among their neighbours move to a
    neighbour's community, as long as modularity rises. All steps are joins and aggregations.

    part, given a column's name, tells which of several separate graphs a node is of; each is
    then merged by its own number of edges, as it would be alone. Moves need one graph.
    """
    if part is not None and moves:
        raise ValueError("moves need a single graph")
    pairs = settle(simple_edges(rels))
    m, both = pairs.count(), neighbours(rels)
    total = F.lit(m).cast("long").alias("m")
    if part is not None:
        sizes = pairs.groupBy(part("a").alias("_part")).agg(F.count("*").alias("_m"))
        pairs, total = pairs.join(sizes, part("a") == F.col("_part")), F.col("_m").alias("m")
    degrees = settle(both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("deg")))
    x, y = (degrees.select(F.col("node").alias(n), F.col("deg").alias(d)) for n, d in (("a", "dx"), ("b", "dy")))
    edges = settle(pairs.join(x, "a").join(y, "b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1).cast("long").alias("w"), "dx", "dy", total))
    gone, n = None, 0
    while m:
        n += 1
        merged = settle(_mergers(edges, n))
        if not merged.limit(1).count():
            break
        gone = merged.select("c", "to") if gone is None else gone.unionByName(merged.select("c", "to"))
        sums = merged.groupBy("to").agg((F.max("d_to") + F.sum("d")).alias("nd"))
        renamed = merged.select("c", "to").join(sums, "to").unionByName(sums.select(F.col("to").alias("c"), "to", "nd"))
        for end, d in (("x", "dx"), ("y", "dy")):
            edges = edges.join(renamed.select(F.col("c").alias(end), F.col("to").alias("_to"), F.col("nd").alias("_nd")), end, "left")
            edges = edges.withColumns({end: F.coalesce("_to", end), d: F.coalesce("_nd", d)}).drop("_to", "_nd")
        turned = F.col("x") > F.col("y")
        low, high = F.when(turned, F.struct(F.col("y").alias("c"), F.col("dy").alias("d"))).otherwise(F.struct(F.col("x").alias("c"), F.col("dx").alias("d"))), F.when(turned, F.struct(F.col("x").alias("c"), F.col("dx").alias("d"))).otherwise(F.struct(F.col("y").alias("c"), F.col("dy").alias("d")))
        edges = settle(edges.where("x <> y").groupBy(low.alias("l"), high.alias("h")).agg(F.sum("w").alias("w"), F.max("m").alias("m")).select(F.col("l.c").alias("x"), F.col("h.c").alias("y"), "w", F.col("l.d").alias("dx"), F.col("h.d").alias("dy"), "m"))
    labels = degrees.select("node", F.col("node").alias("community"))
    if gone is not None:
        up = settle(gone)
        while True:  # every community went into one other at most: follow the names to the last, twice as far each time
            nxt = up.join(up.select(F.col("c").alias("to"), F.col("to").alias("_on")), "to", "left")
            if not nxt.where("_on IS NOT NULL").limit(1).count():
                break
            up = settle(nxt.select("c", F.coalesce("_on", "to").alias("to")))
        labels = settle(labels.join(up.select(F.col("c").alias("node"), "to"), "node", "left").select("node", F.coalesce("to", "community").alias("community")))
    labels = _moved(settle(both), degrees, labels, m, moves) if m else labels
    names = labels.groupBy("community").agg(F.min("node").alias("_first"))
    return settle(labels.join(names, "community").select("node", F.col("_first").alias("community")))


def _mergers(edges: DataFrame, n: int) -> DataFrame:
    """(c, to, d, d_to): communities that go into others in round n, each once, none into one that goes itself."""
    sides = edges.select(F.col("x").alias("c"), F.col("y").alias("o"), "w", F.col("dx").alias("dc"), F.col("dy").alias("do"), "m").unionByName(edges.select(F.col("y").alias("c"), F.col("x").alias("o"), "w", F.col("dy").alias("dc"), F.col("dx").alias("do"), "m"))
    least, most = F.least("c", "o"), F.greatest("c", "o")
    order = F.struct((F.col("w") / (F.col("dc") * F.col("do"))).alias("lift"), F.xxhash64(F.lit(n), least, most).alias("h"), least.alias("l"), most.alias("g"), "o", "w", "dc", "do", "m")
    best = sides.groupBy("c").agg(F.max(F.when(2 * F.col("m") * F.col("w") > F.col("dc") * F.col("do"), order)).alias("b"), F.count("*").alias("near")).where("b IS NOT NULL").select("c", "b.o", "b.w", "b.dc", "b.do", "b.m", "near")
    second = best.select(F.col("c").alias("o"), F.col("o").alias("o2"), F.col("do").alias("d2"))
    third = best.select(F.col("c").alias("o2"), F.col("o").alias("o3"))
    seen = best.join(second, "o", "left").join(third, "o2", "left")
    pairs = seen.where("o2 = c AND c > o").select("c", F.col("o").alias("to"), F.col("dc").alias("d"), F.col("do").alias("d_to"))
    paired = F.col("o3") == F.col("o")
    single = seen.where("near = 1 AND NOT (o2 <=> c)").select("c", "w", "dc", "m", F.when(paired, F.least("o", "o2")).otherwise(F.col("o")).alias("to"), (F.col("do") + F.when(paired, F.col("d2")).otherwise(0)).alias("base"), F.when(paired & (F.col("o2") < F.col("o")), F.col("d2")).otherwise(F.col("do")).alias("d_to"))
    all_ = single.groupBy("to").agg(F.sum("dc").alias("come"))
    joined = single.join(all_, "to").where(2 * F.col("m") * F.col("w") > F.col("dc") * (F.col("base") + F.col("come") - F.col("dc")))
    return pairs.unionByName(joined.select("c", "to", F.col("dc").alias("d"), "d_to"))


def _moved(both: DataFrame, degrees: DataFrame, labels: DataFrame, m: int, rounds: int) -> DataFrame:
    """labels after up to `rounds` rounds of moves of single nodes."""
    def score(of: DataFrame) -> float:
        inside = both.join(of.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(of.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv").count()
        squares = of.join(degrees, "node").groupBy("community").agg(F.sum("deg").alias("d")).agg(F.sum((F.col("d") / (2 * m)) ** 2)).first()[0]
        return inside / (2 * m) - squares

    now = score(labels) if rounds else 0.0
    for n in range(rounds):
        own = labels.join(degrees, "node")
        totals = own.groupBy("community").agg(F.sum("deg").alias("total"))
        votes = both.join(labels.select(F.col("node").alias("v"), "community"), "v").groupBy(F.col("u").alias("node"), "community").agg(F.count("*").alias("w"))
        votes = votes.unionByName(labels.select("node", "community", F.lit(0).cast("long").alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        held = votes.join(totals, "community").join(own.select("node", F.col("community").alias("_own"), "deg"), "node")
        here = F.col("community") == F.col("_own")
        gain = 2 * F.lit(m) * F.col("w") - F.col("deg") * (F.col("total") - F.when(here, F.col("deg")).otherwise(0))
        per = held.groupBy("node").agg(F.max(F.when(here, gain)).alias("stay"), F.max(F.when(~here, F.struct(gain.alias("g"), F.xxhash64(F.lit(n), "node", "community").alias("h"), "community"))).alias("b"))
        wish = settle(per.where("b.g > stay").select("node", "b.community", F.struct((F.col("b.g") - F.col("stay")).alias("g"), F.xxhash64(F.lit(n), "node").alias("h"), "node").alias("rank")))
        rival = wish.select(F.col("node").alias("v"), F.col("rank").alias("_other"))
        outdone = wish.join(both, F.col("node") == F.col("u")).join(rival, "v").where("_other > rank").select("node").distinct()
        goes = wish.join(outdone, "node", "left_anti").select("node", F.col("community").alias("_to"))
        nxt = settle(labels.join(goes, "node", "left").select("node", F.coalesce("_to", "community").alias("community")))
        then = score(nxt)
        if then <= now + 1e-12:
            break
        labels, now = nxt, then
    return labels


def community_table(rels: DataFrame, labels: DataFrame, sample: int = 5) -> DataFrame:
    """Size, internal multigraph and simple edges, densities, first members and index (by smallest member) of each (node, community)."""
    a, b = (labels.select(F.col("node").alias(n), F.col("community").alias(c)) for n, c in (("_s", "cs"), ("_t", "ct")))
    inside = rels.join(a, F.col("source_id") == F.col("_s")).join(b, F.col("target_id") == F.col("_t")).where("cs = ct")
    edges = inside.groupBy(F.col("cs").alias("community")).agg(F.count("*").alias("internal_edges"), F.countDistinct(F.least("source_id", "target_id"), F.greatest("source_id", "target_id")).alias("simple_edges"))
    sizes = sizes_and_firsts(labels, "community", sample)
    room = F.col("size") * (F.col("size") - 1) / 2
    per = sizes.join(edges, "community", "left").select("community", "size", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), F.coalesce("simple_edges", F.lit(0)).alias("simple_edges"), "members")
    per = per.withColumns({d: F.when(room > 0, F.round(F.col(c) / room, 6)).otherwise(0.0) for d, c in (("density", "internal_edges"), ("simple_density", "simple_edges"))})
    return ranked(per, "community").withColumn("community_id", F.format_string("community-%03d", "rank")).drop("rank")


def boundary_scores(rels: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity_id, boundary): number of other communities among a node's neighbours."""
    own = labels.select(F.col("node").alias("_u"), F.col("community").alias("cu"))
    other = labels.select(F.col("node").alias("_v"), F.col("community").alias("cv"))
    return neighbours(rels).join(own, F.col("u") == F.col("_u")).join(other, F.col("v") == F.col("_v")).groupBy(F.col("u").alias("entity_id")).agg(F.countDistinct(F.when(F.col("cu") != F.col("cv"), F.col("cv"))).alias("boundary"))


def articulation_points(rels: DataFrame) -> DataFrame:
    """(entity_id): nodes whose removal splits their component.

    Nodes with one neighbour are taken off first, again and again while they are many: none
    is an articulation point, its neighbour is one if it has another neighbour, and what
    holds for the rest does not change. A forest is so done without growing a tree.
    """
    left, found = settle(neighbours(rels)), None
    while True:
        deg = left.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("deg"), F.min("v").alias("only"))
        deg = settle(deg)
        sizes = deg.agg(F.count("*").alias("n"), F.count(F.when(F.col("deg") == 1, 1)).alias("ends")).first()
        if not sizes["n"] or 8 * sizes["ends"] < sizes["n"]:
            break
        ends = deg.where("deg = 1")
        cuts = deg.where("deg > 1").join(ends.select(F.col("only").alias("node")), "node", "left_semi").select(F.col("node").alias("entity_id"))
        found = cuts if found is None else found.unionByName(cuts)
        gone = ends.select("node")
        left = settle(left.join(gone, F.col("u") == F.col("node"), "left_anti").join(gone, F.col("v") == F.col("node"), "left_anti"))
    rest = block_cuts(left) if sizes["n"] else None
    both = found if rest is None else rest if found is None else found.unionByName(rest)
    return left.select(F.col("u").alias("entity_id")) if both is None else both.distinct()


def block_cuts(adj: DataFrame) -> DataFrame:
    """articulation_points() of the settled simple graph (u, v), both ways, by spanning trees and their blocks.

    A breadth-first forest is grown from each component's smallest node; subtree sizes
    come up and preorder numbers go down by levels; lowest and highest reach of each
    subtree then say which tree edges lie in one block, and components of that relation
    are the blocks. A node in two blocks is an articulation point. Every step is a join or
    an aggregation; rounds follow the graph's depth.
    """
    roots = components(adj).where("node = component").select("node")
    front = tree = settle(roots.select("node", F.lit(None).cast(roots.schema["node"].dataType).alias("parent"), F.lit(0).alias("level"), F.col("node").alias("root")))
    d = 0
    while True:
        d += 1
        nxt = front.select(F.col("node").alias("_f"), "root").join(adj, F.col("_f") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.min("_f").alias("parent"), F.min("root").alias("root"))
        front = settle(nxt.join(tree.select("node"), "node", "left_anti").select("node", "parent", F.lit(d).alias("level"), "root"))
        if not front.limit(1).count():
            break
        tree = tree.unionByName(front)
    tree = settle(tree)
    last = d - 1

    def upward(start: DataFrame, names: dict[str, object]) -> DataFrame:
        """start (node, values) aggregated over subtrees; names: column to aggregate function."""
        level = done = start.join(tree.where(F.col("level") == last).select("node"), "node", "left_semi")
        for d in range(last - 1, -1, -1):
            here = start.join(tree.where(F.col("level") == d).select("node"), "node", "left_semi")
            given = level.join(tree.select("node", "parent"), "node").select(F.col("parent").alias("node"), *names)
            level = settle(here.unionByName(given).groupBy("node").agg(*[f(c).alias(c) for c, f in names.items()]))
            done = done.unionByName(level)
        return settle(done)

    sizes = upward(tree.select("node", F.lit(1).cast("long").alias("nd")), {"nd": F.sum})
    w = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    kids = settle(tree.join(sizes, "node").withColumn("_before", F.coalesce(F.sum("nd").over(w), F.lit(0))))
    level = pre = settle(kids.where("level = 0").select("node", F.lit(0).cast("long").alias("pre")))
    for d in range(1, last + 1):
        level = settle(kids.where(F.col("level") == d).join(level.select(F.col("node").alias("_p"), F.col("pre").alias("_pp")), F.col("parent") == F.col("_p")).select("node", (F.col("_pp") + 1 + F.col("_before")).alias("pre")))
        pre = pre.unionByName(level)
    facts = settle(kids.join(pre, "node").select("node", "parent", "root", "nd", "pre"))
    ends = adj.join(facts.select(F.col("node").alias("u"), F.col("parent").alias("pu"), F.col("pre").alias("nu"), F.col("nd").alias("du")), "u").join(facts.select(F.col("node").alias("v"), F.col("parent").alias("pv"), F.col("pre").alias("nv")), "v")
    cross = settle(ends.where("NOT (pu <=> v) AND NOT (pv <=> u)"))
    reach = facts.select("node", F.col("pre").alias("low"), F.col("pre").alias("high")).unionByName(cross.select(F.col("u").alias("node"), F.col("nv").alias("low"), F.col("nv").alias("high")))
    reach = upward(reach.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high")), {"low": F.min, "high": F.max})
    apart = cross.where("nu + du <= nv").select("u", "v")
    up = facts.select(F.col("node").alias("_p"), F.col("pre").alias("pp"), F.col("nd").alias("pd"), F.col("parent").alias("pparent"))
    through = facts.join(reach, "node").join(up, F.col("parent") == F.col("_p")).where("pparent IS NOT NULL AND (low < pp OR high >= pp + pd)").select(F.col("node").alias("u"), F.col("parent").alias("v"))
    blocks = components(apart.unionByName(through).unionByName(facts.where("parent IS NOT NULL").select(F.col("node").alias("u"), F.col("node").alias("v"))))
    member = facts.where("parent IS NOT NULL").join(blocks.select(F.col("node").alias("_b"), "component"), F.col("node") == F.col("_b"))
    touching = member.select(F.col("parent").alias("entity_id"), "component").unionByName(member.select(F.col("node").alias("entity_id"), "component"))
    return touching.groupBy("entity_id").agg(F.countDistinct("component").alias("_n")).where("_n > 1").select("entity_id")


def bridge_candidates(rels: DataFrame, cuts: DataFrame, between: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Top k of bridge_rows."""
    return bridge_rows(rels, cuts, between, labels).orderBy(F.desc("score"), "entity_id").limit(k)


def bridge_rows(rels: DataFrame, cuts: DataFrame, between: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes that are articulation points, lie on over 5 % of shortest paths or border two other communities, with their first five edges."""
    edge = adjacency(rels).withColumn("_k", F.row_number().over(Window.partitionBy("node").orderBy("relationship_id"))).where("_k <= 5").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("relationship_id")), ",").alias("evidence"))
    rows = between.join(cuts.select("entity_id", F.lit(True).alias("cut")), "entity_id", "left").join(boundary_scores(rels, labels), "entity_id", "left")
    metric = F.when(F.col("cut"), "articulation_point").when(F.col("boundary") >= 2, "community_boundary").when(F.col("betweenness") > 0.05, "betweenness")
    rows = rows.withColumn("metric", metric).where("metric IS NOT NULL")
    score = F.when(F.col("metric") == "betweenness", F.col("betweenness")).otherwise(F.lit(0.6))
    return rows.join(edge, F.col("entity_id") == F.col("node"), "left").select("entity_id", "metric", score.alias("score"), "betweenness", F.coalesce("boundary", F.lit(0)).alias("boundary"), "evidence")

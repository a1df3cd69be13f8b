"""PageRank and label propagation over edges that stay in parts, so that a round moves values of nodes, not edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.base import settle

#: Fixed value: edges of a part.
EDGES_A_PART = 2_000_000


@dataclass
class Dealt:
    """edges (part, lo, hi, w), kept by part, w parallel ones counted; a row whose ends are one holds those to the leaves of lo.
    hubs (hi, parts) and where they are met; leaves (leaf, core, w); cores (node, part, deg, leaves): all but the leaves, deg their different neighbours."""

    edges: DataFrame
    hubs: DataFrame
    leaves: DataFrame
    cores: DataFrame
    parts: int

    def sent(self, values: DataFrame) -> DataFrame:
        """values (node, part, ...) for each part that meets the node; twice where it is a hub and a source there."""
        return values.unionByName(values.drop("part").join(self.hubs.withColumnRenamed("hi", "node"), "node").select(F.explode("parts").alias("part"), *[c for c in values.columns if c != "part"]))

    def met(self, values: DataFrame, meet: Callable, ddl: str) -> DataFrame:
        """What meet makes of each part's edges and values. A part is some EDGES_A_PART edges, so that a task holds no more at once."""
        return self.edges.groupBy("part").cogroup(self.sent(values).groupBy("part")).applyInPandas(meet, ddl)

    def alone(self, nodes: DataFrame, key: str) -> DataFrame:
        """(node): those of nodes that have no edge."""
        left = nodes.select(F.col(key).alias("node")).join(self.leaves.select(F.col("leaf").alias("node")), "node", "left_anti")
        return left.join(self.cores.select("node"), "node", "left_anti").distinct()


def deal(rels: DataFrame, hanging: DataFrame, size: int) -> Dealt:
    """Of edges (source_id, target_id) between whole numbers, none a loop and no pair both ways, and of others whose targets are no end of the first.

    Edges are dealt to parts by their source, so a node's value goes to its part once as a
    source, and as a target to the parts that meet it: sources are best the ends with fewer
    neighbours. Targets of one source among hanging are leaves and are in no part. size: some number of edges.
    """
    parts = max(rels.sparkSession.sparkContext.defaultParallelism, 1 + size // EDGES_A_PART)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias("part")
    ends = settle(hanging.groupBy(F.col("target_id").alias("leaf")).agg(F.min("source_id").alias("core"), F.max("source_id").alias("_most"), F.count("*").alias("w")))
    leaves = ends.where("core = _most").select("leaf", "core", "w")
    rows = rels.select("source_id", "target_id", F.lit(1).cast("long").alias("w")).unionByName(leaves.select(F.col("core").alias("source_id"), F.col("core").alias("target_id"), "w"))
    shared = ends.where("core <> _most").select(F.col("leaf").alias("target_id"))
    if shared.limit(1).count():
        rows = rows.unionByName(hanging.join(shared, "target_id", "left_semi").select("source_id", "target_id", F.lit(1).cast("long").alias("w")))
    dealt = rows.select(part("source_id"), F.col("source_id").alias("lo"), F.col("target_id").alias("hi"), "w").repartition(parts, "part")
    edges = dealt.groupBy("part", "lo", "hi").agg(F.sum("w").alias("w")).sortWithinPartitions("part", "lo").persist()
    hubs = settle(edges.where("lo <> hi").groupBy("part", "hi").agg(F.count("*").alias("n")).groupBy("hi").agg(F.collect_list("part").alias("parts"), F.sum("n").alias("n")))
    low = edges.groupBy("part", "lo").agg(F.count(F.when(F.col("lo") != F.col("hi"), 1)).alias("n")).select(F.col("lo").alias("node"), "n")
    own = leaves.groupBy(F.col("core").alias("node")).agg(F.count("*").alias("leaves"))
    degrees = low.unionByName(hubs.select(F.col("hi").alias("node"), "n")).groupBy("node").agg(F.sum("n").alias("n"))
    number = F.coalesce("leaves", F.lit(0).cast("long"))
    cores = settle(degrees.join(own, "node", "left").select("node", part("node"), (F.col("n") + number).alias("deg"), number.alias("leaves")))
    return Dealt(edges, hubs.select("hi", "parts"), leaves, cores, parts)


def pagerank(g: Dealt, nodes: DataFrame, rounds: int, damping: float = 0.85, key: str = "entity_id") -> DataFrame:
    """(entity_id, pagerank): centrality.pagerank() of as many rounds. Leaves of a node share one rank, which goes with that node's."""
    apart = settle(g.alone(nodes, key))
    alone = apart.count()
    n = g.cores.count() + g.leaves.count() + alone
    if not n:
        return apart.select(F.col("node").alias("entity_id"), F.lit(0.0).alias("pagerank"))
    ranks, single = g.cores.select("*", F.lit(1.0 / n).alias("rank"), F.lit(1.0 / n).alias("leaf")), 1.0 / n
    for _ in range(rounds):
        base = (1 - damping) / n + damping * alone * single / n
        given = g.met(ranks.select("node", "part", (F.col("rank") / F.col("deg")).alias("share")), _shares, "node long, got double")
        got = F.coalesce("got", F.lit(0.0)) + F.col("leaves") * F.col("leaf")
        ranks = settle(ranks.join(given.groupBy("node").agg(F.sum("got").alias("got")), "node", "left").select("node", "part", "deg", "leaves", (F.lit(base) + damping * got).alias("rank"), (F.lit(base) + damping * F.col("rank") / F.col("deg")).alias("leaf")))
        single = base
    g.edges.unpersist()
    hung = g.leaves.join(ranks.select(F.col("node").alias("core"), F.col("leaf").alias("rank")), "core").select(F.col("leaf").alias("node"), "rank")
    out = ranks.select("node", "rank").unionByName(hung).unionByName(apart.select("node", F.lit(single).alias("rank")))
    return out.select(F.col("node").alias("entity_id"), F.round("rank", 6).alias("pagerank"))


def _places(values: pd.DataFrame, edges: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """values by node, each once, and where the ends of edges stand there."""
    values = values.drop_duplicates("node").sort_values("node", ignore_index=True)
    nodes = values["node"].to_numpy()
    return values, np.searchsorted(nodes, edges["lo"].to_numpy()), np.searchsorted(nodes, edges["hi"].to_numpy())


def _shares(edges: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """(node, got): shares that edges bring."""
    edges = edges[edges["lo"] != edges["hi"]]
    values, lo, hi = _places(values, edges)
    share, n = values["share"].to_numpy(), len(values)
    return pd.DataFrame({"node": values["node"], "got": np.bincount(hi, share[lo], n) + np.bincount(lo, share[hi], n)})


def _votes(edges: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """(node, label, w): votes that edges bring, summed; of sources that are no hubs, which have no vote elsewhere, the winner alone."""
    values, lo, hi = _places(values, edges)
    label, w, up = values["label"].to_numpy(), edges["w"].to_numpy(), lo != hi
    at, leaf_w = lo[~up], values["leaf_w"].to_numpy()
    own = np.where(leaf_w[at] > 0, leaf_w[at], w[~up])
    node = np.concatenate([hi[up], lo[up], at])
    names, which = np.unique(np.concatenate([label[lo[up]], label[hi[up]], values["leaf"].to_numpy()[at]]), return_inverse=True)
    keys, of = np.unique(node * len(names) + which, return_inverse=True)
    sums = np.bincount(of, np.concatenate([w[up], w[up], own]), len(keys)).astype("int64")
    node, which = np.divmod(keys, max(1, len(names)))
    order = np.lexsort((which, -sums, node))
    node, which, sums = node[order], which[order], sums[order]
    keep = values["hub"].to_numpy()[node] | (np.diff(node, prepend=-1) != 0)
    return pd.DataFrame({"node": values["node"].to_numpy()[node[keep]], "label": names[which[keep]], "w": sums[keep]})


def label_propagation(g: Dealt, nodes: DataFrame, rounds: int, order: Callable[[str], Column] = F.col, key: str = "entity_id") -> DataFrame:
    """(node, label): community.label_propagation() of as many rounds, one at least; order gives a node's label, a whole number, and ties go to the smallest.

    All leaves of a node take its label one round later; before that only the best vote of
    them counts, as each votes for itself. Votes for nodes that are no hubs stay in their part.
    """
    best = F.min(F.struct((-F.col("w")).alias("w"), "label"))
    first = g.leaves.select(F.col("core").alias("node"), order("leaf").alias("label"), "w").groupBy("node").agg(best.alias("_b")).select("node", F.col("_b.label").alias("leaf"), (-F.col("_b.w")).alias("leaf_w"))
    is_hub, none = g.hubs.select(F.col("hi").alias("node"), F.lit(True).alias("hub")), F.lit(0).cast("long")
    labels = settle(g.cores.join(first, "node", "left").join(is_hub, "node", "left").select("node", "part", F.coalesce("hub", F.lit(False)).alias("hub"), order("node").alias("label"), F.coalesce("leaf", none).alias("leaf"), F.coalesce("leaf_w", none).alias("leaf_w")))
    for _ in range(rounds):
        votes = g.met(labels, _votes, "node long, label long, w long").repartition("node").groupBy("node", "label").agg(F.sum("w").alias("w"))
        won = votes.groupBy("node").agg(best.alias("_b")).select("node", F.col("_b.label").alias("_new"))
        labels = settle(labels.join(won, "node", "left").select("node", "part", "hub", F.coalesce("_new", "label").alias("label"), F.col("label").alias("leaf"), none.alias("leaf_w")))
    g.edges.unpersist()
    hung = g.leaves.join(labels.select(F.col("node").alias("core"), F.col("leaf").alias("label")), "core").select(F.col("leaf").alias("node"), "label")
    return labels.select("node", "label").unionByName(hung).unionByName(g.alone(nodes, key).select("node", order("node").alias("label")))

"""Shortest paths of many pairs at once, searched from both ends, with their edges and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.base import settle
from skein.operators.graph import neighbours
from skein.operators.traverse import MAX_DEPTH


def pair_paths(rels: DataFrame, pairs: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(source_id, target_id, length, path): the smallest of the shortest paths of each pair that `depth` edges join.

    A search grows from each distinct source and another from each distinct target, in
    turns, and keeps for each node reached the smallest path on its own side. A pair is done
    when its two frontiers meet; a search whose pairs are all done grows no more. A pair of
    one node that has an edge is a path of length 0; nodes without edges, nulls and pairs too
    far apart give no row, repeated pairs one.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be in 0..{MAX_DEPTH}")
    adj = settle(neighbours(rels))
    known = adj.select(F.col("u").alias("node")).distinct()
    asked = settle(pairs.select("source_id", "target_id").where("source_id IS NOT NULL AND target_id IS NOT NULL").distinct())
    seen, front = {}, {}
    for end in ("source_id", "target_id"):
        start = asked.select(F.col(end).alias("root")).distinct().join(known, F.col("root") == F.col("node"), "left_semi")
        seen[end] = front[end] = settle(start.select("root", F.col("root").alias("node"), F.array("root").alias("path")))
    found = _met(asked, front["source_id"], front["target_id"], 0)
    for d in range(1, depth + 1):
        end = "source_id" if d % 2 else "target_id"
        open_ = asked.join(found, ["source_id", "target_id"], "left_anti")
        if not open_.limit(1).count():
            break
        here = front[end].join(open_.select(F.col(end).alias("root")).distinct(), "root", "left_semi").select("root", F.col("node").alias("_at"), "path")
        grown = here.join(adj, F.col("_at") == F.col("u")).groupBy("root", F.col("v").alias("node")).agg(F.min("path").alias("_p"))
        new = grown.join(seen[end].select("root", "node"), ["root", "node"], "left_anti")
        step = F.concat("_p", F.array("node")) if end == "source_id" else F.concat(F.array("node"), "_p")
        front[end] = settle(new.select("root", "node", step.alias("path")))
        seen[end] = seen[end].unionByName(front[end])
        found = found.unionByName(_met(open_, front["source_id"], front["target_id"], d))
    return found


def _met(asked: DataFrame, ahead: DataFrame, back: DataFrame, length: int) -> DataFrame:
    """The pairs whose frontiers hold a node in common; all meetings are as far from the source, so the smallest whole path is the smallest."""
    one = ahead.select(F.col("root").alias("source_id"), "node", F.col("path").alias("_ahead"))
    two = back.select(F.col("root").alias("target_id"), "node", F.col("path").alias("_back"))
    met = asked.join(one, "source_id").join(two, ["target_id", "node"])
    whole = F.concat("_ahead", F.slice("_back", F.lit(2), F.size("_back")))
    return settle(met.groupBy("source_id", "target_id").agg(F.min(whole).alias("path")).select("source_id", "target_id", F.lit(length).alias("length"), "path"))


def described_paths(rels: DataFrame, ents: DataFrame, pairs: DataFrame, depth: int = MAX_DEPTH, kinds: list[str] | None = None, members: DataFrame | None = None) -> DataFrame:
    """A row for each pair: whether a path was found, its nodes with types, its edges and their types in order, and where it comes from.

    kinds restricts which edge stands for a hop, not the search; a hop without such an edge
    gets the placeholder id placeholder-from-to and the type of its edge of smallest id. An
    end without a record is of type Unknown. members (source_id, entity_id): the case network
    of each source; in_case_network says whether all nodes belong to it (null where a source
    has no case).
    """
    paths = settle(pair_paths(rels, pairs, depth))
    hops = paths.select("source_id", "target_id", "path", F.posexplode("path").alias("position", "node"))
    types = ents.groupBy("entity_id").agg(F.min("entity_type").alias("_type"))
    named = hops.join(types, F.col("node") == F.col("entity_id"), "left").select("source_id", "target_id", "position", "path", "node", F.coalesce("_type", F.lit("Unknown")).alias("type"))
    before = F.when(F.col("position") > 0, F.get("path", F.col("position") - 1))
    named = named.withColumn("from", before).withColumns({"_a": F.least("from", "node"), "_b": F.greatest("from", "node")})
    named = named.withColumns({c: F.when(F.col("from").isNotNull(), F.col(c)) for c in ("_a", "_b")})
    allowed = F.col("relationship_type").isin(kinds) if kinds else F.lit(True)
    edge = F.struct("relationship_id", "relationship_type")
    best = rels.groupBy(F.least("source_id", "target_id").alias("_a"), F.greatest("source_id", "target_id").alias("_b")).agg(F.min(F.when(allowed, edge)).alias("_kept"), F.min(edge).alias("_any"))
    known = named.join(best, ["_a", "_b"], "left").withColumns({
        "edge": F.when(F.col("from").isNotNull(), F.coalesce("_kept.relationship_id", F.concat_ws("-", F.lit("placeholder"), "from", "node"))),
        "kind": F.when(F.col("from").isNotNull(), F.coalesce("_kept.relationship_type", "_any.relationship_type")),
    })
    inside = F.lit(None).cast("boolean")
    if members is not None:
        net = members.select("source_id", F.col("entity_id").alias("node")).distinct().withColumn("_in", F.lit(True))
        cased = members.select("source_id").distinct().withColumn("_cased", F.lit(True))
        known = known.join(net, ["source_id", "node"], "left").join(cased, "source_id", "left")
        inside = F.when(F.max("_cased"), F.min(F.coalesce("_in", F.lit(False))))

    def in_order(c: str, sep: str = ",") -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("position", c)))), lambda x: x[c]), sep)

    rows = known.groupBy("source_id", "target_id").agg((F.count("*") - 1).alias("hop_count"), in_order("node", ">").alias("nodes"), in_order("type", ">").alias("node_types"), in_order("edge").alias("edges"), in_order("kind").alias("relationship_sequence"), inside.alias("in_case_network"))
    asked = pairs.select("source_id", "target_id").distinct()
    origin = f"graph:shortest_path:max_depth={depth}" + (f":types={','.join(sorted(kinds))}" if kinds else "")
    empty = {c: F.coalesce(c, F.lit("")) for c in ("nodes", "node_types", "edges", "relationship_sequence")}
    return asked.join(rows, ["source_id", "target_id"], "left").withColumns({"found": F.col("hop_count").isNotNull(), **empty, "provenance": F.lit(origin)})

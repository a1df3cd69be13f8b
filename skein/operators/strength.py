"""Interaction strength of relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a relationship type; others weigh 0.8.
TYPE_WEIGHT = {
    "KNOWS": 1.0, "CALLED": 1.2, "TRANSFERRED_TO": 1.5, "WORKS_FOR": 1.0, "ASSOCIATED_WITH": 0.9, "OWNS": 1.0,
    "USED": 1.0, "TRAVELED_TO": 0.8, "LOCATED_AT": 0.7, "MENTIONED_IN": 0.5, "RELATED_TO_CASE": 0.5,
}


def type_weight(kind: str) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, F.coalesce(F.col(kind), F.lit("RELATED_TO_CASE"))), F.lit(0.8))


def pair_frequency(rels: DataFrame) -> DataFrame:
    return rels.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count("*").alias("pair_frequency"))


def relationship_strength(rels: DataFrame) -> DataFrame:
    """Each edge with its pair's frequency and a score of type, confidence, frequency and whether it has a time.

    Frequencies are counted before the shuffle and joined back, so that a pair with very
    many edges never meets in one task as it would in a window.
    """
    a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    freq = pair_frequency(rels)
    keyed = rels.withColumns({"_a": a, "_b": b}).join(freq, (F.col("_a") == freq["a"]) & (F.col("_b") == freq["b"]))
    factor = F.least(F.lit(1.0), (F.col("pair_frequency") - 1) * F.lit(0.15))
    raw = type_weight("relationship_type") * 0.3 + F.coalesce("confidence", F.lit(0.5)) * 0.4 + factor * 0.2 + F.when(F.col("ts").isNotNull(), 0.1).otherwise(0.0)
    return keyed.select("relationship_id", "relationship_type", "source_id", "target_id", "pair_frequency", F.round(F.least(F.lit(1.0), raw / 1.5), 4).alias("interaction_strength"))


def strongest(rels: DataFrame, k: int = 50) -> DataFrame:
    return relationship_strength(rels).orderBy(F.desc("interaction_strength"), "relationship_id").limit(k)


def with_pair_window(rels: DataFrame) -> DataFrame:
    """Edges with their pair's frequency by a window, for pairs known to be small."""
    w = Window.partitionBy(F.least("source_id", "target_id"), F.greatest("source_id", "target_id"))
    return rels.withColumn("pair_frequency", F.count("*").over(w))

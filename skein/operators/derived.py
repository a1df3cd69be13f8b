"""Indicators, findings, evidence and explanations, all with traceable ids and neutral words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import severity, short_hash

#: Phrases that no output may hold.
FORBIDDEN = (
    "crime_probability", "guilt probability", "criminal probability", "guilt score", "criminal score", "criminality score",
    "is criminal", "is guilty", "likely guilty", "likely criminal", "probability of guilt", "criminal detected",
)
SHAPE = ("indicator_id", "indicator_type", "entity_ids", "score", "explanation")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def indicators(central: DataFrame, bridges: DataFrame, bursts: DataFrame, chains: DataFrame) -> DataFrame:
    """One table of descriptive indicators: central nodes, bridges, bursts and chains, with severity.

    The ids of bursts take the entity in, so that entities with one window stay apart.
    """
    top = central.where("betweenness >= 0.05").orderBy(F.desc("betweenness"), "entity_id").limit(5)
    parts = [
        top.select(F.concat(F.lit("ind-central-"), "entity_id").alias("indicator_id"), F.lit("high_betweenness").alias("indicator_type"), F.col("entity_id").alias("entity_ids"), F.least(F.lit(1.0), F.col("betweenness")).alias("score"), F.format_string("betweenness %.4f", "betweenness").alias("explanation")),
        bridges.select(F.concat(F.lit("ind-bridge-"), "entity_id").alias("indicator_id"), F.lit("bridge_candidate").alias("indicator_type"), F.col("entity_id").alias("entity_ids"), F.col("score"), F.concat(F.lit("connects groups by "), "metric").alias("explanation")),
        bursts.orderBy(F.desc("observed"), "win", "entity").limit(5).select(F.concat(F.lit("ind-temporal-"), short_hash(F.col("entity"), F.col("start_us"), digits=8)).alias("indicator_id"), "indicator_type", F.when(F.col("entity").startswith("type:"), "").otherwise(F.col("entity")).alias("entity_ids"), F.round(F.least(F.lit(1.0), (F.col("observed") - F.col("threshold") + 1) / 5), 4).alias("score"), F.format_string("observed %d against a threshold of %.2f", "observed", "threshold").alias("explanation")),
        chains.orderBy("hop_count", "source_account", "destination_account", "path").limit(5).select(F.concat(F.lit("ind-chain-"), short_hash(F.col("path"))).alias("indicator_id"), F.lit("transaction_chain").alias("indicator_type"), F.concat_ws(",", "source_account", "destination_account").alias("entity_ids"), F.round(F.col("hop_count") / 4, 4).alias("score"), F.format_string("chain of %d transfers", "hop_count").alias("explanation")),
    ]
    found = _union(parts).withColumn("severity", severity(F.col("score")))
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return found.orderBy(rank, F.desc("score"), "indicator_id")


def finding_id(ids: str, kind: str, case: str | None) -> F.Column:
    ordered = F.array_join(F.array_sort(F.split(F.col(ids), ",")), "|")
    return F.concat(F.lit("finding-"), short_hash(ordered, F.lit(kind), F.lit(case or "global")))


def findings(bridges: DataFrame, bursts: DataFrame, chains: DataFrame, strengths: DataFrame, case: str | None = None) -> DataFrame:
    """At most two bridges, bursts and chains and one strong relationship, first of each id, ordered by id."""
    def shaped(df: DataFrame, kind: str, ids: F.Column, score: F.Column, text: F.Column) -> DataFrame:
        return df.select(ids.alias("entity_ids"), score.alias("score"), text.alias("description")).withColumn("finding_type", F.lit(kind)).withColumn("finding_id", finding_id("entity_ids", kind, case))

    parts = [
        shaped(bridges.orderBy(F.desc("score"), "entity_id").limit(2), "bridge", F.col("entity_id"), F.col("score"), F.concat("entity_id", F.lit(" connects groups by "), "metric")),
        shaped(bursts.orderBy(F.desc("observed"), "win", "entity").limit(2), "burst", F.col("entity"), F.lit(0.5), F.format_string("%s has %d interactions in one window", "entity", "observed")),
        shaped(chains.orderBy("hop_count", "source_account", "destination_account", "path").limit(2), "chain", F.replace(F.col("path"), F.lit(">"), F.lit(",")), F.round(F.col("hop_count") / 4, 4), F.concat(F.lit("transfers along "), "path")),
        shaped(strengths.where("interaction_strength >= 0.6").orderBy(F.desc("interaction_strength"), "relationship_id").limit(1), "strength", F.concat_ws(",", "source_id", "target_id"), F.col("interaction_strength"), F.concat(F.lit("frequent relationship "), "relationship_id")),
    ]
    one = _union(parts).groupBy("finding_id").agg(*[F.min_by(c, F.struct("finding_type", "entity_ids")).alias(c) for c in ("finding_type", "entity_ids", "score", "description")])
    return neutral(one, "description").orderBy("finding_id").limit(20)


def neutral(df: DataFrame, text: str) -> DataFrame:
    """df, failing on rows whose text holds a forbidden phrase."""
    bad = F.exists(F.array(*[F.lit(p) for p in FORBIDDEN]), lambda p: F.contains(F.lower(F.col(text)), p))
    return df.withColumn(text, F.when(bad, F.raise_error(F.concat(F.lit("wording is not neutral: "), text))).otherwise(F.col(text)))


def evidence_items(ents: DataFrame, rels: DataFrame, chains: DataFrame, found: DataFrame) -> DataFrame:
    """Up to 20 entities, 20 relationships, 5 paths and 5 indicators as evidence, one row an id."""
    def first(df: DataFrame, key: str, kind: str, text: F.Column, k: int) -> DataFrame:
        return df.orderBy(key).limit(k).select(F.concat(F.lit("ev-"), short_hash(F.lit(kind), F.col(key))).alias("evidence_id"), F.lit(kind).alias("evidence_type"), F.col(key).alias("reference"), F.substring(text, 1, 120).alias("description"))

    items = _union([
        first(ents, "entity_id", "entity", F.concat_ws(" ", "entity_type", "name"), 20),
        first(rels, "relationship_id", "relationship", F.concat_ws(" ", "source_id", "relationship_type", "target_id"), 20),
        first(chains, "path", "path", F.col("path"), 5),
        first(found, "indicator_id", "indicator", F.col("explanation"), 5),
    ])
    return items.dropDuplicates(["evidence_id"]).orderBy("evidence_id").limit(50)


def profile(rels: DataFrame, scores: DataFrame, labels: DataFrame, cuts: DataFrame, found: DataFrame, entity: str) -> DataFrame:
    """Everything known of one entity, observed and analytical, a row a fact."""
    one = scores.where(F.col("entity_id") == entity)
    near = rels.where((F.col("source_id") == entity) | (F.col("target_id") == entity))
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    parts = [row(one, "analytical", c, F.col(c)) for c in scores.columns if c != "entity_id"]
    parts += [
        row(near.agg(F.count("*").alias("n")), "observed", "relationships", F.col("n")),
        row(labels.where(F.col("node") == entity), "analytical", "community", F.col("community")),
        row(cuts.where(F.col("entity_id") == entity).agg((F.count("*") > 0).alias("x")), "analytical", "articulation_point", F.col("x")),
        row(found.where(F.array_contains(F.split("entity_ids", ","), entity)), "analytical", "indicator", F.col("indicator_id")),
        row(near.orderBy("relationship_id").limit(5), "observed", "evidence", F.col("relationship_id")),
    ]
    return _union(parts)


def explain(kind: str, subject: str, reason: F.Column, source: DataFrame, match: F.Column, evidence: F.Column, operator: str, params: dict[str, str]) -> DataFrame:
    """One explanation: what was looked up, why, from which rows, by which operator; a record that says so where nothing matches."""
    hit = source.where(match).limit(1).select(reason.alias("reason"), evidence.cast("string").alias("evidence"))
    ask = source.sparkSession.range(1).select(F.lit(kind).alias("kind"), F.lit(subject).alias("subject"), F.lit(operator).alias("operator"), F.lit(",".join(f"{k}={v}" for k, v in sorted(params.items()))).alias("parameters"))
    return ask.join(hit, F.lit(True), "left").select("kind", "subject", F.coalesce("reason", F.lit(f"no {kind} holds for {subject}")).alias("reason"), F.coalesce("evidence", F.lit("")).alias("evidence"), "operator", "parameters")

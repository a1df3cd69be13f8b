"""Validation, integrity, grounding and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import PREFIX_TYPE, RELATIONSHIP_TYPES

TYPES = tuple(PREFIX_TYPE.values())


def errors(checks: list[tuple[Column, str]]) -> Column:
    """Messages of the checks that hold, joined by "; "."""
    return F.array_join(F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks])), "; ")


def validate_entities(ents: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(entity_id, errors): type known, id well formed and of the type's prefix, name present."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.col("entity_type"))
    return ents.select("entity_id", errors([
        (prefix.isNull(), "unknown type"), (~F.col("entity_id").rlike("^[a-z]+-[0-9]{5,}$"), "malformed id"),
        (prefix.isNotNull() & ~F.col("entity_id").startswith(F.concat(prefix, F.lit("-"))), "prefix does not match"), (F.col("name").isNull() | (F.trim("name") == ""), "no name"),
    ]).alias("errors"))


def validate_relationships(rels: DataFrame) -> DataFrame:
    """(relationship_id, errors): type and confidence in range, ends present, no self-loop, a time."""
    return rels.select("relationship_id", errors([
        (~F.col("relationship_type").isin(*RELATIONSHIP_TYPES), "unknown type"), (~F.col("confidence").between(0.0, 1.0), "confidence out of range"),
        (F.col("source_id").isNull() | F.col("target_id").isNull(), "missing end"), (F.col("source_id") == F.col("target_id"), "self-loop"), (F.col("ts").isNull(), "no time"),
    ]).alias("errors"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str, name: str) -> DataFrame:
    """(link, missing): rows of child whose key has no parent."""
    lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")
    return lost.agg(F.count("*").alias("missing")).select(F.lit(name).alias("link"), "missing")


def ungrounded(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims (claim_id, reference) whose reference exists nowhere."""
    return claims.join(ids.select(F.col("id").alias("reference")).distinct(), "reference", "left_anti")


def grounding(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """(claim_id, n_references, n_unsupported, status)."""
    known = ids.select(F.col("id").alias("_id")).distinct()
    marked = claims.join(known, F.col("reference") == F.col("_id"), "left").groupBy("claim_id").agg(F.count("*").alias("n_references"), F.count_if(F.col("_id").isNull()).alias("n_unsupported"))
    return marked.withColumn("status", F.when(F.col("n_unsupported") == 0, "grounded").when(F.col("n_unsupported") < F.col("n_references"), "partial").otherwise("unsupported"))


def precision_recall(pairs: DataFrame, group: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of (expected, predicted) flags; divisions by zero give 0."""
    agg = [F.count_if(F.col("expected") & F.col("predicted")).alias("tp"), F.count_if(~F.col("expected") & F.col("predicted")).alias("fp"), F.count_if(F.col("expected") & ~F.col("predicted")).alias("fn")]
    c = pairs.groupBy(group).agg(*agg) if group else pairs.agg(*agg)
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(safe(2 * p * r, p + r), 4)})


def set_metrics(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """precision_recall() of two sets of keys by a full outer join."""
    e, p = expected.select(*keys).distinct().withColumn("_e", F.lit(True)), predicted.select(*keys).distinct().withColumn("_p", F.lit(True))
    return precision_recall(e.join(p, keys, "full").select(F.coalesce("_e", F.lit(False)).alias("expected"), F.coalesce("_p", F.lit(False)).alias("predicted")))


def latency(df: DataFrame, group: str, value: str, cells: int = 10_000) -> DataFrame:
    """n, mean, largest and upper median (element n div 2 of the sorted values) of each group.

    The median's cell among `cells` equal parts of the group's range is found from counts,
    then the median among that cell's values alone, so no group is sorted in one task.
    """
    facts = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("_low"), F.max(value).alias("max_value"), F.round(F.avg(value), 4).alias("mean"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_low"), F.col("max_value") - F.col("_low")), F.lit(0.0))
    placed = df.where(F.col(value).isNotNull()).join(facts.select(group, "_low", "max_value"), group).select(group, value, F.floor(share * (cells - 1)).alias("_cell"))
    counts = placed.groupBy(group, "_cell").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(Window.partitionBy(group).orderBy("_cell")))
    at = counts.join(facts.select(group, "n"), group).where(F.col("_upto") > F.expr("n div 2")).groupBy(group).agg(F.min(F.struct("_cell", (F.col("_upto") - F.col("_c")).alias("_before"), "n")).alias("_m")).select(group, "_m.*")
    inside = placed.join(at, [group, "_cell"]).groupBy(group, "n", "_before", value).agg(F.count("*").alias("_c"))
    run = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(group).orderBy(value)))
    median = run.where(F.col("_upto") > F.expr("n div 2")).groupBy(group).agg(F.min(value).alias("upper_median"))
    return facts.join(median, group).select(group, "n", "max_value", "mean", "upper_median")

"""Histograms and bursts over relationships with times."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly(rels: DataFrame) -> DataFrame:
    return rels.where("ts IS NOT NULL").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def keyed_times(rels: DataFrame, pseudo: tuple[str, ...] = ("CALLED", "TRANSFERRED_TO")) -> DataFrame:
    """(entity, relationship_id, us): each edge for both of its ends, and for its type where that is tracked."""
    kind = F.when(F.col("relationship_type").isin(*pseudo), F.concat(F.lit("type:"), F.col("relationship_type")))
    keys = F.array_compact(F.array(F.col("source_id"), F.col("target_id"), kind))
    return rels.where("ts IS NOT NULL").select(F.explode(keys).alias("entity"), "relationship_id", "relationship_type", micros("ts").alias("us"))


def windows(times: DataFrame, hours: int = 24) -> DataFrame:
    """(entity, win, n): edges of each entity in windows that begin with the first time of all."""
    first = times.agg(F.min("us").alias("_first"))
    return times.crossJoin(F.broadcast(first)).groupBy("entity", F.floor((F.col("us") - F.col("_first")) / (hours * 3_600_000_000)).cast("long").alias("win"), "_first").agg(F.count("*").alias("n"))


def bursts(rels: DataFrame, hours: int = 24, z: float = 2.0, pseudo: tuple[str, ...] = ("CALLED", "TRANSFERRED_TO")) -> DataFrame:
    """Windows of an entity whose count exceeds the mean of its non-empty windows by z deviations (by 1 where all are equal) and is at least 3."""
    times = keyed_times(rels, pseudo)
    first = times.agg(F.min("us").alias("_first"))
    return over_threshold(times.crossJoin(F.broadcast(first)), hours, z)


def over_threshold(times: DataFrame, hours: int = 24, z: float = 2.0) -> DataFrame:
    """bursts() of (entity, us, _first): times and where the entity's windows begin.

    Mean and deviation come from whole sums and a count is held against them in whole
    numbers, so that one equal to the threshold is no burst in whatever order rows arrive.
    """
    span = hours * 3_600_000_000
    win = times.groupBy("entity", F.expr(f"(us - _first) div {span}").alias("win"), "_first").agg(F.count("*").alias("n"))
    sums = win.groupBy("entity").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n").cast("decimal(18,0)") * F.col("n")).alias("_q")).where("k >= 2 AND total >= 3")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    base = sums.withColumn("_spread", (whole("k") * whole("_q") - whole("total") * whole("total")).cast("decimal(37,0)"))
    base = base.withColumns({"mean": F.col("total") / F.col("k"), "std": F.sqrt(F.col("_spread").cast("double")) / F.col("k")})
    over = (F.col("n") * F.col("k") - F.col("total")).cast("decimal(18,0)")
    square = F.lit(Decimal(str(z)) ** 2) * F.col("_spread")
    threshold = F.when(F.col("_spread") > 0, F.col("mean") + z * F.col("std")).otherwise(F.col("mean") + 1)
    exceeds = F.when(F.col("_spread") > 0, (over > 0) & (over * over > square)).otherwise(over > F.col("k"))
    found = win.join(base, "entity").withColumn("_t", threshold).where(exceeds & (F.col("n") >= 3))
    cents = lambda c: F.round(F.col(c) * 100) / 100
    kind = F.when(F.col("entity") == "type:CALLED", "communication_burst").when(F.col("entity") == "type:TRANSFERRED_TO", "transaction_burst").otherwise("temporal_burst")
    return found.select("entity", kind.alias("indicator_type"), "win", (F.col("_first") + F.col("win") * F.lit(span)).alias("start_us"), F.col("n").alias("observed"), cents("mean").alias("mean"), cents("std").alias("std"), cents("_t").alias("threshold"))


def burst_evidence(rels: DataFrame, found: DataFrame, hours: int = 24, k: int = 5, pseudo: tuple[str, ...] = ("CALLED", "TRANSFERRED_TO")) -> DataFrame:
    """The first k edges of each burst by (time, id): an equi-join on entity and window, for a type only its own edges."""
    times = keyed_times(rels, pseudo)
    first = times.agg(F.min("us").alias("_first"))
    placed = times.crossJoin(F.broadcast(first)).select("entity", F.expr(f"(us - _first) div {hours * 3_600_000_000}").alias("win"), "relationship_id", "us")
    hit = placed.join(found.select("entity", "win"), ["entity", "win"])
    w = Window.partitionBy("entity", "win").orderBy("us", "relationship_id")
    return hit.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("entity", "win", "position", "relationship_id")


def top_bursts(rels: DataFrame, k: int = 20) -> DataFrame:
    return bursts(rels).orderBy(F.desc("observed"), "win", "entity").limit(k)

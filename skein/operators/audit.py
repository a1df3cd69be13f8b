"""Audit log: append, bounded retention, filters, pages; evidence hash chain."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import SECRET_KEYS, short_hash


def with_ids(events: DataFrame, parts: list[str], order: str, width: int = 100_000) -> DataFrame:
    """events with audit_id: hash of the parts, and -1, -2... for repeats in order of the integer column `order`.

    Repeats are numbered within runs of `width` arrivals, whose counts before are added, so
    that the log of one busy source is not numbered in one task.
    """
    hashed = events.withColumns({"_h": short_hash(*[F.col(p) for p in parts]), "_run": F.expr(f"{order} div {width}")})
    runs = hashed.groupBy("_h", "_run").agg(F.count("*").alias("_c"))
    before = runs.select("_h", "_run", F.coalesce(F.sum("_c").over(Window.partitionBy("_h").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_h", "_run").orderBy(order)) - 1
    numbered = hashed.withColumn("_own", own).join(before, ["_h", "_run"]).withColumn("_n", F.col("_own") + F.col("_before"))
    return numbered.withColumn("audit_id", F.concat(F.lit("aud-"), "_h", F.when(F.col("_n") > 0, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""))).drop("_h", "_run", "_own", "_before", "_n")


def latest(events: DataFrame, order: str, bound: int = 1000) -> DataFrame:
    """The last `bound` events by arrival: a top-k, not a sort of all."""
    return events.orderBy(F.desc(order)).limit(bound)


def query(events: DataFrame, *, equal: dict[str, str | None], since: str | None = None, until: str | None = None, ts: str = "ts") -> DataFrame:
    """Events that meet all filters that are given."""
    for name, value in equal.items():
        if value is not None:
            events = events.where(F.col(name) == value)
    if since is not None:
        events = events.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        events = events.where(F.col(ts) <= F.lit(until).cast("timestamp_ntz"))
    return events


def page(events: DataFrame, offset: int, limit: int, ts: str = "ts", key: str = "audit_id") -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be in 1..100")
    return events.orderBy(ts, key).offset(offset).limit(limit)


def sanitised(params: Column) -> Column:
    """A map of strings without secret keys, values of at most 50 characters."""
    kept = F.map_filter(params, lambda k, _: ~F.lower(k).isin(*SECRET_KEYS))
    return F.transform_values(kept, lambda _, v: F.substring(v, 1, 50))


def typed_parameters(params: Column) -> Column:
    """A JSON object without secret keys, as a map of JSON texts: scalars as they are, lists of up to five as texts of at most 50
    characters, other lists and objects as <type:length of their JSON>. What is no JSON object gives null."""
    fields = F.try_parse_json(params).try_cast("map<string,variant>") if hasattr(Column, "try_cast") else F.try_parse_json(params).cast("map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: ~F.lower(k).isin(*SECRET_KEYS))

    def shown(_: Column, v: Column) -> Column:
        kind, text = F.schema_of_variant(v), F.to_json(v)
        listed = v.try_cast("array<string>")
        short = F.to_json(F.transform(listed, lambda x: F.substring(x, 1, 50)))
        name = F.when(kind.startswith("ARRAY"), "list").otherwise("dict")
        return F.when(kind.startswith("ARRAY") & (F.size(listed) <= 5), short).when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.concat(F.lit("<"), name, F.lit(":"), F.length(text).cast("string"), F.lit(">"))).otherwise(text)

    return F.transform_values(kept, shown)


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring(text, 1, 200)), "(" + "|".join(SECRET_KEYS) + ")", "[redacted]")


def block_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def chained(blocks: DataFrame, order: str, data: str, log: str) -> DataFrame:
    """blocks with prev_hash and hash, each from the one before in its log.

    Logs are dealt over the partitions and sorted there; a task passes over its rows batch
    by batch and remembers the last hash alone. A chain is sequential by definition, so
    one log is one task's.
    """
    import hashlib

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, before = None, "0" * 64
        for part in parts:
            prev, own = [], []
            for of, key, value in zip(part[log], part[order], part[data]):
                if of != name:
                    name, before = of, "0" * 64
                prev.append(before)
                before = hashlib.sha256(f"{key}|{value}|{before}".encode()).hexdigest()
                own.append(before)
            yield part.assign(prev_hash=prev, hash=own)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.repartition(log).sortWithinPartitions(log, order).mapInPandas(run, f"{schema}, prev_hash string, hash string")


def verify(blocks: DataFrame, order: str, data: str, log: str) -> DataFrame:
    """(key, hash_ok, link_ok) of each block, the first of a log included; logs are checked apart and in parallel."""
    w = Window.partitionBy(log).orderBy(order)
    own = block_hash(F.col(order).cast("string"), F.col(data), F.col("prev_hash"))
    return blocks.select(F.col(order), (F.col("hash") == own).alias("hash_ok"), (F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit("0" * 64))).alias("link_ok"))

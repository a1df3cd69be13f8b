"""JSON collections, upserts and a deterministic generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions.scalar import PREFIX_TYPE


def read_collections(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """One DataFrame a collection from <folder>/<name>.json, an array of records each, under fixed schemas."""
    return {name: spark.read.schema(StructType.fromDDL(ddl)).option("multiLine", True).json(f"{folder}/{name}.json") for name, ddl in schemas.items() if not name.startswith("_")}


def write_collection(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def key_index(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(entity_id, entity_type, key): entity type to (table, id column, key column)."""
    out = None
    for kind, (df, eid, key) in parts.items():
        one = df.select(F.col(eid).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(key).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def upsert(target: DataFrame, batch: DataFrame, key: str, kept: tuple[str, ...] = ("created_at",), arrival: str | None = None) -> DataFrame:
    """Target after the batch: known keys replaced but for the kept columns, new ones added; rows without a key are left out.

    Of repeated keys in a batch the row of the greatest `arrival` column (of the batch
    alone) wins; without one, the greatest row by its columns that can be ordered.
    """
    rest = [c for c in batch.columns if c not in (key, arrival)]
    plain = [f.name for f in batch.schema if f.name in rest and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    order = F.struct(arrival, *plain) if arrival else F.struct(F.lit(0).alias("_0"), *plain)
    last = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    old = target.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in kept])
    fresh = last.join(old, F.col(key) == F.col("_k"), "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in rest])
    return target.join(last.select(key), key, "left_anti").unionByName(fresh)


def upsert_counts(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row: inserted, updated, and rows without a key as errors."""
    ids = batch.where(F.col(key).isNotNull()).select(key).distinct().join(target.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    return ids.agg(F.count_if(F.col("_k").isNull()).alias("inserted"), F.count_if(F.col("_k").isNotNull()).alias("updated")).crossJoin(F.broadcast(batch.agg(F.count_if(F.col(key).isNull()).alias("errors"))))


def store_entities(ents: DataFrame, path: str) -> None:
    """Entities as a table partitioned by their type."""
    ents.write.mode("overwrite").partitionBy("entity_type").parquet(path)


def stored_entity(spark: SparkSession, path: str, entity: str, types: dict[str, str] = PREFIX_TYPE) -> DataFrame:
    """The rows of one id in a table of store_entities(): a known prefix reads that type's partition alone, another one probes all."""
    kind = types.get(entity.split("-", 1)[0])
    rows = spark.read.parquet(path)
    rows = rows if kind is None else rows.where(F.col("entity_type") == kind)
    return rows.where(F.col("entity_id") == entity)


def merged_properties(old: str, new: str) -> F.Column:
    """Properties of a node after new ones are set over the old ones."""
    return F.map_from_entries(F.array_union(F.map_entries(F.map_filter(F.col(old), lambda k, _: ~F.array_contains(F.map_keys(F.col(new)), k))), F.map_entries(F.col(new))))


def valid_edges(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """Edges with both ends known and no self-loop; of one id the last by (ts, source, target)."""
    ids = ents.select(F.col("entity_id").alias("_id"))
    ok = rels.where("source_id <> target_id").join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("target_id") == F.col("_id"), "left_semi")
    w = Window.partitionBy("relationship_id").orderBy(F.desc("ts"), F.desc("source_id"), F.desc("target_id"))
    return ok.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def generate(spark: SparkSession, seed: int = 42, per_type: int = 25, n_relationships: int = 446) -> tuple[DataFrame, DataFrame]:
    """Entities of every type and relationships among them, pseudo-random from hashes of the seed: the same rows on any cluster."""
    kinds = F.array(*[F.lit(k) for k in PREFIX_TYPE])
    n = len(PREFIX_TYPE)
    ents = spark.range(n * per_type).select(F.element_at(kinds, (F.col("id") % n + 1).cast("int")).alias("_p"), F.expr(f"id div {n}").alias("_n"), F.col("id"))
    ents = ents.select(F.format_string("%s-%05d", "_p", F.col("_n") + 1).alias("entity_id"), F.element_at(F.create_map(*[F.lit(x) for kv in PREFIX_TYPE.items() for x in kv]), F.col("_p")).alias("entity_type"), F.concat(F.lit("Fictional "), F.hex(F.xxhash64(F.lit(seed), "id"))).alias("name"))

    def pick(salt: int, modulus: int) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(modulus))

    account = lambda salt: F.format_string("account-%05d", pick(salt, per_type) + 1)
    rels = spark.range(n_relationships).select(F.format_string("rel-%05d", F.col("id") + 1).alias("relationship_id"), account(1).alias("source_id"), account(2).alias("target_id"), F.lit("TRANSFERRED_TO").alias("relationship_type"), F.timestamp_seconds(F.lit(1_700_000_000) + pick(3, 730 * 86400)).cast("timestamp_ntz").alias("ts"), (F.lit(0.5) + pick(4, 50) / 100).alias("confidence"))
    return ents, rels.where("source_id <> target_id")

"""Several tables under one commit: all of a version's tables become visible at once, or none does.

A commit writes each table to a folder of its own and then appends one row to the manifest, a
single file that Spark's writer moves into place when it is whole. The row names the
folders of all tables. Readers take the row of the highest version, so a writer that dies
before that move leaves the version before it live, and its folders unread.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, id string, tables map<string,string>"


def _rows(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def live(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The live version and its tables' folders; 0 and none before the first commit. Of two commits of one version the smaller id is live."""
    row = _rows(spark, root).orderBy(F.desc("version"), "id").first()
    return (row["version"], row["tables"]) if row else (0, {})


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the live version."""
    version, tables = live(spark, root)
    if name not in tables:
        raise KeyError(f"version {version} of {root} has no table {name}")
    return spark.read.parquet(tables[name])


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write the tables as the next version, with the live version's other tables; its number. A commit that another one outran is an error and changes nothing."""
    version, others = live(spark, root)
    own = uuid.uuid4().hex
    places = {name: f"{root}/data/{own}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(places[name])
    _publish(spark, root, version + 1, own, {**others, **places})
    first = _rows(spark, root).where(F.col("version") == version + 1).orderBy("id").first()
    if first["id"] != own:
        raise RuntimeError(f"version {version + 1} of {root} was committed by another writer")
    return version + 1


def _publish(spark: SparkSession, root: str, version: int, own: str, places: dict[str, str]) -> None:
    spark.createDataFrame([(version, own, places)], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")


def import_graph(spark: SparkSession, root: str, ents: DataFrame, rels: DataFrame) -> int:
    """One commit of entities, relationships whose ends are both known, and rejected rows with their reason; the version's number.

    Of rows with one id the smallest by their other columns stays. Entities without an id,
    relationships without an id, with an unknown end or from an entity to itself are rejected.
    """
    def one(df: DataFrame, key: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])

    kept = one(ents, "entity_id")
    ids = kept.select("entity_id")
    known = rels.join(ids.select(F.col("entity_id").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(ids.select(F.col("entity_id").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left")
    reason = F.when(F.col("relationship_id").isNull(), "no id").when(F.col("_s").isNull(), "unknown source").when(F.col("_t").isNull(), "unknown target").when(F.col("source_id") == F.col("target_id"), "self-loop")
    marked = known.withColumn("_reason", reason)
    edges = one(marked.where("_reason IS NULL").select(rels.columns), "relationship_id")
    bad = marked.where("_reason IS NOT NULL").select(F.col("relationship_id").alias("row_id"), F.col("_reason").alias("reason"))
    bad = bad.unionByName(ents.where("entity_id IS NULL").select(F.lit(None).cast("string").alias("row_id"), F.lit("no id").alias("reason")))
    return commit(spark, root, {"entities": kept, "relationships": edges, "rejected": bad})

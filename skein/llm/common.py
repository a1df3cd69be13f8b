"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at a time, so that a batch of long texts stays small.
SLICE = 256


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the folder that all machines share and cut its lineage.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a temporary
    folder takes its place if the session runs on this machine alone, as in tests; on a
    cluster other machines would not see it, so that is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from spark.checkpoint.dir if it is not yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df written as a Parquet table of its own in the shared folder, and reread: like cut(), for wide rows of text that compress well."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, null texts as empty ones; other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def per_document(docs: DataFrame, rows: Callable[[list, list], dict[str, list]], schema: str, prepare: Callable[[], None] | None = None) -> DataFrame:
    """Apply rows(ids, texts) -> columns to (doc_id, text), a slice of rows at a time, partition by partition."""
    from pyspark.sql.types import StructType

    target = _arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if prepare:
            prepare()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = rows(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return docs.mapInArrow(run, schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def salted_join(many: DataFrame, unique: DataFrame, key: str, size: str, how: str = "inner", slots: int = 1024) -> DataFrame:
    """Join many to unique on key, where unique has one row a key and its number of rows in `many` as column `size`.

    A key with more than 1/slots of all rows is dealt over several salts. At most
    `slots` keys can be that frequent, so their list is broadcast safely whatever the
    input's size; no task gets much more than 1/slots of the rows of hot keys.
    """
    total = unique.agg(F.sum(size)).first()[0] or 0
    most = total // slots + 1
    hot = unique.where(F.col(size) > most).select(key, F.ceil(F.col(size) / F.lit(most)).cast("int").alias("_salts"))
    left = many.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.col("_salts")).cast("int"))).drop("_salts")
    salts = F.sequence(F.lit(0), F.when(F.col(size) > most, F.ceil(F.col(size) / F.lit(most)).cast("int") - 1).otherwise(0))
    right = unique.withColumn("_salt", F.explode(salts))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hub_join(many: DataFrame, unique: DataFrame, key: str, size: str, total: int, slots: int = 1024) -> DataFrame:
    """Join many to unique on key, where unique has one small row a key and its number of rows in `many` as column `size`; total: rows of many, or more.

    Keys with more than 1/slots of the rows, of which there are at most `slots`, are
    broadcast with their columns and need no shuffle; the others are joined by key.
    """
    hot = F.broadcast(unique.where(F.col(size) > total // slots + 1))
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(unique.where(F.col(size) <= total // slots + 1), key)
    return many.join(hot, key).unionByName(rest).drop(size)


class Remembering(dict):
    """Results of compute(key) by short keys, in two generations of at most `limit`: what was not asked for in a whole generation is forgotten."""

    def __init__(self, compute: Callable, limit: int, longest: int) -> None:
        super().__init__()
        self.compute, self.limit, self.longest, self.older = compute, limit, longest, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found

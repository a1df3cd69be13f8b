"""Operator 5: exact duplicates, by DataFrame operations alone.

Rows are grouped by a 128-bit hash of the text *and* by the text itself, so that the
bytes are compared inside each hash group and a collision cannot merge two texts. The
grouping is aggregated before the shuffle: however many copies a text has, each map
task ships it once. Only (hash, smallest or largest id, count) leaves that shuffle; the
documents are joined to it by hash, frequent hashes salted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, id_and_text, salted_join, table


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of equal texts stays. A null text counts as empty
    and so equals other null and empty texts. Null ids never stay unless a group has no
    other (keep_id is then null and its rows are kept). Repeated rows with one id count
    each in group_size and share their mark. An empty table gives an empty result; other
    columns, whatever their names, are not read. hash_of is for tests of collisions.
    """
    pick = F.min if keep == "smallest" else F.max
    base = id_and_text(docs, id_col, text_col).withColumn("_hash", hash_of(F.col("text")))
    groups = cut(base.groupBy("_hash", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select("_hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    shared = groups.groupBy("_hash").count().where("count > 1").select("_hash")
    if shared.limit(1).count():  # two texts with one hash: these groups are joined by their bytes
        clashing = base.join(shared, "_hash", "left_semi")
        exact = clashing.groupBy("text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        exact = salted_join(clashing.select("doc_id", "text"), exact, "text", "group_size").withColumn("text_sha256", F.sha2("text", 256)).drop("text")
        base, groups = base.join(shared, "_hash", "left_anti"), groups.join(shared, "_hash", "left_anti")
    else:
        exact = None
    out = salted_join(base.select("doc_id", "_hash"), groups, "_hash", "group_size").drop("_hash")
    out = out if exact is None else out.unionByName(exact)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def deduplicated(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each group of equal texts, that of the smallest or largest id; columns as they were.

    Null and empty texts are one group. A null id stays only in a group without others. Of
    rows with one id and one text, the one whose plain columns hash lowest stays. An
    empty table gives an empty result. Rows are aggregated before the shuffle, each text
    being shipped once by a map task.
    """
    others = [c for c in docs.columns if c != text_col]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.name in others and f.dataType.typeName() not in ("map", "struct", "array", "variant")]
    sign = F.lit(1 if keep == "smallest" else -1)
    row = F.struct(F.col(f"`{text_col}`").isNull().alias("_none"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
    order = F.struct(F.col(f"`{id_col}`").isNull(), sign * F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.lit(0), *plain))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kept = docs.select(content_hash(text).alias("_hash"), text.alias("_text"), row.alias("_row"), order.alias("_order")).groupBy("_hash", "_text").agg(F.min_by("_row", "_order").alias("_row"))
    at = {c: f"_{i}" for i, c in enumerate(others)}
    return kept.select(*[F.when(~F.col("_row._none"), F.col("_text")).alias(c) if c == text_col else F.col(f"_row.{at[c]}").alias(c) for c in docs.columns])

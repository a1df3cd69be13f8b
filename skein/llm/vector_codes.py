"""Operator 12: product codes of integer vectors.

Vectors are scaled to integers and cut into parts, each with a codebook of its own. The
codebooks are small arrays that go to every task. Arrow batches take the distances of all
parts to all entries at once: |x|^2 - 2 x.y + |y|^2, by one matrix product a part, the first
smallest one winning. Products are exact: they run in float64 where every partial sum is an
integer under 2^53, else in int64, and vectors beyond that are refused. Each task adds up
the parts of each entry, a grouped shuffle merges these sums, and the driver divides
them: a round moves one row a task and entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, hub_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances are held at once.
BLOCK = 4096


def edges(size: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end, as equal as its size allows."""
    return [i * size // parts for i in range(parts + 1)]


def exact_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers, exactly."""
    high = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * high * high * x.shape[1] < 2**53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry of the book, the first of equal ones, and the squared distance."""
    d = (x * x).sum(axis=1)[:, None] - 2 * exact_product(x, book) + (book * book).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def integers(column: pa.Array, size: int, scale: int = SCALE) -> np.ndarray:
    """Scaled rows of a list column; rows of other sizes are not allowed."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(size, 1) if size else 0)
    scaled = np.floor(flat * scale)
    if 4 * float(np.abs(scaled).max(initial=0)) ** 2 * max(size, 1) >= 2**63:
        raise OverflowError("components too large for squared distances of 64 bits")
    return scaled.astype(np.int64)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has neither nulls nor components that are not finite."""
    odd = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~odd)


def _size(kept: DataFrame) -> int:
    """The most frequent number of components, the larger of equal ones."""
    found = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def trained(kept: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks of (vec_id, vector) rows of one size, after `rounds` rounds from the smallest ids on."""
    spark, cuts = kept.sparkSession, edges(size, parts)
    first = kept.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(entries).collect()  # `entries` rows at most
    start = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), size, scale) if first else np.zeros((0, size), dtype=np.int64)
    books = [start[:, a:b] for a, b in zip(cuts, cuts[1:])]
    width = max((b - a for a, b in zip(cuts, cuts[1:])), default=0)
    names = [f"s{i}" for i in range(width)]
    for _ in range(rounds if len(start) else 0):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts, totals = np.zeros((parts, len(start)), dtype=np.int64), np.zeros((parts, len(start), width), dtype=np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    x = integers(batch.column(0).slice(at, BLOCK), size, scale)
                    for p, book in enumerate(sent.value):
                        own = x[:, cuts[p] : cuts[p + 1]]
                        codes, _ = nearest(own, book)
                        counts[p] += np.bincount(codes, minlength=len(book))
                        np.add.at(totals[p][:, : own.shape[1]], codes, own)
            part, entry = np.nonzero(counts)
            columns = [part, entry, counts[part, entry], *totals[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *names])

        schema = ", ".join(["part long", "entry long", "n long", *(f"{s} long" for s in names)])
        merged = kept.select("vector").mapInArrow(sums, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        books = [b.copy() for b in books]
        for r in merged.collect():  # parts * entries rows at most
            book = books[r["part"]]
            book[r["entry"]] = [r[s] // r["n"] for s in names[: book.shape[1]]]
        sent.unpersist()
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each usable row of vectors: vec_id, code, error, label_error, codebooks_sha256.

    Rows are left out whose vector is null or has a null or non-finite component. The size
    of the vectors is the most frequent one (the larger of equally frequent ones); rows of
    other sizes have no part in the codebooks, and null code and error. A size that `parts`
    does not divide gives parts that differ by one. Codebooks start with the smallest ids,
    of equal ids the smallest vector; null ids are coded but never start one. Fewer rows
    than `entries` make smaller codebooks; without any start rows codes and errors are null.
    Repeated rows count each. label_error sums over equal labels, nulls together. An empty
    table gives an empty result; other columns are not read. Components beyond what
    squared distances in 64 bits can hold are an error.
    """
    kept = usable(vectors, f"`{vector_col}`").select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.coalesce(F.concat(F.lit("="), F.col(f"`{label_col}`").cast("string")), F.lit("-")).alias("_label"))
    kept = cut(kept.withColumn("vector", F.col("vector").cast("array<float>")) if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else kept)
    size, digits = _size(kept), max(2, len(f"{entries - 1:x}"))
    same, others = kept.where(F.size("vector") == size), kept.where(F.size("vector") != size)
    books, cuts = trained(same, size, parts, entries, rounds, scale), edges(size, parts)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, column, labels = (c.slice(at, BLOCK) for c in batch.columns)
                x = integers(column, size, scale)
                found = [nearest(x[:, cuts[p] : cuts[p + 1]], book) for p, book in enumerate(sent.value)]
                code = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(c.tolist() for c, _ in found))]
                error = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([ids, pa.array(code, pa.string()), pa.array(error, pa.int64()), labels], names=["vec_id", "code", "error", "_label"])

    blank = lambda rows: rows.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "_label")
    coded = same.mapInArrow(codes, "vec_id long, code string, error long, _label string") if len(books[0]) else blank(same)
    coded = cut(coded.unionByName(blank(others)))
    labels = cut(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    total = labels.agg(F.sum("_n")).first()[0] or 0
    return hub_join(coded, labels, "_label", "_n", total).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int, parts: int = PARTS) -> str:
    """Assignment k of every part to book{k}, and the entries that follow."""
    return f"""
code{k} AS MATERIALIZED (
  SELECT row, part, any_value(v) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.row, x.part, x.v, b.entry, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) AS d FROM parts x JOIN book{k} b ON x.part = b.part)
  GROUP BY row, part
),
mean{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS v FROM (
    SELECT part, entry, i, floor(sum(v[i]) / count(*)) AS m FROM code{k}, range(1, 17) t(i) WHERE i <= len(v) GROUP BY part, entry, i) GROUP BY part, entry
),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry)"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT row, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM kept, range(4) t(part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= 256),
{",".join(_round_sql(k) for k in range(ROUNDS))},
{_round_sql(ROUNDS).split("mean4 AS")[0].rstrip().rstrip(",")},
books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book{ROUNDS})),
coded AS (SELECT row, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM code{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row) CROSS JOIN books
"""

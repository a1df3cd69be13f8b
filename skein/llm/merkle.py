"""Operator 11: a Merkle manifest of a dataset in an external-memory node store.

Every row becomes a leaf digest. Leaves are sorted by tree and id in runs (range
partitions, written as Parquet), whose sizes give each leaf its place in its tree. The
store is one Parquet table partitioned by level. Nodes of one level that lie below the
same node SPAN levels higher make a chunk of at most FANOUT**SPAN nodes; a round reads one
level, streams each chunk in order and writes the levels above it, so that the number of
shuffles is the tree's height over SPAN and no task holds more than a chunk. The roots of
all trees are the leaves of one more tree, made the same way.

Proofs are read from the store from the top down: a round merges the path of a chunk's
top with the chunk's nodes of all its levels, sorted by their coordinates (level,
position), and gives each node of its lowest level the siblings on its way up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.llm.common import _arrow_schema, saved, shared_folder, table

FANOUT, SPAN = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, pos long, n long, digest string, level int"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def framed(*values: Column) -> Column:
    """The values in a row, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    as_text = [v.cast("string") for v in values]
    return F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in as_text])


def height(n: Column) -> Column:
    """Levels above n leaves."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(40)), F.lit(0))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows plus pos, the place in its `tree` by the columns of `order` (rows equal in them in any order), and n, the rows of the tree."""
    keys = ["tree", *order, "_tie"]
    runs = saved(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_run", F.shiftright("_at", 33)))
    of_tree = Window.partitionBy("tree")
    starts = runs.groupBy("tree", "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_size")).withColumn("n", F.sum("_size").over(of_tree))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_size").over(of_tree.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = runs.join(starts, ["tree", "_run"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return saved(out.select(*rows.columns, "pos", "n"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _chunk(level: int, base: int) -> Column:
    """Number of the chunk, in the round that begins at level `base`, of a node on `level`."""
    return F.floor(F.col("pos") / F.lit(FANOUT ** (base + SPAN - level))).cast("long") if base + SPAN > level else F.col("pos")


def climb(nodes: DataFrame, base: int) -> DataFrame:
    """Nodes of the SPAN levels above `nodes`, those of level `base` in trees that have more than one there."""
    schema = _arrow_schema(StructType.fromDDL(NODES))

    def above(tree: str, chunk: int, n: int, own: list[str]) -> Iterator[tuple]:
        first = chunk * FANOUT**SPAN
        for level in range(base + 1, base + SPAN + 1):
            own = [digest("".join(own[i : i + FANOUT])) for i in range(0, len(own), FANOUT)]
            first, n = first // FANOUT, -(-n // FANOUT)
            for i, d in enumerate(own):
                yield tree, first + i, n, d, level
            if n == 1:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, own = [], None, []
        for tree, chunk, n, d in _rows(batches):
            if (tree, chunk, n) != at:
                if at:
                    out += above(*at, own)
                at, own = (tree, chunk, n), []
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            own.append(d)
        out += above(*at, own) if at else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    chunked = nodes.where("n > 1").withColumn("chunk", _chunk(base, base))
    return chunked.repartition("tree", "chunk").sortWithinPartitions("tree", "pos").select("tree", "chunk", "n", "digest").mapInArrow(run, NODES)


class Store:
    """Nodes of all levels over `leaves` (tree, pos, n, digest and more), a Parquet table partitioned by level."""

    def __init__(self, leaves: DataFrame) -> None:
        self.leaves, self.spark = leaves, leaves.sparkSession
        self.path = f"{shared_folder(self.spark)}/nodes-{uuid.uuid4().hex}"
        self.bases = range(0, (leaves.agg(F.max(height(F.col("n")))).first()[0] or 0), SPAN)
        for base in self.bases:
            climb(self.level(base), base).write.mode("append").partitionBy("level").parquet(self.path)

    def level(self, k: int) -> DataFrame:
        if k == 0:
            return self.leaves.select("tree", "pos", "n", "digest")
        return self.inner().where(F.col("level") == k).drop("level")

    def inner(self) -> DataFrame:
        if not self.bases:
            return self.spark.createDataFrame([], NODES)
        return self.spark.read.schema(NODES).parquet(self.path)

    def roots(self) -> DataFrame:
        """(tree, n, digest): the root of each tree and the tree's leaves."""
        top = self.leaves.where("n = 1").select("tree", "digest").unionByName(self.inner().where("n = 1").select("tree", "digest"))
        return top.join(self.leaves.where("pos = 0").select("tree", "n"), "tree")

    def paths(self, tops: DataFrame, payload: list[str], finish: Callable[[dict, str, tuple | None, list], tuple], schema: str) -> DataFrame:
        """finish(payload, digest, path, marks) of each leaf, rows of `schema`.

        tops: (tree, n, lefts, rights, marks), the siblings above each tree's root, from the
        lowest level on, and what finish() is given for all leaves of the tree. A path is a
        linked list of (left siblings, right siblings, rest), from the leaf up; None ends it.
        """
        entry = tops.withColumn("_base", F.when(F.col("n") > 1, F.floor((height(F.col("n")) - 1) / SPAN) * SPAN).otherwise(0)).withColumn("chunk", F.lit(0).cast("long"))
        from_above, names = None, ["tree", "chunk", "lefts", "rights", "marks"]
        for base in reversed(self.bases or range(1)):
            paths = entry.where(F.col("_base") == base).select(names)
            paths = paths if from_above is None else paths.unionByName(from_above)
            if base:
                from_above = saved(self._descend(paths, base, [], _links, "tree string, chunk long, lefts array<string>, rights array<string>, marks array<string>"))
        return self._descend(paths, 0, payload, finish, schema)

    def _descend(self, paths: DataFrame, base: int, payload: list[str], finish: Callable, schema: str) -> DataFrame:
        target = _arrow_schema(StructType.fromDDL(schema))
        at_base = (self.leaves if base == 0 else self.level(base).where("n > 1")).select("tree", "pos", "digest", F.struct(F.lit(base).alias("_base"), *payload).alias("payload"))
        kind = at_base.schema["payload"].dataType
        nodes = at_base.select("tree", _chunk(base, base).alias("chunk"), F.lit(base).alias("level"), "pos", "digest", "payload")
        for level in range(base + 1, base + SPAN if self.bases else 0):
            inner = self.level(level).where("n > 1")
            nodes = nodes.unionByName(inner.select("tree", _chunk(level, base).alias("chunk"), F.lit(level).alias("level"), "pos", "digest", F.lit(None).cast(kind).alias("payload")))
        merged = paths.withColumn("level", F.lit(base + SPAN)).unionByName(nodes, allowMissingColumns=True)
        merged = merged.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", F.desc("level"), "pos").select("tree", "chunk", "level", "pos", "digest", "payload", "lefts", "rights", "marks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, key, marks = [], None, []
            levels: dict[int, list] = {}

            def done() -> Iterator[tuple]:
                links = levels.pop(base + SPAN)
                for level in range(base + SPAN - 1, base - 1, -1):
                    own = levels.get(level)
                    if own is None:
                        continue
                    ds = [d for _, d, _ in own]
                    if len(ds) > 1 or level > base or alone is False:
                        links = [("".join(ds[i - i % FANOUT : i]), "".join(ds[i + 1 : i - i % FANOUT + FANOUT]), links[i // FANOUT]) for i in range(len(ds))]
                for (pos, d, load), link in zip(levels[base], links):
                    yield finish({**(load or {}), "_tree": key[0], "_pos": pos}, d, link, marks)

            alone = None
            for tree, chunk, level, pos, d, load, lefts, rights, told in _rows(batches):
                if (tree, chunk) != key:
                    if key:
                        out += done()
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
                        out = []
                    key, levels = (tree, chunk), {}
                if level == base + SPAN:
                    link = None
                    for a, b in zip(reversed(lefts), reversed(rights)):
                        link = (a, b, link)
                    # a chunk of one leaf is a tree of its own only if the tree has no other
                    levels[level], marks = [link], told[1:]
                    alone = told[0] == "1"
                else:
                    levels.setdefault(level, []).append((pos, d, load))
            out += done() if key else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

        return merged.mapInArrow(run, schema)


def _links(load: dict, d: str, path: tuple | None, marks: list) -> tuple:
    lefts, rights = [], []
    while path:
        lefts.append(path[0])
        rights.append(path[1])
        path = path[2]
    return load["_tree"], load["_pos"], lefts, rights, ["0", *marks]


def folded(d: str, path: tuple | None) -> str:
    """The root over a leaf's digest and its path."""
    while path:
        d = digest(path[0] + d + path[1])
        path = path[2]
    return d


def siblings(path: tuple | None) -> str:
    out = []
    while path:
        out += path[:2]
        path = path[2]
    return "".join(out)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", altered: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of framed(fields). The leaves of a tree (rows of one tree_col,
    nulls a tree of their own) ascend by id, null ids first, equal ids by leaf; repeated
    rows are leaves each. FANOUT neighbours at a time become a node until one is left, the
    subroot; subroots ordered by tree_col (null first, bytewise) make root likewise. A
    proof is the siblings of a leaf's way to the root. altered: what to put in place of the
    last field, to see whether a changed row is noticed; folded_root is the root over the
    leaf so changed and the true siblings. Null and empty texts differ. An empty table gives
    an empty result; columns that are not named are not read.
    """
    named = [F.col(f"`{c}`") for c in fields]
    changed = F.lit(None).cast("string") if altered is None else F.when(~altered.eqNullSafe(named[-1]), F.sha2(framed(*named[:-1], altered), 256))
    of = F.col(f"`{tree_col}`").cast("string")
    tree = F.when(of.isNull(), "-").otherwise(F.concat(F.lit("="), of))  # nulls first, then bytewise
    leaves = placed(saved(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(framed(*named), 256).alias("digest"), changed.alias("altered"))), ["doc_id", "digest"])
    store = Store(leaves)
    trees = store.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), "digest")
    over = Store(placed(trees, ["name"]))
    no_path = F.array().cast("array<string>")
    top = over.roots().select("tree", "n", no_path.alias("lefts"), no_path.alias("rights"), F.array(F.when(F.col("n") == 1, "1").otherwise("0")).alias("marks"))

    def of_tree(load: dict, d: str, path: tuple | None, marks: list) -> tuple:
        _, _, lefts, rights, _ = _links(load, d, path, marks)
        return load["name"], load["leaves"], lefts, rights, ["1" if load["leaves"] == 1 else "0", d, folded(d, path)]

    tops = saved(over.paths(top, ["name", "leaves"], of_tree, "tree string, n long, lefts array<string>, rights array<string>, marks array<string>"))

    def of_leaf(load: dict, d: str, path: tuple | None, marks: list) -> tuple:
        found = folded(load["altered"] or d, path)
        return load["doc_id"], d, marks[0], marks[1], digest(siblings(path)), found, found == marks[1]

    return store.paths(tops, ["doc_id", "altered"], of_leaf, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), altered=F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


_FRAMED = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"


def _tree_sql(name: str, leaves: str) -> str:
    """Recursive tables {name}_nodes (tree, level, pos, h, n), {name}_runs and {name}_way (item, level, pos, siblings so far, folded from the altered leaf)."""
    return f"""
{name}_nodes AS (
  SELECT tree, 0 AS level, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, level, pos, h, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, level + 1 AS level, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, pos // 3)
),
{name}_sides AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name}_nodes a JOIN {name}_nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos
),
{name}_way AS (
  SELECT item, tree, 0 AS level, pos, '' AS proof, changed AS h FROM {leaves}
  UNION ALL
  SELECT w.item, w.tree, w.level + 1, w.pos // 3, w.proof || s.l || s.r, sha256(s.l || w.h || s.r) FROM {name}_way w JOIN {name}_sides s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos
)"""


ORACLE_SQL = f"""
WITH RECURSIVE leafs AS (
  SELECT row_number() OVER () AS item, doc_id, coalesce('=' || source, '-') AS tree, sha256({_FRAMED} || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS h,
         sha256({_FRAMED} || CASE WHEN text IS NULL THEN '-' ELSE strlen(changed_text) || ':' || changed_text END) AS changed
  FROM (SELECT *, CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed_text FROM documents)
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leafs),
{_tree_sql("doc", "leaves")},
subroots AS (SELECT tree AS item, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, h AS changed FROM doc_nodes WHERE n = 1),
{_tree_sql("top", "subroots")},
root AS (SELECT h AS root FROM top_nodes WHERE n = 1),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY level DESC) AS k FROM doc_way) WHERE k = 1),
top_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY level DESC) AS k FROM top_way) WHERE k = 1),
again AS (
  SELECT l.item, l.tree AS source_tree, 0 AS level, s.pos, l.h FROM last l JOIN subroots s ON s.item = l.tree
  UNION ALL
  SELECT a.item, a.source_tree, a.level + 1, a.pos // 3, sha256(t.l || a.h || t.r) FROM again a JOIN top_sides t ON t.level = a.level AND t.pos = a.pos
),
ended AS (SELECT item, arg_max(h, level) AS h FROM again GROUP BY item)
SELECT v.doc_id, v.h AS leaf, s.h AS subroot, root, sha256(l.proof || t.proof) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM leaves v JOIN last l USING (item) JOIN subroots s ON s.item = v.tree JOIN top_last t ON t.item = v.tree JOIN ended e ON e.item = v.item CROSS JOIN root
"""

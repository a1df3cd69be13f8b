"""Operator 7: SimHash near-duplicates through pivot distance tables.

Each distinct fingerprint gets a table of its Hamming distances to PIVOTS reference
fingerprints, and to the copies of each reference in which one of SEGMENTS runs of bits is
flipped. Half of what those two distances differ by, plus half the run's length, is the
distance within the run. For two fingerprints within `radius` bits, the largest coordinate
difference of a run is at most the number of bits that differ there, so those maxima add up
to at most `radius`: in at least SEGMENTS - radius runs *all* coordinates agree.
Fingerprints are therefore joined on the coordinates of each choice of SEGMENTS - radius
runs, which loses no pair. (Whole distances alone cannot serve as keys: one pivot leaves
more than half of all random pairs within `radius`, so candidates would grow with the
square of the input.) Inside such a bucket, pairs whose whole distances differ by more than
`radius` for any pivot are discarded, survivors verified by their bits, and only a spanning
forest of the links leaves it, so that a bucket of near copies never becomes all its pairs.
A bucket that is too large, or takes too many comparisons, goes round again in smaller
ones: its other bits are cut into radius + 1 runs, one of which two linked fingerprints
share. Connected components follow by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, hub_join, id_and_text, per_document, salted_join, table

BITS, SEGMENTS, PIVOTS = 64, 6, 16
WORDS, RADIUS = 4, 4
#: Fingerprints of a bucket that a task holds at once, and comparisons that it makes in one; what is left is split.
WHOLE, COMPARED = 1 << 16, 1 << 22


def _pivots() -> list[int]:
    """Reference fingerprints: consecutive outputs of the SplitMix64 generator."""
    out, x = [], 0
    for _ in range(PIVOTS):
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        out.append(z ^ (z >> 31))
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _masks() -> list[int]:
    edges = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit number; 0 without words."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxh64_intdigest(joined, 42)], dtype="<u8")
    else:
        starts, at = [], 0
        for t in tokens:
            starts.append(at)
            at += len(t) + 1
        ends = [*(s - 1 for s in starts[words:]), len(joined)]
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends)), dtype="<u8", count=len(ends))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so that the unpacked bits stay small
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (64 bits as a signed long), a row for each row of docs."""

    def rows(ids, texts):
        return {"doc_id": ids, "fp": [fingerprint(t, words) for t in texts]}

    return per_document(id_and_text(docs, id_col, text_col), rows, "doc_id long, fp long")


def distances_to_pivots(fp: Column, mask: int) -> list[Column]:
    """Coordinates of a fingerprint: its distances to the pivots within the mask's bits."""
    return [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))).cast("byte") for p in _pivots()]


def bucket_rows(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(bucket, mask, fp): one row for each choice of segments that have to agree; mask: the bits of those segments."""
    coords = unique.select("fp", *[F.xxhash64(F.lit(k), *distances_to_pivots(F.col("fp"), m)).alias(f"_s{k}") for k, m in enumerate(_masks())])
    choices = [F.struct(F.xxhash64(F.lit(n), *[F.col(f"_s{k}") for k in c]).alias("bucket"), F.lit(_signed(sum(_masks()[k] for k in c))).alias("mask")) for n, c in enumerate(combinations(range(SEGMENTS), SEGMENTS - radius))]
    return coords.select("fp", F.explode(F.array(*choices)).alias("one")).select("one.bucket", "one.mask", "fp")


def split_bucket(bucket: int, mask: int, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, mask, fp) rows of the smaller buckets: the bits outside the mask in radius + 1 runs, a bucket for each value of a run."""
    bits = [b for b in range(BITS) if not mask >> b & 1]
    edges = [round(i * len(bits) / (radius + 1)) for i in range(radius + 2)]
    buckets, masks = [], []
    for r, (a, b) in enumerate(zip(edges, edges[1:])):
        run = sum(1 << k for k in bits[a:b])
        z = (fps & np.uint64(run)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((bucket + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append(z ^ (z >> np.uint64(27)))
        masks.append(np.full(len(fps), mask | run, dtype=np.uint64))
    return np.concatenate(buckets), np.concatenate(masks), np.tile(fps, radius + 1)


def _coordinates(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ np.array(_pivots(), dtype=np.uint64)[None, :]).astype(np.int16)


def spanning_links(fps: np.ndarray, radius: int, compared: int = COMPARED) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of a spanning forest of distinct fingerprints within radius of each other, and the places still to be compared.

    A flood: each fingerprint that is reached looks for those not yet reached, first by
    its pivot coordinates, then by its bits. It stops after about `compared` comparisons.
    Memory is linear in the bucket.
    """
    table_, left, out, spent = _coordinates(fps), np.arange(len(fps)), [], 0
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            if spent > compared:
                return out, [*front, *left]
            at = front.pop()
            spent += len(left)
            near = np.abs(table_[left] - table_[at]).max(axis=1) <= radius
            near[near] = np.bitwise_count(fps[left[near]] ^ fps[at]) <= radius
            found = left[near]
            out += [(at, x) for x in found]
            front.extend(found)
            left = left[~near]
        if spent > compared and len(left):
            return out, list(left)
    return out, []


def compare(rows: DataFrame, radius: int = RADIUS, whole: int = WHOLE, compared: int = COMPARED) -> DataFrame:
    """(a, b, bucket, mask): links found in buckets of (bucket, mask, fp), and, where b is null, rows to be compared in smaller buckets."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
        """(True, whole buckets) and (False, parts of one that is too large), in the order of the rows."""
        held, n, large = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if large is not None:
                more = int(np.searchsorted(part[0], large, "right"))
                if more:
                    yield False, *(x[:more] for x in part)
                    part = [x[more:] for x in part]
                    if not len(part[0]):
                        continue
                large = None
            held.append(part)
            n += len(part[0])
            if held[0][0][0] == part[0][-1] and n <= whole:
                continue
            all_ = [np.concatenate(x) for x in zip(*held)]
            first = int(np.searchsorted(all_[0], all_[0][-1], "left"))
            if first:
                yield True, *(x[:first] for x in all_)
            rest = [x[first:] for x in all_]
            if len(rest[0]) > whole:
                yield False, *rest
                large, held, n = rest[0][0], [], 0
            else:
                held, n = [rest], len(rest[0])
        if held:
            yield True, *(np.concatenate(x) for x in zip(*held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for complete, keys, masks, fps in groups(batches):
            keys, masks, fps = (x.view(np.uint64) for x in (keys, masks, fps))
            found, again = [], []
            if complete:
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                sizes = np.diff(np.r_[starts, len(keys)])
                pairs = starts[sizes == 2]
                a, b = fps[pairs], fps[pairs + 1]
                near = np.abs(_coordinates(a) - _coordinates(b)).max(axis=1, initial=0) <= radius
                near[near] = np.bitwise_count(a[near] ^ b[near]) <= radius
                found.append((a[near], b[near]))
                for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                    some = fps[s : s + n]
                    got, left = spanning_links(some, radius, compared)
                    if got:
                        i, j = np.array(got).T
                        found.append((some[i], some[j]))
                    if left:
                        again.append(split_bucket(int(keys[s]), int(masks[s]), some[left], radius))
            else:
                again.append(split_bucket(int(keys[0]), int(masks[0]), fps, radius))
            if found:
                a, b = (pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "bucket", "mask"])
            for bucket, mask, fp in again:
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(bucket.view(np.int64)), pa.array(mask.view(np.int64))], names=["a", "b", "bucket", "mask"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, bucket long, mask long")


def links(rows: DataFrame, radius: int = RADIUS, whole: int = WHOLE, compared: int = COMPARED) -> DataFrame:
    """(a, b): links between fingerprints that share a bucket of (bucket, mask, fp), a spanning forest of each bucket."""
    found = None
    while True:
        out = cut(compare(rows, radius, whole, compared))
        some = out.where("b IS NOT NULL").select("a", "b")
        found = some if found is None else found.unionByName(some)
        rows = out.where("b IS NULL").select("bucket", "mask", F.col("a").alias("fp"))
        if not rows.limit(1).count():
            return found


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the component's smallest node.

    Large-star and small-star contractions in turn until the links no longer change; the
    links between rounds are checkpointed. Smallest neighbours are aggregated before the
    shuffle and joined back, those of hubs by broadcast, so that no task holds a node's
    neighbours.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = cut(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count("*").alias("n")))
        large = cut(hub_join(both, low, "v", "n", 2 * state[0]).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        down = cut(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
        small = hub_join(large, down, "v", "n", 2 * state[0]).select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        edges = cut(small.where("u <> v").distinct())
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def first_of_each(marked: DataFrame, first: Column, radius: int) -> DataFrame:
    """(fp, n, first): each fingerprint of `marked`, its number of rows and the smallest `first` of its component."""
    unique = cut(marked.groupBy("fp").agg(F.min(first).alias("own"), F.count("*").alias("n")))
    found = components(links(bucket_rows(unique, radius), radius))
    rooted = cut(unique.join(found, unique["fp"] == found["node"], "left").select("fp", "n", "own", F.coalesce("root", "fp").alias("root")))
    smallest = cut(rooted.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("_size")))
    return cut(hub_join(rooted, smallest, "root", "_size", rooted.count()).select("fp", "n", "first"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id.

    component_id is the smallest doc_id that is reachable by links of at most `radius`
    differing bits. Null and empty texts, and those of white space only, have fingerprint
    0 and are linked like others; a text of fewer than `words` words is one shingle.
    Repeated rows and equal texts share a fingerprint. Null ids are the smallest only in
    a component without others. An empty table gives an empty result; other columns are
    not read. The distinct fingerprints, not the documents, are compared, and neither
    they nor the links pass through the driver.
    """
    marked = cut(fingerprints(docs, words, id_col, text_col))
    labels = first_of_each(marked, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"), radius)
    return salted_join(marked, labels.select("fp", "n", F.col("first.doc_id").alias("component_id")), "fp", "n").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each component, that of the smallest doc_id (of one id's texts, the one of the smallest hash); columns as they were.

    Nulls and empties are as in near_duplicates(). Of rows that repeat both id and text one stays.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.md5(text).alias("digest")).alias("key"), text.alias("text"))

    def rows(keys, texts):
        return {"doc_id": [k["id"] for k in keys], "digest": [k["digest"] for k in keys], "fp": [fingerprint(t, words) for t in texts]}

    marked = cut(per_document(keyed, rows, "doc_id long, digest string, fp long"))
    stays = first_of_each(marked, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"), radius).select("first.doc_id", "first.digest").distinct()
    counted = cut(marked.groupBy("doc_id", "digest").agg(F.count("*").alias("rows_")).alias("m").join(stays.alias("s"), F.col("m.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("m.digest") == F.col("s.digest"))).select("m.doc_id", "m.digest", "rows_"))
    own_id, own_text = F.col(f"d.`{id_col}`").cast("long"), F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit(""))
    same = own_id.eqNullSafe(F.col("c.doc_id")) & (F.md5(own_text) == F.col("c.digest"))
    once = docs.alias("d").join(counted.where("rows_ = 1").alias("c"), same, "left_semi")
    if not counted.where("rows_ > 1").limit(1).count():
        return once
    of = "_of" + "_" * max(map(len, docs.columns))  # a name that docs does not have
    repeated = docs.alias("d").join(counted.where("rows_ > 1").alias("c"), same, "left_semi").withColumn(of, F.md5(text)).dropDuplicates([id_col, of]).drop(of)
    return once.unionByName(repeated)

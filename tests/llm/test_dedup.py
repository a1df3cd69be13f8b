import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import exact_dedup, simhash
from tests.conftest import SF, same


def groups_of(pairs, keep):
    by = {}
    for i, t in pairs:
        by.setdefault(t or "", []).append(i)
    pick = {"smallest": min, "largest": max}[keep]
    chosen = {t: pick([i for i in ids if i is not None], default=None) for t, ids in by.items()}
    return sorted(((i, chosen[t or ""], len(by[t or ""]), i == chosen[t or ""]) for i, t in pairs), key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, lambda t: F.length(t)])
def test_exact_groups(docs, odd, keep, hash_of):
    pairs = odd + [(20, "abcd"), (21, "abce"), (22, "abcd")]
    got = exact_dedup.exact_duplicates(docs(pairs), keep=keep, hash_of=hash_of).collect()
    assert sorted((tuple(r[:4]) for r in got), key=str) == groups_of(pairs, keep)


def test_exact_against_sql(spark, sql):
    assert same(exact_dedup.op5_exact_dedup(spark, SF).toPandas(), sql(exact_dedup.ORACLE_SQL))


def test_deduplicated_keeps_columns(docs, odd):
    out = exact_dedup.deduplicated(docs(odd))
    assert out.columns == docs(odd).columns and sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 3, 4, 6, None, 7, 8], key=str)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[1] is None


def test_one_row_of_each_whatever_the_ids(docs):
    pairs = [(5, "a b c"), (5, "a b c"), (5, "zzz"), (None, "a b c"), (None, "q"), (None, "q"), (7, None), (7, "")]
    for keep in ("smallest", "largest"):
        got = sorted(((r["doc_id"], r["text"] or "") for r in exact_dedup.deduplicated(docs(pairs), keep).collect()), key=str)
        assert got == sorted([(5, "a b c"), (5, "zzz"), (None, "q"), (7, "")], key=str)
    got = sorted(((r["doc_id"], r["text"] or "") for r in simhash.one_of_each(docs(pairs)).collect()), key=str)
    assert got == sorted([(5, "a b c"), (5, "zzz"), (None, "q"), (7, "")], key=str)
    assert simhash.one_of_each(docs(pairs)).columns == docs(pairs).columns
    assert exact_dedup.deduplicated(docs(pairs).limit(0)).count() == simhash.one_of_each(docs(pairs).limit(0)).count() == 0


def test_empty(docs, odd):
    none = docs(odd).limit(0)
    assert exact_dedup.exact_duplicates(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius):
    n, fps = len(ids), np.array(fps, dtype=np.uint64)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius):
            parent[find(int(i + 1 + j))] = find(i)
    low = {}
    for k in range(n):
        r = find(k)
        if ids[k] is not None:
            low[r] = min(low.get(r, ids[k]), ids[k])
    return [low.get(find(k)) for k in range(n)]


def test_op7_against_brute_force(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1] or "") for r in rows]
    assert got == {i: ("%016x" % f, c) for i, f, c in zip(ids, fps, plain_components(ids, fps, 4))}


def test_odd_documents(docs, odd):
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs(odd)).collect()), key=str)
    ids, fps = [i for i, _ in odd], [plain_fingerprint(t or "") for _, t in odd]
    assert got == sorted(zip(ids, fps, plain_components(ids, fps, 4)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_lose_no_component(spark, seed):
    rng = random.Random(seed)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            fps.add(f)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                f ^= 1 << b
    fps = sorted(fps)
    unique = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(simhash.bucket_rows(unique))).collect()}
    want = plain_components(list(range(len(fps))), fps, 4)
    label = [roots.get(f, f) for f in fps]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_spanning_links_are_linear():
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)))
    assert len(simhash.spanning_links(fps, 4)[0]) == len(fps) - 1


@pytest.mark.parametrize("whole, compared", [(1 << 16, 1 << 22), (50, 1 << 22), (1 << 16, 100)])
def test_large_buckets_are_split(spark, whole, compared):
    """Skewed fingerprints: 40 bits are the same in all of them, so every bucket of those bits is hot."""
    rng = np.random.default_rng(7)
    n = 20_000 if whole == 1 << 16 and compared > 100 else 1200
    fps = np.unique((rng.integers(0, 1 << 24, n, dtype=np.uint64) if n > 5000 else rng.integers(0, 1 << 18, n, dtype=np.uint64)) | np.uint64(0xABCDE12345 << 24))
    unique = spark.createDataFrame([(simhash._signed(int(f)),) for f in fps], "fp long")
    found = simhash.links(simhash.bucket_rows(unique), whole=whole, compared=compared)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(found).collect()}
    want = plain_components(list(range(len(fps))), fps, 4)
    label = [roots.get(int(f), int(f)) for f in fps]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))

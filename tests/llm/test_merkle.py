import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from skein.llm import merkle
from tests.conftest import SF, same


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def frame(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(level):
    """All levels over a list of digests."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(levels, at):
    for level in levels[:-1]:
        first = at - at % 3
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 3])
        at //= 3


def plain(rows, change):
    """Manifest of (doc_id, source, lang, n_chars, text) rows by lists."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(frame(r)), H(frame((*r[:4], change(r)))), r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, other, i) in enumerate(sorted(by[s])):
            path, d = [*way(trees[s], at), *way(top, k)], other
            for a, b in path:
                d = H(a, d, b)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], H(*(x for p in path for x in p)), d, d == top[-1][0]))
    return sorted(out, key=str)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, pos string, `n` string"


@pytest.mark.parametrize("span", [1, 2, 6])
def test_against_lists(spark, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = [(i, "src0" if i % 3 else None, "en", i, f"line\n{i}\nü" if i % 5 else None) for i in range(100)]
    rows += [(None, "é", None, None, ""), (7, "z", "", 0, ""), (7, "z", "", 0, ""), (7, "z", "", 1, "x" * 100_000), (8, "one", "a", 3, "\n\n")]
    rows += [(i, f"s{i % 20}", "en", 1, "a\nb") for i in range(200, 260)]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], FIELDS)

    def change(r):
        return r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]

    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = sorted((tuple(r) for r in merkle.manifest(docs, altered=altered).collect()), key=str)
    assert got == plain(rows, change)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


def test_small_tables(spark):
    none = spark.createDataFrame([], FIELDS)
    assert merkle.manifest(none).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, "", "", "", "")], FIELDS)
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["root"] == row["subroot"] == row["folded_root"] == H("1:1----") and row["proof_sha256"] == H("") and row["verified"]


def test_against_sql(spark, sql):
    assert same(merkle.op11_merkle(spark, SF).toPandas(), sql(merkle.ORACLE_SQL))

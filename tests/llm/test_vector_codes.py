import math
import random
from hashlib import sha256

import numpy as np
import pytest

from skein.llm import vector_codes as vc
from tests.conftest import SF, same

FIELDS = "vec_id long, embedding array<float>, label int, code string, vector string, _label string, part int, n string"


def plain(rows, entries, rounds, parts=4):
    """Codes of (vec_id, vector, label) rows by loops over Python integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0])
    cut = [[[math.floor(1024 * x) for x in r[1]][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, y)), i) for i, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for c in cut:
                got.setdefault(best(c[p], books[p])[1], []).append(c[p])
            for i, vs in got.items():
                books[p][i] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    digest = sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    return sorted((r[0], "".join(f"{i:02x}" for _, i in f), e, by[r[2]], digest) for r, f, e in zip(kept, found, errors))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, "x") for r in rows], FIELDS)


@pytest.mark.parametrize("size,high", [(16, 1.0), (8, 30000.0)])
def test_against_loops(spark, size, high):
    rng = random.Random(size)
    rows = [(i, [float(np.float32(rng.uniform(-high, high))) for _ in range(size)], rng.choice([None, 0, 1])) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1], None) for i in range(40)]  # copies, and so ties between entries
    rows[5:5] = [(2000, rows[7][1], 4), (2001, rows[7][1], 4)]
    rows += [(3000, None, 1), (3001, [None] * size, 1), (3002, [math.nan] * size, 1), (3003, [1.0] * (size - 1) + [-math.inf], 1)]
    got = sorted(tuple(r) for r in vc.vector_codes(frame(spark, rows), entries=32).collect())
    assert got == plain(rows, 32, 4)


def test_odd_tables(spark):
    assert vc.vector_codes(frame(spark, [])).count() == 0
    assert vc.vector_codes(frame(spark, [(1, None, 1)])).count() == 0
    (one,) = vc.vector_codes(frame(spark, [(None, [1.0, 2.0], 1)])).collect()
    assert one["code"] is None and one["error"] is None
    rows = vc.vector_codes(frame(spark, [(1, [0.5, 0.25, 0.0, -0.001, 2.0], None), (1, [0.5, 0.25, 0.0, -0.001, 2.0], None), (2, [1.0], 3), (3, [], 3)])).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in rows if r["vec_id"] == 1) == [(1, "00000000", 0)] * 2
    assert {r["code"] for r in rows if r["vec_id"] > 1} == {None}


def test_products_are_exact_and_too_large_is_refused(spark):
    x = np.array([[2**29 + 1, 3], [2**30 - 1, -5]])
    assert vc.exact_product(x, x).tolist() == [[sum(a * b for a, b in zip(r.tolist(), s.tolist())) for s in x] for r in x]
    with pytest.raises(Exception, match="too large"):
        vc.vector_codes(frame(spark, [(1, [1e30] * 4, 1)])).collect()


def test_against_sql(spark, sql):
    assert same(vc.op12_vector_codes(spark, SF).toPandas(), sql(vc.ORACLE_SQL))

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import context_tree as ct
from tests.conftest import SF

def held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


class Plain:
    """Context-tree weighting by dictionaries, one bit at a time, block probabilities by their sequential definition."""

    def __init__(self, texts, depth):
        self.depth, self.seen = depth, {}
        for t in texts:
            for ctx, known, bit in self.bits(t):
                for d in range(depth + 1):
                    self.seen.setdefault((ctx[:d], known), []).append(bit)
        self.weighted, self.share = {}, {}
        below = {}
        for (ctx, known), bits in sorted(self.seen.items(), key=lambda x: -len(x[0][0])):
            own, n = 0.0, [0, 0]
            for b in bits:
                own += math.log((n[b] + 0.5) / (sum(n) + 1))
                n[b] += 1
            if len(ctx) == depth:
                w = own
            else:
                w = np.logaddexp(own, below[ctx, known]) - math.log(2)
                self.share[ctx, known] = math.exp(own - math.log(2) - w)
            if ctx:
                below[ctx[:-1], known] = below.get((ctx[:-1], known), 0.0) + w

    def bits(self, text):
        """(context, newest byte first, bits known, bit)."""
        full = b" " * self.depth + text
        for i in range(self.depth, len(full)):
            byte = format(full[i], "08b")
            for j in range(8):
                yield full[i - self.depth : i][::-1], byte[:j], int(byte[j])

    def score(self, text):
        total = 0.0
        for ctx, known, bit in self.bits(text):
            p = None
            for d in range(self.depth, -1, -1):
                if bits := self.seen.get((ctx[:d], known)):
                    kt = (bits.count(bit) + 0.5) / (len(bits) + 1)
                    p = kt if p is None else self.share[ctx[:d], known] * kt + (1 - self.share[ctx[:d], known]) * p
            total += math.log10(0.5 if p is None else p)
        return total


def base(texts, train):
    count = Counter(w for t in train for w in ct._words(ct.normalised(t)))
    n, v = sum(count.values()), len(count)
    return [(len(ws), sum(w in count for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in (ct._words(ct.normalised(t)) for t in texts)]


@pytest.mark.parametrize("depth,cut,block,batch,part", [(5, 3, 1 << 18, 1 << 24, 1 << 23), (3, 2, 200, 500, 400), (2, 1, 1, 1, 50)])
def test_against_dictionaries(spark, docs, odd, monkeypatch, depth, cut, block, batch, part):
    for name, value in (("BLOCK", block), ("BATCH", batch), ("PART", part), ("STEP", 1000 if block < 1000 else 1 << 22)):
        monkeypatch.setattr(ct, name, value)
    rng = random.Random(depth)
    pairs = [(i, t if t is None or len(t) < 6000 else t[:3000]) for i, t in odd] + [(100 + i, " ".join(rng.choice(["The", "cat", "sat\x0b", "on", "œil", "b"]) for _ in range(rng.randrange(30)))) for i in range(40)]
    got = ct.text_scores(docs(pairs), held(), depth, cut).collect()
    train = [t or "" for i, t in pairs if not held_out(i)]
    model, bases = Plain([ct.normalised(t) for t in train], depth), base([t or "" for _, t in pairs], train)
    want = [(i, held_out(i), *b, model.score(ct.normalised(t or ""))) for (i, t), b in zip(pairs, bases)]
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=lambda r: str(r[:4]) + f"{r[6]:.6f}"), sorted(want, key=lambda r: str(r[:4]) + f"{r[6]:.6f}")):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-5, abs_tol=1e-4)


def test_probabilities_add_up():
    keys = np.unique(np.random.default_rng(1).integers(97, 101, (5000, 6)).astype(np.uint64) @ (np.uint64(256) ** np.arange(6, dtype=np.uint64)))
    layer = ct.Contexts(keys, np.ones(len(keys), dtype=np.int64), 0, 5)
    for ctx in (keys[7], keys[700], np.uint64(0)):
        one = ct.log_probabilities((ctx & ~np.uint64(255)) | np.arange(256, dtype=np.uint64), [layer], 5)
        assert math.isclose((10**one).sum(), 1.0, rel_tol=1e-9)


def test_empty_and_untrained(docs):
    assert ct.text_scores(docs([]), held()).count() == 0
    (row,) = ct.text_scores(docs([(1, "Ab c")]), F.lit(True)).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert math.isclose(row["bits_per_byte"], 8.0)


def test_better_than_words_on_held_out_texts(spark):
    """An unseen word costs the word counts no spelling, so the corpus must be large enough to hold most words."""
    sums = ct.op13_context_tree(spark, SF.replace("0.001", "0.1")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert sums[0] > 0.97 * sums[1] and sums[2] < 2.3


def test_longer_contexts_help(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, five = (ct.text_scores(docs, held(), d, 1).where("held_out").agg(F.sum("score")).first()[0] for d in (1, 5))
    assert five > 0.85 * one

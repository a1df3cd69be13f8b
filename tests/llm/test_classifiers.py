import zlib

import numpy as np
from pyspark.sql import functions as F

from skein.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, scored, label, mod, rest):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = scored.join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    return [r for r in rows if r["held_out"]]


def test_toxicity_held_out(spark):
    scored = toxicity.op2_toxicity(spark, SF).cache()
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = held_out(spark, scored, "toxic", 5, 0)
    assert np.mean([r["predicted"] == r["y"] for r in rows]) >= 0.9
    assert np.mean([r["predicted"] for r in rows if r["y"] == 0]) <= 0.05


def test_quality_held_out(spark):
    rows = held_out(spark, quality.op4_quality(spark, SF), "quality", 3, 1)
    assert np.mean([r["predicted"] == r["y"] for r in rows]) >= 0.92
    assert np.mean([r["predicted"] for r in rows if r["y"] == 1]) >= 0.95


def test_odd_documents(spark, docs, odd):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for scores in (toxicity.toxicity_scores, quality.quality_scores):
        out = scores(docs(odd), labels).collect()
        assert len(out) == len(odd) and all(0 <= r["score"] <= 1 for r in out)
        assert scores(docs(odd), labels.limit(0)).count() == len(odd)
        assert scores(docs(odd).limit(0), labels).count() == 0
    assert toxicity.without_toxic(docs(odd), labels).columns == docs(odd).columns


def test_training_learns_a_word():
    words = "alpha beta gamma delta omega kappa sigma".split()
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, 40)) + (" villain" if i % 3 == 0 else "") for i in range(300)]
    net = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)])
    assert toxicity.score(net, "alpha beta villain gamma") > 0.5 > toxicity.score(net, "alpha beta gamma delta")


def test_language_guess():
    assert toxicity.language("der hund und die katze".split()) == "de" and toxicity.language([]) == "other"


def test_training_reads_whole_texts(spark):
    long = "calm water " * 3000 + "villain"
    docs = spark.createDataFrame([(1, long), (2, "calm water")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    texts, marks = toxicity.fit(docs, labels, "toxic", lambda c: c.isNotNull())
    assert sorted(zip(texts, marks)) == sorted([(long, 1), ("calm water", 0)])


def test_a_repeated_id_trains_once_and_characters_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a" * 10), (1, "b" * 10), (2, "c" * 10), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    texts, marks = toxicity.fit(docs, labels, "toxic", lambda c: c.isNotNull())
    assert sorted(zip(texts, marks)) == [("", 1), ("b" * 10, 1), ("c" * 10, 0)]
    assert len(toxicity.fit(docs, labels, "toxic", lambda c: c.isNotNull(), rows=2)[0]) == 2


def test_pooling_against_a_naive_convolution():
    rng = np.random.default_rng(3)
    net = toxicity.train([], [], rows=64)
    net.bias = {w: rng.normal(0, 0.1, 6).astype(np.float32) for w in net.filters}
    for n in (0, 1, 2, 3, 9):
        x = rng.normal(size=(n, 12)).astype(np.float32)
        want = []
        for w, f in net.filters.items():
            for k in range(f.shape[2]):
                every = [sum(float(x[t + j] @ f[j, :, k]) for j in range(w)) + net.bias[w][k] for t in range(n - w + 1)]
                want.append(max(0.0, *every) if every else 0.0)
        assert np.allclose(toxicity._pooled(net, x)[0], want, atol=1e-5)


def test_features_against_plain_compression():
    import zstandard

    good, bad = (quality._dictionary([f"{w} number {i} of many such texts".encode() for i in range(300)], 4096) for w in ("pleasant prose", "JUNK!!! $$$"))
    text = "pleasant prose number 7 of many such texts " * 20
    data, sizes = text.encode(), []
    for d in (good, bad):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append([len(c.compress(data[a : a + 256])) for a in range(0, len(data), 256)])
    want = (sum(sizes[1]) - sum(sizes[0])) / len(data)
    assert np.isclose(quality.features(text, good, bad)[0], want) and want > 0

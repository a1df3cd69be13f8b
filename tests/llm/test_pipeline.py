import corpus_pipeline
from skein.llm import registry, simhash

SF = "/root/testdata/sf0.001"


def test_registry_has_every_operator():
    assert {int(q[2:].split("_")[0]) for q in registry.QUERIES} == set(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] and sizes[1] >= 0.8 * sizes[0]
    before = corpus_pipeline.drop_copies(spark, corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), SF)
    rows = simhash.near_duplicates(before).collect()
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted({r["component_id"] for r in rows})


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_stages_on_odd_documents(spark, odd):
    """Nulls in any column, repeated and null ids, clashing names and empty tables; rows are compared, not sets of ids."""
    wide = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, _hash string, key string, _id string, _digest string, digest string, rows_ string, _of string"
    rows = [(i, t, None, None, None if t is None else len(t), "x", None, "x", "x", "x", "x", "x", "x", "x") for i, t in odd + [(5, "another text of number five"), (4, "one two three four five")]]
    docs = spark.createDataFrame(rows, wide)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, empty, SF).count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), wide)
        if name == "exact_dedup":
            texts = [r["text"] or "" for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert out.select("doc_id").distinct().count() > 3

"""PageRank and label propagation over edges dealt to parts, against the joins over all edges."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import centrality, community, dealt
from skein.plans import catalogue
from skein.sources import adapters as A
from tests.conftest import SF, same


def graph_of(spark, seed):
    """Sources 0-39, hubs 100-107 of which some are sources too, hanging targets from 1000 on, one with two sources, and nodes alone; with parallel edges."""
    rng = random.Random(seed)
    rels = [(rng.randrange(40), 100 + rng.randrange(8)) for _ in range(150)] + [(100 + i, 108) for i in range(4)] + [(60, 109)]
    hanging = [(rng.randrange(40), 1000 + i) for i in range(50)] + [(3, 1000), (70, 2000), (70, 2001), (101, 2002)]
    hanging += [hanging[7]] * 3
    ddl = "source_id long, target_id long"
    nodes = spark.createDataFrame([(i,) for i in [*range(42), 42, *range(100, 110), 5000, 5001, 5000]], "entity_id long")
    return spark.createDataFrame(rels, ddl), spark.createDataFrame(hanging, ddl), nodes


@pytest.mark.parametrize("seed", [1, 2])
def test_values_move_and_results_stay(spark, monkeypatch, seed):
    monkeypatch.setattr(dealt, "EDGES_A_PART", 20)
    rels, hanging, nodes = graph_of(spark, seed)
    both = rels.unionByName(hanging).withColumn("relationship_id", F.lit(""))
    deal = lambda: dealt.deal(rels, hanging, 200)
    want = {r[0]: r[1] for r in centrality.pagerank(both, nodes.distinct(), rounds=7, tolerance=None).collect()}
    rows = dealt.pagerank(deal(), nodes, 7).collect()
    assert len(rows) == len(want) and {r["entity_id"]: r["pagerank"] for r in rows} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    for rounds in (1, 2, 5):
        want = {r["node"]: r["label"] for r in community.label_propagation(both, nodes.distinct(), rounds=rounds).collect()}
        rows = dealt.label_propagation(deal(), nodes, rounds).collect()
        assert len(rows) == len(want) and {r["node"]: r["label"] for r in rows} == want
    # Ties go by the order that is given, here the opposite one.
    turned = both.select((-F.col("source_id")).alias("source_id"), (-F.col("target_id")).alias("target_id"))
    want = {-r["node"]: r["label"] for r in community.label_propagation(turned, nodes.select((-F.col("entity_id")).alias("entity_id")).distinct(), rounds=3).collect()}
    assert {r["node"]: r["label"] for r in dealt.label_propagation(deal(), nodes, 3, order=lambda c: -F.col(c)).collect()} == want


def test_edges_stay_in_their_parts(spark):
    g = dealt.deal(*graph_of(spark, 3)[:2], 200)
    assert g.edges.count()
    plan = g.met(g.cores.select("node", "part", F.lit(1.0).alias("share")), dealt._shares, "node long, got double")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(part") == 1 + plan.count("REPARTITION_BY_NUM")  # that of the values, and the one that the edges were stored by
    g.edges.unpersist()


def test_whole_queries_keep_names_and_order(spark):
    rels, entities = A.network(spark, SF).cache(), A.entities(spark, SF)
    assert same(catalogue.QUERIES["label_propagation_whole"](spark, SF).toPandas(), community.label_propagation(rels, entities, rounds=6).toPandas())
    want = {r[0]: r[1] for r in centrality.pagerank(rels, entities, rounds=10, tolerance=None).collect()}
    assert {r["entity_id"]: r["pagerank"] for r in catalogue.QUERIES["pagerank_fixed_iters_whole"](spark, SF).collect()} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    rows = spark.createDataFrame([(k,) for k in (None, 0, 99_999, 100_000, 10**15 - 1, -1, -123_456)], "k long")
    for p in A.PREFIXES:
        assert rows.select(A.name_in_order(A.order_of(A.number(p, "k"))).alias("a"), A.entity_id(p, "k").alias("b")).where("a <> b").count() == 0

import itertools
import random

import pytest

from skein.operators import centrality, community, graph, strength, temporal, traverse

SCHEMA = "relationship_id string, source_id string, target_id string, relationship_type string, ts timestamp_ntz, confidence double"


def rels(spark, pairs, kind="TRANSFERRED_TO"):
    return spark.createDataFrame([(f"rel-{i:05d}", a, b, kind, None, 0.9) for i, (a, b) in enumerate(pairs)], SCHEMA)


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "entity_id string")


PATH = [("a", "b"), ("b", "c"), ("c", "d")]


def test_path_graph(spark):
    r = rels(spark, PATH)
    dist = centrality.distances(r)
    between = {x[0]: x[1] for x in centrality.betweenness(r, dist, 4).collect()}
    assert between == {"a": 0.0, "b": pytest.approx(2 / 3, abs=1e-6), "c": pytest.approx(2 / 3, abs=1e-6), "d": 0.0}
    close = {x[0]: x[1] for x in centrality.closeness(dist, 4).collect()}
    assert close["a"] == 0.5 and close["b"] == 0.75
    assert {x[0] for x in community.articulation_points(r).collect()} == {"b", "c"}
    assert {x[0]: x[1] for x in traverse.neighbourhood(r, ids(spark, ["a"]), 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_pagerank_sums_to_one(spark):
    r = rels(spark, [("a", "b"), ("a", "c"), ("a", "d")])
    got = {x[0]: x[1] for x in centrality.pagerank(r, ids(spark, ["a", "b", "c", "d", "alone"])).collect()}
    assert abs(sum(got.values()) - 1) < 1e-4 and got["b"] == got["c"] and got["a"] > got["b"] > got["alone"]


def test_components_and_isolated(spark):
    r = rels(spark, [("b", "a"), ("c", "b"), ("y", "x")])
    got = {x[0]: x[1] for x in graph.components(graph.neighbours(r)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_empty_graph(spark):
    r = rels(spark, [("a", "b")]).where("false")
    assert graph.simple_edges(r).count() == 0 and traverse.transfer_chains(r).count() == 0
    assert strength.relationship_strength(r).count() == 0 and temporal.bursts(r).count() == 0
    assert centrality.pagerank(r, ids(spark, ["a"])).collect()[0][1] == 1.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_articulation_points_by_removal(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = [p for p in itertools.combinations(names, 2) if rng.random() < 0.14]

    def parts(nodes):
        left, n = set(nodes), 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                x = todo.pop()
                for a, b in pairs:
                    for u, v in ((a, b), (b, a)):
                        if u == x and v in left:
                            left.discard(v)
                            todo.append(v)
        return n

    touched = sorted({x for p in pairs for x in p})
    expected = {x for x in touched if parts([y for y in touched if y != x]) > parts(touched)}
    assert {x[0] for x in community.articulation_points(rels(spark, pairs)).collect()} == expected


def test_two_cliques_and_a_bridge(spark):
    left, right = list("abcd"), list("wxyz")
    pairs = [*itertools.combinations(left, 2), *itertools.combinations(right, 2), ("a", "w")]
    got = {x[0]: x[1] for x in community.modularity_communities(rels(spark, pairs)).collect()}
    assert len({got[x] for x in left}) == 1 and len({got[x] for x in right}) == 1 and got["a"] != got["w"]


def test_chains_have_an_edge_a_hop(spark):
    for c in traverse.transfer_chains(rels(spark, [*PATH, ("d", "a")])).collect():
        assert len(c["evidence"].split(",")) == c["hop_count"] == c["path"].count(">")


def test_depth_is_bounded(spark):
    with pytest.raises(ValueError):
        traverse.neighbourhood(rels(spark, PATH), ids(spark, ["a"]), 7)


def test_indicators_are_ordered_and_explained(spark):
    from pyspark.sql import functions as F

    from skein.operators import derived

    r = rels(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    dist = centrality.distances(r)
    between = centrality.betweenness(r, dist, 5)
    bridge = community.bridge_candidates(r, community.articulation_points(r), between, community.modularity_communities(r))
    burst = spark.createDataFrame([], "entity string, indicator_type string, win long, start_us long, observed long, mean double, std double, threshold double")
    found = derived.indicators(between, bridge, burst, traverse.transfer_chains(r)).collect()
    rank = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
    keys = [(rank[x["severity"]], -x["score"], x["indicator_id"]) for x in found]
    assert keys == sorted(keys) and {x["indicator_type"] for x in found} == {"high_betweenness", "bridge_candidate", "transaction_chain"}
    none = derived.explain("bridge", "z", F.lit("x"), bridge, F.col("entity_id") == "z", F.col("evidence"), "bridge_candidates", {"k": "5"}).first()
    assert none["reason"] == "no bridge holds for z" and none["evidence"] == ""


def test_findings_have_stable_ids(spark):
    from skein.operators import derived

    r = rels(spark, [("a", "b"), ("b", "c")])
    bridge = spark.createDataFrame([("b", "articulation_point", 0.6)], "entity_id string, metric string, score double")
    burst = spark.createDataFrame([("a", 3, 9)], "entity string, win long, observed long")
    one, two = (sorted(x["finding_id"] for x in derived.findings(bridge, burst, traverse.transfer_chains(x), strength.relationship_strength(x)).collect()) for x in (r, r.repartition(3)))
    assert one == two and len(one) == 3

"""Paths of many pairs against enumeration, scopes against each scope alone, and the queries against SQL."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import centrality, community, graph, interpret, paths, scopes
from skein.plans import scopes as plans
from tests.conftest import SF, same

RELS = "relationship_id string, source_id string, target_id string, relationship_type string, ts timestamp_ntz, confidence double"


def made(spark, pairs, kind="TRANSFERRED_TO"):
    return spark.createDataFrame([(f"rel-{i:03d}", a, b, kind, None, 0.9) for i, (a, b) in enumerate(pairs)], RELS)


def smallest_paths(pairs, depth):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for root in near:
        level, seen = {root: [root]}, {root: [root]}
        for _ in range(depth):
            nxt = {}
            for u, path in level.items():
                for v in near[u] - set(seen):
                    nxt[v] = min(nxt.get(v, path + [v]), path + [v])
            seen |= nxt
            level = nxt
        out |= {(root, t): p for t, p in seen.items()}
    return out


@pytest.mark.parametrize("depth", [1, 4, 6])
def test_pair_paths_are_smallest(spark, depth):
    rng, names = random.Random(depth), [f"n{i:02d}" for i in range(22)]
    pairs = [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < 0.11] + [("n00", "n00"), ("n01", "n00")]
    want = smallest_paths(pairs, depth)
    asked = [(a, b) for a in names for b in names] + [("n00", "n05"), ("x", "n00"), ("n00", None)]
    got = {(r["source_id"], r["target_id"]): r["path"] for r in paths.pair_paths(made(spark, pairs), spark.createDataFrame(asked, "source_id string, target_id string"), depth).collect()}
    assert got == want


def test_described_path(spark):
    rels = made(spark, [("a", "b"), ("b", "c"), ("a", "b")]).withColumn("relationship_type", F.when(F.col("relationship_id") == "rel-001", "OWNS").otherwise(F.col("relationship_type")))
    ents = spark.createDataFrame([("a", "Person"), ("b", "Account")], "entity_id string, entity_type string")
    asked = spark.createDataFrame([("a", "c"), ("a", "z"), ("c", "a")], "source_id string, target_id string")
    members = spark.createDataFrame([("a", "a"), ("a", "b")], "source_id string, entity_id string")
    got = {(r["source_id"], r["target_id"]): r for r in paths.described_paths(rels, ents, asked, 4, ["TRANSFERRED_TO"], members).collect()}
    one = got["a", "c"]
    assert (one["found"], one["hop_count"], one["nodes"], one["node_types"]) == (True, 2, "a>b>c", "Person>Account>Unknown")
    assert (one["edges"], one["relationship_sequence"], one["in_case_network"]) == ("rel-000,placeholder-b-c", "TRANSFERRED_TO,OWNS", False)
    assert got["c", "a"]["in_case_network"] is None and got["c", "a"]["edges"] == "placeholder-c-b,rel-000"
    assert not got["a", "z"]["found"] and got["a", "z"]["nodes"] == "" and one["provenance"] == "graph:shortest_path:max_depth=4:types=TRANSFERRED_TO"


def test_scopes_together_are_scopes_alone(spark):
    rng, names = random.Random(5), [f"n{i:02d}" for i in range(16)]
    rels = made(spark, [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < 0.2])
    members = spark.createDataFrame([("case:one", n) for n in names[:9]] + [("case:two", n) for n in names[5:]], "scope string, entity_id string")
    edges = scopes.scoped_edges(rels, members)
    both = {r["entity_id"]: r["betweenness"] for r in scopes.betweenness(edges).collect()}
    groups = {r["node"]: r["community"] for r in community.modularity_communities(edges, 0, scopes.scope_of).collect()}
    for scope in ("global", "case:one", "case:two"):
        alone = edges.where(F.col("scope") == scope)
        n = graph.endpoints(alone).count()
        own = {r["entity_id"]: r["betweenness"] for r in centrality.betweenness(alone, centrality.distances(alone), n).collect()}
        assert {e: v for e, v in both.items() if e.startswith(scope + "/")} == own
        assert {k: v for k, v in groups.items() if k.startswith(scope + "/")} == {r["node"]: r["community"] for r in community.modularity_communities(alone, 0).collect()}


def test_bounds_of_roots_and_empty_scopes(spark):
    star = made(spark, [("hub", f"leaf{i:03d}") for i in range(250)])
    roots = spark.createDataFrame([("root:hub", "hub"), ("root:none", "none")], "scope string, entity_id string")
    near = scopes.neighbourhoods(star, roots, 2)
    assert {r["scope"]: r["count"] for r in near.groupBy("scope").count().collect()} == {"root:hub": scopes.MAX_NODES, "root:none": 1}
    edges = scopes.scoped_edges(star, near, F.startswith("scope", F.lit("root:")))
    assert {r["scope"]: r["count"] for r in edges.groupBy("scope").count().collect()} == {"global": 250, "root:hub": scopes.MAX_NODES - 1}
    none = scopes.scoped_edges(star.limit(0), near.limit(0))
    assert scopes.bursts(none).count() == scopes.betweenness(none).count() == 0


def test_findings_hold_bridges_and_explain(spark):
    found = plans.findings_by_scope(spark, SF)
    rows = found.collect()
    assert {r["finding_type"] for r in rows} >= {"bridge", "burst"} and len({(r["scope"], r["finding_id"]) for r in rows}) == len(rows)
    records = {r["id"]: r for r in scopes.explained(found, found.select(F.col("finding_id").alias("id"))).collect()}
    for r in rows:
        assert records[r["finding_id"]]["scope"] in {x["scope"] for x in rows if x["finding_id"] == r["finding_id"] and x["rank"] <= r["rank"]}


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert same(got, sql(plans.SQL[name])) and len(got)


COUNTS = "scope string, case_id string, root string, entities long, relationships long, central boolean, first_ids string, bridges long, communities long, bursts long, chains long, indicators long"


def test_interpretations(spark):
    rows = [("full", "case-1", "n1", 4, 5, True, "n1,n2,n3", 1, 2, 3, 4, 5), ("none", None, None, 0, 0, False, "", None, 0, None, 0, None), ("bare", None, None, 2, None, None, "a,b", None, None, None, None, None)]
    got = {(r["scope"], r["analysis_type"]): r for r in interpret.interpretations(spark.createDataFrame(rows, COUNTS)).collect()}
    assert len(got) == 3 * len(interpret.KINDS) and len({r["analysis_id"] for r in got.values()}) == len(got)
    full, none, bare = (got[s, "entity_brief"] for s in ("full", "none", "bare"))
    assert all(text.split("%d")[-1] in full["observations"] for _, text, _ in interpret.SIGNALS) and full["observations"].startswith("4 entities and 5 relationships")
    assert all(note in full["notes"] for _, _, note in interpret.SIGNALS if note) and "brief on n1" in full["notes"]
    assert (full["confidence"], none["confidence"], bare["confidence"], got["bare", "centrality"]["confidence"]) == (0.85, 0.35, 0.65, 0.6)
    assert none["observations"] == interpret.EMPTY and "an unknown entity" in none["notes"] and "brief on a " in bare["notes"]
    with pytest.raises(ValueError):
        interpret.interpretations(spark.createDataFrame(rows, COUNTS), ("guess",))

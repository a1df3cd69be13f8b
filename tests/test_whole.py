"""Queries that do the whole job, against brute force."""

import re

import pytest

from tests.conftest import SF, same
from tests.test_graphs import ids, rels

from skein.operators import centrality
from skein.plans import catalogue

TRADE = """SELECT DISTINCT printf('nation-%05d', c_nationkey) AS a, printf('nation-%05d', s_nationkey) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey"""


def test_chains_of_all_trade(spark, sql):
    out = {}
    for a, b in sql(TRADE).itertuples(index=False):
        out.setdefault(a, set()).add(b)
    expected, walks = 0, [[a] for a in out]
    for hops in range(1, 5):
        walks = [[*w, b] for w in walks for b in out.get(w[-1], ()) if b not in w]
        expected += len(walks) if hops > 1 else 0
    assert catalogue.QUERIES["transfer_chains_whole"](spark, SF).count() == expected > 10_000


def test_distances_reach_the_whole_network(spark, sql):
    n = sql("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 25 + 5 AS n")["n"][0]
    found = catalogue.QUERIES["all_pairs_distance_whole"](spark, SF)
    assert {r["count"] for r in found.groupBy("src").count().collect()} == {n}


def test_betweenness_from_some_sources(spark):
    r = rels(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    got = {x[0]: x[1] for x in centrality.betweenness(r, centrality.distances(r, ids(spark, ["a", "b"])), 4).collect()}
    # b lies on a-c, a-d of the pairs that start at a; c on a-d and b-d of those that start at a and b
    assert got == {"a": 0.0, "b": pytest.approx(1.0), "c": pytest.approx(0.5), "d": 0.0}


def test_all_customers_are_resolved(spark, sql):
    n = sql("SELECT count(*) AS n FROM customer")["n"][0]
    for name, kind in (("resolve_candidates", "Person"), ("resolve_attached", "Person")):
        assert catalogue.QUERIES[name](spark, SF).where(f"entity_type = '{kind}'").select("mention_id").distinct().count() == n


def test_given_ids_are_all_found(spark, sql):
    expected = sql("SELECT DISTINCT printf('customer-%05d', c_custkey) AS source_id, printf('nation-%05d', c_nationkey) AS target_id FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1-%'")
    got = catalogue.QUERIES["typed_pairs_by_id"](spark, SF).select("source_id", "target_id").toPandas()
    assert same(got, expected) and len(got)


def test_mentions_are_counted_in_all_documents(spark, sql):
    docs = sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
    expected = {int(i): n for i, t in docs.itertuples(index=False) if (n := len(re.findall(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", t)))}
    assert any(not t.isascii() for i, t in docs.itertuples(index=False) if i in expected)
    assert dict(map(tuple, catalogue.QUERIES["mentions_per_document"](spark, SF).collect())) == expected


def test_distances_have_no_bound(spark):
    names = [f"n{i:02d}" for i in range(61)]
    r = rels(spark, list(zip(names, names[1:])))
    found = {x["node"]: x["dist"] for x in centrality.distances(r, ids(spark, [names[0]])).collect()}
    assert found == {n: i for i, n in enumerate(names)}


def test_an_unknown_root_has_no_path(spark):
    from skein.operators import traverse

    r = rels(spark, [("a", "b")])
    assert traverse.shortest_paths(r, "zz").count() == 0 and traverse.shortest_paths(r, "a").count() == 2


def test_upsert_takes_maps_and_the_last_arrival(spark):
    from skein.sources import collections, schemas

    for name in schemas.COLLECTIONS:
        assert schemas.columns(name) == schemas.empty(spark, name).columns
        none = schemas.empty(spark, name)
        assert collections.upsert(none, none, schemas.key_of(name)).count() == 0
    ddl = "k string, v int, metadata map<string,string>, created_at string"
    target = spark.createDataFrame([("a", 1, {"x": "1"}, "old")], ddl)
    batch = spark.createDataFrame([("a", 9, {"x": "2"}, "new", 1), ("a", 5, {"x": "3"}, "new", 2), (None, 0, None, "new", 3), ("b", 7, None, "new", 4)], ddl + ", seq int")
    got = {r["k"]: (r["v"], r["metadata"], r["created_at"]) for r in collections.upsert(target, batch, "k", arrival="seq").collect()}
    assert got == {"a": (5, {"x": "3"}, "old"), "b": (7, None, "new")}

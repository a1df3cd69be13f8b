"""Distances, closeness and betweenness of every node, whole numbers for names, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import centrality, graph
from skein.plans import catalogue
from skein.sources import adapters as A
from tests.conftest import SF, same


def some_graph(seed):
    """A core of two parts, nodes that hang on it, a star and a pair apart."""
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)} | {tuple(sorted(rng.sample(range(40, 52), 2))) for _ in range(18)}
    return sorted(pairs | {(rng.randrange(52), 100 + i) for i in range(60)} | {(200, 201)} | {(300, 301 + i) for i in range(4)})


def brute_distances(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        at, front = {s: 0}, [s]
        for x in front:
            for y in near[x]:
                if y not in at:
                    at[y] = at[x] + 1
                    front.append(y)
        out |= {(s, x): d for x, d in at.items()}
    return out


def links(spark, pairs):
    return spark.createDataFrame(pairs, "source_id long, target_id long")


def test_every_pair_and_its_closeness(spark, monkeypatch):
    monkeypatch.setattr(centrality, "TOGETHER", 8)
    pairs = some_graph(5)
    want = brute_distances(pairs)
    rows = centrality.every_distance(links(spark, pairs)).collect()
    assert len(rows) == len(want) and {(r["src"], r["node"]): r["dist"] for r in rows} == want
    n, of = len({s for s, _ in want}), {}
    for (s, _), d in want.items():
        r, t = of.get(s, (-1, 0))
        of[s] = r + 1, t + d
    got = {r["entity_id"]: r["closeness"] for r in centrality.every_closeness(links(spark, pairs)).collect()}
    assert got == {s: pytest.approx((r / t) * (r / (n - 1)), abs=1e-6) for s, (r, t) in of.items()}


def test_whole_distances_begin_at_every_node(spark, sql):
    n = sql("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 25 + 5 AS n")["n"][0]
    found = catalogue.QUERIES["all_pairs_distance_whole"](spark, SF).groupBy("src").agg(F.count("*").alias("n"), F.sum("dist").alias("t")).toPandas()
    assert len(found) == n and set(found["n"]) == {n}
    close = {r["entity_id"]: r["closeness"] for r in catalogue.QUERIES["closeness_whole"](spark, SF).collect()}
    assert close == {r.src: pytest.approx((n - 1) / r.t, abs=1e-6) for r in found.itertuples()}


def test_numbers_stand_for_ids_in_their_order(spark):
    keys = [None, 0, 7, 99_999, 100_000, 12_345, 123_456, 1_234_567, 10**15 - 1, -1, -12_345, -123_456, 1 - 10**15]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    both = None
    for p in A.PREFIXES:
        one = rows.select(A.number(p, "k").alias("n"), A.entity_id(p, "k").alias("id"))
        both = one if both is None else both.unionByName(one)
    got = both.select("n", "id", A.name_of("n").alias("name"), A.order_of("n").alias("o")).collect()
    assert len({r["n"] for r in got}) == len(got) == len(keys) * len(A.PREFIXES) and all(r["id"] == r["name"] for r in got)
    assert [r["id"] for r in sorted(got, key=lambda r: r["o"])] == sorted(r["id"] for r in got)
    with pytest.raises(Exception, match="digits"):
        spark.createDataFrame([(10**15,)], "k long").select(A.number("order", "k")).collect()


def test_the_numbered_network_is_the_network(spark):
    whole = A.network(spark, SF).groupBy("source_id", "target_id").agg(F.count("*").alias("w")).toPandas()
    assert same(A.numbered_network(spark, SF).select(A.name_of("source_id").alias("source_id"), A.name_of("target_id").alias("target_id"), "w").toPandas(), whole)
    assert same(A.numbered_entities(spark, SF).select(A.name_of("entity_id").alias("entity_id")).toPandas(), A.entities(spark, SF).select("entity_id").toPandas())


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_of_every_node_is_exact(spark, seed):
    """Against plain distances and numbers of paths; more than 64 nodes, where 64 pivots only estimate."""
    pairs = some_graph(seed)
    r = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}") for a, b in [*pairs, *pairs[:5], (3, 3)]], "source_id string, target_id string")
    n = graph.endpoints(graph.links(r)).count()
    want = {x[0]: x[1] for x in centrality.betweenness(r, centrality.distances(r), n).collect()}
    got = {x["entity_id"]: x["betweenness"] for x in centrality.every_betweenness(r).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()} and len(got) > 100 and max(got.values()) > 0.05
    star = spark.createDataFrame([("hub", f"leaf{i}") for i in range(4)], "source_id string, target_id string")
    assert {x[0]: x[1] for x in centrality.every_betweenness(star).collect()} == {"hub": 1.0} | {f"leaf{i}": 0.0 for i in range(4)}


def test_indicators_come_from_exact_betweenness(spark, monkeypatch):
    from skein.plans import graphs

    monkeypatch.setattr(centrality, "sampled_betweenness", lambda *a, **k: 1 / 0)
    x = graphs.scored(spark, SF)
    n = graph.endpoints(graph.links(x.rels)).count()
    want = {r[0]: r[1] for r in centrality.betweenness(x.rels, centrality.distances(x.rels), n).collect()}
    assert n and {r["entity_id"]: r["betweenness"] for r in x.between.collect()} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_whole_cuts_and_betweenness_move_numbers_for_names(spark, monkeypatch):
    from skein.operators import community

    rels = A.network(spark, SF).cache()
    cuts = {r[0] for r in community.articulation_points(rels).collect()}
    between = {r[0]: r[1] for r in centrality.betweenness_from(rels, A.nations(spark, SF)).collect()}
    texts = []
    for m in (community, centrality, graph):
        monkeypatch.setattr(m, "settle", lambda df, *a, real=m.settle, **k: texts.extend(c for c, t in df.dtypes if t == "string") or real(df, *a, **k))
    assert {r["entity_id"] for r in catalogue.QUERIES["articulation_points_whole"](spark, SF).collect()} == cuts and cuts
    got = {r["entity_id"]: r["betweenness"] for r in catalogue.QUERIES["betweenness_whole"](spark, SF).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in between.items()} and not texts

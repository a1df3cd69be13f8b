import itertools
import random
from collections import Counter, defaultdict

import pytest

from skein.operators import community
from tests.test_graphs import ids, rels


def modularity(pairs, label):
    m, degree = len(pairs), Counter(x for p in pairs for x in p)
    total = Counter()
    for n, d in degree.items():
        total[label[n]] += d
    return sum(label[a] == label[b] for a, b in pairs) / m - sum((d / (2 * m)) ** 2 for d in total.values())


def greedy(pairs):
    """Merges the pair of largest gain, one at a time, by looking at all pairs."""
    m, label = len(pairs), {x: x for p in pairs for x in p}
    while True:
        degree, between = Counter(), Counter()
        for a, b in pairs:
            x, y = label[a], label[b]
            degree[x] += 1
            degree[y] += 1
            between[min(x, y), max(x, y)] += x != y
        gains = [(2 * m * e - degree[x] * degree[y], x, y) for (x, y), e in between.items() if e]
        if not gains or max(gains)[0] <= 0:
            return label
        _, x, y = max(gains)
        label = {n: x if c == y else c for n, c in label.items()}


def planted(seed, groups, size, inside, outside):
    rng, names = random.Random(seed), [f"n{i:03d}" for i in range(groups * size)]
    return [(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if rng.random() < (inside if i // size == j // size else outside)]


GRAPHS = {
    "planted": planted(1, 3, 10, 0.45, 0.03), "sparse": planted(2, 1, 32, 0.08, 0.08), "two": [*itertools.combinations("abcd", 2), *itertools.combinations("wxyz", 2), ("a", "w")],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_modularity_near_greedy(spark, name):
    pairs = GRAPHS[name]
    label = {r["node"]: r["community"] for r in community.modularity_communities(rels(spark, pairs)).collect()}
    assert set(label) == {x for p in pairs for x in p} and all(label[c] == c and c <= n for n, c in label.items())
    assert modularity(pairs, label) >= modularity(pairs, greedy(pairs)) - 0.02


def test_few_rounds_on_a_star_and_a_complete_graph(spark, monkeypatch):
    rounds, true = [], community._mergers
    monkeypatch.setattr(community, "_mergers", lambda *a: rounds.append(1) or true(*a))
    star = community.modularity_communities(rels(spark, [("hub", f"leaf{i:03d}") for i in range(40)]), moves=0)
    assert star.select("community").distinct().count() == 1 and len(rounds) <= 3
    rounds.clear()
    names = [f"n{i:02d}" for i in range(12)]
    assert community.modularity_communities(rels(spark, list(itertools.combinations(names, 2))), moves=0).count() == 12 and len(rounds) <= 8


def test_no_edges(spark):
    none = rels(spark, [("a", "b")]).where("false")
    assert community.modularity_communities(none).count() == 0 and community.label_propagation_in_turns(none, ids(spark, [])).count() == 0
    table = community.community_table(rels(spark, GRAPHS["two"]), community.modularity_communities(rels(spark, GRAPHS["two"])))
    assert [(r["community_id"], r["community"], r["size"]) for r in table.orderBy("community_id").collect()] == [("community-000", "a", 4), ("community-001", "w", 4)]


@pytest.mark.parametrize("name", ["two", "bipartite"])
def test_votes_in_turn_equal_one_by_one(spark, name):
    pairs = [(f"a{i}", f"b{j}") for i in range(3) for j in range(3)] if name == "bipartite" else GRAPHS[name][:60]
    pairs = [*pairs, pairs[0], pairs[0], (pairs[1][0], pairs[1][0])]  # parallel edges and a self-loop
    got = {r["node"]: (r["colour"], r["label"]) for r in community.label_propagation_in_turns(rels(spark, pairs), ids(spark, ["alone"])).collect()}
    near = defaultdict(list)
    for a, b in pairs:
        if a != b:
            near[a].append(b)
            near[b].append(a)
    assert all(got[a][0] != got[b][0] for a, b in pairs if a != b) and got["alone"] == (0, "alone")
    label = {n: n for n in got}
    for _ in range(12):
        before = dict(label)
        for n in sorted(got, key=lambda n: (got[n][0], n)):
            if near[n]:
                label[n] = min((-c, x) for x, c in Counter(label[v] for v in near[n]).items())[1]
        if label == before:
            break
    assert {n: x for n, (_, x) in got.items()} == label
    if name == "bipartite":
        assert len(set(label.values())) == 2  # alone, and one for all the others


def test_estimates_are_exact_from_all_nodes_and_near_from_some(spark):
    from skein.operators import centrality

    r = rels(spark, GRAPHS["planted"])
    n = len({x for p in GRAPHS["planted"] for x in p})
    dist = centrality.distances(r)
    true = {x[0]: x[1] for x in centrality.betweenness(r, dist, n).collect()}, {x[0]: x[1] for x in centrality.closeness(dist, n).collect()}
    for f, want in zip((centrality.sampled_betweenness, centrality.sampled_closeness), true):
        assert {x[0]: (x[1], x[2]) for x in f(r, n).collect()} == {k: (pytest.approx(v, abs=2e-6), 0.0) for k, v in want.items()}
        some = {x[0]: (x[1], x[2]) for x in f(r, 15).collect()}
        assert sum(abs(v - want[k]) <= 3 * e + 0.01 for k, (v, e) in some.items()) >= 0.9 * n


def test_timed_chains_by_loops(spark):
    from skein.operators import traverse

    rng = random.Random(5)
    import datetime
    from decimal import Decimal

    pays = [(f"rel-{i:03d}", f"a{rng.randrange(5)}", f"a{rng.randrange(5)}", datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(50)), Decimal(rng.randrange(0, 400)) / 4) for i in range(120)]
    pays += [("none", "a1", "a2", None, Decimal(5)), ("void", "a1", "a2", datetime.date(2020, 1, 3), None)]
    df = spark.createDataFrame(pays, "relationship_id string, source_id string, target_id string, ts date, amount decimal(15,2)")
    walks, want = [([p[1], p[2]], [p[0]], p[3], p[4]) for p in pays if p[1] != p[2] and p[3] and p[4]], []
    for _ in range(2, 5):
        walks = [([*w[0], p[2]], [*w[1], p[0]], p[3], p[4]) for w in walks for p in pays if p[3] and p[4] and p[1] == w[0][-1] and p[2] not in w[0] and 0 < (p[3] - w[2]).days <= 10 and w[3] * Decimal("0.8") <= p[4] <= w[3]]
        want += [(">".join(w[0]), ",".join(w[1])) for w in walks]
    got = [(r["path"], r["evidence"]) for r in traverse.timed_chains(df, 10, 0.8).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    assert traverse.timed_chains(df, 10, 0.8, limit=3).select("chain_id").orderBy("chain_id").first()[0] == "chain-000"

"""Steps whose cost must follow the input."""

import random
import re

from pyspark.sql import functions as F
from tests.test_graphs import rels

from skein.operators import centrality, community, graph, text, traverse
from skein.sources import adapters as A


def brute_cuts(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def parts(without):
        left, n = set(near) - {without}, 0
        while left:
            n += 1
            todo = [left.pop()]
            while todo:
                new = near[todo.pop()] & left
                left -= new
                todo += new
        return n

    return {x for x in near if parts(x) > parts(None)}


def test_distances_meet_an_edge_once_for_64_sources(spark, monkeypatch):
    rng = random.Random(2)
    names = [f"n{i:03d}" for i in range(70)]
    r = rels(spark, [tuple(rng.sample(names, 2)) for _ in range(350)]).cache()
    want = {tuple(x) for x in centrality.distances(r).select("src", "node", "dist").collect()}
    rows = []
    monkeypatch.setattr(centrality, "settle", lambda df, partitioned=False, real=centrality.settle: rows.append((df.columns, (out := real(df, partitioned)).count())) or out)
    assert {tuple(x) for x in centrality.hops(r).collect()} == want and len(want) > 64 * 64
    assert sum(n for c, n in rows if "mask" in c) < len(want) / 4


def test_a_forest_needs_no_tree_of_blocks(spark, monkeypatch):
    pairs = [(f"c{i % 7}", f"o{i}") for i in range(60)] + [(f"c{i}", "n0") for i in range(7)] + [("x", "y")]
    monkeypatch.setattr(community, "block_cuts", lambda adj: 1 / 0)
    assert {x[0] for x in community.articulation_points(rels(spark, pairs)).collect()} == brute_cuts(pairs)


def test_leaves_of_other_graphs(spark):
    rng = random.Random(9)
    for n, m in ((20, 26),):
        pairs = [(f"n{a}", f"n{b}") for a, b in (rng.sample(range(n), 2) for _ in range(m))] + [(f"n{rng.randrange(n)}", f"leaf{i}") for i in range(25)] + [("n1", "n1")]
        assert {x[0] for x in community.articulation_points(rels(spark, pairs)).collect()} == brute_cuts(pairs)
    assert community.articulation_points(rels(spark, [("a", "a")])).count() == 0
    assert graph.links(rels(spark, [("b", "a"), ("a", "b"), ("a", "a")])).collect() == [("a", "b")]


def payments(spark, rows):
    return spark.createDataFrame(rows, "relationship_id string, source_id string, target_id string, ts string, amount string").selectExpr("relationship_id", "source_id", "target_id", "date(ts) AS ts", "cast(amount AS decimal(31,4)) AS amount")


def test_payments_that_follow_none_are_not_kept_for_chains(spark, monkeypatch):
    """Of 200 payments to one account only its own payment can follow; either side may be the smaller."""
    many = [(f"r{i:03d}", f"payer{i}", "hub", "2020-01-01", "100") for i in range(200)] + [("s0", "hub", "end", "2020-01-05", "95")]
    turned = [("s0", "start", "hub", "2020-01-01", "100")] + [(f"r{i:03d}", "hub", f"paid{i}", "2020-01-05", "95") for i in range(200)]
    for rows, kept in ((many, 1), (turned, 200)):
        stored = []
        with monkeypatch.context() as m:
            m.setattr(traverse, "settle", lambda df, real=traverse.settle: stored.append((out := real(df)).count()) or out)
            assert traverse.timed_chains(payments(spark, rows)).count() == 200
        assert stored[:2] == [1, kept]


def test_ids_of_numbers_as_formatted(spark):
    keys = [0, 7, 99_999, 100_000, 12_345_678_901, -1, -123_456]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", A.entity_id("x", "k").alias("id"), A._account("k").alias("account")).collect()
    assert {r["k"]: r["id"] for r in got} == {k: "x-%05d" % k for k in keys}
    assert {r["k"]: r["account"] for r in got} == {k: "account-" + ("%05d" % k).lstrip("-") for k in keys}


def test_betweenness_from_sources_moves_no_edge_for_sources_it_serves_not(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(60)] + [(rng.choice(names), f"leaf{i}") for i in range(40)] + [("p", "q"), ("s", "r")]
    r = rels(spark, pairs).cache()
    sources = spark.createDataFrame([(x,) for x in [*names[:5], "leaf3", "s", "absent"]], "id string")
    n = graph.links(r).select("source_id").union(graph.links(r).select("target_id")).distinct().count()
    want = {x[0]: x[1] for x in centrality.betweenness(r, centrality.distances(r, sources), n).collect()}
    rows = []
    monkeypatch.setattr(centrality, "settle", lambda df, partitioned=False, real=centrality.settle: rows.append((df.columns, (out := real(df, partitioned)).count())) or out)
    got = {x[0]: x[1] for x in centrality.betweenness_from(r, sources).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 2e-6 for k in want) and max(want.values()) > 0
    assert max(c for _, c in rows) < 4 * len(pairs)


def test_shortest_paths_compare_numbers_and_stop_with_the_graph(spark, monkeypatch):
    """Paths are written once a node, and no round follows the one that reaches nothing."""
    rng = random.Random(8)
    pairs = [tuple(rng.sample([f"n{i:02d}" for i in range(30)], 2)) for _ in range(70)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best, front = {"n00": ("n00",)}, {"n00": ("n00",)}
    while front:
        new = {}
        for node, path in front.items():
            for other in near[node] - set(best):
                new[other] = min(new.get(other, (*path, other)), (*path, other))
        best, front = {**best, **new}, new
    held = []
    monkeypatch.setattr(traverse, "settle", lambda df, real=traverse.settle: held.append(("path" in df.columns, (out := real(df)).count())) or out)
    got = {r["entity_id"]: tuple(r["path"]) for r in traverse.shortest_paths(rels(spark, pairs), "n00").collect()}
    assert got == best and max(map(len, best.values())) < traverse.MAX_DEPTH
    assert sum(has for has, _ in held) == max(map(len, best.values())) + 1 and sum(n for has, n in held if has) == len(best)


def test_a_task_of_cue_relations_sorts_a_bounded_number_of_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "Amber Holt called Boris Holt. Boris Holt works for Delta Traders Ltd.") for i in range(100)], "doc_id long, text string")
    cues, mentions = text.cues_in(docs), text.extract_mentions(docs)
    monkeypatch.setattr(text, "DOCS_A_TASK", 10)
    dealt = text.nearest_cue_relations(cues, mentions, docs=100)
    assert sorted(dealt.collect()) == sorted(text.nearest_cue_relations(cues, mentions).collect()) and dealt.count() >= 200
    assert dealt.rdd.getNumPartitions() == 11


def test_cue_relations_and_the_gate_read_each_text_once(spark):
    rng = random.Random(8)
    words = ["Anna Smith", "Bob Jones", "Blue Traders Ltd", "Sector 9", "Mill Lane Abc", "KA-12-AB-1007", "FICA12345678", "called", "Works  for", "met", "owns", "member of", "Went to", "sent", "metro", "works\xa0for", "émet", "located at"]
    texts = {i: "".join(rng.choice(words) + rng.choice([" ", " . ", ""]) for _ in range(rng.randrange(1, 30))) for i in range(150)} | {200: None, 201: "", 202: "Sector 12met Anna Smith"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    read = text.extract_mentions(docs, reach=True).cache()
    linked = F.col("start") % 2 == 0
    got = sorted(tuple(r) for r in text.cue_relations(None, read, linked).select("doc_id", "source_text", "target_text", "relationship_type").collect())  # no texts are asked for
    want, mentions = [], {}
    for m in read.drop("reach").collect():
        mentions.setdefault(m["doc_id"], []).append(m)
    for i, found in mentions.items():
        for s, t, pattern, kind, _ in text.CUES:
            for p in (m for m in found if m["entity_type"] == s):
                for q in (m for m in found if m["entity_type"] == t and (s != t or p["start"] < m["start"])):
                    low, high = min(p["end"], q["end"]), max(p["start"], q["start"])
                    ok = kind not in text.NEEDS_IDS or (p["start"] % 2 == 0 and q["start"] % 2 == 0)
                    between = texts[i][low:high].replace("\xa0", ".")
                    if ok and low < high and re.search(pattern, between):
                        want.append((i, p["text"], q["text"], kind))
    assert got == sorted(want) and len(got) > 200
    assert sorted(map(tuple, text.cue_relations(docs, read.drop("reach")).collect())) == sorted(map(tuple, text.cue_relations(None, read).collect()))
    gate = {r["doc_id"]: r for r in text.gate(docs, read, text.cue_relations(None, read, linked)).collect()}
    assert {i: (r["n_mentions"], r["n_relations"]) for i, r in gate.items()} == {i: (len(mentions.get(i, [])), sum(x[0] == i for x in want)) for i in texts}


def test_texts_without_a_rules_hint_hold_no_match():
    rng = random.Random(9)
    words = ["+91-92-1234567", "+44 1234567890", "AB-FIC12-XY123", "KA 1 B 123", "KA-12-AB-1007", "FICA12345678", "SYN-CASE-2024-001", "SYN-FIR-2024-0001", "Blue\tTraders Ltd", "Imports & Exports", "Anna Smith", "Ring Road", "Tech Park Gate 4", "and", "AB", "12", "-"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(1, 6))) for _ in range(2000)]
    for rule in text.RULES:
        held = [t for t in texts if re.search(rule.pattern, t)]
        assert held and rule.hint and all(re.search(rule.hint, t) for t in held), rule.name


def test_walks_through_a_hub_are_dealt_to_tasks(spark, monkeypatch):
    pairs = [(f"n{i:03d}", "hub") for i in range(300)] + [("hub", "top"), ("n000", "n001"), ("n000", "hub")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    starts = [f"n{i:03d}" for i in range(0, 300, 3)] + ["none"]
    want = [(s, v, 1, (s, v)) for s in starts for v in near.get(s, ())]
    want += [(s, w, 2, (s, v, w)) for s, v, _, _ in list(want) for w in near[v] if w != s]
    monkeypatch.setattr(graph, "BUCKET", 16, raising=False)
    monkeypatch.setattr(graph, "WALKS_A_TASK", 1000, raising=False)
    got = graph.typed_walks(rels(spark, pairs), spark.createDataFrame([(s,) for s in starts], "entity_id string"), ["TRANSFERRED_TO"], 2).cache()
    assert sorted((r["start"], r["node"], r["hops"], tuple(r["path"])) for r in got.collect()) == sorted(want)
    a_task = got.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    assert len(want) > 30_000 and a_task < 4_000


def test_two_thousand_walks_and_neighbours_of_a_hub_meet_without_copies(spark):
    walks = spark.range(2000).selectExpr("'hub' AS node", "concat('s', id) AS start", "array(concat('s', id), 'hub') AS path")
    near = spark.range(2000).selectExpr("'hub' AS node", "concat('n', id) AS nbr")
    got = graph._extended(walks, near)
    assert got.count() == 4_000_000 and got.select("_i", "_j").distinct().count() == 1

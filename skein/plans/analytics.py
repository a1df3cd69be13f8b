"""Strength, temporal and derived queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import centrality, derived, strength, temporal, traverse
from skein.operators.base import settle
from skein.plans import graphs
from skein.sources import adapters as A

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STRENGTH_SQL = f"""WITH {A.PAYMENTS_SQL}, freq AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS pair_frequency FROM payments GROUP BY 1, 2),
strength AS (SELECT relationship_id, relationship_type, source_id, target_id, pair_frequency,
  round(least(1e0, (1.5e0 * 0.3e0 + confidence * 0.4e0 + least(1e0, (pair_frequency - 1) * 0.15e0) * 0.2e0 + CASE WHEN ts IS NOT NULL THEN 0.1e0 ELSE 0e0 END) / 1.5e0), 4) AS interaction_strength
  FROM payments JOIN freq ON least(source_id, target_id) = a AND greatest(source_id, target_id) = b)"""


@query(f"{STRENGTH_SQL} SELECT * FROM strength ORDER BY interaction_strength DESC, relationship_id LIMIT 50")
def relationship_strength_top(spark, d):
    return strength.strongest(A.payments(spark, d))


@query(f"{STRENGTH_SQL} SELECT * FROM strength")
def relationship_strength(spark, d):
    return strength.relationship_strength(A.payments(spark, d))


@query(f"WITH {A.PAYMENTS_SQL}, f AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS pair_frequency FROM payments GROUP BY 1, 2) SELECT * FROM f ORDER BY pair_frequency DESC, a, b LIMIT 20")
def pair_frequency_top(spark, d):
    return strength.pair_frequency(A.payments(spark, d)).orderBy(F.desc("pair_frequency"), "a", "b").limit(20)


@query(f"WITH {A.PAYMENTS_SQL} SELECT relationship_id, count(*) OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id)) AS pair_frequency FROM payments")
def pair_frequency_window(spark, d):
    return strength.with_pair_window(A.payments(spark, d)).select("relationship_id", "pair_frequency")


@query(f"WITH {A.PAYMENTS_SQL} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM payments GROUP BY 1")
def monthly_activity(spark, d):
    return temporal.monthly(A.payments(spark, d))


@query(f"WITH {A.PAYMENTS_SQL} SELECT source_id, sum(amount)::DOUBLE AS total, max(amount)::DOUBLE AS largest, count(*) AS n FROM payments GROUP BY 1 ORDER BY total DESC, source_id LIMIT 20")
def amount_by_payer(spark, d):
    pay = A.payments(spark, d)
    return pay.groupBy("source_id").agg(F.sum("amount").cast("double").alias("total"), F.max("amount").cast("double").alias("largest"), F.count("*").alias("n")).orderBy(F.desc("total"), "source_id").limit(20)


BURST_SQL = f"""WITH {A.ACTIVITY_SQL}, times AS (SELECT source_id AS entity, relationship_id, epoch_us(ts) AS us FROM activity UNION ALL SELECT target_id, relationship_id, epoch_us(ts) FROM activity
  UNION ALL SELECT 'type:' || relationship_type, relationship_id, epoch_us(ts) FROM activity WHERE relationship_type IN ('purchase', 'error')),
placed AS (SELECT *, (us - (SELECT min(us) FROM times)) // 86400000000 AS win, (SELECT min(us) FROM times) AS first FROM times),
win AS (SELECT entity, win, first, count(*) AS n FROM placed GROUP BY 1, 2, 3),
base AS (SELECT entity, avg(n) AS mean, stddev_pop(n) AS std FROM win GROUP BY 1 HAVING count(*) >= 2 AND sum(n) >= 3),
found AS (SELECT w.*, mean, std, CASE WHEN std > 0 THEN mean + 2e0 * std ELSE mean + 1 END AS t FROM win w JOIN base USING (entity)),
bursts AS (SELECT entity, 'temporal_burst' AS indicator_type, win, first + win * 86400000000 AS start_us, n AS observed, round(mean, 2) AS mean, round(std, 2) AS std, round(t, 2) AS threshold FROM found WHERE n > t AND n >= 3)"""
KINDS = ("purchase", "error")


@query(f"{BURST_SQL} SELECT * FROM bursts")
def activity_bursts(spark, d):
    return temporal.bursts(A.activity(spark, d), pseudo=KINDS)


@query(f"{BURST_SQL}, hit AS (SELECT p.entity, p.win, p.relationship_id, row_number() OVER (PARTITION BY p.entity, p.win ORDER BY p.us, p.relationship_id) AS position FROM placed p JOIN bursts USING (entity, win)) SELECT entity, win, position::INTEGER AS position, relationship_id FROM hit WHERE position <= 5")
def burst_evidence_interval(spark, d):
    act = A.activity(spark, d)
    return temporal.burst_evidence(act, temporal.bursts(act, pseudo=KINDS), pseudo=KINDS)


@query(f"WITH {A.ACTIVITY_SQL}, t AS (SELECT source_id AS entity, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM activity)) // 86400000000 AS win FROM activity) SELECT entity, win, count(*) AS n FROM t GROUP BY 1, 2")
def window_counts(spark, d):
    act = A.activity(spark, d)
    times = act.select(F.col("source_id").alias("entity"), temporal.micros("ts").alias("us"))
    return temporal.windows(times).select("entity", "win", "n")


def _all(spark, d):
    """The analytics of frequent payments, the activity's bursts and the chains of payments between accounts."""
    rows = settle(A.paid(spark, d))
    x = graphs.scored(spark, d, rows)
    return x, settle(temporal.bursts(A.activity(spark, d), pseudo=KINDS)), settle(traverse.timed_chains(A.account_payments(spark, d, rows)))


@query()
def indicators(spark, d):
    x, burst, chains = _all(spark, d)
    return derived.indicators(x.between, x.bridges, burst, chains)


@query()
def findings(spark, d):
    x, burst, chains = _all(spark, d)
    return derived.findings(x.bridges, burst, chains, strength.relationship_strength(x.rels))


@query()
def evidence_items(spark, d):
    x, burst, chains = _all(spark, d)
    return derived.evidence_items(A.entities(spark, d), x.rels, chains, derived.indicators(x.between, x.bridges, burst, chains))


@query()
def snapshot_bundle(spark, d):
    """Subgraph, findings and evidence of one root as rows of one table."""
    x, burst, chains = _all(spark, d)
    root = spark.createDataFrame([("supplier-00003",)], "entity_id string")
    nodes, edges = traverse.bounded_subgraph(x.rels, A.entities(spark, d), root, 2)
    found = derived.findings(x.bridges, burst, chains, strength.relationship_strength(x.rels))
    items = derived.evidence_items(nodes, edges, chains, derived.indicators(x.between, x.bridges, burst, chains))
    part = lambda df, name, key: df.select(F.lit(name).alias("part"), F.col(key).alias("id"))
    return part(nodes, "entity", "entity_id").unionByName(part(edges, "relationship", "relationship_id")).unionByName(part(found, "finding", "finding_id")).unionByName(part(items, "evidence", "evidence_id"))


@query()
def entity_profile(spark, d):
    x, burst, chains = _all(spark, d)
    facts = x.between.join(centrality.degree_centrality(x.rels, graphs.graph.endpoints(x.rels)), "entity_id")
    return derived.profile(x.rels, facts, x.labels, x.cuts, derived.indicators(x.between, x.bridges, burst, chains), "supplier-00003")


@query()
def explain_lookup(spark, d):
    """Explanations of a bridge, a chain, a burst, a strength, a community and a centrality, uniform records."""
    x, burst, chains = _all(spark, d)
    tied = strength.relationship_strength(x.rels)
    parts = [
        derived.explain("bridge", "supplier-00003", F.concat(F.lit("connects groups by "), "metric"), x.bridges, F.col("entity_id") == "supplier-00003", F.col("evidence"), "bridge_candidates", {"k": "5"}),
        derived.explain("chain", "account-00003", F.format_string("%d transfers", "hop_count"), chains.orderBy("hop_count", "path"), F.contains("path", F.lit("account-00003")), F.col("evidence"), "timed_chains", {"min_hops": "2", "max_hops": "4"}),
        derived.explain("burst", "user-00001", F.format_string("%d in one window", "observed"), burst.orderBy("win"), F.col("entity") == "user-00001", F.col("win"), "bursts", {"hours": "24", "z": "2"}),
        derived.explain("strength", "supplier-00003", F.format_string("strength %.4f", "interaction_strength"), tied.orderBy("relationship_id"), F.col("target_id") == "supplier-00003", F.col("relationship_id"), "relationship_strength", {}),
        derived.explain("community", "supplier-00003", F.concat(F.lit("member of "), "community"), x.labels, F.col("node") == "supplier-00003", F.col("community"), "modularity_communities", {}),
        derived.explain("centrality", "supplier-00003", F.format_string("betweenness %.4f", "betweenness"), x.between, F.col("entity_id") == "supplier-00003", F.col("entity_id"), "betweenness", {}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

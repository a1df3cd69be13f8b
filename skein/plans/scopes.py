"""Paths, analytics, findings and snapshots by scope, over frequent payments between accounts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.scalar import short_hash
from skein.operators import graph, interpret, paths, scopes
from skein.operators.base import settle
from skein.sources import adapters as A

QUERIES, SQL = {}, {}
#: Cases, roots and depth that are looked into, targets of a snapshot's paths.
CASES, ROOTS, DEPTH, TARGETS = 4, 10, 2, 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cases(spark, d):
    """(case_id, entity_id) of the first cases, the case itself included."""
    all_ = A.account_cases(spark, d)
    some = all_.select("case_id").distinct().orderBy("case_id").limit(CASES)
    return all_.join(F.broadcast(some), "case_id", "left_semi").unionByName(some.select("case_id", F.col("case_id").alias("entity_id")))


def _scoped(spark, d):
    """Payments, members of cases and roots, names of the scopes, and the scoped edges."""
    rels = settle(A.frequent_account_payments(spark, d, settle(A.paid(spark, d))))
    roots = settle(graph.endpoints(rels).orderBy("entity_id").limit(ROOTS).select(F.concat(F.lit("root:"), "entity_id").alias("scope"), "entity_id"))
    cases = settle(_cases(spark, d))
    members = cases.select(F.concat(F.lit("case:"), "case_id").alias("scope"), "entity_id").unionByName(scopes.neighbourhoods(rels, roots, DEPTH))
    none = F.lit(None).cast("string")
    names = spark.range(1).select(F.lit("global").alias("scope"), F.lit(0).alias("rank"), none.alias("case_id"))
    names = names.unionByName(cases.select(F.concat(F.lit("case:"), "case_id").alias("scope"), F.lit(1).alias("rank"), "case_id").distinct()).unionByName(roots.select("scope", F.lit(2).alias("rank"), none.alias("case_id")))
    return rels, settle(members), settle(names), settle(scopes.scoped_edges(rels, members, F.startswith("scope", F.lit("root:"))))


SCOPED_SQL = f"""{A.FREQUENT_ACCOUNTS_SQL}, {A.ACCOUNT_CASES_SQL},
links AS (SELECT DISTINCT source_id AS u, target_id AS v FROM pay WHERE source_id <> target_id UNION SELECT target_id, source_id FROM pay WHERE source_id <> target_id),
cases AS (SELECT * FROM account_cases WHERE case_id IN (SELECT DISTINCT case_id FROM account_cases ORDER BY 1 LIMIT {CASES}) UNION SELECT case_id, case_id FROM (SELECT DISTINCT case_id FROM account_cases ORDER BY 1 LIMIT {CASES})),
roots AS (SELECT DISTINCT id FROM (SELECT source_id AS id FROM pay UNION SELECT target_id FROM pay) ORDER BY 1 LIMIT {ROOTS}),
hood AS (SELECT id AS root, id FROM roots UNION SELECT id, v FROM roots JOIN links ON u = id UNION SELECT r.id, b.v FROM roots r JOIN links a ON a.u = r.id JOIN links b ON b.u = a.v),
members AS (SELECT 'case:' || case_id AS scope, entity_id FROM cases UNION ALL SELECT 'root:' || root, id FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id) AS k FROM hood) WHERE k <= {scopes.MAX_NODES}),
names AS (SELECT 'global' AS scope, 0 AS rank, NULL AS case_id UNION ALL SELECT DISTINCT 'case:' || case_id, 1, case_id FROM cases UNION ALL SELECT 'root:' || id, 2, NULL FROM roots),
inside AS (SELECT s.scope, p.* FROM pay p JOIN members s ON s.entity_id = source_id JOIN members t ON t.entity_id = target_id AND t.scope = s.scope),
edges AS (SELECT 'global' AS scope, * FROM pay UNION ALL SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY relationship_id) AS k FROM inside) WHERE k <= {scopes.MAX_EDGES} OR scope LIKE 'case:%'),
times AS (SELECT scope, unnest([source_id, target_id, 'type:' || relationship_type]) AS entity, epoch_us(ts) AS us FROM edges),
wins AS (SELECT scope, entity, (us - first) // 86400000000 AS win, first, count(*) AS n FROM times JOIN (SELECT scope, min(epoch_us(ts)) AS first FROM edges GROUP BY 1) USING (scope) GROUP BY ALL),
base AS (SELECT scope, entity, avg(n) AS mean, stddev_pop(n) AS std FROM wins GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(n) >= 3),
bursts AS (SELECT w.* FROM wins w JOIN base USING (scope, entity) WHERE n >= 3 AND n > CASE WHEN std > 0 THEN mean + 2e0 * std ELSE mean + 1 END),
hops AS (SELECT scope, relationship_id, source_id, target_id, ts::DATE AS ts, amount FROM edges WHERE source_id <> target_id AND amount > 0),
walk AS (SELECT scope, [source_id, target_id] AS path, [relationship_id] AS evidence, target_id AS last, ts, amount, 1 AS hops FROM hops
  UNION ALL SELECT w.scope, list_append(path, h.target_id), list_append(evidence, h.relationship_id), h.target_id, h.ts, h.amount, w.hops + 1 FROM walk w JOIN hops h ON h.scope = w.scope AND h.source_id = w.last
    AND h.ts > w.ts AND h.ts <= w.ts + 30 AND h.amount <= w.amount AND h.amount >= w.amount * 0.9 AND NOT list_contains(w.path, h.target_id) WHERE w.hops < 4),
chains AS (SELECT scope, hops AS hop_count, path[1] AS source_account, last AS destination_account, array_to_string(path, '>') AS path, array_to_string(evidence, ',') AS evidence FROM walk WHERE hops >= 2),
freq AS (SELECT scope, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS f FROM edges GROUP BY 1, 2, 3),
tied AS (SELECT e.scope, relationship_id, source_id, target_id, round(least(1e0, (1.5e0 * 0.3e0 + confidence * 0.4e0 + least(1e0, (f - 1) * 0.15e0) * 0.2e0 + CASE WHEN ts IS NOT NULL THEN 0.1e0 ELSE 0e0 END) / 1.5e0), 4) AS strength
  FROM edges e JOIN freq q ON q.scope = e.scope AND a = least(source_id, target_id) AND b = greatest(source_id, target_id))"""
OBSERVED_SQL = f"""{SCOPED_SQL},
found AS (SELECT scope, 'burst' AS finding_type, entity AS entity_ids, '' AS relationship_ids, 0.5e0 AS score, printf('%s has %d interactions in one window', entity, n) AS description FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, win, entity) AS k FROM bursts) WHERE k <= 2
  UNION ALL SELECT scope, 'chain', replace(path, '>', ','), evidence, round(hop_count / 4e0, 4), 'transfers along ' || path FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY hop_count, source_account, destination_account, path, evidence) AS k FROM chains) WHERE k <= 2
  UNION ALL SELECT scope, 'strength', source_id || ',' || target_id, relationship_id, strength, 'frequent relationship ' || relationship_id FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY strength DESC, relationship_id) AS k FROM tied WHERE strength >= 0.6) WHERE k <= 1),
ids AS (SELECT f.*, rank, 'finding-' || substr(sha256(array_to_string(list_sort(string_split(entity_ids, ',')), '|') || '|' || finding_type || '|' || coalesce(case_id, 'global')), 1, 12) AS finding_id FROM found f JOIN names USING (scope)),
numbered AS (SELECT * EXCLUDE (j) FROM (SELECT *, row_number() OVER (PARTITION BY scope, finding_id ORDER BY finding_type, relationship_ids, description) AS j FROM ids) WHERE j = 1)"""


def _observed(edges):
    return scopes.observed_findings(scopes.bursts(edges), scopes.chains(edges), scopes.strengths(edges))


@query(f"WITH RECURSIVE {OBSERVED_SQL} SELECT * FROM numbered")
def observed_findings_by_scope(spark, d):
    """Bursts, chains and strong relationships of the whole graph, the first cases and the neighbourhoods of the first accounts."""
    _, _, names, edges = _scoped(spark, d)
    return scopes.numbered(_observed(edges), names)


@query(f"""WITH RECURSIVE {OBSERVED_SQL}, asked AS (SELECT DISTINCT finding_id AS id FROM numbered UNION SELECT 'finding-unknown'),
first AS (SELECT * EXCLUDE (z) FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY rank, scope, finding_type, entity_ids, relationship_ids) AS z FROM numbered) WHERE z = 1)
SELECT 'expl-finding-' || id || '-' || substr(sha256(id), 1, 12) AS explanation_id, id, coalesce(scope, '') AS scope, coalesce('Finding ' || finding_type || ': ' || description, 'finding ' || id || ' not found') AS summary,
  coalesce(entity_ids, '') AS contributing_entities, coalesce(relationship_ids, '') AS contributing_relationships, score FROM asked LEFT JOIN first ON id = finding_id""")
def explain_findings_by_scope(spark, d):
    """Every finding of a scope explained by its id, from the first scope that has it."""
    found = settle(observed_findings_by_scope(spark, d))
    asked = found.select(F.col("finding_id").alias("id")).unionByName(spark.range(1).select(F.lit("finding-unknown").alias("id")))
    return scopes.explained(found, asked)


@query(f"WITH RECURSIVE {SCOPED_SQL} SELECT scope, count(*) AS n_edges, count(DISTINCT least(source_id, target_id) || '|' || greatest(source_id, target_id)) AS n_pairs, sum(amount)::DOUBLE AS total, (SELECT count(*) FROM bursts b WHERE b.scope = e.scope) AS n_bursts, (SELECT count(*) FROM chains c WHERE c.scope = e.scope) AS n_chains FROM edges e GROUP BY scope")
def scope_counts(spark, d):
    """Edges, pairs, sum, bursts and chains of each scope that has edges."""
    _, _, _, edges = _scoped(spark, d)
    per = edges.groupBy("scope").agg(F.count("*").alias("n_edges"), F.countDistinct(F.least("source_id", "target_id"), F.greatest("source_id", "target_id")).alias("n_pairs"), F.sum("amount").cast("double").alias("total"))
    count = lambda df, name: df.groupBy("scope").agg(F.count("*").alias(name))
    out = per.join(count(scopes.bursts(edges), "n_bursts"), "scope", "left").join(count(scopes.chains(edges), "n_chains"), "scope", "left")
    return out.na.fill(0, ["n_bursts", "n_chains"])


@query()
def findings_by_scope(spark, d):
    """Findings of every kind, bridges included, by scope."""
    _, _, names, edges = _scoped(spark, d)
    x = scopes.analyses(edges)
    found = scopes.bridge_findings(x.bridges).unionByName(scopes.observed_findings(x.bursts, x.chains, x.strengths))
    return scopes.numbered(found, names)


@query()
def analytics_by_scope(spark, d):
    """Six analytics of every scope as rows: scope, analysis, subject, value."""
    _, _, _, edges = _scoped(spark, d)
    x = scopes.analyses(edges)
    row = lambda df, name, subject, value: df.select("scope", F.lit(name).alias("analysis"), F.col(subject).alias("subject"), F.col(value).cast("double").alias("value"))
    return (
        row(x.central, "centrality", "entity_id", "betweenness").unionByName(row(x.central, "degree", "entity_id", "degree_centrality")).unionByName(row(x.communities, "community", "community", "size"))
        .unionByName(row(x.bridges, "bridge", "entity_id", "score")).unionByName(row(x.bursts, "burst", "entity", "observed")).unionByName(row(x.chains, "chain", "path", "hop_count"))
        .unionByName(row(x.strengths, "strength", "relationship_id", "interaction_strength"))
    )


def _asked_paths(names, members):
    """From each root its first other members in the order of ids, as a snapshot asks for them."""
    root = names.where("rank = 2").select("scope", F.expr("substr(scope, 6)").alias("source_id"))
    return scopes.first_of(members.join(root, "scope").where("entity_id <> source_id"), TARGETS, "entity_id").select("source_id", F.col("entity_id").alias("target_id"))


REACH = "".join(
    f""", l{n} AS (SELECT root, v AS id, min(list_append(path, v)) AS path FROM l{n - 1} JOIN links ON u = id WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT root AS r, id AS i FROM l{k}' for k in range(n))}) WHERE r = root AND i = v) GROUP BY 1, 2)"""
    for n in range(1, DEPTH + 3)
)
PATHS_SQL = f"""{SCOPED_SQL}, asked AS (SELECT root AS source_id, id AS target_id FROM (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY id) AS k FROM (SELECT substr(scope, 6) AS root, entity_id AS id FROM members WHERE scope LIKE 'root:%') WHERE id <> root) WHERE k <= {TARGETS}),
l0 AS (SELECT id AS root, id, [id] AS path FROM roots WHERE id IN (SELECT u FROM links)){REACH},
reached AS ({' UNION ALL '.join(f'SELECT * FROM l{n}' for n in range(DEPTH + 3))}),
best AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, min(relationship_id) AS edge, 'TRANSFERRED_TO' AS kind FROM pay GROUP BY 1, 2),
nodes AS (SELECT source_id, target_id, len(path) - 1 AS hop_count, i, path[i] AS node, CASE WHEN i > 1 THEN path[i - 1] END AS "from" FROM asked JOIN reached ON root = source_id AND id = target_id, (SELECT unnest(range(1, {DEPTH + 4})) AS i) WHERE i <= len(path)),
rows AS (SELECT source_id, target_id, hop_count, string_agg(node, '>' ORDER BY i) AS nodes, string_agg('FinancialAccount', '>' ORDER BY i) AS node_types, string_agg(edge, ',' ORDER BY i) AS edges, string_agg(kind, ',' ORDER BY i) AS relationship_sequence,
    CASE WHEN source_id IN (SELECT entity_id FROM cases) THEN bool_and((SELECT c.case_id FROM account_cases c WHERE c.entity_id = node) = (SELECT c.case_id FROM account_cases c WHERE c.entity_id = source_id)) END AS in_case_network
  FROM nodes LEFT JOIN best ON a = least(node, "from") AND b = greatest(node, "from") AND "from" IS NOT NULL GROUP BY 1, 2, 3)"""


def _described(spark, d, rels, asked):
    cases = _cases(spark, d)
    home = cases.select("case_id", F.col("entity_id").alias("source_id"))
    net = asked.select("source_id").distinct().join(home, "source_id").join(cases, "case_id").select("source_id", "entity_id")
    ents = A.table(spark, d, "customer").select(A.entity_id("account", "c_custkey").alias("entity_id"), F.lit("FinancialAccount").alias("entity_type"))
    return paths.described_paths(rels, ents, asked, DEPTH + 2, ["TRANSFERRED_TO"], net)


@query(f"WITH RECURSIVE {PATHS_SQL} SELECT source_id, target_id, coalesce(hop_count, -1)::INTEGER AS hop_count, coalesce(nodes, '') AS nodes, coalesce(node_types, '') AS node_types, coalesce(edges, '') AS edges, coalesce(relationship_sequence, '') AS relationship_sequence, coalesce(in_case_network::VARCHAR, 'no case') AS in_case_network, hop_count IS NOT NULL AS found, 'graph:shortest_path:max_depth={DEPTH + 2}:types=TRANSFERRED_TO' AS provenance FROM asked LEFT JOIN rows USING (source_id, target_id)")
def snapshot_paths(spark, d):
    """Paths of each root's snapshot with nodes, edges, relationship sequence, case network and provenance."""
    rels, members, names, _ = _scoped(spark, d)
    return _described(spark, d, rels, _asked_paths(names, members)).withColumns({"hop_count": F.coalesce("hop_count", F.lit(-1)).cast("int"), "in_case_network": F.coalesce(F.col("in_case_network").cast("string"), F.lit("no case"))})


@query(f"""WITH RECURSIVE {OBSERVED_SQL}, {PATHS_SQL[len(SCOPED_SQL) + 2:]}, parts AS (SELECT scope, 'entity' AS part, entity_id AS id FROM members WHERE scope LIKE 'root:%' UNION ALL SELECT scope, 'relationship', relationship_id FROM edges WHERE scope LIKE 'root:%'
  UNION ALL SELECT 'root:' || source_id, 'path', nodes FROM rows UNION ALL SELECT scope, 'finding', finding_id FROM numbered WHERE scope LIKE 'root:%')
SELECT 'snapshot-' || substr(sha256('global|' || substr(scope, 6) || '|{DEPTH}|{scopes.MAX_NODES}'), 1, 12) AS snapshot_id, substr(scope, 6) AS root, part, id, 'ev-' || substr(sha256(part || '|' || id), 1, 12) AS evidence_id FROM parts""")
def snapshots_by_root(spark, d):
    """Snapshots of the roots: entities, relationships, paths and observed findings, each with its evidence id, under an id of case, root, depth and bound."""
    rels, members, names, edges = _scoped(spark, d)
    of_root = F.startswith("scope", F.lit("root:"))
    part = lambda df, name, c: df.select("scope", F.lit(name).alias("part"), F.col(c).alias("id"))
    asked = _described(spark, d, rels, _asked_paths(names, members)).where("found").withColumn("scope", F.concat(F.lit("root:"), "source_id"))
    found = scopes.numbered(_observed(edges.where(of_root)), names)
    all_ = part(members, "entity", "entity_id").unionByName(part(edges, "relationship", "relationship_id")).where(of_root).unionByName(part(asked, "path", "nodes")).unionByName(part(found, "finding", "finding_id"))
    root = F.expr("substr(scope, 6)")
    snapshot = F.concat(F.lit("snapshot-"), short_hash(F.lit("global"), root, F.lit(str(DEPTH)), F.lit(str(scopes.MAX_NODES))))
    return all_.select(snapshot.alias("snapshot_id"), root.alias("root"), "part", "id", F.concat(F.lit("ev-"), short_hash(F.col("part"), F.col("id"))).alias("evidence_id"))


def _interpretation_sql() -> str:
    """The sentences of interpret.py put together in SQL, for scopes whose bursts and chains were measured."""
    text = {c: (seen, note) for c, seen, note in interpret.SIGNALS}
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    seen = ", ".join(f"CASE WHEN n_{c} > 0 THEN printf({quote(text[c][0])}, n_{c}) END" for c in ("bursts", "chains"))
    notes = ", ".join(f"CASE WHEN n_{c} > 0 THEN {quote(text[c][1])} END" for c in ("bursts", "chains"))
    kinds = ", ".join(quote(k) for k in interpret.KINDS)
    b = interpret.BRIEFS
    return f"""WITH RECURSIVE {SCOPED_SQL}, ends AS (SELECT scope, source_id AS id FROM edges UNION SELECT scope, target_id FROM edges),
per AS (SELECT scope, count(*) AS e, array_to_string(list_sort(list(id))[1:3], ',') AS first_ids FROM ends GROUP BY 1),
c AS (SELECT p.*, case_id, CASE WHEN scope LIKE 'root:%' THEN substr(scope, 6) END AS root, (SELECT count(*) FROM edges x WHERE x.scope = p.scope) AS r, (SELECT count(*) FROM bursts x WHERE x.scope = p.scope) AS n_bursts, (SELECT count(*) FROM chains x WHERE x.scope = p.scope) AS n_chains FROM per p JOIN names USING (scope)),
k AS (SELECT *, unnest([{kinds}]) AS analysis_type FROM c),
said AS (SELECT *, list_filter([printf({quote(interpret.WHOLE)}, e, r, coalesce(case_id, 'global')), {seen}], lambda x: x IS NOT NULL) AS o,
  list_filter([{quote(interpret.CENTRAL)}, {notes}, CASE analysis_type WHEN 'entity_brief' THEN printf({quote(b['entity_brief'])}, coalesce(root, string_split(first_ids, ',')[1])) WHEN 'investigation_brief' THEN {quote(b['investigation_brief'])} WHEN 'network_brief' THEN {quote(b['network_brief'])} END], lambda x: x IS NOT NULL) AS n FROM k)
SELECT scope, analysis_type, 'ai-' || substr(sha256(concat_ws('|', analysis_type, coalesce(case_id, ''), coalesce(root, ''), e, r, first_ids)), 1, 12) AS analysis_id, analysis_type || ': ' || o[1] AS summary, array_to_string(o, ' ') AS observations, array_to_string(n, ' ') AS notes,
  round(least({interpret.CEILING}e0, {interpret.FLOOR}e0 + {interpret.STEP}e0 * (len(o) + len(n))), 2) AS confidence, first_ids AS supporting_entities FROM said"""


@query(_interpretation_sql())
def interpretations_by_scope(spark, d):
    """Eleven kinds of interpretation of each scope that has edges, from its counts, bursts and chains."""
    _, _, names, edges = _scoped(spark, d)
    ends = graph.endpoints(edges).select(scopes.scope_of("entity_id").alias("scope"), scopes.bare("entity_id").alias("entity_id"))
    first = scopes.first_of(ends, 3, "entity_id").groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("first_ids"))
    count = lambda df, name: df.groupBy("scope").agg(F.count("*").alias(name))
    counts = names.join(count(ends, "entities"), "scope").join(count(edges, "relationships"), "scope").join(first, "scope")
    counts = counts.join(count(scopes.bursts(edges), "bursts"), "scope", "left").join(count(scopes.chains(edges), "chains"), "scope", "left")
    none, root = F.lit(None).cast("long"), F.when(F.startswith("scope", F.lit("root:")), F.expr("substr(scope, 6)"))
    return interpret.interpretations(counts.withColumns({"root": root, "central": F.lit(True), "bridges": none, "communities": none, "indicators": none}))

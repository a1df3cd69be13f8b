"""Evaluation, grounding, validation, chains, explanations and case views, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions import scalar as S
from skein.operators import graph, review, temporal
from skein.plans import analytics, graphs
from skein.operators.base import shared_folder
from skein.sources import adapters as A
from skein.sources import collections, versions

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Evaluation: what is known of customers against a provider's answers, which miss some, change the case of some and get some wrong.

EVAL_SQL = """cust AS (SELECT c_custkey AS k, printf('nation-%05d', c_nationkey) AS scenario, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
ee AS (SELECT DISTINCT scenario, 'Person' AS kind, lower(trim(c_name)) AS value FROM cust),
pe AS (SELECT DISTINCT scenario, CASE WHEN k % 17 = 0 THEN 'Organization' ELSE 'Person' END AS kind, lower(trim(CASE WHEN k % 11 = 0 THEN upper(c_name) WHEN k % 13 = 0 THEN c_name || ' x' ELSE c_name END)) AS value FROM cust WHERE k % 7 <> 0),
er AS (SELECT DISTINCT scenario, lower(c_name) AS source, lower(n_name) AS target, 'LOCATED_AT' AS kind FROM cust),
pr AS (SELECT DISTINCT scenario, lower(c_name) AS source, lower(n_name) AS target, CASE WHEN k % 9 = 0 THEN 'OWNS' ELSE 'LOCATED_AT' END AS kind FROM cust WHERE k % 5 <> 0),
ec AS (SELECT scenario, count(*) FILTER (e.value IS NOT NULL AND p.value IS NOT NULL) AS tp, count(*) FILTER (e.value IS NULL) AS fp, count(*) FILTER (p.value IS NULL) AS fn
  FROM ee e FULL JOIN pe p USING (scenario, kind, value) GROUP BY 1),
rc AS (SELECT scenario, count(*) FILTER (e.source IS NOT NULL AND p.source IS NOT NULL) AS tp, count(*) FILTER (e.source IS NULL) AS fp, count(*) FILTER (p.source IS NULL) AS fn
  FROM er e FULL JOIN pr p USING (scenario, source, target, kind) GROUP BY 1)"""


def _rates(prefix: str = "") -> str:
    p, r = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)"
    return f"round({p}, 4) AS {prefix}precision, round({r}, 4) AS {prefix}recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 4) AS {prefix}f1"


def _evaluated(spark, d):
    """Counts of entities and of relationships by scenario."""
    nation = A.table(spark, d, "nation").select("n_nationkey", "n_name")
    c = A.table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), A.entity_id("nation", "c_nationkey").alias("scenario"), "c_name", "n_name")
    every = lambda m: F.col("k") % m == 0
    value = F.when(every(11), F.upper("c_name")).when(every(13), F.concat("c_name", F.lit(" x"))).otherwise(F.col("c_name"))
    entity = lambda kind, text: (F.trim(kind).alias("kind"), F.lower(F.trim(text)).alias("value"))
    link = lambda kind: (F.lower("c_name").alias("source"), F.lower("n_name").alias("target"), F.upper(kind).alias("kind"))
    ec = review.scenario_counts(c.select("scenario", *entity(F.lit("Person"), F.col("c_name"))), c.where(~every(7)).select("scenario", *entity(F.when(every(17), "Organization").otherwise("Person"), value)), "scenario", ["kind", "value"])
    rc = review.scenario_counts(c.select("scenario", *link(F.lit("LOCATED_AT"))), c.where(~every(5)).select("scenario", *link(F.when(every(9), "owns").otherwise("located_at"))), "scenario", ["source", "target", "kind"])
    return ec, rc


@query(f"WITH {EVAL_SQL} SELECT scenario, 'entity' AS part, tp, fp, fn, {_rates()} FROM ec UNION ALL SELECT scenario, 'relationship', tp, fp, fn, {_rates()} FROM rc")
def evaluation_by_scenario(spark, d):
    ec, rc = _evaluated(spark, d)
    return review.with_rates(ec.withColumn("part", F.lit("entity")).unionByName(rc.withColumn("part", F.lit("relationship"))))


# Grounding: an analysis a nation, with some wrong references.

GROUND_SQL = f"""{A.ENTITIES_SQL}, {A.OWNERSHIP_SQL}, first AS (SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, (SELECT count(*) FROM entities) AS n FROM events),
analyses AS (SELECT n_nationkey AS k, printf('analysis-%05d', n_nationkey) AS analysis_id, CASE WHEN n_nationkey % 10 <> 9 THEN printf('region-%05d', n_regionkey) END AS case_id,
  n_name || ' has ' || CASE WHEN n_nationkey % 3 = 0 THEN 12 ELSE n END || ' entities since ' || CASE WHEN n_nationkey % 2 = 0 THEN '1999-01-01T00:00:00Z' ELSE iso END AS text FROM nation, first),
refs AS (SELECT printf('analysis-%05d', c_nationkey) AS analysis_id, 'entity' AS kind, printf('customer-%05d', c_custkey) AS reference FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT analysis_id, 'entity', 'customer-99999999' FROM analyses WHERE k % 4 = 0
  UNION ALL SELECT analysis_id, 'entity', printf('nation-%05d', (k + 1) % 25) FROM analyses
  UNION ALL SELECT analysis_id, 'relationship', 'rel-0000000000000000' FROM analyses WHERE k % 5 = 0
  UNION ALL SELECT printf('analysis-%05d', c_nationkey), 'relationship', relationship_id FROM customer JOIN ownership ON source_id = printf('customer-%05d', c_custkey) AND relationship_type = 'LOCATED_AT' WHERE c_custkey % 20 = 0
  UNION ALL SELECT analysis_id, 'evidence', printf('evidence-%05d', k) FROM analyses),
members AS (SELECT printf('region-%05d', n_regionkey) AS case_id, printf('nation-%05d', n_nationkey) AS id FROM nation
  UNION ALL SELECT printf('region-%05d', n_regionkey), printf('customer-%05d', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT printf('region-%05d', n_regionkey), printf('supplier-%05d', s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
bad AS (SELECT analysis_id, 'entities' AS c FROM refs WHERE kind = 'entity' AND reference NOT IN (SELECT entity_id FROM entities)
  UNION ALL SELECT analysis_id, 'relationships' FROM refs WHERE kind = 'relationship' AND reference NOT IN (SELECT relationship_id FROM ownership)
  UNION ALL SELECT analysis_id, 'evidence' FROM refs WHERE kind = 'evidence' AND reference NOT IN (SELECT printf('evidence-%05d', n_nationkey) FROM nation WHERE n_nationkey % 8 <> 7)
  UNION ALL SELECT analysis_id, 'case_membership' FROM refs r JOIN analyses a USING (analysis_id) WHERE kind <> 'evidence' AND case_id IS NOT NULL AND reference <> case_id
    AND CASE WHEN reference LIKE 'rel-%' THEN reference NOT IN (SELECT relationship_id FROM ownership) ELSE NOT EXISTS (SELECT 1 FROM members m WHERE m.case_id = a.case_id AND m.id = r.reference) END
  UNION ALL SELECT analysis_id, 'numerical' FROM analyses, first WHERE k % 3 = 0 AND n <> 12
  UNION ALL SELECT analysis_id, 'temporal' FROM analyses WHERE k % 2 = 0 AND '1999-01-01T00:00:00Z' NOT IN (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') FROM events)),
grounded AS (SELECT a.analysis_id, {', '.join(f"count(*) FILTER (c = '{c}') AS {c}" for c in review.CHECKS)}, count(c) AS unsupported_claims,
  CASE WHEN count(c) = 0 THEN 'SUPPORTED' ELSE 'NEEDS_REVIEW' END AS overall_status FROM analyses a LEFT JOIN bad USING (analysis_id) GROUP BY 1)"""
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _grounded(spark, d, by_case: bool = False):
    ents, own = A.entities(spark, d).select(F.col("entity_id").alias("id")), A.ownership(spark, d)
    times = A.table(spark, d, "events").select(F.date_format("ts", ISO).alias("iso")).distinct()
    nation, customer, supplier = (A.table(spark, d, t) for t in ("nation", "customer", "supplier"))
    first = F.broadcast(A.table(spark, d, "events").agg(F.date_format(F.min("ts"), ISO).alias("iso")).crossJoin(ents.agg(F.count("*").alias("n"))))
    k, aid = F.col("n_nationkey"), lambda c: F.format_string("analysis-%05d", c).alias("analysis_id")
    text = F.concat("n_name", F.lit(" has "), F.when(k % 3 == 0, F.lit(12)).otherwise(F.col("n")).cast("string"), F.lit(" entities since "), F.when(k % 2 == 0, "1999-01-01T00:00:00Z").otherwise(F.col("iso")))
    analyses = nation.crossJoin(first).select(k.alias("k"), aid("n_nationkey"), F.when(k % 10 != 9, A.entity_id("region", "n_regionkey")).alias("case_id"), text.alias("text"))
    ref = lambda df, kind, c: df.select("analysis_id", F.lit(kind).alias("kind"), c.alias("reference"))
    some = customer.select(aid("c_nationkey"), F.col("c_custkey"), A.entity_id("customer", "c_custkey").alias("_id"))
    edges = some.where("c_custkey % 20 = 0").join(own.where("relationship_type = 'LOCATED_AT'"), F.col("_id") == F.col("source_id"))
    refs = [
        ref(some.where("c_custkey % 10 = 0"), "entity", F.col("_id")), ref(analyses.where("k % 4 = 0"), "entity", F.lit("customer-99999999")), ref(analyses, "entity", A.entity_id("nation", (F.col("k") + 1) % 25)),
        ref(analyses.where("k % 5 = 0"), "relationship", F.lit("rel-0000000000000000")), ref(edges, "relationship", F.col("relationship_id")), ref(analyses, "evidence", A.entity_id("evidence", "k")),
    ]
    references = refs[0]
    for r in refs[1:]:
        references = references.unionByName(r)
    case = F.broadcast(nation.select(F.col("n_nationkey").alias("_n"), A.entity_id("region", "n_regionkey").alias("case_id")))
    member = lambda df, key, eid: df.join(case, F.col(key) == F.col("_n")).select("case_id", eid.alias("id"))
    members = member(nation, "n_nationkey", A.entity_id("nation", "n_nationkey")).unionByName(member(customer, "c_nationkey", A.entity_id("customer", "c_custkey"))).unionByName(member(supplier, "s_nationkey", A.entity_id("supplier", "s_suppkey")))
    evidence = nation.where("n_nationkey % 8 <> 7").select(A.entity_id("evidence", "n_nationkey").alias("id"))
    case_edges = None
    if by_case:
        at = lambda c: members.select(F.col("case_id").alias(f"_{c}"), F.col("id").alias(c))
        inside = own.join(at("source_id"), "source_id").join(at("target_id"), "target_id").where("_source_id = _target_id")
        case_edges = inside.select(F.col("_source_id").alias("case_id"), F.col("relationship_id").alias("id"))
    return review.ground_analyses(analyses.drop("k"), references, ents, own.select(F.col("relationship_id").alias("id")), evidence, members, times, case_edges)


@query(f"WITH {GROUND_SQL} SELECT * FROM grounded")
def analysis_grounding(spark, d):
    return _grounded(spark, d)


CASE_GROUND_SQL = GROUND_SQL.replace(
    "CASE WHEN reference LIKE 'rel-%' THEN reference NOT IN (SELECT relationship_id FROM ownership) ELSE",
    "CASE WHEN reference LIKE 'rel-%' THEN NOT EXISTS (SELECT 1 FROM ownership o JOIN members s ON s.id = o.source_id JOIN members t ON t.id = o.target_id AND t.case_id = s.case_id WHERE s.case_id = a.case_id AND o.relationship_id = r.reference) ELSE",
)


@query(f"WITH {CASE_GROUND_SQL} SELECT * FROM grounded")
def case_edge_grounding(spark, d):
    """Grounding where a relationship must belong to the analysis's case by both of its ends, not only exist."""
    return _grounded(spark, d, by_case=True)


@query("""WITH c AS (SELECT c_nationkey AS n, count(*) AS entities, min(length(c_name)) AS text_chars FROM customer GROUP BY 1),
o AS (SELECT c_nationkey AS n, count(*) AS records, sum(length(o_orderpriority) + length(o_orderstatus))::BIGINT AS chars FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT printf('nation-%05d', n_nationkey) AS entity_id, entities, records, chars, text_chars FROM nation LEFT JOIN c ON c.n = n_nationkey LEFT JOIN o ON o.n = n_nationkey),
b AS (SELECT *, concat_ws(',', CASE WHEN entities > 500 THEN 'entities' END, CASE WHEN records > 200 THEN 'records' END, CASE WHEN chars > 500000 THEN 'chars' END, CASE WHEN text_chars > 100000 THEN 'text_chars' END, CASE WHEN text_chars = 0 THEN 'blank text' END) AS exceeded FROM s)
SELECT entity_id, exceeded, exceeded = '' AS ok, coalesce(records, 0) AS records FROM b""")
def provider_bounds(spark, d):
    """Whether a nation's customers and orders may be given to a provider as one snapshot, and which bounds they exceed."""
    customer, orders = A.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name"), A.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    c = customer.groupBy("c_nationkey").agg(F.count("*").alias("entities"), F.min(F.length("c_name")).alias("text_chars"))
    o = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("records"), F.sum(F.length("o_orderpriority") + F.length("o_orderstatus")).alias("chars"))
    nation = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), A.entity_id("nation", "n_nationkey").alias("entity_id"))
    sizes = nation.join(c, "c_nationkey", "left").join(o, "c_nationkey", "left")
    return review.provider_bounds(sizes).select("entity_id", "exceeded", "ok", F.coalesce("records", F.lit(0)).alias("records"))


@query(f"""WITH {EVAL_SQL}, {GROUND_SQL},
e AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ec), r AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM rc),
e2 AS (SELECT tp AS entity_tp, fp AS entity_fp, fn AS entity_fn, {_rates('entity_')} FROM e), r2 AS (SELECT tp AS relationship_tp, fp AS relationship_fp, fn AS relationship_fn, {_rates('relationship_')} FROM r)
SELECT e2.*, r2.*, (SELECT count(*) FROM grounded) AS scenario_count, (SELECT count(*) FROM grounded WHERE overall_status = 'SUPPORTED') AS grounded_scenarios,
  (SELECT round(avg((overall_status = 'SUPPORTED')::INT), 4) FROM grounded) AS groundedness_rate, (SELECT sum(unsupported_claims)::BIGINT FROM grounded) AS unsupported_claim_count FROM e2, r2""")
def evaluation_report(spark, d):
    """Micro-averages of entities and relationships and the groundedness of analyses: the report's one row."""
    ec, rc = _evaluated(spark, d)
    return review.micro_average(ec, "entity").crossJoin(review.micro_average(rc, "relationship")).crossJoin(review.groundedness(analysis_grounding(spark, d)))


# Validation

@query("""WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 14 = 6 THEN '' ELSE c_name END AS text, CASE WHEN c_custkey % 10 = 3 THEN 'Alien' ELSE 'Person' END AS entity_type, (c_custkey % 12) / 10.0::DOUBLE AS confidence,
  CASE WHEN c_custkey % 9 = 4 THEN '' ELSE 'rule' END AS method, CASE c_custkey % 8 WHEN 1 THEN 'org-00001' WHEN 2 THEN 'person-1' WHEN 5 THEN NULL ELSE printf('person-%05d', c_custkey % 100000) END AS id,
  CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 5 END AS s, c_custkey % 5 + c_custkey % 4 AS e FROM customer)
SELECT k, concat_ws('; ', CASE WHEN entity_type = 'Alien' THEN 'unknown type' END, CASE WHEN confidence > 1 THEN 'confidence out of range' END, CASE WHEN text = '' THEN 'no text' END, CASE WHEN method = '' THEN 'no method' END,
  CASE WHEN entity_type = 'Person' AND id NOT LIKE 'person-%' THEN 'id of another type' END, CASE WHEN NOT (entity_type = 'Person' AND id NOT LIKE 'person-%') AND NOT regexp_matches(id, '^[a-z]+-[0-9]{5}$') THEN 'malformed id' END,
  CASE WHEN e <= s THEN 'end not after start' END) AS errors FROM r""")
def validate_entity_records(spark, d):
    k = F.col("c_custkey")
    nid = F.when(k % 8 == 1, "org-00001").when(k % 8 == 2, "person-1").when(k % 8 != 5, F.format_string("person-%05d", k % 100000))
    return review.validate_entity_records(A.table(spark, d, "customer").select(
        k.alias("k"), F.when(k % 14 == 6, "").otherwise(F.col("c_name")).alias("text"), F.when(k % 10 == 3, "Alien").otherwise("Person").alias("entity_type"), ((k % 12) / 10.0).alias("confidence"),
        F.when(k % 9 == 4, "").otherwise("rule").alias("extraction_method"), nid.alias("normalized_id"), F.when(k % 6 != 0, k % 5).alias("start"), (k % 5 + k % 4).alias("end")), "k")


@query("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 1 THEN 'rel-1' ELSE printf('rel-%05d', o_orderkey % 100000) END AS id, CASE WHEN o_orderkey % 11 = 2 THEN 'Alien' ELSE 'Person' END AS st, CASE WHEN o_orderkey % 11 = 3 THEN 'Alien' ELSE 'Person' END AS tt,
  CASE WHEN o_orderkey % 13 = 4 THEN 'LIKES' ELSE 'KNOWS' END AS kind, (o_orderkey % 12) / 10.0::DOUBLE AS c, CASE WHEN o_orderkey % 9 = 5 THEN '' ELSE 'rule' END AS m, CASE o_orderkey % 8 WHEN 6 THEN '' WHEN 7 THEN 'yesterday' ELSE '2024-01-01T00:00:00Z' END AS ca,
  CASE o_orderkey % 7 WHEN 1 THEN NULL WHEN 2 THEN 'soon' ELSE '2024-02-01T10:00:00Z' END AS ts, printf('person-%05d', o_custkey % 100000) AS s, CASE WHEN o_orderkey % 15 = 8 THEN printf('person-%05d', o_custkey % 100000) WHEN o_orderkey % 15 = 9 THEN 'org-00001' ELSE 'person-99999' END AS t FROM orders)
SELECT k, concat_ws('; ', CASE WHEN st = 'Alien' THEN 'unknown source type' END, CASE WHEN tt = 'Alien' THEN 'unknown target type' END, CASE WHEN kind = 'LIKES' THEN 'unknown type' END, CASE WHEN c > 1 THEN 'confidence out of range' END,
  CASE WHEN id = 'rel-1' THEN 'malformed id' END, CASE WHEN m = '' THEN 'no method' END, CASE WHEN ca = '' THEN 'no creation time' END, CASE WHEN ca = 'yesterday' THEN 'creation time not ISO' END, CASE WHEN ts = 'soon' THEN 'time not ISO' END,
  CASE WHEN s = t AND st = tt THEN 'self-loop' END, CASE WHEN st = 'Person' AND s NOT LIKE 'person-%' THEN 'source of another type' END, CASE WHEN tt = 'Person' AND t NOT LIKE 'person-%' THEN 'target of another type' END) AS errors FROM r""")
def validate_relationship_records(spark, d):
    k, person = F.col("o_orderkey"), F.format_string("person-%05d", F.col("o_custkey") % 100000)
    return review.validate_relationship_records(A.table(spark, d, "orders").select(
        k.alias("k"), F.when(k % 10 == 1, "rel-1").otherwise(F.format_string("rel-%05d", k % 100000)).alias("relationship_id"), F.when(k % 11 == 2, "Alien").otherwise("Person").alias("source_type"), F.when(k % 11 == 3, "Alien").otherwise("Person").alias("target_type"),
        F.when(k % 13 == 4, "LIKES").otherwise("KNOWS").alias("relationship_type"), ((k % 12) / 10.0).alias("confidence"), F.when(k % 9 == 5, "").otherwise("rule").alias("extraction_method"),
        F.when(k % 8 == 6, "").when(k % 8 == 7, "yesterday").otherwise("2024-01-01T00:00:00Z").alias("created_at"), F.when(k % 7 == 2, "soon").when(k % 7 != 1, "2024-02-01T10:00:00Z").alias("timestamp"),
        person.alias("source_id"), F.when(k % 15 == 8, person).when(k % 15 == 9, "org-00001").otherwise("person-99999").alias("target_id")), "k")


RELATIONS_SQL = """rel AS (SELECT l_orderkey AS doc_id, printf('rel-%05d', l_linenumber // 2) AS relationship_id, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE printf('person-%05d', l_suppkey) END AS source_id, printf('person-%05d', l_partkey % 10) AS target_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'Organization' ELSE 'Person' END AS st, 'Person' AS tt, CASE WHEN l_partkey % 4 = 0 THEN 'OWNS' ELSE 'KNOWS' END AS kind, (l_linenumber + 4) / 10.0::DOUBLE AS c, l_linenumber FROM lineitem)"""


@query(f"""WITH {RELATIONS_SQL} SELECT doc_id, relationship_id, concat_ws('; ', CASE WHEN c > 1 THEN 'confidence out of range' END, CASE WHEN source_id = target_id THEN 'self-loop' END, CASE WHEN st = 'Person' AND kind <> 'KNOWS' THEN 'persons only know' END,
  CASE WHEN count(*) OVER (PARTITION BY doc_id, relationship_id) > 1 THEN 'repeated id' END, CASE WHEN source_id IS NULL THEN 'unresolved end' END) AS errors FROM rel""")
def validate_document_relations(spark, d):
    line = A.table(spark, d, "lineitem")
    return review.validate_document_relations(line.select(
        F.col("l_orderkey").alias("doc_id"), F.format_string("rel-%05d", F.expr("l_linenumber div 2")).alias("relationship_id"), F.when(F.col("l_suppkey") % 6 != 0, F.format_string("person-%05d", "l_suppkey")).alias("source_id"), F.format_string("person-%05d", F.col("l_partkey") % 10).alias("target_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "Organization").otherwise("Person").alias("source_type"), F.lit("Person").alias("target_type"), F.when(F.col("l_partkey") % 4 == 0, "OWNS").otherwise("KNOWS").alias("relationship_type"), ((F.col("l_linenumber") + 4) / 10.0).alias("confidence")))


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 10 = 1 THEN 'Alien' ELSE 'Person' END AS kind, CASE WHEN event_id % 12 = 2 THEN '' ELSE event_type END AS text, event_id % 7 AS s, event_id % 7 + event_id % 5 AS e, (event_id % 13) / 10.0::DOUBLE AS c, CASE WHEN event_id % 9 = 3 THEN '' ELSE 'regex' END AS method FROM events)
SELECT event_id, s || ':' || e || ':' || text AS mention_key, concat_ws('; ', CASE WHEN kind = 'Alien' THEN 'unknown type' END, CASE WHEN c > 1 THEN 'confidence out of range' END, CASE WHEN text = '' THEN 'no text' END, CASE WHEN method = '' THEN 'no method' END, CASE WHEN e <= s THEN 'end not after start' END) AS errors FROM m""")
def validate_mentions(spark, d):
    """Mentions with their key start:end:text and what is wrong with them."""
    k = F.col("event_id")
    m = A.table(spark, d, "events").select(k, F.when(k % 10 == 1, "Alien").otherwise("Person").alias("entity_type"), F.when(k % 12 == 2, "").otherwise(F.col("event_type")).alias("text"), (k % 7).alias("start"), (k % 7 + k % 5).alias("end"), ((k % 13) / 10.0).alias("confidence"), F.when(k % 9 == 3, "").otherwise("regex").alias("extraction_method"), F.lit(None).cast("string").alias("normalized_id"))
    m = m.withColumn("mention_key", F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "text")).withColumn("_key", F.struct("event_id", "mention_key"))
    return review.validate_entity_records(m, "_key").select("_key.event_id", "_key.mention_key", "errors")


# Evidence chains

CHAINED_SQL = """RECURSIVE o AS (SELECT printf('customer-%05d', o_custkey) AS log, o_orderkey AS key, sha256(o_orderpriority) AS evidence_hash, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
chain AS (SELECT DISTINCT log, 0::BIGINT AS index, '0' AS previous_hash, sha256('GENESIS') AS hash, NULL::BIGINT AS key FROM o
  UNION ALL SELECT o.log, o.i, c.hash, sha256('{"data": {"status": "' || o.status || '"}, "evidence_hash": "' || o.evidence_hash || '", "index": ' || o.i || ', "previous_hash": "' || c.hash || '", "timestamp": TIME}'), o.key FROM chain c JOIN o ON o.log = c.log AND o.i = c.index + 1)""".replace("GENESIS", review.GENESIS).replace("TIME", review.BLOCK_TIME)


@query(f"WITH {CHAINED_SQL} SELECT log, index, key, previous_hash, hash, key % 50 <> 0 AS hash_ok, TRUE AS link_ok FROM chain WHERE index > 0")
def evidence_chain_by_log(spark, d):
    """A chain of evidence for each customer over its orders; every fiftieth block was altered afterwards, and is found."""
    o = A.table(spark, d, "orders").select(A.entity_id("customer", "o_custkey").alias("log"), F.col("o_orderkey").alias("key"), F.sha2("o_orderpriority", 256).alias("evidence_hash"), F.col("o_orderstatus").alias("status"))
    chain = review.chain_logs(o)
    altered = chain.withColumn("status", F.when(F.col("key") % 50 == 0, "altered").otherwise(F.col("status")))
    return review.verify_logs(altered).select("log", "index", "key", "previous_hash", "hash", "hash_ok", "link_ok")


# Explanations by id

@query(f"""{analytics.STRENGTH_SQL}, asked AS (SELECT relationship_id AS id FROM payments WHERE relationship_id LIKE '%00' UNION SELECT 'rel-unknown')
SELECT 'expl-strength-' || id || '-' || substr(sha256(id), 1, 12) AS explanation_id, id, 'strength' AS analysis_type, coalesce(printf('strength %.4f by %d interactions', interaction_strength, pair_frequency), 'strength ' || id || ' not found') AS summary,
  'weighted sum of type, confidence, pair frequency and time' AS methodology, 'strong=0.6' AS parameters, coalesce(source_id || ',' || target_id, '') AS contributing_entities, coalesce(relationship_id, '') AS supporting_evidence FROM asked LEFT JOIN strength ON id = relationship_id""")
def explain_strength_by_edge(spark, d):
    from skein.operators import strength

    pay = A.payments(spark, d)
    asked = pay.where("relationship_id LIKE '%00'").select(F.col("relationship_id").alias("id")).unionByName(spark.createDataFrame([("rel-unknown",)], "id string"))
    return review.explanations(strength.relationship_strength(pay), "strength", "relationship_id", F.format_string("strength %.4f by %d interactions", "interaction_strength", "pair_frequency"), F.concat_ws(",", "source_id", "target_id"), F.col("relationship_id"), "weighted sum of type, confidence, pair frequency and time", "strong=0.6", asked)


INDICATOR_SQL = f"""{analytics.BURST_SQL}, ind AS (SELECT 'ind-temporal-' || substr(sha256(entity || '|' || start_us), 1, 8) AS indicator_id, entity, observed, threshold,
  round(least(1e0, (observed - threshold + 1) / 5), 4) AS score FROM bursts), rated AS (SELECT *, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ind)"""


def _burst_indicators(spark, d):
    b = temporal.bursts(A.activity(spark, d), pseudo=analytics.KINDS)
    score = F.round(F.least(F.lit(1.0), (F.col("observed") - F.col("threshold") + 1) / 5), 4)
    return b.select(F.concat(F.lit("ind-temporal-"), S.short_hash(F.col("entity"), F.col("start_us"), digits=8)).alias("indicator_id"), "entity", "observed", "threshold", score.alias("score")).withColumn("severity", S.severity(F.col("score")))


@query(f"{INDICATOR_SQL} SELECT * FROM rated")
def burst_indicators(spark, d):
    """Every burst as an indicator with its severity."""
    return _burst_indicators(spark, d)


@query(f"""{INDICATOR_SQL}, asked AS (SELECT DISTINCT indicator_id AS id FROM rated WHERE severity = 'HIGH' UNION SELECT 'ind-temporal-unknown'), one AS (SELECT indicator_id, min(entity) AS entity, max(score) AS score, max(severity) AS severity FROM rated GROUP BY 1)
SELECT 'expl-indicator-' || id || '-' || substr(sha256(id), 1, 12) AS explanation_id, id, 'indicator' AS analysis_type, coalesce(printf('severity %s score %.4f', severity, score), 'indicator ' || id || ' not found') AS summary,
  'windows above mean plus two deviations' AS methodology, 'HIGH=0.75,MEDIUM=0.4' AS parameters, coalesce(entity, '') AS contributing_entities, coalesce(indicator_id, '') AS supporting_evidence FROM asked LEFT JOIN one ON id = indicator_id""")
def explain_indicator(spark, d):
    found = _burst_indicators(spark, d)
    one = found.groupBy("indicator_id").agg(F.min("entity").alias("entity"), F.max("score").alias("score"), F.max("severity").alias("severity"))
    asked = found.where("severity = 'HIGH'").select(F.col("indicator_id").alias("id")).unionByName(spark.createDataFrame([("ind-temporal-unknown",)], "id string"))
    return review.explanations(one, "indicator", "indicator_id", F.format_string("severity %s score %.4f", "severity", "score"), F.col("entity"), F.col("indicator_id"), "windows above mean plus two deviations", "HIGH=0.75,MEDIUM=0.4", asked)


FINDING_SQL = f"""{analytics.BURST_SQL}, scoped AS (SELECT 0 AS scope, 'global' AS scope_name, entity, max(observed) AS observed FROM bursts GROUP BY entity
  UNION ALL SELECT 1, 'root', entity, max(observed) FROM bursts WHERE entity LIKE 'user-%' GROUP BY entity),
finding AS (SELECT 'finding-' || substr(sha256(entity || '|burst|' || scope_name), 1, 12) AS finding_id, scope, scope_name, entity, observed FROM scoped)"""


@query(f"""{FINDING_SQL}, asked AS (SELECT finding_id AS id FROM finding WHERE entity LIKE '%1' UNION SELECT 'finding-unknown')
SELECT 'expl-finding-' || id || '-' || substr(sha256(id), 1, 12) AS explanation_id, id, 'finding' AS analysis_type, coalesce(printf('%s: %s has %d interactions in one window', scope_name, entity, observed), 'finding ' || id || ' not found') AS summary,
  'findings of each scope, global first' AS methodology, 'scopes=global,root' AS parameters, coalesce(entity, '') AS contributing_entities, coalesce(finding_id, '') AS supporting_evidence FROM asked LEFT JOIN finding ON id = finding_id""")
def explain_finding(spark, d):
    """Findings of the global scope and of roots, materialised once with their scope, looked up by id."""
    b = temporal.bursts(A.activity(spark, d), pseudo=analytics.KINDS).groupBy("entity").agg(F.max("observed").alias("observed"))
    scoped = b.withColumn("scope_name", F.lit("global")).unionByName(b.where("entity LIKE 'user-%'").withColumn("scope_name", F.lit("root")))
    finding = scoped.withColumn("finding_id", F.concat(F.lit("finding-"), S.short_hash(F.col("entity"), F.lit("burst"), F.col("scope_name"))))
    asked = finding.where("entity LIKE '%1'").select(F.col("finding_id").alias("id")).unionByName(spark.createDataFrame([("finding-unknown",)], "id string"))
    return review.explanations(finding, "finding", "finding_id", F.format_string("%s: %s has %d interactions in one window", "scope_name", "entity", "observed"), F.col("entity"), F.col("finding_id"), "findings of each scope, global first", "scopes=global,root", asked)


# Cases, lookups, scalars

@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, event_id % 10 <> 3 AS valid, CASE WHEN event_id % 10 <> 3 THEN epoch_us(ts) // 1000000 ELSE -1 END AS seconds FROM events""")
def iso_times(spark, d):
    """Times written as ISO text, every tenth of them broken, and read again: a broken one gives null, shown as not valid and -1."""
    ev = A.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("_t"))
    text = F.when(F.col("event_id") % 10 == 3, F.lit("not a time")).otherwise(F.concat("_t", F.lit("Z")))
    read = F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))
    return ev.select("event_id", F.concat("_t", F.lit("+00:00")).alias("iso"), read.isNotNull().alias("valid"), F.coalesce(F.unix_seconds(read), F.lit(-1).cast("long")).alias("seconds"))


COLLECTIONS = ("customer", "nation", "orders", "region", "supplier")


@query("SELECT 'dataset-' || substr(sha256(string_agg(c || ':' || n, ',' ORDER BY c)), 1, 12) AS dataset_id FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS c, count(*) AS n FROM {t}" for t in COLLECTIONS) + ")")
def dataset_id(spark, d):
    """Hash of the sorted collection counts."""
    parts = None
    for t in COLLECTIONS:
        one = A.table(spark, d, t).agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{t}:"), F.col("n").cast("string")).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.concat(F.lit("dataset-"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ","), 256), 1, 12)).alias("dataset_id"))


@query("""SELECT printf('customer-%05d', c_custkey) AS source, printf('supplier-%05d', c_custkey % 30) AS target, CASE WHEN c_custkey % 30 IN (SELECT s_suppkey FROM supplier) THEN 'ok' ELSE 'unknown target' END AS status FROM customer
UNION ALL SELECT printf('person-%05d', n_nationkey), printf('nation-%05d', n_nationkey), 'unknown source' FROM nation""")
def path_endpoints(spark, d):
    """Asked paths with whether both ends are known."""
    asked = A.table(spark, d, "customer").select(A.entity_id("customer", "c_custkey").alias("source"), A.entity_id("supplier", F.col("c_custkey") % 30).alias("target"))
    asked = asked.unionByName(A.table(spark, d, "nation").select(A.entity_id("person", "n_nationkey").alias("source"), A.entity_id("nation", "n_nationkey").alias("target")))
    return review.endpoints(asked, A.entities(spark, d))


@query(f"WITH {A.OWNERSHIP_SQL}, per AS (SELECT node, count(*) AS degree FROM (SELECT source_id AS node FROM ownership UNION ALL SELECT target_id FROM ownership) GROUP BY 1) SELECT node AS entity_id, degree, round(degree / ((SELECT count(*) FROM per) - 1)::DOUBLE, 6) AS degree_centrality FROM per")
def multigraph_degree(spark, d):
    """Degree by edges, repeated ones included, over the other nodes: the centrality that needs no library."""
    per = graph.adjacency(A.ownership(spark, d)).groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("degree"))
    n = F.broadcast(per.agg((F.count("*") - 1).alias("_others")))
    return per.crossJoin(n).select("entity_id", "degree", F.round(F.col("degree") / F.col("_others"), 6).alias("degree_centrality"))


@query(f"WITH {graphs.CASE_SQL}, {A.ENTITIES_SQL} SELECT e.entity_id AS evidence_id, name, 'region-00001' AS case_id FROM entities e WHERE entity_type = 'Organization' AND entity_id IN (SELECT entity_id FROM members)")
def case_evidence(spark, d):
    """Records of one type that belong to a case."""
    members = graphs._members(spark, d)
    return A.entities(spark, d).where("entity_type = 'Organization'").join(members, "entity_id", "left_semi").select(F.col("entity_id").alias("evidence_id"), "name", F.lit("region-00001").alias("case_id"))


@query(f"""WITH {graphs.CASE_SQL}, {A.ENTITIES_SQL}, inside AS (SELECT o.* FROM ownership o SEMI JOIN members s ON o.source_id = s.entity_id SEMI JOIN members t ON o.target_id = t.entity_id)
SELECT 'entity' AS part, entity_id AS id, 'snapshot-' || substr(sha256('region-00001|2'), 1, 12) AS snapshot_id FROM entities WHERE entity_id IN (SELECT entity_id FROM members)
UNION ALL SELECT 'relationship', relationship_id, 'snapshot-' || substr(sha256('region-00001|2'), 1, 12) FROM inside
UNION ALL SELECT 'central', id, 'snapshot-' || substr(sha256('region-00001|2'), 1, 12) FROM (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM inside UNION ALL SELECT target_id FROM inside) GROUP BY 1 ORDER BY n DESC, id LIMIT 5)""")
def case_snapshot(spark, d):
    """Entities, relationships and most connected entities of one case, under an id that depends on the case and the depth alone."""
    members, ents = graphs._members(spark, d), A.entities(spark, d)
    inside = graph.induced(A.ownership(spark, d), members)
    central = graph.adjacency(inside).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(5)
    part = lambda df, name, c: df.select(F.lit(name).alias("part"), F.col(c).alias("id"))
    all_ = part(ents.join(members, "entity_id", "left_semi"), "entity", "entity_id").unionByName(part(inside, "relationship", "relationship_id")).unionByName(part(central, "central", "id"))
    return all_.withColumn("snapshot_id", F.concat(F.lit("snapshot-"), S.short_hash(F.lit("region-00001"), F.lit("2"))))


@query("SELECT printf('nation-%05d', c_nationkey) AS entity_id, count(DISTINCT o_orderstatus || o_orderpriority) AS n_sources, array_to_string(list_sort(list(DISTINCT o_orderstatus || o_orderpriority))[1:6], ',') AS sources FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def source_documents(spark, d):
    """Distinct sources of each entity's records, and the first six of them."""
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    s = F.collect_set(F.concat("o_orderstatus", "o_orderpriority"))
    return o.groupBy(A.entity_id("nation", "c_nationkey").alias("entity_id")).agg(F.size(s).cast("long").alias("n_sources"), F.array_join(F.slice(F.array_sort(s), 1, 6), ",").alias("sources"))


@query("SELECT count(*) FILTER (lower(o_orderstatus) IN ('o', 'p')) AS open_cases, count(*) AS cases FROM orders")
def open_cases(spark, d):
    return A.table(spark, d, "orders").agg(F.count_if(F.lower("o_orderstatus").isin("o", "p")).alias("open_cases"), F.count("*").alias("cases"))


@query("""SELECT 'rel-' || substr(sha256('event-' || event_id || '|location-' || user_id % 50), 1, 32) AS relationship_id, printf('event-%05d', event_id) AS source_id, printf('location-%05d', user_id % 50) AS target_id, 'LOCATED_AT' AS relationship_type, 0.9::DOUBLE AS confidence FROM events WHERE event_type = 'view' AND user_id % 5 <> 0""")
def event_locations(spark, d):
    """Structured records of an event with a place give LOCATED_AT; records without a place give nothing."""
    ev = A.table(spark, d, "events").where("event_type = 'view'").withColumn("place", F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 50))
    rid = A.row_id(F.concat(F.lit("event-"), F.col("event_id").cast("string")), F.concat(F.lit("location-"), F.col("place").cast("string")))
    return ev.where("place IS NOT NULL").select(rid.alias("relationship_id"), F.format_string("event-%05d", "event_id").alias("source_id"), F.format_string("location-%05d", "place").alias("target_id"), F.lit("LOCATED_AT").alias("relationship_type"), F.lit(0.9).alias("confidence"))


@query("""WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber AS position, CASE WHEN l_linenumber % 2 = 0 THEN printf('SUPPLIER-%05d', l_suppkey) ELSE printf('supplier-%05d', l_suppkey) END AS text FROM lineitem),
r AS (SELECT a.l_orderkey AS doc_id, printf('supplier-%05d', a.l_suppkey) AS s, printf('supplier-%05d', b.l_suppkey + CASE WHEN b.l_partkey % 10 = 0 THEN 1000000 ELSE 0 END) AS t, CASE WHEN a.l_linenumber % 3 = 0 THEN 'KNOWS' ELSE 'OWNS' END AS kind, 0.5 + (a.l_linenumber % 4) / 10.0::DOUBLE AS c
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
f AS (SELECT doc_id, lower(text) AS text, min(position) AS at FROM m GROUP BY 1, 2)
SELECT r.doc_id, kind AS relationship_type, s.at AS source_index, t.at AS target_index, c AS confidence, c < 0.7 AS needs_review FROM r JOIN f s ON s.doc_id = r.doc_id AND s.text = lower(r.s) JOIN f t ON t.doc_id = r.doc_id AND t.text = lower(r.t) WHERE s.at <> t.at""")
def mapped_relations(spark, d):
    """Relations by surface, mapped to the first mention of each surface in their document."""
    line = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    text = F.format_string("supplier-%05d", "l_suppkey")
    mentions = line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_linenumber") % 2 == 0, F.upper(text)).otherwise(text).alias("text"))
    nxt = line.select(F.col("l_orderkey").alias("_o"), (F.col("l_linenumber") - 1).alias("_n"), F.format_string("supplier-%05d", F.col("l_suppkey") + F.when(F.col("l_partkey") % 10 == 0, 1000000).otherwise(0)).alias("target_text"))
    rel = line.join(nxt, (F.col("l_orderkey") == F.col("_o")) & (F.col("l_linenumber") == F.col("_n"))).select(F.col("l_orderkey").alias("doc_id"), text.alias("source_text"), "target_text", F.when(F.col("l_linenumber") % 3 == 0, "KNOWS").otherwise("OWNS").alias("relationship_type"), (F.lit(0.5) + (F.col("l_linenumber") % 4) / 10.0).alias("confidence"))
    return review.map_relations(rel, mentions)


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' \t\n\r') = '' THEN 'blank' WHEN length(text) > 100000 THEN 'too long' ELSE 'ok' END AS status FROM documents")
def input_bounds(spark, d):
    """Whether a text may be given to a provider: not blank, at most 100,000 characters."""
    blank = F.coalesce(F.regexp_replace("text", "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", ""), F.lit("")) == ""
    return A.table(spark, d, "documents").select("doc_id", F.when(blank, "blank").when(F.length("text") > 100_000, "too long").otherwise("ok").alias("status"))


@query(f"""WITH {A.ENTITIES_SQL}, {A.OWNERSHIP_SQL}, n AS (SELECT (SELECT count(*) FROM entities) AS e, (SELECT count(*) FROM ownership) AS r, (SELECT count(DISTINCT relationship_type) FROM ownership) AS k)
SELECT 'network_summary' AS analysis_type, 1 AS position, printf('The network holds %d entities and %d relationships.', e, r) AS sentence FROM n
UNION ALL SELECT 'network_summary', 2, printf('Relationships are of %d types.', k) FROM n
UNION ALL SELECT 'network_summary', 3, CASE WHEN r > e THEN 'There are more relationships than entities.' ELSE 'There are no more relationships than entities.' END FROM n""")
def interpretation_summary(spark, d):
    """Counts as fixed neutral sentences."""
    own = A.ownership(spark, d)
    n = A.entities(spark, d).agg(F.count("*").alias("e")).crossJoin(own.agg(F.count("*").alias("r"), F.countDistinct("relationship_type").alias("k")))
    said = F.array(F.format_string("The network holds %d entities and %d relationships.", "e", "r"), F.format_string("Relationships are of %d types.", "k"), F.when(F.col("r") > F.col("e"), "There are more relationships than entities.").otherwise("There are no more relationships than entities."))
    return n.select(F.lit("network_summary").alias("analysis_type"), F.posexplode(said).alias("position", "sentence")).withColumn("position", F.col("position") + 1)


IMPORT_SQL = f"""{A.ENTITIES_SQL}, {A.PAYMENTS_SQL}, batch AS (SELECT relationship_id, source_id, CASE WHEN relationship_id LIKE '%a' THEN 'supplier-99999999' WHEN relationship_id LIKE '%b' THEN source_id ELSE target_id END AS target_id FROM payments),
judged AS (SELECT relationship_id, CASE WHEN source_id = target_id THEN 'self-loop' WHEN source_id NOT IN (SELECT entity_id FROM entities) OR target_id NOT IN (SELECT entity_id FROM entities) THEN 'missing endpoint' ELSE 'imported' END AS outcome FROM batch)"""


@query(f"WITH {IMPORT_SQL} SELECT outcome, count(*) AS n FROM judged GROUP BY 1")
def import_outcomes(spark, d):
    """Entities first, then relationships: rows whose ends are unknown or equal are errors, which do not stop the others."""
    pay, rid = A.payments(spark, d), F.col("relationship_id")
    batch = pay.select("relationship_id", "source_id", F.when(rid.endswith("a"), "supplier-99999999").when(rid.endswith("b"), F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"))
    known = A.entities(spark, d).select("entity_id")
    s, t = known.select(F.col("entity_id").alias("_s")), known.select(F.col("entity_id").alias("_t"))
    judged = batch.join(s, F.col("source_id") == F.col("_s"), "left").join(t, F.col("target_id") == F.col("_t"), "left")
    outcome = F.when(F.col("source_id") == F.col("target_id"), "self-loop").when(F.col("_s").isNull() | F.col("_t").isNull(), "missing endpoint").otherwise("imported")
    return judged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT 'ind-bridge-' || entity_id AS indicator_id, 'bridge_candidate' AS indicator_type, entity_id FROM (" + graphs.SQL["articulation_points_ownership"] + ") ORDER BY entity_id LIMIT 5")
def articulation_indicators(spark, d):
    """Indicators of articulation points: the first five by id, whatever their score."""
    cuts = graphs.QUERIES["articulation_points_ownership"](spark, d).orderBy("entity_id").limit(5)
    return cuts.select(F.concat(F.lit("ind-bridge-"), "entity_id").alias("indicator_id"), F.lit("bridge_candidate").alias("indicator_type"), "entity_id")


# Typed bursts, chains by id, base analysis, lookups with fallbacks

TYPED_SQL = f"""WITH {A.ACTIVITY_SQL}, typed AS (SELECT relationship_id, source_id, target_id, ts, CASE relationship_type WHEN 'purchase' THEN 'TRANSFERRED_TO' WHEN 'click' THEN 'CALLED' ELSE 'KNOWS' END AS t FROM activity),
times AS (SELECT source_id AS entity, epoch_us(ts) AS us FROM typed UNION ALL SELECT target_id, epoch_us(ts) FROM typed UNION ALL SELECT 'type:' || t, epoch_us(ts) FROM typed WHERE t <> 'KNOWS'),
win AS (SELECT entity, (us - (SELECT min(us) FROM times)) // 3600000000 AS win, count(*) AS n FROM times GROUP BY 1, 2),
base AS (SELECT entity, avg(n) AS mean, stddev_pop(n) AS std FROM win GROUP BY 1 HAVING count(*) >= 2 AND sum(n) >= 3),
found AS (SELECT w.*, CASE WHEN std > 0 THEN mean + 2e0 * std ELSE mean + 1 END AS t FROM win w JOIN base USING (entity))
SELECT entity, CASE entity WHEN 'type:CALLED' THEN 'communication_burst' WHEN 'type:TRANSFERRED_TO' THEN 'transaction_burst' ELSE 'temporal_burst' END AS indicator_type, win, n AS observed, round(t, 2) AS threshold FROM found WHERE n > t AND n >= 3"""


def _typed(spark, d):
    kind = F.when(F.col("relationship_type") == "purchase", "TRANSFERRED_TO").when(F.col("relationship_type") == "click", "CALLED").otherwise("KNOWS")
    return temporal.bursts(A.activity(spark, d).withColumn("relationship_type", kind), hours=1).select("entity", "indicator_type", "win", "observed", "threshold")


@query(TYPED_SQL)
def typed_bursts(spark, d):
    """Bursts by the hour of entities and of the two types that have bursts of their own."""
    return _typed(spark, d)


@query(f"SELECT * FROM ({TYPED_SQL}) ORDER BY observed DESC, win, entity LIMIT 20")
def top_bursts(spark, d):
    return _typed(spark, d).orderBy(F.desc("observed"), "win", "entity").limit(20)


@query(f"""WITH c AS ({graphs.SQL['transfer_chains_top']}), asked AS (SELECT chain_id AS id FROM c WHERE chain_id LIKE '%0' UNION SELECT 'chain-unknown')
SELECT 'expl-chain-' || id || '-' || substr(sha256(id), 1, 12) AS explanation_id, id, 'chain' AS analysis_type, coalesce(printf('chain of %d transfers from %s to %s', hop_count, source_account, destination_account), 'chain ' || id || ' not found') AS summary,
  'simple directed paths of two to four transfers' AS methodology, 'min_hops=2,max_hops=4' AS parameters, coalesce(replace(path, '>', ','), '') AS contributing_entities, coalesce(evidence, '') AS supporting_evidence FROM asked LEFT JOIN c ON id = chain_id""")
def explain_chain(spark, d):
    chains = graphs.QUERIES["transfer_chains_top"](spark, d)
    asked = chains.where("chain_id LIKE '%0'").select(F.col("chain_id").alias("id")).unionByName(spark.createDataFrame([("chain-unknown",)], "id string"))
    return review.explanations(chains, "chain", "chain_id", F.format_string("chain of %d transfers from %s to %s", "hop_count", "source_account", "destination_account"), F.replace(F.col("path"), F.lit(">"), F.lit(",")), F.col("evidence"), "simple directed paths of two to four transfers", "min_hops=2,max_hops=4", asked)


@query(f"""WITH {A.ENTITIES_SQL}, {A.OWNERSHIP_SQL}, per AS (SELECT node, count(*) AS c FROM (SELECT source_id AS node FROM ownership UNION ALL SELECT target_id FROM ownership) GROUP BY 1),
top AS (SELECT node, c FROM per ORDER BY c DESC, node LIMIT 5)
SELECT 'count' AS section, 'entities' AS name, count(*)::VARCHAR AS value FROM entities UNION ALL SELECT 'count', 'relationships', count(*)::VARCHAR FROM ownership
UNION ALL SELECT 'degree', 'min', min(c)::VARCHAR FROM per UNION ALL SELECT 'degree', 'max', max(c)::VARCHAR FROM per UNION ALL SELECT 'top', node, c::VARCHAR FROM top
UNION ALL SELECT 'indicator', 'high_network_centrality:' || node, CASE WHEN c >= 10 THEN 'HIGH' ELSE 'LOW' END FROM top
UNION ALL SELECT 'type', relationship_type, count(*)::VARCHAR FROM ownership GROUP BY 2
UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(*)::VARCHAR FROM orders GROUP BY 2""")
def base_analysis(spark, d):
    """Counts, degrees, most connected entities with an indicator each, relationship types and months, a row a fact."""
    ents, own = A.entities(spark, d), A.ownership(spark, d)
    per = graph.adjacency(own).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("c"))
    top = per.orderBy(F.desc("c"), "name").limit(5)
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("string").alias("value"))
    parts = [
        row(ents.agg(F.count("*").alias("n")), "count", F.lit("entities"), F.col("n")), row(own.agg(F.count("*").alias("n")), "count", F.lit("relationships"), F.col("n")),
        row(per.agg(F.min("c").alias("n")), "degree", F.lit("min"), F.col("n")), row(per.agg(F.max("c").alias("n")), "degree", F.lit("max"), F.col("n")), row(top, "top", F.col("name"), F.col("c")),
        row(top, "indicator", F.concat(F.lit("high_network_centrality:"), "name"), F.when(F.col("c") >= 10, "HIGH").otherwise("LOW")),
        row(own.groupBy("relationship_type").count(), "type", F.col("relationship_type"), F.col("count")),
        row(A.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).count(), "month", F.col("m"), F.col("count")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH asked AS (SELECT printf('customer-%05d', c_custkey) AS id FROM customer UNION ALL SELECT printf('supplier-%05d', s_suppkey) FROM supplier UNION ALL SELECT printf('person-%05d', n_nationkey) FROM nation)
SELECT id, coalesce(c_name, s_name, id) AS name, CASE WHEN c_name IS NOT NULL THEN 'Person' WHEN s_name IS NOT NULL THEN 'Organization' ELSE 'Unknown' END AS entity_type
FROM asked LEFT JOIN (SELECT printf('customer-%05d', c_custkey) AS id, c_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0) USING (id) LEFT JOIN (SELECT printf('supplier-%05d', s_suppkey) AS id, s_name FROM supplier) USING (id)""")
def node_records_with_fallback(spark, d):
    """Records of asked ids from the first store, else the second, else a stub of type Unknown; the first store lacks some on purpose."""
    cust, supp, nation = (A.table(spark, d, t) for t in ("customer", "supplier", "nation"))
    cid, sid = A.entity_id("customer", "c_custkey"), A.entity_id("supplier", "s_suppkey")
    asked = cust.select(cid.alias("id")).unionByName(supp.select(sid.alias("id"))).unionByName(nation.select(A.entity_id("person", "n_nationkey").alias("id")))
    first = cust.where("c_custkey % 2 = 0 OR c_custkey % 3 = 0").select(cid.alias("id"), "c_name")
    j = asked.join(first, "id", "left").join(supp.select(sid.alias("id"), "s_name"), "id", "left")
    kind = F.when(F.col("c_name").isNotNull(), "Person").when(F.col("s_name").isNotNull(), "Organization").otherwise("Unknown")
    return j.select("id", F.coalesce("c_name", "s_name", "id").alias("name"), kind.alias("entity_type"))


@query("SELECT doc_id, surface, min(l_linenumber) AS position, arg_min(p, (l_linenumber::BIGINT * 1000000000 + l_partkey)) AS entity_id FROM (SELECT l_orderkey AS doc_id, lower(l_returnflag || l_linestatus) AS surface, l_linenumber, l_partkey, printf('part-%05d', l_partkey) AS p FROM lineitem) GROUP BY 1, 2")
def first_match_by_surface(spark, d):
    """Of the records registered under one surface in a document, the first; ties go to the smallest."""
    line = A.table(spark, d, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("doc_id"), F.lower(F.concat("l_returnflag", "l_linestatus")).alias("surface")).agg(F.min("l_linenumber").alias("position"), F.min_by(A.entity_id("part", "l_partkey"), F.struct("l_linenumber", "l_partkey")).alias("entity_id"))


@query("SELECT event_id, user_id, printf('object-%d', event_id % 10) AS object_id FROM events WHERE printf('user-%d', user_id) = 'object-3' OR printf('object-%d', event_id % 10) = 'object-3'")
def audit_by_entity_or_object(spark, d):
    """Audit records of an id, whether it acted or was acted upon."""
    ev = A.table(spark, d, "events").select("event_id", "user_id", F.format_string("object-%d", F.col("event_id") % 10).alias("object_id"))
    return ev.where((F.format_string("user-%d", "user_id") == "object-3") | (F.col("object_id") == "object-3"))


@query(f"""WITH {A.OWNERSHIP_SQL}, one AS (SELECT source_id AS id FROM ownership WHERE target_id = 'nation-00003' UNION SELECT target_id FROM ownership WHERE source_id = 'nation-00003' UNION SELECT 'nation-00003'),
kept AS (SELECT id FROM one ORDER BY id LIMIT 20), inside AS (SELECT relationship_id FROM ownership WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept))
SELECT (SELECT count(*) FROM one) AS found_nodes, (SELECT count(*) FROM kept) AS nodes, (SELECT count(*) FROM inside) AS found_edges, least((SELECT count(*) FROM inside), 10) AS edges, (SELECT count(*) FROM one) > 20 OR (SELECT count(*) FROM inside) > 10 AS truncated""")
def subgraph_truncation(spark, d):
    """Whether a neighbourhood of at most 20 nodes and 10 edges left something out, with the counts before and after."""
    from skein.operators import traverse

    own = A.ownership(spark, d)
    reached = traverse.neighbourhood(own, spark.createDataFrame([("nation-00003",)], "entity_id string"), 1)
    kept = reached.orderBy("entity_id").limit(20)
    n = reached.agg(F.count("*").alias("found_nodes")).crossJoin(kept.agg(F.count("*").alias("nodes"))).crossJoin(graph.induced(own, kept).agg(F.count("*").alias("found_edges")))
    return n.select("found_nodes", "nodes", "found_edges", F.least("found_edges", F.lit(10).cast("long")).alias("edges"), ((F.col("found_nodes") > 20) | (F.col("found_edges") > 10)).alias("truncated"))


@query("""SELECT printf('evidence-%05d', o_orderkey) AS evidence_id, sha256('{"evidence_id": "' || printf('evidence-%05d', o_orderkey) || '", "payload": {"customer": {"id": ' || o_custkey || ', "note": null}, "priority": "' ||
  replace(o_orderpriority, '-', '\\u2013') || '", "tags": ["' || o_orderstatus || '", "a\\"b"]}, "previous_hash": "0"}') AS chain_hash FROM orders""")
def evidence_payload_hash(spark, d):
    """Chain hashes of evidence records with nested payloads, over their canonical JSON."""
    o = A.table(spark, d, "orders")
    payload = F.named_struct(
        F.lit("tags"), F.array("o_orderstatus", F.lit('a"b')), F.lit("priority"), F.replace("o_orderpriority", F.lit("-"), F.lit("\u2013")),
        F.lit("customer"), F.named_struct(F.lit("note"), F.lit(None).cast("string"), F.lit("id"), F.col("o_custkey")),
    )
    eid = A.entity_id("evidence", "o_orderkey")
    return o.select(eid.alias("evidence_id"), S.evidence_chain_hash(eid, payload, F.lit("0")).alias("chain_hash"))


@query("""WITH ids AS (SELECT printf('customer-%05d', c_custkey) AS id FROM customer UNION ALL SELECT printf('nation-%05d', n_nationkey) FROM nation),
e AS (SELECT CASE WHEN s.id IS NULL THEN 'unknown source' WHEN t.id IS NULL THEN 'unknown target' ELSE '' END AS reason
  FROM (SELECT printf('customer-%05d', user_id * 3) AS s, printf('nation-%05d', event_id % 30) AS t FROM events) LEFT JOIN ids s ON s.id = s LEFT JOIN ids t ON t.id = t)
SELECT 'entities' AS part, '' AS reason, count(*) AS n FROM ids UNION ALL SELECT CASE WHEN reason = '' THEN 'relationships' ELSE 'rejected' END, reason, count(*) FROM e GROUP BY 1, 2""")
def import_outcome_tables(spark, d):
    """Customers, nations and the events between them imported as one commit, then counted from the live version: entities, relationships, rejected rows by reason."""
    ents = A.table(spark, d, "customer").select(A.entity_id("customer", "c_custkey").alias("entity_id"), F.col("c_name").alias("name")).unionByName(A.table(spark, d, "nation").select(A.entity_id("nation", "n_nationkey").alias("entity_id"), F.col("n_name").alias("name")))
    rels = A.table(spark, d, "events").select(F.format_string("rel-%08d", "event_id").alias("relationship_id"), A.entity_id("customer", F.col("user_id") * 3).alias("source_id"), A.entity_id("nation", F.col("event_id") % 30).alias("target_id"), "ts")
    root = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    versions.import_graph(spark, root, ents, rels)
    count = lambda name, reason: versions.read(spark, root, name).groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "reason", "n")
    return count("entities", F.lit("")).unionByName(count("relationships", F.lit(""))).unionByName(count("rejected", F.col("reason")))


@query("""SELECT event_id, 'ids=["user-' || user_id || '","' || event_type || '"];k=' || json_extract_string(props, '$.k') || ';many=<list:13>;nested=<dict:' || length('{"v":"' || event_type || '"}') || '>' AS parameters FROM events""")
def audit_typed_parameters(spark, d):
    """Audit parameters of all events, with lists, objects and a secret beside each event's own properties."""
    from skein.operators import audit

    ev = A.table(spark, d, "events")
    more = F.concat(F.lit(', "ids": ["user-'), F.col("user_id").cast("string"), F.lit('", "'), "event_type", F.lit('"], "many": [1, 2, 3, 4, 5, 6], "Token": "x", "nested": {"v": "'), "event_type", F.lit('"}}'))
    made = audit.typed_parameters(F.concat(F.expr("substring(props, 1, length(props) - 1)"), more))
    return ev.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(made)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("parameters"))


@query(f"WITH {A.ENTITIES_SQL} SELECT entity_id, entity_type, name FROM entities WHERE entity_id IN ('customer-00042', 'supplier-00007', 'region-00002', 'order-00001')")
def stored_entities_by_id(spark, d):
    """Four asked ids from all entities, stored by type; the prefix of orders is not known to the router, so that id is sought in all."""
    path, types = f"{shared_folder(spark)}/entities-{uuid.uuid4().hex}", {"customer": "Person", "supplier": "Organization", "region": "Case"}
    collections.store_entities(A.entities(spark, d), path)
    found = [collections.stored_entity(spark, path, i, types).select("entity_id", "entity_type", "name") for i in ("customer-00042", "supplier-00007", "region-00002", "order-00001")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])

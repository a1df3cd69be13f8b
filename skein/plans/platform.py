"""Lookups, validation, audit, hashing, upserts and generation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalar as S
from skein.operators import audit, checks
from skein.sources import adapters as A
from skein.sources import collections as C
from skein.sources import schemas

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PREFIXES = {"Person": "customer", "Organization": "supplier", "Transaction": "order", "Location": "nation", "Case": "region"}
TYPES = {v: k for k, v in PREFIXES.items()}


@query(f"WITH {A.ENTITIES_SQL} SELECT entity_id, entity_type, name, CASE split_part(entity_id, '-', 1) WHEN 'customer' THEN 'Person' WHEN 'supplier' THEN 'Organization' WHEN 'order' THEN 'Transaction' WHEN 'nation' THEN 'Location' WHEN 'region' THEN 'Case' ELSE 'Person' END AS inferred_type FROM entities WHERE entity_id IN ('customer-00012', 'supplier-00003', 'order-00100', 'nation-00004', 'region-00001')")
def entity_lookup_projection(spark, d):
    ents = A.entities(spark, d).where(F.col("entity_id").isin("customer-00012", "supplier-00003", "order-00100", "nation-00004", "region-00001"))
    return ents.withColumn("inferred_type", S.type_of_id(F.col("entity_id"), TYPES))


@query(f"WITH {A.PAYMENTS_SQL} SELECT relationship_id, source_id, 'Person' AS source_type, source_id AS source_text, target_id, 'Organization' AS target_type, target_id AS target_text FROM payments")
def relationship_nested_shape(spark, d):
    def end(c, kind):
        return F.struct(F.col(c).alias("entity_id"), F.lit(kind).alias("entity_type"), F.coalesce(F.nullif(F.lit(""), F.lit("")), F.col(c), F.lit("")).alias("text"))

    nested = A.payments(spark, d).select("relationship_id", end("source_id", "Person").alias("source"), end("target_id", "Organization").alias("target"))
    return nested.select("relationship_id", F.col("source.entity_id").alias("source_id"), F.col("source.entity_type").alias("source_type"), F.col("source.text").alias("source_text"), F.col("target.entity_id").alias("target_id"), F.col("target.entity_type").alias("target_type"), F.col("target.text").alias("target_text"))


@query(f"""WITH {A.ENTITIES_SQL}, {A.OWNERSHIP_SQL}, items AS (SELECT 'entity' AS kind, entity_id AS id, name AS label, CASE entity_type WHEN 'Person' THEN 'Person' WHEN 'Organization' THEN 'Organization' WHEN 'Transaction' THEN 'Account' WHEN 'Location' THEN 'Location' ELSE 'Organization' END AS display FROM entities
  UNION ALL SELECT 'relationship', relationship_id, source_id || ' ' || target_id, relationship_type FROM ownership)
SELECT * FROM items WHERE contains(lower(id || ' ' || label), '00012') ORDER BY kind, id LIMIT 50""")
def global_search(spark, d):
    e = A.entities(spark, d).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("name").alias("label"), S.lookup(S.DISPLAY_TYPE, F.col("entity_type"), "Organization").alias("display"))
    r = A.ownership(spark, d).select(F.lit("relationship").alias("kind"), F.col("relationship_id").alias("id"), F.concat_ws(" ", "source_id", "target_id").alias("label"), F.col("relationship_type").alias("display"))
    return e.unionByName(r).where(F.contains(F.lower(F.concat_ws(" ", "id", "label")), F.lit("00012"))).orderBy("kind", "id").limit(50)


@query(f"""WITH {A.ENTITIES_SQL}, faulty AS (SELECT CASE WHEN entity_id LIKE '%7' THEN replace(entity_id, '-', '_') ELSE entity_id END AS entity_id, CASE WHEN entity_id LIKE '%3' THEN 'Alien' ELSE entity_type END AS entity_type, CASE WHEN entity_id LIKE '%5' THEN NULL ELSE name END AS name FROM entities),
p AS (SELECT *, CASE entity_type WHEN 'Person' THEN 'customer' WHEN 'Organization' THEN 'supplier' WHEN 'Transaction' THEN 'order' WHEN 'Location' THEN 'nation' WHEN 'Case' THEN 'region' END AS prefix FROM faulty)
SELECT entity_id, concat_ws('; ', CASE WHEN prefix IS NULL THEN 'unknown type' END, CASE WHEN NOT regexp_matches(entity_id, '^[a-z]+-[0-9]{{5,}}$') THEN 'malformed id' END,
  CASE WHEN prefix IS NOT NULL AND NOT starts_with(entity_id, prefix || '-') THEN 'prefix does not match' END, CASE WHEN name IS NULL OR trim(name) = '' THEN 'no name' END) AS errors FROM p""")
def validate_entities(spark, d):
    e = A.entities(spark, d)
    faulty = e.select(F.when(F.col("entity_id").endswith("7"), F.replace("entity_id", F.lit("-"), F.lit("_"))).otherwise(F.col("entity_id")).alias("entity_id"), F.when(F.col("entity_id").endswith("3"), "Alien").otherwise(F.col("entity_type")).alias("entity_type"), F.when(F.col("entity_id").endswith("5"), None).otherwise(F.col("name")).alias("name"))
    return checks.validate_entities(faulty, PREFIXES)


@query(f"""WITH {A.PAYMENTS_SQL}, faulty AS (SELECT relationship_id, CASE WHEN relationship_id LIKE '%a' THEN 'LIKES' ELSE relationship_type END AS relationship_type, CASE WHEN relationship_id LIKE '%b' THEN 1.5e0 ELSE confidence END AS confidence, source_id, CASE WHEN relationship_id LIKE '%c' THEN source_id WHEN relationship_id LIKE '%d' THEN NULL ELSE target_id END AS target_id, CASE WHEN relationship_id LIKE '%e' THEN NULL ELSE ts END AS ts FROM payments)
SELECT relationship_id, concat_ws('; ', CASE WHEN relationship_type NOT IN ('TRANSFERRED_TO') THEN 'unknown type' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' END,
  CASE WHEN source_id IS NULL OR target_id IS NULL THEN 'missing end' END, CASE WHEN source_id = target_id THEN 'self-loop' END, CASE WHEN ts IS NULL THEN 'no time' END) AS errors FROM faulty""")
def validate_relationships(spark, d):
    r = A.payments(spark, d)
    ends = lambda x: F.col("relationship_id").endswith(x)
    faulty = r.select("relationship_id", F.when(ends("a"), "LIKES").otherwise(F.col("relationship_type")).alias("relationship_type"), F.when(ends("b"), 1.5).otherwise(F.col("confidence")).alias("confidence"), "source_id", F.when(ends("c"), F.col("source_id")).when(ends("d"), None).otherwise(F.col("target_id")).alias("target_id"), F.when(~ends("e"), F.col("ts")).alias("ts"))
    return checks.validate_relationships(faulty)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_check(spark, d):
    return checks.duplicates(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


LINKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS link, (SELECT count(*) FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})) AS missing" for c, k, p, pk in LINKS))
def fk_integrity(spark, d):
    out = None
    for c, k, p, pk in LINKS:
        one = checks.orphans(A.table(spark, d, c), A.table(spark, d, p), k, pk, f"{c}.{k}")
        out = one if out is None else out.unionByName(one)
    return out


AUDIT_SQL = """WITH log0 AS (SELECT event_id, ts, user_id, event_type, value, 'aud-' || substr(sha256(coalesce(user_id::VARCHAR, '') || '|' || coalesce(event_type, '')), 1, 12) AS h FROM events),
log AS (SELECT event_id, ts, user_id, event_type, value, h || CASE WHEN row_number() OVER (PARTITION BY h ORDER BY event_id) > 1 THEN '-' || (row_number() OVER (PARTITION BY h ORDER BY event_id) - 1) ELSE '' END AS audit_id FROM log0)"""


def _log(spark, d):
    return audit.with_ids(A.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


@query(f"{AUDIT_SQL} SELECT audit_id, event_id, user_id, (SELECT count(*) FROM log) AS total FROM log WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, audit_id LIMIT 50 OFFSET 20")
def audit_page(spark, d):
    log = _log(spark, d)
    hits = audit.query(log, equal={"event_type": "click", "user_id": None}, since="2024-01-05 00:00:00", until="2024-01-20 00:00:00")
    return audit.page(hits, 20, 50).crossJoin(F.broadcast(log.agg(F.count("*").alias("total")))).select("audit_id", "event_id", "user_id", "total")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def audit_retention(spark, d):
    return audit.latest(A.table(spark, d, "events"), "event_id").select("event_id", "event_type")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def audit_facets(spark, d):
    return A.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, regexp_replace(lower(substr('Token=' || props, 1, 200)), '(password|passwd|secret|token|connection_string|database_url|dsn)', '[redacted]', 'g') AS preview FROM events")
def audit_param_sanitize(spark, d):
    ev = A.table(spark, d, "events")
    params = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("Token"), F.lit("x")))
    return ev.select("event_id", audit.sanitised(params)["k"].alias("k"), audit.redacted(F.concat(F.lit("Token="), "props")).alias("preview"))


@query("SELECT o_orderkey, substr(sha256(concat_ws('|', coalesce(o_custkey::VARCHAR, ''), coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''))), 1, 12) AS short_id FROM orders")
def hash_ids(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", S.short_hash(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("short_id"))


CHAIN_SQL = """WITH b AS (SELECT o_orderkey, o_orderpriority AS data, sha256(o_orderkey || '|' || o_orderpriority) AS hash FROM orders),
c AS (SELECT *, CASE WHEN o_orderkey % 100 = 5 THEN 'broken' ELSE coalesce(lag(hash) OVER (ORDER BY o_orderkey), '') END AS prev_hash FROM b)"""


@query(f"{CHAIN_SQL} SELECT o_orderkey, prev_hash = coalesce(lag(hash) OVER (ORDER BY o_orderkey), '') AS link_ok, hash = sha256(o_orderkey || '|' || data) AS hash_ok FROM c")
def hash_chain_links(spark, d):
    """References from each order to the one of the key before, by an equi-join: right for dense keys, as these are.

    The hashes cover a block's own content alone; evidence_chain_by_log has chains whose
    hashes cover the hash before.
    """
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("data"))
    own = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "data"), 256)
    b = o.withColumn("hash", own)
    # The key is dense, so the block before is found by an equi-join instead of one global window.
    before = b.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("hash").alias("_before"))
    c = b.join(before, "o_orderkey", "left").withColumn("prev_hash", F.when(F.col("o_orderkey") % 100 == 5, "broken").otherwise(F.coalesce("_before", F.lit(""))))
    return c.select("o_orderkey", (F.col("prev_hash") == F.coalesce("_before", F.lit(""))).alias("link_ok"), (F.col("hash") == own).alias("hash_ok"))


@query("SELECT o_orderkey AS key, TRUE AS hash_ok, TRUE AS link_ok FROM orders")
def hash_chain_build(spark, d):
    """A chain for each customer over its orders, built and verified."""
    blocks = A.table(spark, d, "orders").select(F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("data"))
    return audit.verify(audit.chained(blocks, "key", "data", "log"), "key", "data", "log")


UPSERT_SQL = """WITH batch AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal, 'new' AS created_at FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal, 'new' FROM customer WHERE c_custkey % 50 = 0),
base AS (SELECT c_custkey, c_name, c_acctbal, 'old' AS created_at FROM customer)"""


def _upsert_input(spark, d):
    cust = A.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    batch = cust.where("c_custkey % 10 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    batch = batch.unionByName(cust.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)).withColumn("created_at", F.lit("new"))
    return cust.withColumn("created_at", F.lit("old")), batch


@query(f"{UPSERT_SQL} SELECT * FROM base WHERE c_custkey NOT IN (SELECT c_custkey FROM batch) UNION ALL SELECT b.c_custkey, b.c_name, b.c_acctbal, coalesce(o.created_at, b.created_at) FROM batch b LEFT JOIN base o USING (c_custkey)")
def upsert_merge(spark, d):
    return C.upsert(*_upsert_input(spark, d), "c_custkey")


@query(f"{UPSERT_SQL} SELECT (SELECT count(*) FROM batch WHERE c_custkey NOT IN (SELECT c_custkey FROM base)) AS inserted, (SELECT count(*) FROM batch WHERE c_custkey IN (SELECT c_custkey FROM base)) AS updated, 0 AS errors")
def upsert_counts(spark, d):
    return C.upsert_counts(*_upsert_input(spark, d), "c_custkey")


@query()
def synthetic_generate(spark, d):
    ents, rels = C.generate(spark)
    return C.valid_edges(rels, ents)


@query(" UNION ALL ".join(f"SELECT '{c}' AS collection, '{schemas.key_of(c)}' AS key, {len(schemas.columns(c))} AS n_columns" for c in schemas.COLLECTIONS))
def schema_health(spark, d):

    return schemas.health(spark)


@query(f"""WITH {A.ENTITIES_SQL}, {A.OWNERSHIP_SQL} SELECT o.* FROM ownership o LEFT JOIN entities s ON s.entity_id = o.source_id LEFT JOIN entities t ON t.entity_id = o.target_id
WHERE coalesce(s.entity_type IN ('Location', 'Organization'), TRUE) AND coalesce(t.entity_type IN ('Location', 'Organization'), TRUE)""")
def type_visible_edges(spark, d):
    """Edges whose known ends are of the chosen types; unknown ends hide nothing."""
    types = A.entities(spark, d).select("entity_id", F.col("entity_type").isin("Location", "Organization").alias("_ok"))
    rels = A.ownership(spark, d)
    s, t = types.select(F.col("entity_id").alias("_s"), F.col("_ok").alias("_sk")), types.select(F.col("entity_id").alias("_t"), F.col("_ok").alias("_tk"))
    seen = rels.join(s, F.col("source_id") == F.col("_s"), "left").join(t, F.col("target_id") == F.col("_t"), "left")
    return seen.where(F.coalesce("_sk", F.lit(True)) & F.coalesce("_tk", F.lit(True))).select(*rels.columns)


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND list_contains(['user-00001', 'user-00002'], printf('user-%05d', user_id))")
def timeline_filter(spark, d):
    ev = A.table(spark, d, "events").where("event_type = 'purchase'").withColumn("_e", A.entity_id("user", "user_id"))
    return ev.where(F.array_contains(F.array(F.lit("user-00001"), F.lit("user-00002")), F.col("_e"))).select("event_id", "event_type", "value")


@query("SELECT p_partkey, printf('vehicle-%05d', p_partkey + 99000) AS vehicle_id, regexp_matches(printf('vehicle-%05d', p_partkey + 99000), '^vehicle-[0-9]{5,}$') AS valid FROM part")
def generated_ids(spark, d):
    vid = F.format_string("vehicle-%05d", F.col("p_partkey") + 99000)
    return A.table(spark, d, "part").select("p_partkey", vid.alias("vehicle_id"), vid.rlike("^vehicle-[0-9]{5,}$").alias("valid"))


@query(f"""WITH {A.OWNERSHIP_SQL}, {A.ENTITIES_SQL}, adj AS (SELECT source_id AS node, target_id AS nbr FROM ownership UNION ALL SELECT target_id, source_id FROM ownership)
SELECT node AS entity_id, count(DISTINCT entity_type) AS neighbour_types, count(DISTINCT nbr) AS neighbours FROM adj JOIN entities ON entity_id = nbr GROUP BY 1""")
def neighbour_types(spark, d):
    from skein.operators import graph

    ents = A.entities(spark, d).select(F.col("entity_id").alias("nbr"), "entity_type")
    return graph.adjacency(A.ownership(spark, d)).join(ents, "nbr").groupBy(F.col("node").alias("entity_id")).agg(F.countDistinct("entity_type").alias("neighbour_types"), F.countDistinct("nbr").alias("neighbours"))


@query(f"WITH {A.OWNERSHIP_SQL} SELECT * FROM ownership WHERE relationship_type = 'LOCATED_AT' AND source_id IN (SELECT printf('customer-%05d', o_custkey) FROM orders WHERE o_orderpriority LIKE '1-%')")
def typed_pairs_by_id(spark, d):
    """LOCATED_AT edges of a given list of ids: those of customers with an order of highest priority."""
    own, orders = A.ownership(spark, d), A.table(spark, d, "orders").where("o_orderpriority LIKE '1-%'")
    urgent = A.table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    given = urgent.select(A.row_id(A.entity_id("customer", "c_custkey"), A.entity_id("nation", "c_nationkey"), F.lit("LOCATED_AT")).alias("relationship_id"))
    return own.where("relationship_type = 'LOCATED_AT'").join(given, "relationship_id", "left_semi")


@query(f"WITH {A.ENTITIES_SQL} SELECT e.* FROM entities e WHERE entity_id IN (SELECT printf('nation-%05d', n_nationkey) FROM nation WHERE n_regionkey = 2) OR entity_id = 'region-00002'")
def case_lookup(spark, d):
    from skein.operators import graph

    core = graph.case_members(A.ownership(spark, d).where("relationship_type = 'ASSOCIATED_WITH'"), "region-00002")
    return A.entities(spark, d).join(core, "entity_id", "left_semi")

"""Queries over text, keys and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalar as S
from skein.operators import checks, text
from skein.operators.base import settle
from skein.sources import adapters as A
from skein.sources import collections as C

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PERSON_KEY = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9_ \\t\\r\\n]', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')"
SUFFIX = "(" + "|".join(S.LEGAL_SUFFIXES) + ")$"
ORG_KEY = f"trim(regexp_replace({PERSON_KEY}, '{SUFFIX}', ''))"


@query(f"SELECT c_custkey AS id, {PERSON_KEY.format('c_name')} AS person_key, {ORG_KEY.format("c_name || ' Pvt Ltd'")} AS org_key FROM customer")
def normalize_names(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.person_key(F.col("c_name")).alias("person_key"), S.org_key(F.concat("c_name", F.lit(" Pvt Ltd"))).alias("org_key"))


@query("SELECT p_partkey AS id, trim(regexp_replace(p_name || '  x', '[ \\t\\r\\n]+', ' ', 'g')) AS clean, right(regexp_replace('+91-' || (9000000000 + p_partkey), '[^0-9]', '', 'g'), 10) AS phone_key, upper(replace(trim(p_brand || ' ab'), ' ', '')) AS plate_key FROM part")
def normalize_keys(spark, d):
    p = A.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), S.clean_space(F.concat("p_name", F.lit("  x"))).alias("clean"), S.phone_key(F.concat(F.lit("+91-"), (F.col("p_partkey") + 9_000_000_000).cast("string"))).alias("phone_key"), S.plate_key(F.concat("p_brand", F.lit(" ab"))).alias("plate_key"))


RESOLVE_SQL = """WITH m AS (SELECT printf('m-%d', c_custkey) AS mention_id, 'Person' AS entity_type, lower(c_name) AS key FROM customer
  UNION ALL SELECT printf('s-%d', s_suppkey), 'Organization', lower(s_name) FROM supplier UNION ALL SELECT printf('p-%d', p_partkey), 'Product', p_brand FROM part),
k AS (SELECT printf('customer-%05d', c_custkey) AS entity_id, 'Person' AS entity_type, lower(c_name) AS key FROM customer
  UNION ALL SELECT printf('supplier-%05d', s_suppkey), 'Organization', lower(s_name) FROM supplier UNION ALL SELECT printf('brand-%05d', n_nationkey), 'Product', 'Brand#' || (n_nationkey // 2 + 1) FROM nation),
h AS (SELECT mention_id, entity_id, entity_type, count(DISTINCT entity_id) OVER (PARTITION BY mention_id) AS candidates FROM m JOIN k USING (entity_type, key)),
c AS (SELECT mention_id, entity_id, entity_type, CASE WHEN entity_type IN ('Organization', 'Product') THEN 1e0 ELSE 0.6e0 END AS confidence, candidates,
  CASE WHEN entity_type IN ('Organization', 'Product') AND candidates = 1 THEN 'auto_linked' ELSE 'needs_review' END AS status FROM h)"""


def _mentions_and_keys(spark, d, people="true"):
    cust, supp, part, nation = (A.table(spark, d, n) for n in ("customer", "supplier", "part", "nation"))
    one = lambda df, mid, kind, key: df.select(mid.alias("mention_id"), F.lit(kind).alias("entity_type"), key.alias("key"))
    m = one(cust.where(people), F.format_string("m-%d", "c_custkey"), "Person", F.lower("c_name")).unionByName(one(supp, F.format_string("s-%d", "s_suppkey"), "Organization", F.lower("s_name"))).unionByName(one(part, F.format_string("p-%d", "p_partkey"), "Product", F.col("p_brand")))
    named = lambda df, prefix, key, value: df.select(A.entity_id(prefix, key).alias("id"), value.alias("k"))
    k = C.key_index({
        "Person": (named(cust, "customer", "c_custkey", F.lower("c_name")), "id", "k"), "Organization": (named(supp, "supplier", "s_suppkey", F.lower("s_name")), "id", "k"),
        "Product": (named(nation, "brand", "n_nationkey", F.concat(F.lit("Brand#"), F.expr("n_nationkey div 2 + 1"))), "id", "k"),
    })
    return m, k


@query(f"{RESOLVE_SQL} SELECT * FROM c")
def resolve_candidates(spark, d):
    return text.resolve(*_mentions_and_keys(spark, d), exact=["Organization", "Product"])


@query(f"{RESOLVE_SQL} SELECT m.mention_id, m.entity_type, m.key, c.entity_id AS linked_id FROM m LEFT JOIN c ON c.mention_id = m.mention_id AND c.status = 'auto_linked'")
def resolve_attached(spark, d):
    m, k = _mentions_and_keys(spark, d)
    return text.attached(m, text.resolve(m, k, exact=["Organization", "Product"]))


def _documents(spark, d):
    return A.table(spark, d, "documents").select("doc_id", "text")


@query()
def extract_mentions(spark, d):
    return text.extract_mentions(_documents(spark, d))


@query()
def mentions_per_document(spark, d):
    """Mentions by the rule of capitalised words, of every document that has one."""
    return text.extract_mentions(_documents(spark, d), rules=tuple(r for r in text.RULES if r.name == "person_titlecase")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+[ \\t\\r\\n]+[A-Z][a-z]+')) AS n FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+[ \\t\\r\\n]+[A-Z][a-z]+')")
def capitalised_pairs(spark, d):
    """Neighbouring capitalised words in ASCII letters, counted over all documents without Python."""
    pattern = F.lit("[A-Z][a-z]+[ \\t\\r\\n]+[A-Z][a-z]+")
    return _documents(spark, d).select("doc_id", F.regexp_count("text", pattern).alias("n")).where("n > 0").withColumn("n", F.col("n").cast("long"))


@query()
def cue_relations(spark, d):
    docs = _documents(spark, d)
    return text.cue_relations(docs, settle(text.extract_mentions(docs, reach=True)))


@query()
def mention_review_flags(spark, d):
    return text.review_flags(text.extract_mentions(_documents(spark, d))).groupBy("method", "needs_review").agg(F.count("*").alias("n"))


@query()
def pipeline_gate(spark, d):
    docs = _documents(spark, d)
    mentions = settle(text.extract_mentions(docs, reach=True))
    return text.gate(docs, mentions, text.cue_relations(docs, mentions))


@query(f"WITH {A.PAYMENTS_SQL} SELECT relationship_id, source_id, target_id, 'TRANSFERRED_TO' AS relationship_type, 1e0 AS confidence FROM payments WHERE source_id <> target_id")
def structured_relations(spark, d):
    pay = A.payments(spark, d)
    return text.structured_transfers(pay.select("relationship_id", F.col("source_id").alias("from_account"), F.col("target_id").alias("to_account")))


@query("SELECT user_id, first, second, gap FROM (SELECT user_id, event_id AS first, lead(event_id) OVER w AS second, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)) WHERE second IS NOT NULL")
def cooccurrence_pairs(spark, d):
    ev = A.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return text.cooccurring(ev, "user_id", "us", "event_id")


@query("SELECT a.user_id, a.event_id AS l, b.event_id AS r FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 3600000000")
def proximity_pairs(spark, d):
    ev = A.table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return text.near_pairs(ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'"), "user_id", "us", 3_600_000_000)


GROUND_SQL = f"""WITH {A.PAYMENTS_SQL}, claims AS (SELECT 'claim-' || (l_orderkey % 50) AS claim_id, CASE WHEN l_linenumber = 7 THEN 'customer-x' ELSE printf('customer-%05d', o_custkey) END AS reference FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ids AS (SELECT DISTINCT source_id AS id FROM payments)"""


def _claims(spark, d):
    lines = A.table(spark, d, "lineitem").join(A.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.concat(F.lit("claim-"), (F.col("l_orderkey") % 50).cast("string")).alias("claim_id"), F.when(F.col("l_linenumber") == 7, "customer-x").otherwise(A.entity_id("customer", "o_custkey")).alias("reference"))


@query(f"{GROUND_SQL} SELECT claim_id, count(*) AS n_references, count(*) FILTER (id IS NULL) AS n_unsupported, CASE WHEN count(*) FILTER (id IS NULL) = 0 THEN 'grounded' WHEN count(*) FILTER (id IS NULL) < count(*) THEN 'partial' ELSE 'unsupported' END AS status FROM claims LEFT JOIN ids ON reference = id GROUP BY 1")
def grounding_check(spark, d):
    return checks.grounding(_claims(spark, d), A.payments(spark, d).select(F.col("source_id").alias("id")))


@query(f"{GROUND_SQL} SELECT reference, claim_id FROM claims WHERE reference NOT IN (SELECT id FROM ids)")
def ungrounded_claims(spark, d):
    return checks.ungrounded(_claims(spark, d), A.payments(spark, d).select(F.col("source_id").alias("id")))


PRF = "round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall, round(coalesce(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / ((tp / (tp + fp)::DOUBLE) + (tp / (tp + fn)::DOUBLE)), 0), 4) AS f1"


@query(f"""WITH p AS (SELECT lang, quality = 1 AS expected, n_chars >= 500 AS predicted FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (NOT expected AND predicted) AS fp, count(*) FILTER (expected AND NOT predicted) AS fn FROM p GROUP BY 1) SELECT *, {PRF} FROM c""")
def precision_recall_f1(spark, d):
    both = A.table(spark, d, "labels").join(A.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return checks.precision_recall(both.select("lang", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 500).alias("predicted")), "lang")


@query(f"""WITH e AS (SELECT doc_id FROM labels WHERE quality = 1), p AS (SELECT doc_id FROM documents WHERE n_chars >= 500),
c AS (SELECT (SELECT count(*) FROM e WHERE doc_id IN (SELECT doc_id FROM p)) AS tp, (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS fp, (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS fn) SELECT *, {PRF} FROM c""")
def set_difference_metrics(spark, d):
    return checks.set_metrics(A.table(spark, d, "labels").where("quality = 1"), A.table(spark, d, "documents").where("n_chars >= 500"), ["doc_id"])


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), m AS (SELECT event_type, max(value) AS max_value, round(avg(value), 4) AS mean FROM events GROUP BY 1) SELECT event_type, n, max_value, mean, value AS upper_median FROM r JOIN m USING (event_type) WHERE i = n // 2")
def latency_median_rule(spark, d):
    return checks.latency(A.table(spark, d, "events"), "event_type", "value")


@query("SELECT lang, count(*) AS n, CASE WHEN count(*) = 0 THEN 0.35e0 ELSE round(least(0.85e0, 0.5e0 + 0.05e0 * (count(DISTINCT source) + 1)), 4) END AS confidence FROM documents GROUP BY 1")
def interpretation_confidence(spark, d):
    g = A.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("_s"))
    return g.select("lang", "n", S.interpretation_confidence(F.col("_s"), F.lit(1)).alias("confidence"))


@query("WITH g AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 500) AS fp, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn, avg(n_chars) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT (2 * tp >= 0.8 * (2 * tp + fp + fn)) AS good, count(*) AS n, round(avg(c), 4) AS mean_value FROM g GROUP BY 1")
def confidence_calibration(spark, d):
    """Mean of a value over the groups with an F1 of 0.8 or more, and over the others."""
    both = A.table(spark, d, "labels").join(A.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    pairs = both.select("lang", "n_chars", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 500).alias("predicted"))
    f1 = checks.precision_recall(pairs, "lang").select("lang", (F.col("tp") * 2 * 10 >= 8 * (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("good"))
    return f1.join(pairs.groupBy("lang").agg(F.avg("n_chars").alias("_c")), "lang").groupBy("good").agg(F.count("*").alias("n"), F.round(F.avg("_c"), 4).alias("mean_value"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]+Z')) AS times, substr(text, 1, 120) AS preview FROM documents")
def claims_in_text(spark, d):
    docs = _documents(spark, d)
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("numbers"), F.size(F.regexp_extract_all("text", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]+Z"), F.lit(0))).alias("times"), F.substring("text", 1, 120).alias("preview"))


GIVEN = "Anna Boris Clara David Elena Felix Grace Henry Irina Jonas Karla Louis Maria Nadia Oscar Paula Quinn Rosa Simon Tessa".split()
FAMILY = "Adler Brook Carver Dalton Ellis Foster Garner Holt Irving Jarvis Keller Lowell Mercer Norris Osborn Porter Quill Ramsey Sutton Tanner".split()
FIRMS = "Amber Birch Cobalt Delta Ember Falcon Granite Harbor Indigo Juniper".split()


def order_reports(spark, d):
    """(doc_id, text): a sentence or two on each order: its customer, a contact picked by its price and the customer's nation."""
    def pick(words, n):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))

    def person(n):
        return F.concat_ws(" ", pick(GIVEN, n), pick(FAMILY, F.floor(n / len(GIVEN))))

    orders = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("contact"))
    rows = orders.join(A.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    p, q, firm, nation = person(F.col("o_custkey")), person(F.col("contact")), F.concat(pick(FIRMS, F.col("o_custkey")), F.lit(" Traders Ltd")), F.col("c_nationkey").cast("string")
    told = [
        F.concat(p, F.lit(" works for "), firm, F.lit(" and has travelled to Sector "), nation, F.lit(".")), F.concat(p, F.lit(" called "), q, F.lit(" about the order.")),
        F.concat(p, F.lit(", owner of KA-12-AB-1"), F.lpad(nation, 3, "0"), F.lit(", met "), q, F.lit(".")), F.concat(p, F.lit(" is a member of "), firm, F.lit(". Nothing more was said.")),
    ]
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(*told), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("text"))


def _person_sql(n: str) -> str:
    return f"list_element({GIVEN}, ({n}) % 20 + 1) || ' ' || list_element({FAMILY}, (({n}) // 20) % 20 + 1)"


@query(f"""WITH r AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k, {_person_sql("o_custkey")} AS p, {_person_sql("floor(o_totalprice)::BIGINT")} AS q,
  list_element({FIRMS}, o_custkey % 10 + 1) || ' Traders Ltd' AS firm, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT doc_id, p AS source_text, firm AS target_text, 'WORKS_FOR' AS relationship_type, 0.8e0 AS confidence FROM r WHERE k = 0
UNION ALL SELECT doc_id, p, 'Sector ' || n, 'TRAVELED_TO', 0.75e0 FROM r WHERE k = 0 UNION ALL SELECT doc_id, p, q, 'CALLED', 0.75e0 FROM r WHERE k = 1
UNION ALL SELECT doc_id, p, 'KA-12-AB-1' || lpad(n::VARCHAR, 3, '0'), 'OWNS', 0.8e0 FROM r WHERE k = 2 UNION ALL SELECT doc_id, p, q, 'KNOWS', 0.55e0 FROM r WHERE k = 2
UNION ALL SELECT doc_id, p, firm, 'ASSOCIATED_WITH', 0.7e0 FROM r WHERE k = 3""")
def cue_relations_of_orders(spark, d):
    """Relations told in the reports on all orders; the SQL takes them from the orders themselves."""
    docs = settle(order_reports(spark, d))
    found = text.nearest_cue_relations(text.cues_in(docs), text.extract_mentions(docs), docs=docs.count())
    return found.select("doc_id", "source_text", "target_text", "relationship_type", "confidence")

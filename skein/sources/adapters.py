"""Entities and relationships over the star-schema and event tables.

An edge table has relationship_id, source_id, target_id, relationship_type, ts and
confidence; graphs without times leave ts null. Ids are hashes of whole rows, so that no
global order is needed to name an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_id(prefix: str, key: str | Column) -> Column:
    """prefix- and the whole number in five digits or more; the formatter, which is slow, only meets nulls and numbers below 0."""
    k = F.col(key) if isinstance(key, str) else key
    digits = k.cast("string")
    return F.when(k.between(0, 99_999), F.concat(F.lit(f"{prefix}-"), F.lpad(digits, 5, "0"))).when(k > 99_999, F.concat(F.lit(f"{prefix}-"), digits)).otherwise(F.format_string(f"{prefix}-%05d", k))


def row_id(*parts: Column) -> Column:
    """rel- and 32 hex digits of the hash of the parts' text."""
    return F.concat(F.lit("rel-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their customer, numbers for names: what payments(), frequent_payments() and account_payments() name.

    The hash of a line is taken, as 16 bytes, before lines meet orders, so that the join
    moves it in place of the columns it is made of. Settle it where it is read more than once.
    """
    money = [F.col(c).cast("decimal(15,2)").cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], *money, F.col("l_returnflag"), F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"), "l_shipdate", "l_discount", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cents = lambda c: c.cast("decimal(15,2)")
    amount = cents(F.col("l_extendedprice")) * (cents(F.lit(1)) - cents(F.col("l_discount")))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "l_suppkey", "digest", "l_shipdate", "l_discount", amount.alias("amount"))


def _named(rows: DataFrame, source: Column, target: Column) -> DataFrame:
    """Rows of paid() as edges with amounts."""
    return rows.select(
        F.concat(F.lit("rel-"), F.lower(F.hex("digest"))).alias("relationship_id"),
        source.alias("source_id"),
        target.alias("target_id"),
        F.lit("TRANSFERRED_TO").alias("relationship_type"),
        F.col("l_shipdate").alias("ts"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        "amount",
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer TRANSFERRED_TO supplier, one edge an order line."""
    return _named(paid(spark, sf_dir), entity_id("customer", "o_custkey"), entity_id("supplier", "l_suppkey"))


PAYMENTS_SQL = """payments AS (
  SELECT 'rel-' || substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DECIMAL(15,2)::VARCHAR,
      l_extendedprice::DECIMAL(15,2)::VARCHAR, l_discount::DECIMAL(15,2)::VARCHAR, l_tax::DECIMAL(15,2)::VARCHAR, l_returnflag, l_linestatus,
      strftime(l_shipdate, '%Y-%m-%d'))), 1, 32) AS relationship_id,
    printf('customer-%05d', o_custkey) AS source_id, printf('supplier-%05d', l_suppkey) AS target_id, 'TRANSFERRED_TO' AS relationship_type,
    l_shipdate AS ts, 1e0 - l_discount AS confidence, l_extendedprice::DECIMAL(15,2) * (1::DECIMAL(15,2) - l_discount::DECIMAL(15,2)) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation to nation (customer's to supplier's, different ones) with the number of order lines."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    homes = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        lines.join(homes, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
        .groupBy(entity_id("nation", "c_nationkey").alias("source_id"), entity_id("nation", "s_nationkey").alias("target_id")).agg(F.count("*").alias("n_lines"))
    )


def backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two destinations of each nation with most lines, as TRANSFERRED_TO edges."""
    w = Window.partitionBy("source_id").orderBy(F.desc("n_lines"), "target_id")
    top = trade(spark, sf_dir).withColumn("_rank", F.row_number().over(w)).where("_rank <= 2")
    return top.select(
        row_id(F.col("source_id"), F.col("target_id")).alias("relationship_id"), "source_id", "target_id", F.lit("TRANSFERRED_TO").alias("relationship_type"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0.9).alias("confidence"),
    )


BACKBONE_SQL = """trade AS (
  SELECT printf('nation-%05d', c_nationkey) AS source_id, printf('nation-%05d', s_nationkey) AS target_id, count(*) AS n_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
backbone AS (
  SELECT 'rel-' || substr(sha256(source_id || '|' || target_id), 1, 32) AS relationship_id, source_id, target_id
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n_lines DESC, target_id) AS k FROM trade) WHERE k <= 2),
links AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM backbone),
both_ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT DISTINCT u AS id FROM both_ways)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of trade(), as TRANSFERRED_TO edges."""
    return trade(spark, sf_dir).select(
        row_id(F.col("source_id"), F.col("target_id")).alias("relationship_id"), "source_id", "target_id", F.lit("TRANSFERRED_TO").alias("relationship_type"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0.9).alias("confidence"),
    )


def _often(rows: DataFrame) -> DataFrame:
    """Rows of paid() between the pairs that frequent_payments() takes; pairs are counted and met as numbers."""
    pairs = rows.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("_n"))
    bound = pairs.agg((F.avg("_n") + 2 * F.stddev_pop("_n")).alias("_bound"))
    often = pairs.crossJoin(F.broadcast(bound)).where("_n > _bound").select("o_custkey", "l_suppkey")
    return rows.join(often, ["o_custkey", "l_suppkey"], "left_semi")


def frequent_payments(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The payments between customers and suppliers that pay more often than the mean pair does by over two standard deviations; rows: paid(), where that is at hand."""
    pay = _named(_often(paid(spark, sf_dir) if rows is None else rows), entity_id("customer", "o_custkey"), entity_id("supplier", "l_suppkey"))
    return pay.select("relationship_id", "source_id", "target_id", "relationship_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "confidence")


FREQUENT_SQL = PAYMENTS_SQL + """,
pair_counts AS (SELECT source_id, target_id, count(*) AS n FROM payments GROUP BY 1, 2),
frequent AS (SELECT p.* FROM payments p JOIN pair_counts c USING (source_id, target_id) WHERE n > (SELECT avg(n) + 2 * stddev_pop(n) FROM pair_counts))"""


def _account(key: str) -> Column:
    """account- and the last digits of the entity's id."""
    return F.when(F.col(key) >= 0, entity_id("account", key)).otherwise(F.concat(F.lit("account-"), F.regexp_extract(entity_id("party", key), "[0-9]+$", 0)))


def account_payments(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """account TRANSFERRED_TO account, one edge an order line. Customer and supplier of one number hold one account, which so both pays and is paid. rows: paid(), where that is at hand."""
    return _named(paid(spark, sf_dir) if rows is None else rows, _account("o_custkey"), _account("l_suppkey"))


ACCOUNTS_SQL = PAYMENTS_SQL + """,
accounts AS (SELECT relationship_id, 'account-' || regexp_extract(source_id, '[0-9]+$') AS source_id, 'account-' || regexp_extract(target_id, '[0-9]+$') AS target_id, ts::DATE AS ts, amount FROM payments)"""


def frequent_account_payments(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """account_payments() between the parties of frequent_payments()."""
    return account_payments(spark, sf_dir, _often(paid(spark, sf_dir) if rows is None else rows)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


FREQUENT_ACCOUNTS_SQL = FREQUENT_SQL + """,
pay AS (SELECT relationship_id, 'account-' || regexp_extract(source_id, '[0-9]+$') AS source_id, 'account-' || regexp_extract(target_id, '[0-9]+$') AS target_id, relationship_type, ts::TIMESTAMP AS ts, confidence, amount FROM frequent)"""


def account_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, entity_id): the region of each customer's account, a case."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(entity_id("region", "n_regionkey").alias("case_id"), entity_id("account", "c_custkey").alias("entity_id"))


ACCOUNT_CASES_SQL = "account_cases AS (SELECT printf('region-%05d', n_regionkey) AS case_id, printf('account-%05d', c_custkey) AS entity_id FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(entity_id("nation", "n_nationkey").alias("entity_id"), F.lit("Location").alias("entity_type"), F.col("n_name").alias("name"))


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer OWNS order; customer and supplier LOCATED_AT nation; nation ASSOCIATED_WITH region."""
    def edges(name, source, target, kind):
        return table(spark, sf_dir, name).select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("relationship_type"))

    parts = [
        edges("orders", entity_id("customer", "o_custkey"), entity_id("order", "o_orderkey"), "OWNS"),
        edges("customer", entity_id("customer", "c_custkey"), entity_id("nation", "c_nationkey"), "LOCATED_AT"),
        edges("supplier", entity_id("supplier", "s_suppkey"), entity_id("nation", "s_nationkey"), "LOCATED_AT"),
        edges("nation", entity_id("nation", "n_nationkey"), entity_id("region", "n_regionkey"), "ASSOCIATED_WITH"),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.select(row_id(F.col("source_id"), F.col("target_id"), F.col("relationship_type")).alias("relationship_id"), "*")


OWNERSHIP_SQL = """own0 AS (
  SELECT printf('customer-%05d', o_custkey) AS source_id, printf('order-%05d', o_orderkey) AS target_id, 'OWNS' AS relationship_type FROM orders
  UNION ALL SELECT printf('customer-%05d', c_custkey), printf('nation-%05d', c_nationkey), 'LOCATED_AT' FROM customer
  UNION ALL SELECT printf('supplier-%05d', s_suppkey), printf('nation-%05d', s_nationkey), 'LOCATED_AT' FROM supplier
  UNION ALL SELECT printf('nation-%05d', n_nationkey), printf('region-%05d', n_regionkey), 'ASSOCIATED_WITH' FROM nation),
ownership AS (SELECT 'rel-' || substr(sha256(concat_ws('|', source_id, target_id, relationship_type)), 1, 32) AS relationship_id, * FROM own0)"""


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of payments() and ownership()."""
    cols = ("relationship_id", "source_id", "target_id", "relationship_type")
    own = ownership(spark, sf_dir).select(*cols, F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0.9).alias("confidence"))
    return payments(spark, sf_dir).select(*cols, F.col("ts").cast("timestamp_ntz").alias("ts"), "confidence").unionByName(own)


#: Kinds of nodes of network() in the order of their names; a fixed rule of the ids, whose place is the kind's number.
PREFIXES = ("customer", "nation", "order", "region", "supplier")
DIGITS = 15


def number(prefix: str, key: str) -> Column:
    """entity_id() as one whole number: the key above four bits for its kind and whether it is null. Keys have up to DIGITS digits."""
    k, kind = F.col(key).cast("long"), PREFIXES.index(prefix)
    most = 10**DIGITS - 1
    return F.when(k.between(-most, most), F.shiftleft(k, 4).bitwiseOR(F.lit(kind))).when(k.isNull(), F.lit(8 | kind).cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"a {prefix}'s key has over {DIGITS} digits: "), k.cast("string"))))


def name_of(number: str | Column) -> Column:
    """The id that a number() stands for."""
    n = F.col(number) if isinstance(number, str) else number
    key, kind = F.when(n.bitwiseAND(F.lit(8)) == 0, F.shiftright(n, 4)), n.bitwiseAND(F.lit(7))
    out = F.when(kind == 0, entity_id(PREFIXES[0], key))
    for i, prefix in enumerate(PREFIXES[1:], 1):
        out = out.when(kind == i, entity_id(prefix, key))
    return out


def order_of(number: str | Column) -> Column:
    """A whole number that orders number()s as their names are ordered: kind, sign, digits from the left, length."""
    n = F.col(number) if isinstance(number, str) else number
    key, kind = F.shiftright(n, 4), n.bitwiseAND(F.lit(7))
    size = F.abs(key)
    digits = F.greatest(F.length(size.cast("string")), F.when(key < 0, 4).otherwise(5))
    tens = F.array(*[F.lit(10**i).cast("long") for i in range(DIGITS)])
    sign = F.when(n.bitwiseAND(F.lit(8)) != 0, 0).when(key < 0, 1).otherwise(2)  # as blank, minus and digits are ordered
    return ((kind * 3 + sign) * F.lit(10**DIGITS) + size * F.element_at(tens, F.lit(DIGITS + 1) - digits)) * 16 + digits


def name_in_order(order: str | Column) -> Column:
    """The id that an order_of() stands for."""
    o = F.col(order) if isinstance(order, str) else order
    digits, rest = o.bitwiseAND(F.lit(15)), F.shiftright(o, 4)
    tens = F.array(*[F.lit(10**i).cast("long") for i in range(DIGITS)])
    whole = lambda a, b: F.call_function("div", a, b)
    size, kind = whole(F.pmod(rest, F.lit(10**DIGITS)), F.element_at(tens, (F.lit(DIGITS + 1) - digits).cast("int"))), whole(rest, F.lit(10**DIGITS))
    sign = F.pmod(kind, F.lit(3))
    key = F.when(sign == 1, -size).when(sign == 2, size)
    out = F.when(kind < 3, entity_id(PREFIXES[0], key))
    for i, prefix in enumerate(PREFIXES[1:], 1):
        out = out.when(kind < 3 * i + 3, entity_id(prefix, key))
    return out


def numbered_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges of network() in number()s, (source_id, target_id): those between customers, suppliers, nations and regions, and those to orders.

    The kinds of the ends tell which is the source, so that no pair comes both ways and none is a loop.
    """
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ends = lambda df, source, target: df.select(number(*source).alias("source_id"), number(*target).alias("target_id"))
    rows = ends(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), ("customer", "o_custkey"), ("supplier", "l_suppkey"))
    for name, source, target in (("customer", ("customer", "c_custkey"), ("nation", "c_nationkey")), ("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")), ("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"))):
        rows = rows.unionByName(ends(table(spark, sf_dir, name), source, target))
    return rows, ends(orders, ("customer", "o_custkey"), ("order", "o_orderkey"))


def numbered_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, w): a row a pair of ends of numbered_edges() with the number of its edges."""
    rows, owned = numbered_edges(spark, sf_dir)
    return rows.unionByName(owned).groupBy("source_id", "target_id").agg(F.count("*").alias("w"))


def numbered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id): the number()s of entities()."""
    keys = {"customer": "c_custkey", "nation": "n_nationkey", "orders": "o_orderkey", "region": "r_regionkey", "supplier": "s_suppkey"}
    out = None
    for (name, key), prefix in zip(keys.items(), PREFIXES):
        one = table(spark, sf_dir, name).select(number(prefix, key).alias("entity_id"))
        out = one if out is None else out.unionByName(one)
    return out


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified view of the entities of the ownership graph."""
    def one(name, prefix, key, kind, label):
        return table(spark, sf_dir, name).select(entity_id(prefix, key).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(label).cast("string").alias("name"))

    parts = [
        one("customer", "customer", "c_custkey", "Person", "c_name"), one("supplier", "supplier", "s_suppkey", "Organization", "s_name"),
        one("orders", "order", "o_orderkey", "Transaction", "o_orderpriority"), one("nation", "nation", "n_nationkey", "Location", "n_name"),
        one("region", "region", "r_regionkey", "Case", "r_name"),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union


ENTITIES_SQL = """entities AS (
  SELECT printf('customer-%05d', c_custkey) AS entity_id, 'Person' AS entity_type, c_name AS name FROM customer
  UNION ALL SELECT printf('supplier-%05d', s_suppkey), 'Organization', s_name FROM supplier
  UNION ALL SELECT printf('order-%05d', o_orderkey), 'Transaction', o_orderpriority FROM orders
  UNION ALL SELECT printf('nation-%05d', n_nationkey), 'Location', n_name FROM nation
  UNION ALL SELECT printf('region-%05d', r_regionkey), 'Case', r_name FROM region)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user to event type, from the events table."""
    return table(spark, sf_dir, "events").select(
        F.format_string("rel-%08d", F.col("event_id")).alias("relationship_id"), entity_id("user", "user_id").alias("source_id"),
        F.concat(F.lit("kind-"), F.col("event_type")).alias("target_id"), F.col("event_type").alias("relationship_type"), F.col("ts"), F.lit(0.8).alias("confidence"),
    )


ACTIVITY_SQL = """activity AS (
  SELECT printf('rel-%08d', event_id) AS relationship_id, printf('user-%05d', user_id) AS source_id, 'kind-' || event_type AS target_id,
    event_type AS relationship_type, ts, 0.8e0 AS confidence FROM events)"""

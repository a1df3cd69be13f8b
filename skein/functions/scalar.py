"""Scalar expressions: keys, ids, labels."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Id prefixes of the entity types.
PREFIX_TYPE = {
    "person": "Person", "org": "Organization", "phone": "PhoneNumber", "vehicle": "Vehicle", "location": "Location", "account": "FinancialAccount",
    "transaction": "Transaction", "comm": "Communication", "case": "Case", "fir": "FIR", "event": "Event", "evidence": "Evidence",
}
#: Relationship types.
RELATIONSHIP_TYPES = ("KNOWS", "WORKS_FOR", "OWNS", "USED", "CALLED", "TRANSFERRED_TO", "LOCATED_AT", "TRAVELED_TO", "ASSOCIATED_WITH", "MENTIONED_IN", "RELATED_TO_CASE")
#: Legal suffixes, tried in this order.
LEGAL_SUFFIXES = (" pvt ltd", " private limited", " ltd", " limited", " llp", " inc", " corp", " associates")
#: What a person is shown for an entity type.
DISPLAY_TYPE = {
    "Person": "Person", "Organization": "Organization", "PhoneNumber": "Phone", "Vehicle": "Vehicle", "Location": "Location", "FinancialAccount": "Account",
    "Transaction": "Account", "Communication": "Phone", "Case": "Organization", "FIR": "Organization", "Event": "Location", "Evidence": "Organization",
}
#: Parameters that an audit record must not hold.
SECRET_KEYS = ("password", "passwd", "secret", "token", "connection_string", "database_url", "dsn")


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    """Value of a small fixed table."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def type_of_id(eid: Column, table: dict[str, str] | None = None, default: str = "Person") -> Column:
    return lookup(table or PREFIX_TYPE, F.split_part(eid, F.lit("-"), F.lit(1)), default)


def clean_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def person_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_ \\t\\r\\n]", " "), "[ \\t\\r\\n]+", " ")


def org_key(name: Column) -> Column:
    pattern = "(" + "|".join(LEGAL_SUFFIXES) + ")$"
    return F.trim(F.regexp_replace(person_key(name), pattern, ""))


def phone_key(number: Column) -> Column:
    return F.right(F.regexp_replace(number, "[^0-9]", ""), F.lit(10))


def plate_key(value: Column) -> Column:
    return F.upper(F.replace(F.trim(value), F.lit(" "), F.lit("")))


def short_hash(*parts: Column, digits: int = 12) -> Column:
    """First digits of the SHA-256 of parts joined by |; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, digits)


def severity(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def interpretation_confidence(observed: Column, interpreted: Column) -> Column:
    return F.when(observed == 0, 0.35).otherwise(F.round(F.least(F.lit(0.85), F.lit(0.5) + F.lit(0.05) * (observed + interpreted)), 4))


def words_in(csv: str) -> list[str]:
    """Parts of a comma-separated parameter, trimmed, without empties."""
    return [p for p in (x.strip() for x in csv.split(",")) if p]


def canonical_json(value: Column) -> Column:
    """A struct, map or array as JSON with keys sorted at every depth, written as json.dumps(..., sort_keys=True) writes it; nulls are kept. Structs are made by named_struct or are columns."""
    @F.pandas_udf("string")
    def written(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True), na_action="ignore")

    return written(F.to_json(value, {"ignoreNullFields": "false"}))


def evidence_chain_hash(evidence_id: Column, payload: Column, previous: Column) -> Column:
    """Hash of an evidence record over its id, its payload and the hash before it."""
    return F.sha2(canonical_json(F.named_struct(F.lit("evidence_id"), evidence_id, F.lit("payload"), payload, F.lit("previous_hash"), previous)), 256)

"""Fixed schemas of the canonical collections, and their empty tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_REST = "metadata map<string,string>, created_at timestamp"
#: Columns of each collection; the first column is its key.
COLLECTIONS = {
    "persons": f"person_id string, full_name string, date_of_birth date, nationality string, {_REST}",
    "organizations": f"org_id string, name string, org_type string, registration_number string, jurisdiction string, {_REST}",
    "phone_numbers": f"phone_id string, number string, phone_type string, carrier string, {_REST}",
    "vehicles": f"vehicle_id string, registration_number string, make string, model string, year int, color string, vin string, {_REST}",
    "locations": f"location_id string, latitude double, longitude double, description string, area_name string, {_REST}",
    "financial_accounts": f"account_id string, account_number string, account_type string, institution string, jurisdiction string, currency string, {_REST}",
    "transactions": f"transaction_id string, amount decimal(15,2), transaction_type string, currency string, from_account_id string, to_account_id string, timestamp timestamp, is_flagged_demo boolean, description string, {_REST}",
    "communications": f"comm_id string, medium string, direction string, from_entity_type string, from_entity_id string, to_entity_type string, to_entity_id string, from_phone_id string, to_phone_id string, timestamp timestamp, duration_seconds int, {_REST}",
    "cases": f"case_id string, case_number string, title string, description string, case_type string, status string, assigned_to string, opened_at timestamp, updated_at timestamp, {_REST}",
    "firs": f"fir_id string, fir_number string, case_id string, fir_type string, filed_at timestamp, filed_by string, jurisdiction string, {_REST}",
    "events": f"event_id string, name string, description string, event_type string, timestamp timestamp, location_id string, {_REST}",
    "evidence": f"evidence_id string, case_id string, description string, evidence_type string, source string, collected_at timestamp, collected_by string, chain_hash string, status string, {_REST}",
    "relationships": f"relationship_id string, source_id string, source_type string, target_id string, target_type string, relationship_type string, timestamp timestamp, confidence double, extraction_method string, {_REST}",
}


def key_of(collection: str) -> str:
    return COLLECTIONS[collection].split(" ", 1)[0]


def columns(collection: str) -> list[str]:
    """Names of a collection's columns; commas within a type's brackets part nothing."""
    return [part.split()[0] for part in re.sub(r"[<(][^<>()]*[>)]", "", COLLECTIONS[collection]).split(",")]


def empty(spark: SparkSession, collection: str) -> DataFrame:
    return spark.createDataFrame([], COLLECTIONS[collection])


def health(spark: SparkSession) -> DataFrame:
    """(collection, key, n_columns) of every collection that the session can create."""
    return spark.createDataFrame([(c, key_of(c), len(empty(spark, c).columns)) for c in COLLECTIONS], "collection string, key string, n_columns int")

"""Evaluation, grounding, validation, chains and explanations against SQL and small cases."""

import hashlib
import json

import pytest

from skein.operators import review
from skein.plans import review as plans
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_against_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert same(got, sql(plans.SQL[name])) and len(got)


def test_chain_is_that_of_canonical_json(spark):
    blocks = spark.createDataFrame([("a", 2, "e2", "O"), ("a", 1, "e1", "F"), ("b", 9, "e3", "P")], "log string, key long, evidence_hash string, status string")
    genesis = json.dumps({"index": 0, "timestamp": 1704067200.0, "evidence_hash": "", "previous_hash": "0", "data": {"message": "Genesis block"}}, sort_keys=True)
    want = {}
    for log, rows in (("a", [("e1", "F"), ("e2", "O")]), ("b", [("e3", "P")])):
        before = hashlib.sha256(genesis.encode()).hexdigest()
        for i, (e, s) in enumerate(rows, 1):
            before = hashlib.sha256(json.dumps({"index": i, "timestamp": 1704067200.0, "evidence_hash": e, "previous_hash": before, "data": {"status": s}}, sort_keys=True).encode()).hexdigest()
            want[log, i] = before
    chain = review.chain_logs(blocks)
    assert {(r["log"], r["index"]): r["hash"] for r in chain.collect()} == want
    assert all(r["hash_ok"] and r["link_ok"] for r in review.verify_logs(chain).collect())
    cut_ = review.verify_logs(chain.where("NOT (log = 'a' AND index = 1)")).collect()
    assert {(r["log"], r["index"]): r["link_ok"] for r in cut_} == {("a", 2): False, ("b", 1): True}


def test_no_case_and_no_times_support_everything(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    out = review.ground_analyses(one([("x", None, "5 entities at 2024-01-01T00:00:00Z")], "analysis_id string, case_id string, text string"), one([("x", "entity", "a")], "analysis_id string, kind string, reference string"), one([("a",)], "id string"), one([], "id string"), one([], "id string"), one([], "case_id string, id string"), one([], "iso string")).collect()[0]
    assert (out["numerical"], out["temporal"], out["case_membership"], out["unsupported_claims"], out["overall_status"]) == (1, 0, 0, 1, "NEEDS_REVIEW")


def test_case_edges_and_bounds(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    analyses, refs = one([("x", "c1", "")], "analysis_id string, case_id string, text string"), one([("x", "relationship", r) for r in ("rel-1", "rel-2", "rel-3")], "analysis_id string, kind string, reference string")
    known, none = one([("rel-1",), ("rel-2",)], "id string"), one([], "id string")
    rest = (none, known, none, one([], "case_id string, id string"), one([], "iso string"))
    found = lambda edges: review.ground_analyses(analyses, refs, *rest, edges).first()["case_membership"]
    assert found(None) == 1 and found(one([("c1", "rel-1"), ("c2", "rel-2")], "case_id string, id string")) == 2
    sizes = one([("a", 500, 200, 500_000, 100_000), ("b", 501, 201, 500_001, 100_001), ("c", None, None, None, None), ("d", 1, 1, 1, 0)], "key string, entities long, records long, chars long, text_chars long")
    assert {r["key"]: r["exceeded"] for r in review.provider_bounds(sizes).collect()} == {"a": "", "b": "entities,records,chars,text_chars", "c": "", "d": "blank text"}

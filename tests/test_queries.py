import pytest

from tests.conftest import SF, same

from skein.plans import catalogue

#: One of each family here; the driver runs them all.
SOME = "relationship_strength_top activity_bursts burst_evidence_interval induced_subgraph transfer_chains_top timed_chains timed_chains_top frequent_payments cue_relations_of_orders validate_relationships fk_integrity audit_page upsert_merge resolve_candidates grounding_check proximity_pairs precision_recall_f1 label_propagation".split()


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sql, name):
    assert same(catalogue.QUERIES[name](spark, SF).toPandas(), sql(catalogue.ORACLES[name]))


def test_oracles_belong_to_queries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())

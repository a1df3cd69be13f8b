"""Evaluation over scenarios, grounding of analyses, canonical validation, evidence chains by log, explanations by id."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import PREFIX_TYPE, RELATIONSHIP_TYPES, lookup, short_hash
from skein.operators.checks import errors

PREFIX_OF = {kind: prefix for prefix, kind in PREFIX_TYPE.items()}
#: Pattern of ids, time of a deterministic chain's blocks, its first block.
ID_PATTERN = "^[a-z]+-[0-9]{5}$"
BLOCK_TIME = "1704067200.0"
GENESIS = '{"data": {"message": "Genesis block"}, "evidence_hash": "", "index": 0, "previous_hash": "0", "timestamp": ' + BLOCK_TIME + "}"


# Evaluation

def scenario_counts(expected: DataFrame, predicted: DataFrame, scenario: str, keys: list[str]) -> DataFrame:
    """(scenario, tp, fp, fn) of the sets of composite keys of each scenario; repeats count once."""
    e = expected.select(scenario, *keys).distinct().withColumn("_e", F.lit(1))
    p = predicted.select(scenario, *keys).distinct().withColumn("_p", F.lit(1))
    both = e.join(p, [scenario, *keys], "full").groupBy(scenario)
    e_, p_ = F.col("_e").isNotNull(), F.col("_p").isNotNull()
    return both.agg(F.count_if(e_ & p_).alias("tp"), F.count_if(~e_ & p_).alias("fp"), F.count_if(e_ & ~p_).alias("fn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1; divisions by zero give 0."""
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(safe(2 * p * r, p + r), 4)})


def micro_average(counts: DataFrame, name: str) -> DataFrame:
    """One row: the scenarios' sums of tp, fp and fn, and the rates of these sums."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return with_rates(total).select(*[F.col(c).alias(f"{name}_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1")])


def groundedness(grounded: DataFrame) -> DataFrame:
    """One row: scenarios, those supported, their share, and the sum of unsupported claims."""
    ok = F.count_if(F.col("overall_status") == "SUPPORTED")
    return grounded.agg(F.count("*").alias("scenario_count"), ok.alias("grounded_scenarios"), F.round(ok / F.count("*"), 4).alias("groundedness_rate"), F.coalesce(F.sum("unsupported_claims"), F.lit(0)).alias("unsupported_claim_count"))


# Grounding

CHECKS = ("entities", "relationships", "evidence", "case_membership", "numerical", "temporal")


def ground_analyses(analyses: DataFrame, references: DataFrame, ents: DataFrame, rels: DataFrame, evidence: DataFrame, members: DataFrame, times: DataFrame, case_edges: DataFrame | None = None) -> DataFrame:
    """For each analysis (analysis_id, case_id, text): unsupported claims of each of six checks, their sum and the overall status.

    references: (analysis_id, kind, reference), kind one of entity, relationship, evidence.
    ents, rels and evidence hold the known ids in a column id; members (case_id, id) the
    entities of each case; times (iso) the times of relationships. case_edges (case_id, id):
    the relationships of each case, else any known one counts as its own. Without a case every
    reference is a member; numbers before "entities" must be the number of entities if there
    are any; without times no time is unsupported.
    """
    def unknown(kind: str, known: DataFrame, check: str) -> DataFrame:
        return references.where(F.col("kind") == kind).join(known.select(F.col("id").alias("reference")), "reference", "left_anti").select("analysis_id", F.lit(check).alias("check"))

    claims = references.where("kind <> 'evidence'").join(analyses.select("analysis_id", "case_id"), "analysis_id").where("case_id IS NOT NULL")
    is_edge = F.startswith("reference", F.lit("rel-"))
    outside = claims.where(~is_edge & (F.col("reference") != F.col("case_id"))).join(members.select("case_id", F.col("id").alias("reference")), ["case_id", "reference"], "left_anti")
    known, keys = (rels, ["reference"]) if case_edges is None else (case_edges, ["case_id", "reference"])
    lost = claims.where(is_edge).join(known.withColumnRenamed("id", "reference").select(*keys), keys, "left_anti")
    member = outside.select("analysis_id").unionByName(lost.select("analysis_id")).select("analysis_id", F.lit("case_membership").alias("check"))
    n = F.broadcast(ents.agg(F.count("*").alias("_n")))
    numbers = analyses.select("analysis_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)\\s+entities"), 1)).alias("said")).join(n, (F.col("_n") != 0) & (F.col("said").try_cast("long") != F.col("_n"))).select("analysis_id", F.lit("numerical").alias("check"))
    any_time = F.broadcast(times.agg((F.count("*") > 0).alias("_any")))
    said = analyses.select("analysis_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"), 0)).alias("iso"))
    temporal = said.join(times, "iso", "left_anti").join(any_time, F.col("_any")).select("analysis_id", F.lit("temporal").alias("check"))
    found = reduce(DataFrame.unionByName, [unknown("entity", ents, "entities"), unknown("relationship", rels, "relationships"), unknown("evidence", evidence, "evidence"), member, numbers, temporal])
    counts = found.groupBy("analysis_id").agg(*[F.count_if(F.col("check") == c).alias(c) for c in CHECKS], F.count("*").alias("unsupported_claims"))
    out = analyses.select("analysis_id").join(counts, "analysis_id", "left")
    out = out.select("analysis_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*CHECKS, "unsupported_claims")])
    return out.withColumn("overall_status", F.when(F.col("unsupported_claims") == 0, "SUPPORTED").otherwise("NEEDS_REVIEW"))


# Canonical validation

def _bad_prefix(kind: str, eid: str) -> Column:
    prefix = lookup(PREFIX_OF, F.col(kind), "")
    return (prefix != "") & ~F.coalesce(F.startswith(eid, F.concat(prefix, F.lit("-"))), F.lit(False))


def _no_time(c: str) -> Column:
    return F.try_to_timestamp(F.replace(F.col(c), F.lit("Z"), F.lit("+00:00"))).isNull()


def validate_entity_records(df: DataFrame, key: str) -> DataFrame:
    """(key, errors) of (text, entity_type, confidence, extraction_method, normalized_id, start, end): six checks."""
    nid = F.col("normalized_id")
    bad = nid.isNotNull() & _bad_prefix("entity_type", "normalized_id")
    return df.select(key, errors([
        (~F.col("entity_type").isin(*PREFIX_OF), "unknown type"), (~F.col("confidence").between(0.0, 1.0), "confidence out of range"), (F.coalesce("text", F.lit("")) == "", "no text"),
        (F.coalesce("extraction_method", F.lit("")) == "", "no method"), (bad, "id of another type"), (nid.isNotNull() & ~bad & ~nid.rlike(ID_PATTERN), "malformed id"), (F.col("end") <= F.col("start"), "end not after start"),
    ]).alias("errors"))


def validate_relationship_records(df: DataFrame, key: str = "relationship_id") -> DataFrame:
    """(key, errors) of canonical relationships: types, confidence, id, provenance, times, self-loops, prefixes."""
    return df.select(key, errors([
        (~F.col("source_type").isin(*PREFIX_OF), "unknown source type"), (~F.col("target_type").isin(*PREFIX_OF), "unknown target type"), (~F.col("relationship_type").isin(*RELATIONSHIP_TYPES), "unknown type"),
        (~F.col("confidence").between(0.0, 1.0), "confidence out of range"), (~F.coalesce(F.col("relationship_id").rlike("^rel-[0-9]{5}$"), F.lit(False)), "malformed id"), (F.coalesce("extraction_method", F.lit("")) == "", "no method"),
        (F.coalesce("created_at", F.lit("")) == "", "no creation time"), ((F.col("created_at") != "") & _no_time("created_at"), "creation time not ISO"), (F.col("timestamp").isNotNull() & _no_time("timestamp"), "time not ISO"),
        ((F.col("source_id") == F.col("target_id")) & (F.col("source_type") == F.col("target_type")), "self-loop"), (_bad_prefix("source_type", "source_id"), "source of another type"), (_bad_prefix("target_type", "target_id"), "target of another type"),
    ]).alias("errors"))


def validate_document_relations(df: DataFrame) -> DataFrame:
    """(doc_id, relationship_id, errors) of a document's relations: confidence, self-loop, persons only KNOWS, ids met twice, ends without an id."""
    twice = df.groupBy("doc_id", "relationship_id").agg(F.count("*").alias("_n"))
    persons = (F.col("source_type") == "Person") & (F.col("target_type") == "Person")
    return df.join(twice, ["doc_id", "relationship_id"]).select("doc_id", "relationship_id", errors([
        (~F.col("confidence").between(0.0, 1.0), "confidence out of range"), (F.col("source_id") == F.col("target_id"), "self-loop"), (persons & (F.col("relationship_type") != "KNOWS"), "persons only know"),
        (F.col("_n") > 1, "repeated id"), (F.col("source_id").isNull() | F.col("target_id").isNull(), "unresolved end"),
    ]).alias("errors"))


# Evidence chains

def block_json(index: str, evidence_hash: str, previous: str, status: str) -> str:
    """A block as JSON with sorted keys; status must need no escapes."""
    return '{"data": {"status": "' + status + '"}, "evidence_hash": "' + evidence_hash + f'", "index": {index}, "previous_hash": "' + previous + f'", "timestamp": {BLOCK_TIME}' + "}"


def chain_logs(blocks: DataFrame) -> DataFrame:
    """(log, key, evidence_hash, status) with index, previous_hash and hash: one chain a log, from a genesis block on, by key.

    Logs are dealt over the partitions and sorted there; a task passes over its rows batch
    by batch and remembers the last hash alone, so a long log takes no memory. A log's
    blocks depend on each other, so one log is one task's.
    """
    first = hashlib.sha256(GENESIS.encode()).hexdigest()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, index, before = None, 0, first
        for part in parts:
            at, previous, own = [], [], []
            for name, evidence, status in zip(part["log"], part["evidence_hash"], part["status"]):
                if name != log:
                    log, index, before = name, 0, first
                index += 1
                at.append(index)
                previous.append(before)
                before = hashlib.sha256(block_json(str(index), evidence, before, status).encode()).hexdigest()
                own.append(before)
            yield part.assign(index=at, previous_hash=previous, hash=own)

    rows = blocks.select("log", F.col("key").cast("long").alias("key"), "evidence_hash", "status")
    return rows.repartition("log").sortWithinPartitions("log", "key").mapInPandas(run, "log string, key long, evidence_hash string, status string, index long, previous_hash string, hash string")


def verify_logs(chain: DataFrame) -> DataFrame:
    """chain with hash_ok and link_ok: each block against its own content and the block before it in its log, found by a join on the index."""
    parts = block_json("%s", "%s", "%s", "%s").split("%s")
    text = F.concat(F.lit(parts[0]), "status", F.lit(parts[1]), "evidence_hash", F.lit(parts[2]), F.col("index").cast("string"), F.lit(parts[3]), "previous_hash", F.lit(parts[4]))
    before = chain.select("log", (F.col("index") + 1).alias("index"), F.col("hash").alias("_before"))
    first = hashlib.sha256(GENESIS.encode()).hexdigest()
    joined = chain.join(before, ["log", "index"], "left")
    expected = F.when(F.col("index") == 1, F.lit(first)).otherwise(F.col("_before"))
    return joined.withColumns({"hash_ok": F.col("hash") == F.sha2(text, 256), "link_ok": F.coalesce(F.col("previous_hash") == expected, F.lit(False))}).drop("_before")


#: The most entities, records and characters that a provider is given, and the longest text.
MAX_ENTITIES, MAX_RECORDS, MAX_CHARS, MAX_TEXT = 500, 200, 500_000, 100_000


def provider_bounds(sizes: DataFrame) -> DataFrame:
    """sizes (any key columns, entities, records, chars, text_chars) with the bounds they exceed, joined by commas, and ok; a null size counts as 0, a blank text (0) is out of bounds, a null one is not given."""
    over = [("entities", MAX_ENTITIES), ("records", MAX_RECORDS), ("chars", MAX_CHARS), ("text_chars", MAX_TEXT)]
    said = [F.when(F.coalesce(c, F.lit(0)) > most, F.lit(c)) for c, most in over] + [F.when(F.col("text_chars") == 0, F.lit("blank text"))]
    bad = F.array_join(F.array_compact(F.array(*said)), ",")
    return sizes.withColumns({"exceeded": bad, "ok": bad == ""})


# Explanations

def explanations(found: DataFrame, kind: str, key: str, summary: Column, entities: Column, evidence: Column, method: str, parameters: str, asked: DataFrame) -> DataFrame:
    """One record for each asked id (a column `id`): what was found under it, how, from which entities and edges; unknown ids say so."""
    rows = found.select(F.col(key).alias("id"), summary.alias("summary"), entities.alias("contributing_entities"), evidence.alias("supporting_evidence"))
    out = asked.select("id").distinct().join(rows, "id", "left")
    return out.select(
        F.concat(F.lit(f"expl-{kind}-"), "id", F.lit("-"), short_hash(F.col("id"))).alias("explanation_id"), "id", F.lit(kind).alias("analysis_type"),
        F.coalesce("summary", F.concat(F.lit(f"{kind} "), "id", F.lit(" not found"))).alias("summary"), F.lit(method).alias("methodology"), F.lit(parameters).alias("parameters"),
        F.coalesce("contributing_entities", F.lit("")).alias("contributing_entities"), F.coalesce("supporting_evidence", F.lit("")).alias("supporting_evidence"),
    )


def endpoints(asked: DataFrame, ents: DataFrame) -> DataFrame:
    """(source, target, status) of asked paths: ok, or which end is unknown."""
    known = lambda c: ents.select(F.col("entity_id").alias(f"_{c}"))
    j = asked.join(known("source"), F.col("source") == F.col("_source"), "left").join(known("target"), F.col("target") == F.col("_target"), "left")
    status = F.when(F.col("_source").isNull(), "unknown source").when(F.col("_target").isNull(), "unknown target").otherwise("ok")
    return j.select("source", "target", status.alias("status"))


def map_relations(relations: DataFrame, mentions: DataFrame, review: float = 0.70) -> DataFrame:
    """Relations (doc_id, source_text, target_text, relationship_type, confidence) by the first mention of each surface in the
    document (mentions: doc_id, position, text); relations with an unmapped end or one end twice are dropped."""
    first = mentions.groupBy("doc_id", F.lower("text").alias("_text")).agg(F.min("position").alias("_at"))
    s, t = (first.select(F.col("doc_id"), F.col("_text").alias(f"_{c}"), F.col("_at").alias(f"{c}_index")) for c in ("source", "target"))
    j = relations.withColumns({"_source": F.lower("source_text"), "_target": F.lower("target_text")}).join(s, ["doc_id", "_source"]).join(t, ["doc_id", "_target"])
    return j.where("source_index <> target_index").select("doc_id", "relationship_type", "source_index", "target_index", "confidence", (F.col("confidence") < review).alias("needs_review"))

"""Neutral interpretations of a scope's measured signals, of eleven kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import short_hash
from skein.operators.derived import neutral

#: The kinds of analysis, and how sure an interpretation is by what it says.
KINDS = ("network_summary", "centrality", "community", "bridge", "temporal", "transaction_chain", "indicator", "finding", "investigation_brief", "entity_brief", "network_brief")
FLOOR, STEP, CEILING, NOTHING = 0.50, 0.05, 0.85, 0.35
#: A signal's column, what was measured, and what it may be read as.
SIGNALS = (
    ("bridges", "%d entities join parts of the network.", "Such entities matter by their place in the network alone."),
    ("communities", "%d groups interact more with each other than with others.", "A group shows interaction, not joint intent."),
    ("bursts", "%d windows exceed their entity's own baseline.", "A burst is a deviation from a baseline and says nothing by itself."),
    ("chains", "%d sequences of transfers follow each other.", "A sequence of transfers is an order of events and says nothing by itself."),
    ("indicators", "%d indicators are rated.", None),
)
CENTRAL = "Central entities hold a position in the structure, not a responsibility."
WHOLE = "%d entities and %d relationships are in the scope %s."
EMPTY, PLAIN = "The scope holds no signal, and none is assumed.", "Only the given measures are read."
BRIEFS = {
    "investigation_brief": "A person should check entities, relationships and the order of events before any step.",
    "entity_brief": "The brief on %s rests on the measures around it.",
    "network_brief": "The brief rests on the given scope alone.",
}


def interpretations(counts: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each scope and kind: id, summary, what was observed, how it may be read, confidence.

    counts: scope, case_id and root (null where it has none), entities, relationships,
    central (whether centralities are there), first_ids (its smallest ids, joined by commas)
    and the columns of SIGNALS. A signal that is null or 0 is not spoken of; a scope without
    entities says that it holds no signal and gets the lowest confidence. A kind that is not
    known is an error, a forbidden wording too.
    """
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of analysis: {sorted(unknown)}")
    has = {c: F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("entities", *(s[0] for s in SIGNALS))}
    where = F.coalesce("case_id", F.lit("global"))
    seen = F.array_compact(F.array(F.when(has["entities"], F.format_string(WHOLE, F.col("entities"), F.coalesce("relationships", F.lit(0)), where)), *[F.when(has[c], F.format_string(text, F.col(c))) for c, text, _ in SIGNALS]))
    read = F.array_compact(F.array(F.when(F.coalesce("central", F.lit(False)), CENTRAL), *[F.when(has[c], note) for c, _, note in SIGNALS if note]))
    rows = counts.withColumns({"observations": F.when(F.size(seen) > 0, seen).otherwise(F.array(F.lit(EMPTY))), "notes": F.when(F.size(read) > 0, read).otherwise(F.array(F.lit(PLAIN)))})
    rows = rows.withColumn("analysis_type", F.explode(F.array(*[F.lit(k) for k in kinds])))
    subject = F.coalesce(F.col("root"), F.when(F.col("first_ids") != "", F.substring_index("first_ids", ",", 1)), F.lit("an unknown entity"))
    brief = F.when(F.col("analysis_type") == "entity_brief", F.format_string(BRIEFS["entity_brief"], subject))
    for k in ("investigation_brief", "network_brief"):
        brief = brief.when(F.col("analysis_type") == k, BRIEFS[k])
    rows = rows.withColumn("notes", F.array_compact(F.concat("notes", F.array(brief))))
    sure = F.when(has["entities"], F.least(F.lit(CEILING), F.lit(FLOOR) + F.lit(STEP) * (F.size("observations") + F.size("notes")))).otherwise(F.lit(NOTHING))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = rows.select(
        "scope", "analysis_type", F.concat(F.lit("ai-"), short_hash(F.col("analysis_type"), text("case_id"), text("root"), text("entities"), text("relationships"), text("first_ids"))).alias("analysis_id"),
        F.concat(F.col("analysis_type"), F.lit(": "), F.col("observations")[0]).alias("summary"), F.array_join("observations", " ").alias("observations"), F.array_join("notes", " ").alias("notes"), F.round(sure, 2).alias("confidence"), F.coalesce("first_ids", F.lit("")).alias("supporting_entities"),
    )
    return neutral(neutral(out, "observations"), "notes")

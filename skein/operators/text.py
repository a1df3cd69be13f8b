"""From text to a graph: pattern mentions, key resolution, cue relations, pipeline gate."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import short_hash


@dataclass(frozen=True)
class Rule:
    """A pattern for one entity type with its declared prior; earlier rules claim text first.

    hint: a pattern that each text with a match holds too and that is quicker to look for; texts without it are not searched."""

    name: str
    pattern: str
    entity_type: str
    prior: float
    hint: str = ""


#: Extraction rules in order of priority.
RULES = (
    Rule("phone_fictional", r"\+91-(?:9[0-4])-\d{7}", "PhoneNumber", 0.95, r"\+91-9"),
    Rule("phone_e164", r"\+\d{1,3}[-\s]?\d{7,10}\b", "PhoneNumber", 0.85, r"\+\d"),
    Rule("vehicle_registration", r"\b[A-Z]{2}-FIC\d{2}-[A-Z]{1,3}\d{3,4}\b|\b[A-Z]{2}[-\s]\d{1,2}[-\s][A-Z]{1,3}[-\s]\d{3,4}\b", "Vehicle", 0.90, r"[A-Z][A-Z][-\s](?:FIC)?\d"),
    Rule("account_number", r"\bFICA\d{8,9}\b", "FinancialAccount", 0.95, "FICA"),
    Rule("case_number", r"\bSYN-CASE-\d{4}-\d{3}\b", "Case", 0.95, "SYN-CASE-"),
    Rule("fir_number", r"\bSYN-FIR-\d{4}-\d{4}\b", "FIR", 0.95, "SYN-FIR-"),
    Rule("org_suffix", r"\b([A-Z][\w&]*\s+){1,3}(?:Traders|Logistics|Enterprises|Services|Solutions|Industries|Associates|Imports\s*&\s*Exports)\s+(?:Pvt Ltd|LLP|Ltd|Inc|Corp)?\b", "Organization", 0.80, "Traders|Logistics|Enterprises|Services|Solutions|Industries|Associates|Imports"),
    Rule("person_titlecase", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", "Person", 0.40, r"[A-Z][a-z]+\s+[A-Z][a-z]"),
    Rule("location_titlecase", r"\b(?:Sector|Ring Road|Old Fort Road|Lake View Colony|Station Square|Mill Lane|Garden Chowk|Riverside Depot|Tech Park Gate|Hillview Apartments)\b(?:\s+(?:\d+|[A-Z][a-z]+))*", "Location", 0.30, "Sector|Ring Road|Old Fort Road|Lake View Colony|Station Square|Mill Lane|Garden Chowk|Riverside Depot|Tech Park Gate|Hillview Apartments"),
)
#: Cues between two mentions: types, pattern, relationship, prior, whether the pair is of one type and so ordered.
CUES = (
    ("Person", "Organization", r"(?i)\b(?:works?\s+(?:for|at|with)|employed\s+(?:by|at)|employee\s+of)\b", "WORKS_FOR", 0.80),
    ("Person", "Person", r"(?i)\b(?:called|phoned|rang|contacted\s+by\s+phone)\b", "CALLED", 0.75),
    ("Person", "Person", r"(?i)\b(?:knows|know|knew|knowing|acquainted with|met|introduced to)\b", "KNOWS", 0.55),
    ("Person", "Location", r"(?i)\b(?:traveled|travelled|went|drove|flew)\s+to\b", "TRAVELED_TO", 0.75),
    ("Person", "Location", r"(?i)\b(?:located at|located in|resides at|stayed at|present at|observed at)\b", "LOCATED_AT", 0.65),
    ("Person", "Vehicle", r"(?i)\b(?:owns|owned\s+by|owner\s+of|registered\s+to)\b", "OWNS", 0.80),
    ("Person", "Vehicle", r"(?i)\b(?:used|using|utilized|driven|drove|operated|operating)\b", "USED", 0.68),
    ("Person", "Organization", r"(?i)\b(?:associated\s+with|affiliated\s+with|linked\s+to|member\s+of)\b", "ASSOCIATED_WITH", 0.70),
    ("FinancialAccount", "FinancialAccount", r"(?i)\b(?:transferred|transfer|sent|paying|paid)\b", "TRANSFERRED_TO", 0.78),
)
NEEDS_IDS = ("LOCATED_AT", "USED", "TRANSFERRED_TO")
MENTIONS = "doc_id long, mention_no int, text string, entity_type string, start int, end int, normalized string, confidence double, method string"
#: The cues as Spark's rlike reads them: any letter is part of a word; white space and case are those of ASCII. Those of one rule never overlap.
CUE_PATTERNS = tuple(re.compile(rf"\b(?ai:{c[2].removeprefix('(?i)').removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')})\b") for c in CUES)


def mentions_of(text: str, rules: list[tuple[re.Pattern, Rule]]) -> list[tuple[str, str, int, int, str, float, str]]:
    """Mentions of one text; a match that overlaps one of an earlier rule is dropped."""
    starts: list[int] = []  # of the spans taken, in order; they do not overlap
    ends: list[int] = []
    out = []
    for pattern, rule in rules:
        if rule.hint and not re.search(rule.hint, text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            at = bisect_left(starts, a)
            if not m[0].strip() or (at and ends[at - 1] > a) or (at < len(starts) and starts[at] < b):
                continue
            starts.insert(at, a)
            ends.insert(at, b)
            value = re.sub(r"\s+", " ", m[0].strip())
            out.append((m[0], rule.entity_type, a, b, value.replace(" ", "") if rule.entity_type == "Vehicle" else value, rule.prior, f"pattern:{rule.name}"))
    return sorted(out, key=lambda x: (x[2], -x[3]))


def reach_of(text: str, spans: list[tuple[str, int, int]]) -> list[list[int] | None]:
    """For each span (type, start, end): the end of the first cue of each rule of CUES that begins where the span ends or later, -1 where
    there is none; None for spans without any. Only text between spans of a rule's types is searched, once a rule."""
    out: list[list[int] | None] = [None] * len(spans)
    kinds = [k for k, _, _ in spans]
    for n, ((source, target, *_), pattern) in enumerate(zip(CUES, CUE_PATTERNS)):
        if kinds.count(source) < 1 + (source == target) or target not in kinds:
            continue
        own = [i for i, k in enumerate(kinds) if k in (source, target)]
        low, high = min(spans[i][2] for i in own), max(spans[i][1] for i in own)
        cues = [m.span() for m in pattern.finditer(text, low, high)]
        starts = [a for a, _ in cues]
        for i in own:
            end = spans[i][2]
            # a span may end inside a word; what is left of that word counts as one
            cut = pattern.match(text[end:high]) if end < high and re.match(r"\w\w", text[end - 1 : end + 1]) else None
            at = bisect_left(starts, end)
            to = end + cut.end() if cut else cues[at][1] if at < len(cues) else -1
            if to >= 0:
                out[i] = out[i] or [-1] * len(CUES)
                out[i][n] = to
    return out


def extract_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, reach: bool = False) -> DataFrame:
    """Mentions of each document with code point offsets, batch by batch; null texts have none. reach: with reach_of() as a column, from the same pass."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(re.compile(r.pattern), r) for r in rules]
        names = [f.split()[0] for f in schema.split(", ")]
        for part in parts:
            rows = []
            for i, t in zip(part["doc_id"], part["text"]):
                found = mentions_of(t, compiled)
                ends = [(r,) for r in reach_of(t, [(m[1], m[2], m[3]) for m in found])] if reach else [()] * len(found)
                rows += [(i, n, *m, *e) for n, (m, e) in enumerate(zip(found, ends))]
            yield pd.DataFrame(rows, columns=names)

    schema = MENTIONS + ", reach array<int>" if reach else MENTIONS
    two = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInPandas(run, schema)


def supported_types(rules: tuple[Rule, ...] = RULES) -> set[str]:
    return {r.entity_type for r in rules}


def resolve(mentions: DataFrame, keys: DataFrame, exact: list[str]) -> DataFrame:
    """Candidates of (mention_id, entity_type, key) among (entity_id, entity_type, key).

    Exact types have confidence 1.0 and are linked when one entity matches; names have 0.6
    and always wait for review.
    """
    hits = mentions.join(keys, ["entity_type", "key"])
    n = hits.groupBy("mention_id").agg(F.countDistinct("entity_id").alias("candidates"))
    sure = F.col("entity_type").isin(exact)
    status = F.when(sure & (F.col("candidates") == 1), "auto_linked").otherwise("needs_review")
    return hits.join(n, "mention_id").select("mention_id", "entity_id", "entity_type", F.when(sure, 1.0).otherwise(0.6).alias("confidence"), "candidates", status.alias("status"))


def attached(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mentions with the id of their only auto-linked candidate."""
    one = candidates.where("status = 'auto_linked'").select("mention_id", F.col("entity_id").alias("linked_id"))
    return mentions.join(one, "mention_id", "left")


def reached(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions of documents that have several, with reach_of() as a column, for mentions that come without it."""
    span = F.struct("entity_type", "start", "end")
    spans = mentions.groupBy("doc_id").agg(F.collect_list(F.struct(span.alias("span"), F.struct(*mentions.columns).alias("m"))).alias("each")).where(F.size("each") > 1)
    reach = F.udf(lambda t, each: reach_of(t, [tuple(e) for e in each]), "array<array<int>>")
    both = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(spans, "doc_id").select(F.explode(F.arrays_zip(F.col("each.m").alias("m"), reach("text", "each.span").alias("reach"))).alias("r"))
    return both.select("r.m.*", "r.reach")


def cue_relations(docs: DataFrame, mentions: DataFrame, known: Column | None = None) -> DataFrame:
    """Relations between two mentions of a document with a cue in the text between them.

    Mentions carry the end of the next cue of each rule (reach, from extract_mentions(); where it is missing it is taken
    from the texts). A later mention pairs with those whose next cue ends before it, so numbers meet and no text is copied to
    pairs. Pairs of one type are taken in text order. Documents without any cue have no reach and no pairs.
    """
    spark = mentions.sparkSession
    mentions = mentions if "reach" in mentions.columns else reached(docs, mentions)
    sides = [(n, a, b, a == s, k, p) for n, (s, t, _, k, p) in enumerate(CUES) for a, b in dict.fromkeys(((s, t), (t, s)))]
    rules = spark.createDataFrame(sides, "rule int, entity_type string, later_type string, in_order boolean, relationship_type string, prior double")
    m = mentions.withColumn("linked", known if known is not None else F.lit(False))
    one = F.struct(F.col("entity_type").alias("type"), "text", "start", "linked")
    first = m.where("reach IS NOT NULL").select("doc_id", "entity_type", one.alias("first"), F.posexplode("reach").alias("rule", "cue_end")).where("cue_end >= 0").join(F.broadcast(rules), ["rule", "entity_type"])
    later = m.select("doc_id", F.col("entity_type").alias("later_type"), F.col("start").alias("_at"), one.alias("later"))
    pairs = first.join(later, ["doc_id", "later_type"]).where(F.col("_at") >= F.col("cue_end"))
    pairs = pairs.where(~F.col("relationship_type").isin(*NEEDS_IDS) | (F.col("first.linked") & F.col("later.linked")))
    p, q = F.when(F.col("in_order"), F.col("first")).otherwise(F.col("later")), F.when(F.col("in_order"), F.col("later")).otherwise(F.col("first"))
    named = pairs.select("doc_id", p.alias("p"), q.alias("q"), "relationship_type", F.col("prior").alias("confidence"))
    return named.select("doc_id", F.concat(F.lit("rel-"), short_hash(F.col("doc_id"), F.col("p.start"), F.col("q.start"), F.col("relationship_type"))).alias("relationship_id"), F.col("p.type").alias("source_type"), F.col("p.text").alias("source_text"), F.col("q.type").alias("target_type"), F.col("q.text").alias("target_text"), "relationship_type", "confidence")


#: Documents whose mentions and cues one task sorts.
DOCS_A_TASK = 50_000


def cues_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, start, end): every cue of CUES in each text, found in one pass over it; null texts have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(c[2]) for c in CUES]
        for part in parts:
            rows = [(i, n, *m.span()) for i, t in zip(part["doc_id"], part["text"]) for n, pattern in enumerate(compiled) for m in pattern.finditer(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "rule", "start", "end"])

    two = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInPandas(run, "doc_id long, rule int, start int, end int")


def nearest_cue_relations(cues: DataFrame, mentions: DataFrame, known: Column | None = None, docs: int | None = None) -> DataFrame:
    """Relations between the last mention before a cue and the first one after it, of the types that the cue's rule names.

    Mentions and cues of a document stand in one sorted sequence, along which the nearest
    mention of each type is carried forward and backward, so the work is linear in them;
    cue_relations() gives all pairs around a cue instead. Two types may stand in either
    order, one type is taken in text order. A mention that overlaps the cue does not count.
    Several cues between the same two mentions give one relation. docs: the number of
    documents; a task then sorts those of about DOCS_A_TASK, however many there are.
    """
    types = sorted({t for c in CUES for t in c[:2]})
    m = mentions.where(F.col("entity_type").isin(types)).select("doc_id", "start", "end", "entity_type", "text", (known if known is not None else F.lit(False)).alias("linked"), F.lit(None).cast("int").alias("rule"))
    line = m.unionByName(cues.select("doc_id", "start", "end", F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("linked"), "rule"))
    line = line if docs is None else line.repartition(1 + docs // DOCS_A_TASK, "doc_id")
    one = F.struct("start", "end", "text", "linked")
    order = ["start", "end", F.col("rule").asc_nulls_first()]
    ahead = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("doc_id").orderBy(F.desc("start"), F.desc("end"), F.col("rule").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    near = {f"{side}_{i}": F.last(F.when(F.col("entity_type") == t, one), ignorenulls=True).over(w) for side, w in (("b", ahead), ("a", back)) for i, t in enumerate(types)}
    at = line.select("*", *[c.alias(n) for n, c in near.items()]).where("rule IS NOT NULL")
    found = []
    for n, (s, t, _, kind, prior) in enumerate(CUES):
        i, j = types.index(s), types.index(t)
        for source, target in [(f"b_{i}", f"a_{j}")] + ([(f"a_{i}", f"b_{j}")] if s != t else []):
            first, last = (source, target) if source[0] == "b" else (target, source)
            ok = (F.col("rule") == n) & (F.col(f"{first}.end") <= F.col("start")) & (F.col(f"{last}.start") >= F.col("end"))
            if kind in NEEDS_IDS:
                ok = ok & F.col(f"{source}.linked") & F.col(f"{target}.linked")
            found.append(F.when(ok, F.struct(F.lit(s).alias("source_type"), F.col(source).alias("s"), F.lit(t).alias("target_type"), F.col(target).alias("t"), F.lit(kind).alias("relationship_type"), F.lit(prior).alias("confidence"))))
    each = at.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).select("doc_id", "r.*")
    named = each.select("doc_id", F.concat(F.lit("rel-"), short_hash(F.col("doc_id"), F.col("s.start"), F.col("t.start"), F.col("relationship_type"))).alias("relationship_id"), "source_type", F.col("s.text").alias("source_text"), "target_type", F.col("t.text").alias("target_text"), "relationship_type", "confidence")
    return named.dropDuplicates(["doc_id", "relationship_id"])


def review_flags(mentions: DataFrame, bound: float = 0.6) -> DataFrame:
    return mentions.withColumn("needs_review", F.coalesce(F.col("confidence") < bound, F.lit(True)))


def structured_transfers(records: DataFrame) -> DataFrame:
    """TRANSFERRED_TO with confidence 1 for records with two different accounts."""
    ok = "from_account IS NOT NULL AND from_account <> '' AND to_account IS NOT NULL AND to_account <> '' AND from_account <> to_account"
    return records.where(ok).select("relationship_id", F.col("from_account").alias("source_id"), F.col("to_account").alias("target_id"), F.lit("TRANSFERRED_TO").alias("relationship_type"), F.lit(1.0).alias("confidence"))


def cooccurring(mentions: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Neighbouring mentions of a group, each with the next one."""
    w = Window.partitionBy(group).orderBy(order, key)
    return mentions.select(group, F.col(key).alias("first"), F.lead(key).over(w).alias("second"), (F.lead(order).over(w) - F.col(order)).alias("gap")).where("second IS NOT NULL")


def near_pairs(left: DataFrame, right: DataFrame, group: str, at: str, width: int) -> DataFrame:
    """(group, l, r): rows of one group whose places differ by less than width: an equi-join on cells, not on the whole group."""
    cell = F.expr(f"{at} div {width}")
    a = left.select(group, F.col("id").alias("l"), F.col(at).alias("_x"), cell.alias("_cell"))
    b = right.select(group, F.col("id").alias("r"), F.col(at).alias("_y"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    return a.join(b, [group, "_cell"]).where(F.abs(F.col("_x") - F.col("_y")) < width).select(group, "l", "r")


def gate(docs: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, n_mentions, n_relations, errors, accepted): a document is accepted whole or not at all."""
    m = mentions.groupBy("doc_id").agg(F.count("*").alias("n_mentions"), F.max(F.expr("confidence < 0 OR confidence > 1 OR end <= start")).alias("_out"))
    r = relations.groupBy("doc_id").agg(F.count("*").alias("n_relations"), F.max(F.expr("source_type = 'Person' AND target_type = 'Person' AND relationship_type <> 'KNOWS'")).alias("_people"))
    errors = F.concat_ws("; ", F.when(F.col("_out"), "mention out of range"), F.when(F.col("_people"), "person-person must be KNOWS"))
    out = docs.select("doc_id").join(m, "doc_id", "left").join(r, "doc_id", "left").withColumn("errors", errors)
    return out.select("doc_id", F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"), "errors", (F.col("errors") == "").alias("accepted"))

"""From mentions to checked rulings: candidates, windows, answers applied, verdicts, ledgers, relinking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stareflow.functions import citations as cit
from stareflow.functions import text as tx

# A mention's least confidence, answers' confidences, window sizes, chunk size, unresolved names.
LINK_CONFIDENCE = 0.8
CONFIDENCE = {"high": 0.8, "medium": 0.6, "low": 0.4}
BEFORE, AFTER, CHUNK = 900, 150, 25
UNKNOWN, NOT_CITATION = "unknown", "not_a_citation"
CONSTITUTION = "constitution"


def only(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """df where a column is one of the values; all of df where none are given."""
    return df if values is None else df.where(F.col(column).isin(values))


def candidates(judgments: DataFrame, mentions: DataFrame, ids: list | None = None) -> DataFrame:
    """Judgments(judgment_id, text) that may hold a ruling: a trigger phrase, and a surely linked mention(judgment_id,
    provision_id, act_slug, confidence) of a law that is not the Constitution; with how many provisions."""
    sure = mentions.where((F.col("confidence") >= LINK_CONFIDENCE) & F.col("provision_id").isNotNull() & (F.col("act_slug") != CONSTITUTION))
    held = sure.groupBy("judgment_id").agg(F.count_distinct("provision_id").alias("held"))
    return only(judgments, "judgment_id", ids).where(F.col("text").rlike(tx.TRIGGER)).join(held, "judgment_id").select("judgment_id", "held")


def in_trigger_order(found: DataFrame) -> DataFrame:
    """candidates() with their place: those of most provisions first."""
    return found.orderBy(F.desc("held"), "judgment_id")


def named_laws(mentions: DataFrame) -> DataFrame:
    """(judgment_id, laws): the laws that a judgment names and that need no answer, and both Constitutions."""
    asked = F.col("act_ref").isNull() | F.col("act_ref").isin("the Act", "the Code") | (F.col("method") == "llm")
    both = F.array(F.lit(cit.TITLES["constitution"]), F.lit(cit.REPEALED_CONSTITUTION))
    laws = F.collect_set(F.when(~asked, F.col("act_ref")))  # the law names of one judgment
    return mentions.groupBy("judgment_id").agg(F.array_sort(F.array_union(laws, both)).alias("laws"))


def windows(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """(judgment_id, chunk, char_start, char_end, window) of mentions still asked about: the text around each place,
    CHUNK places to a question in their order."""
    spans = mentions.where(F.col("act_ref").isNull() | F.col("act_ref").isin("the Act", "the Code")).select("judgment_id", "char_start", "char_end").distinct()
    place = Window.partitionBy("judgment_id").orderBy("char_start", "char_end")
    spans = spans.withColumn("chunk", F.floor((F.row_number().over(place) - 1) / CHUNK).cast("int")).join(texts, "judgment_id")
    start = F.greatest(F.col("char_start") - BEFORE, F.lit(0))
    return spans.select("judgment_id", "chunk", "char_start", "char_end", F.substr("text", start + 1, F.col("char_end") + AFTER - start).alias("window"))


def _loose(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), "^the ", ""), r"[,\s]+\d{4}$", "")


def allowed_law(law: Column, laws: Column) -> Column:
    """The one of the laws that an answer means: written the same, or alike to just one of them; else null."""
    options = F.concat(laws, F.array(F.lit(UNKNOWN), F.lit(NOT_CITATION)))
    alike = F.filter(options, lambda o: _loose(o) == _loose(law))
    return F.when(F.array_contains(options, law), law).when(F.size(alike) == 1, F.get(alike, F.lit(0)))


def apply_answers(mentions: DataFrame, answers: DataFrame, provisions: DataFrame) -> DataFrame:
    """mentions(mention_id, judgment_id, char_start, char_end, section_ref, act_ref, decision_date, method) with answers(
    judgment_id, char_start, char_end, law, level) applied to those still unresolved: act_ref, act_slug, provision_id,
    confidence and method of a law; unknown and not_a_citation change nothing. outcome tells which."""
    a = answers.groupBy("judgment_id", "char_start", "char_end").agg(F.min(F.struct("law", "level")).alias("a"))
    m = mentions.join(a, ["judgment_id", "char_start", "char_end"], "left")
    open_ = F.col("act_ref").isNull() | F.col("act_ref").isin("the Act", "the Code")
    law = F.when(open_, F.col("a.law"))
    outcome = F.when(law.isNull(), "kept").when(law.isin(UNKNOWN, NOT_CITATION), law).otherwise("applied")
    m = m.withColumns({"outcome": outcome, "_slug": F.when(outcome == "applied", cit.law_slug(law))})
    level = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        level = F.when(F.col("a.level") == name, value).otherwise(level)
    put = F.col("outcome") == "applied"
    m = m.withColumns({"act_ref": F.when(put, F.coalesce(cit.law_title(F.col("_slug")), law)).otherwise(F.col("act_ref")), "act_slug": F.when(put, F.col("_slug")), "confidence": F.when(put, level), "method": F.when(put, "llm").otherwise(F.col("method"))})
    return cit.linked(m.drop("a", "_slug"), provisions)


def relinked(mentions: DataFrame, provisions: DataFrame) -> DataFrame:
    """(mention_id, act_ref, provision_id) of stored mentions without a link whose named law is held by now."""
    rest = mentions.where("provision_id IS NULL AND act_ref IS NOT NULL").drop("provision_id").withColumn("act_slug", cit.law_slug(F.col("act_ref")))
    out = cit.linked(rest.where(F.col("act_slug").isNotNull() & F.col("section_ref").rlike(r"^\d")), provisions)
    return out.where("provision_id IS NOT NULL").select("mention_id", cit.law_title(F.col("act_slug")).alias("act_ref"), "provision_id")


def changed_paragraphs(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """(mention_id, paragraph) of mentions(mention_id, judgment_id, char_start, paragraph) whose paragraph in the text
    differs from the stored one: the last number at or before the place."""
    marks = texts.select("judgment_id", F.explode(cit.scanned("text")).alias("s")).where("s.kind = 'paragraph'").select("judgment_id", F.col("s.start").alias("at"), F.col("s.n").alias("n"))
    m = mentions.select("judgment_id", F.col("char_start").alias("at"), F.lit(None).cast("int").alias("n"), F.struct("mention_id", "paragraph").alias("m"))
    rows = m.unionByName(marks.withColumn("m", F.lit(None).cast(m.schema["m"].dataType)))
    upto = Window.partitionBy("judgment_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("now", F.max(F.when(F.col("n").isNotNull(), F.struct("at", "n"))).over(upto)["n"].cast("string"))
    return rows.where("m IS NOT NULL AND NOT (now <=> m.paragraph)").select("m.mention_id", F.col("now").alias("paragraph"))


def short_labels(labels: DataFrame) -> DataFrame:
    """(judgment_id, section, provision_id) of labels(judgment_id, label, provision_id): each label, and its part before
    a bracket where no other label of the judgment begins alike."""
    short = F.get(F.split("label", r" \("), F.lit(0))
    each = Window.partitionBy("judgment_id", "short")
    rows = labels.withColumn("short", short).withColumn("n", F.count("*").over(each))
    both = rows.select("judgment_id", F.explode(F.when(F.col("n") == 1, F.array("label", "short")).otherwise(F.array("label"))).alias("section"), "provision_id")
    return both.distinct()


def valid_answers(answers: DataFrame, labels: DataFrame, types: list[str]) -> DataFrame:
    """answers(judgment_id, section, event_type, scope, confidence, quote) with provision_id and problem: what bars an
    answer, or null. A section is named by its label, whole or short."""
    out = answers.join(short_labels(labels), ["judgment_id", "section"], "left")
    fine = F.col("provision_id").isNotNull() & F.col("event_type").isin(types) & F.col("scope").isin("total", "partial") & F.col("confidence").isin(*CONFIDENCE) & F.col("quote").isNotNull()
    return out.withColumn("problem", F.when(~F.coalesce(fine, F.lit(False)), "invalid_answer"))


def replace_unverified(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events(judgment_id, provision_id, event_type, verified, ...) of a judgment replaced by new ones; verified rows stay,
    and a new row that repeats a verified one is left out."""
    kept = old.where("verified").unionByName(old.where("NOT verified").join(new.select("judgment_id").distinct(), "judgment_id", "left_anti"))
    fresh = new.join(old.where("verified").select("judgment_id", "provision_id", "event_type").distinct(), ["judgment_id", "provision_id", "event_type"], "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def verdict(own_holding: Column, right_section: Column) -> Column:
    """A second pass's verdict on an event."""
    return F.when((own_holding == "yes") & (right_section == "yes"), "pass").when(own_holding.eqNullSafe("no") | right_section.eqNullSafe("no"), "fail").otherwise("unsure")


def to_ask(items: DataFrame, ledger: DataFrame, redo: bool = False) -> DataFrame:
    """items(item_id, model, version, prompt) that the ledger(item_id, model, version, prompt_key) does not settle: never
    asked of this model and version, or with redo, asked with another prompt. With prompt_key, the prompt's digest."""
    rows = items.withColumn("prompt_key", F.sha2(F.concat_ws("|", "model", "version", "prompt"), 256))
    keys = ["item_id", "model", "version", "prompt_key"] if redo else ["item_id", "model", "version"]
    return rows.join(ledger.select(*keys).distinct(), keys, "left_anti")


def shard(items: DataFrame, key: str, i: int, n: int) -> DataFrame:
    """The i-th of n workers' share of the items, by a hash of their key."""
    return items.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def usable_appeals(findings: DataFrame) -> DataFrame:
    """Findings on later appeals that may be loaded: pending, of medium or high confidence, with a source."""
    return findings.where((F.col("status") == "pending") & F.col("confidence").isin("medium", "high") & (F.coalesce("source", F.lit("")) != ""))


def appeal_report(appeals: DataFrame) -> DataFrame:
    """(outcome, n, n_changed) of appeals(outcome, status_before, status_after)."""
    return appeals.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(~F.col("status_before").eqNullSafe(F.col("status_after"))).alias("n_changed"))


def audited(events: DataFrame, labels: DataFrame) -> DataFrame:
    """events with issue and stance of labels(event_id, issue, stance) where these say one."""
    new = labels.select("event_id", F.col("issue").alias("_issue"), F.col("stance").alias("_stance"))
    out = events.join(new, "event_id", "left")
    return out.withColumns({"issue": F.coalesce("_issue", "issue"), "stance": F.coalesce("_stance", "stance")}).drop("_issue", "_stance")


def review_cases(events: DataFrame, agreed: DataFrame, verdicts: DataFrame, texts: DataFrame) -> DataFrame:
    """(event_id, kind, provision_id, text) to review: events that both labellers agreed on(event_id), and leads without
    a saved verdict(event_id, round, verdict), the last round's counting; with the section's text."""
    last = Window.partitionBy("event_id").orderBy(F.desc("round"))
    saved = verdicts.withColumn("_r", F.row_number().over(last)).where("_r = 1 AND verdict <> 'reopened'").select("event_id")
    bench = events.join(agreed.select("event_id").distinct(), "event_id").withColumn("kind", F.lit("benchmark"))
    leads = events.where("NOT verified").join(agreed.select("event_id").distinct(), "event_id", "left_anti").join(saved, "event_id", "left_anti").withColumn("kind", F.lit("lead"))
    return bench.unionByName(leads).join(texts, "provision_id", "left").select("event_id", "kind", "provision_id", "text")

"""The draft check: what a drafted answer says on its own, judged by the filing checker and the collection.

A draft is a list of parts: text that the model wrote, and rulings, sections and cases that were filled in
from tables. Its parts, findings and quotes are read in one order of places, so each finding falls into
the part that holds it without comparing it with every part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stareflow.functions import text as tx
from stareflow.operators.staging import staged

# A quote, its least words, rulings of courts that limit a section, and words for what could not be confirmed.
QUOTED, QUOTED_WORDS = r"[\"“]([^\"“”]+)[\"”]", 5
COURT_LIMITS = ("declared_unconstitutional", "read_down", "severed")
UNCONFIRMED = r"(?i)(could ?n[o'’]t|cannot|can['’]t|unable to|did not|was not able to)\s+(be\s+)?confirm|not (been )?confirmed|not in [\w'’]+ collection"
NEAR, LEAST_PARTY = 200, 3
VERSUS = r"\s+v\.?\s+"

_ITEM = ("draft_id", "raw_text", "kind", "result", "flagged", "cite")


def spans(parts: DataFrame) -> DataFrame:
    """parts(draft_id, part_no, kind, text, ...) with start and end in the rendered draft."""
    before = Window.partitionBy("draft_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length(F.coalesce("text", F.lit("")))).over(before)
    return parts.withColumn("end", end).withColumn("start", F.col("end") - F.length(F.coalesce("text", F.lit(""))))


def rendered(parts: DataFrame) -> DataFrame:
    """(draft_id, text) of the parts in order."""
    own = F.sort_array(F.collect_list(F.struct("part_no", F.coalesce("text", F.lit("")).alias("text"))))
    return parts.groupBy("draft_id").agg(F.array_join(F.transform(own, lambda p: p["text"]), "").alias("text"))


def placed(findings: DataFrame, parts: DataFrame) -> DataFrame:
    """findings(draft_id, char_start, ...) with where: the kind of the part that they stand in, text if none holds them.
    parts may have their spans() already."""
    if "end" not in parts.columns:
        parts = spans(parts)
    own = parts.where("end > start").select("draft_id", F.col("start").alias("char_start"), F.lit(0).alias("_row"), F.col("kind").alias("_kind"), F.col("end").alias("_end"))
    rows = own.unionByName(findings.withColumn("_row", F.lit(1)), allowMissingColumns=True)
    read = Window.partitionBy("draft_id").orderBy("char_start", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_row") == 0, F.struct("_kind", "_end")), ignorenulls=True).over(read)
    rows = rows.withColumn("_in", last).where("_row = 1")
    return rows.select(*findings.columns, F.when(F.col("char_start") < F.col("_in._end"), F.col("_in._kind")).otherwise("text").alias("where"))


def _items(df: DataFrame, raw: Column, kind: str, result: Column, flagged: Column, cite: Column | None = None) -> DataFrame:
    none = F.array().cast("array<bigint>")
    return df.select("draft_id", F.left(raw, F.lit(200)).alias("raw_text"), F.lit(kind).alias("kind"), result.alias("result"), flagged.alias("flagged"), (none if cite is None else F.coalesce(cite, none)).alias("cite"))


def _of_draft(parts: DataFrame, kind: str, value: str, alias: str) -> DataFrame:
    return parts.where(F.col("kind") == kind).groupBy("draft_id").agg(F.collect_set(value).alias(alias))


def _some(values: Column, fits) -> Column:
    return F.coalesce(F.exists(values, fits), F.lit(False))


def judged_quotes(quotes: DataFrame, cases: DataFrame, parts: DataFrame) -> DataFrame:
    """quotes(draft_id, case_no, quote, result) of cases that stand outside rulings, with own: the words are part of a
    ruling that the draft shows. cases may be placed() already."""
    if "where" not in cases.columns:
        cases = placed(cases, parts)
    outside = cases.where("where <> 'ruling'").select("draft_id", "case_no")
    found = quotes.join(outside, ["draft_id", "case_no"]).join(_of_draft(parts, "ruling", "quote", "rulings"), "draft_id", "left")
    return found.withColumn("own", _some(F.col("rulings"), lambda r: F.contains(r, F.col("quote")))).drop("rulings")


def loose_quotes(parts: DataFrame, judged: DataFrame) -> DataFrame:
    """(draft_id, quote) of quoted words that the model wrote with no case to check them by: none of the judged quotes
    holds them or is held by them."""
    said = parts.where("kind = 'text'").select("draft_id", F.explode(tx.found_at(F.col("text"), QUOTED)).alias("s"))
    said = said.select("draft_id", F.trim(F.substr("s.raw", F.lit(2), F.length("s.raw") - 2)).alias("quote"))
    said = said.where(F.size(F.filter(F.split("quote", r"(?U)\s+"), lambda w: w != "")) >= QUOTED_WORDS)
    seen = judged.groupBy("draft_id").agg(F.collect_set("quote").alias("seen"))
    said = said.join(seen, "draft_id", "left")
    return said.where(~_some(F.col("seen"), lambda j: F.contains(j, F.col("quote")) | F.contains(F.col("quote"), j))).select("draft_id", "quote")


def section_items(sections: DataFrame, parts: DataFrame, limits: DataFrame) -> DataFrame:
    """Items of sections(draft_id, char_start, raw_text, provision_id, act_ref, status) that stand outside rulings, each
    section once: whether the draft tells that it is repealed or limited. limits: (provision_id, event_id, event_type) of
    the rulings that its status rests on."""
    own = placed(sections, parts).where("where <> 'ruling'").withColumn("key", F.coalesce("provision_id", "act_ref")).where("key IS NOT NULL")
    first = Window.partitionBy("draft_id", "key").orderBy("char_start", "raw_text")
    own = own.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    ids = limits.groupBy("provision_id").agg(F.sort_array(F.collect_set("event_id")).alias("all"), F.sort_array(F.collect_set(F.when(F.col("event_type").isin(*COURT_LIMITS), F.col("event_id")))).alias("court"))
    own = own.join(ids, "provision_id", "left").join(_of_draft(parts, "ruling", "event_id", "cited"), "draft_id", "left").join(_of_draft(parts, "section", "provision_id", "shown"), "draft_id", "left")
    none = F.array().cast("array<bigint>")
    overlap = lambda c: F.coalesce(F.arrays_overlap("cited", c), F.lit(False))
    repealed = F.col("status") == "repealed"
    told = F.when(repealed, _some(F.col("shown"), lambda p: p == F.col("provision_id")) | overlap("all")).otherwise(overlap("court"))
    limited = repealed | (F.size(F.coalesce("court", none)) > 0)
    result = F.when(F.col("provision_id").isNull(), "not_covered").when(limited & told, "limit_mentioned").when(limited, "limit_not_mentioned").otherwise("in_force")
    own = own.withColumn("_result", result)
    cite = F.when(F.col("_result") == "limit_not_mentioned", F.when(repealed, F.col("all")).otherwise(F.col("court")))
    return _items(own, F.col("raw_text"), "section", F.col("_result"), F.col("_result").isin("not_covered", "limit_not_mentioned"), cite)


def _first_party(name: Column) -> Column:
    return F.trim(F.get(F.split(name, VERSUS, 2), F.lit(0)))


def _said_near(text: Column, word: Column) -> Column:
    """Whether a text says, near a word, that something could not be confirmed."""
    literal = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    n = F.length(word)

    def around(parts: Column) -> Column:
        before = F.slice(parts, 1, F.size(parts) - 1)  # a place of the word follows each part but the last
        return F.exists(before, lambda p: tx.let(p["start"] + F.length(p["raw"]), lambda at: tx.let(F.greatest(at - NEAR, F.lit(0)), lambda low: F.substr(text, low + 1, at + n + NEAR - low).rlike(UNCONFIRMED))))

    return F.when((n >= LEAST_PARTY) & F.contains(text, word), tx.let(tx.parts_at(text, literal), around)).otherwise(False)


def dropped_cases(lookups: DataFrame, questions: DataFrame, parts: DataFrame) -> DataFrame:
    """Items of cases that the user named and a lookup did not confirm as one, that the draft neither cites nor calls
    unconfirmed. lookups: (draft_id, step_no, name, confirmed, candidate_ids, candidate_titles); questions: (draft_id,
    question)."""
    wrote = rendered(parts.where("kind = 'text'")).select("draft_id", F.lower("text").alias("wrote"))
    cited = parts.where("kind IN ('case', 'ruling')").groupBy("draft_id").agg(F.collect_set("judgment_id").alias("cited"), F.collect_set("title").alias("titles"))
    asked = lookups.join(questions, "draft_id").join(wrote, "draft_id", "left").join(cited, "draft_id", "left")
    name, question = F.lower(F.trim("name")), F.lower("question")
    asked = asked.withColumns({"_name": name, "_party": _first_party(name)})
    named = (F.col("_name") != "") & (F.contains(question, F.col("_name")) | ((F.length("_party") >= LEAST_PARTY) & F.contains(question, F.col("_party"))))
    known = F.coalesce(F.arrays_overlap("cited", "candidate_ids"), F.lit(False)) | F.coalesce(F.arrays_overlap("titles", "candidate_titles"), F.lit(False))
    text = F.coalesce("wrote", F.lit(""))
    said = _said_near(text, F.col("_name")) | _said_near(text, F.col("_party"))
    open_ = asked.where(named & (F.size(F.array_distinct("confirmed")) != 1) & ~known & ~said)
    first = open_.groupBy("draft_id", "name").agg(F.min("step_no").alias("step_no"))
    return _items(first, F.col("name"), "case", F.lit("not_confirmed"), F.lit(True))


def draft_items(parts: DataFrame, cases: DataFrame, quotes: DataFrame, sections: DataFrame, limits: DataFrame, lookups: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """(draft_id, raw_text, kind, result, flagged, cite) of everything that is judged in drafts: cases(draft_id, case_no,
    char_start, raw_text, result), quotes(draft_id, case_no, quote, result), sections as section_items() takes them."""
    parts = staged(spans(parts))
    cases = staged(placed(cases, parts))
    own = cases.where("where = 'text'")
    out = _items(own, F.col("raw_text"), "case", F.col("result"), F.col("result") != "found")
    judged = staged(judged_quotes(quotes, cases, parts))
    out = out.unionByName(_items(judged.where("NOT own"), F.col("quote"), "quote", F.col("result"), F.col("result") != "verbatim"))
    out = out.unionByName(_items(loose_quotes(parts, judged), F.col("quote"), "quote", F.lit("not_checked"), F.lit(True)))
    out = out.unionByName(section_items(sections, parts, limits))
    if lookups is not None:
        out = out.unionByName(dropped_cases(lookups, questions, parts))
    return out

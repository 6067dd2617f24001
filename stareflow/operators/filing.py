"""The filing checker: cases and sections that a filing cites, and the quotes that it gives them.

Places of citations and quotes come from expressions on the filing's text; all else is joins: names to
titles, quotes to the nearest citation of their paragraph, quotes to the texts of the cases found. Words are
compared in one form (compatibility forms joined, lower case) and keep their places, so that what is
found is shown as the court wrote it.

What several later steps read (cases, their results, quotes) is staged, so that a filing's text is searched once.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stareflow.functions import citations as cit
from stareflow.functions import text as tx
from stareflow.operators import matching as mt
from stareflow.operators.staging import staged

# A quote, what stands for words left out, and the least words of a quote.
QUOTE = r"[“\"]([^“”\"]{1,3000})[”\"]"
ELLIPSIS = r"\.\s?\.\s?\.|…"
QUOTE_WORDS = 8
BLANK_LINE = r"\n\s*\n"


def cited_cases(filings: DataFrame) -> DataFrame:
    """(filing_id, case_no, form, char_start, char_end, raw_text, citation, year, name, number) of the neutral and
    eKLR citations in filings(filing_id, text), each with the case name before it."""
    # A filing's cases are numbered where its text is read, so that no row is shuffled for it.
    spots = filings.select("filing_id", "text", F.posexplode(F.sort_array(tx.found_at(F.col("text"), tx.NEUTRAL, tx.EKLR))).alias("case_no", "s")).select("filing_id", "text", "case_no", "s.*")
    neutral = ~F.col("raw").endswith("eKLR")
    spots = spots.withColumn("eklr", F.when(~neutral, tx.before_eklr(F.col("text"), F.col("start"))))
    found = spots.select(
        "filing_id",
        "case_no",
        F.when(neutral, "neutral").otherwise("eklr").alias("form"),
        F.col("start").alias("char_start"),
        F.col("end").alias("char_end"),
        F.col("raw").alias("raw_text"),
        F.when(neutral, F.regexp_replace("raw", tx.WHOLE_NEUTRAL, "[$1] $2 $3 (KLR)")).alias("citation"),
        F.regexp_extract("raw", r"\[(\d{4})\]", 1).cast("int").alias("year"),
        F.when(neutral, tx.name_before(F.col("text"), F.col("start"))).otherwise(F.col("eklr.name")).alias("name"),
        F.when(~neutral, F.col("eklr.number")).alias("number"),
    )
    return staged(found)


def _along(filings: DataFrame, *kinds: DataFrame) -> DataFrame:
    """Rows of several kinds as one table, to be read in the order of their places."""
    every = filings
    for k in kinds:
        every = every.unionByName(k, allowMissingColumns=True)
    return every


def quotes_given(filings: DataFrame, cases: DataFrame) -> DataFrame:
    """(filing_id, quote_no, case_no, quote): each quote of QUOTE_WORDS words or more with the nearest citation of
    its paragraph, the earlier on ties. Quotes of paragraphs without a citation are left out.

    Quotes are looked for in each paragraph alone, so a stray mark does not reach into the next one.
    Paragraphs, citations and quotes are read in one order of places: nothing is paired with everything.
    """
    blocks = filings.select("filing_id", F.posexplode(tx.parts_between(F.col("text"), BLANK_LINE)).alias("block", "b"))
    blocks = staged(blocks.select("filing_id", "block", F.col("b.start").alias("at"), tx.found_at(F.col("b.raw"), QUOTE).alias("quoted")))
    quotes = blocks.select("filing_id", "block", "at", F.explode("quoted").alias("s"))
    quotes = quotes.select("filing_id", "block", (F.col("at") + F.col("s.start")).alias("at"), F.substr("s.raw", F.lit(2), F.length("s.raw") - 2).alias("quote"))
    quotes = quotes.where(F.size(F.regexp_extract_all("quote", F.lit(r"(?U)[\w&&[^_]]+"), F.lit(0))) >= QUOTE_WORDS)
    marks = _along(blocks.select("filing_id", "block", "at", F.lit(0).alias("kind")), cases.select("filing_id", F.col("char_start").alias("at"), F.lit(1).alias("kind"), "case_no"))
    read = Window.partitionBy("filing_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cited = marks.withColumn("block", F.last("block", ignorenulls=True).over(read)).where("kind = 1")
    both = _along(cited, quotes.withColumn("kind", F.lit(2)))
    case = F.when(F.col("kind") == 1, F.struct("at", "case_no"))
    order = Window.partitionBy("filing_id", "block").orderBy("at", "kind")
    before = F.last(case, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(case, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumns({"before": before, "after": after}).where("kind = 2 AND (before IS NOT NULL OR after IS NOT NULL)")
    nearer = F.col("after").isNull() | (F.col("at") - F.col("before.at") <= F.col("after.at") - F.col("at"))
    number = F.row_number().over(Window.partitionBy("filing_id").orderBy("at")) - 1
    return staged(both.select("filing_id", number.alias("quote_no"), F.when(F.col("before").isNotNull() & nearer, F.col("before.case_no")).otherwise(F.col("after.case_no")).alias("case_no"), "quote"))


_WORD = re.compile(r"[^\W_]+")
_ELLIPSIS = re.compile(ELLIPSIS)


def words_at(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end) of a text's words, each in compatibility form and lower case; places are the text's own."""
    return [(unicodedata.normalize("NFKC", m[0]).lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]


_WORDS = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(_WORDS)
def text_words(text: pa.Array) -> pa.Array:
    found = [words_at(t) for t in text.to_pylist()]
    columns = [pa.array([[w[i] for w in one] for one in found], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    return pa.StructArray.from_arrays(columns, names=["words", "starts", "ends"])


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def quote_parts(quote: pa.Array) -> pa.Array:
    """The words of the parts of quotes around their ellipses; parts without words are left out."""
    found = [[p for p in ([w for w, *_ in words_at(x)] for x in _ELLIPSIS.split(q or "")) if p] for q in quote.to_pylist()]
    return pa.array(found, pa.list_(pa.list_(pa.string())))


def _spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def standing_in_order(parts: Column, words: Column) -> Column:
    """(first, last) when parts of a quote stand in a text's words one behind another, each at the first place behind
    the one before: the words from first to before last; else null."""

    def after(a: Column, p: Column, body: Column) -> Column:
        found = lambda s: tx.let(F.position(s, body, a["at"]), lambda i: F.struct(F.when(i > 0, i + F.length(s) - 1).otherwise(0).alias("at"), F.when(a["first"] > 0, a["first"]).otherwise(i).alias("first")))
        return F.when(a["at"] > 0, tx.let(_spaced(p), found)).otherwise(a)

    def place(body: Column) -> Column:
        ends = F.aggregate(parts, F.struct(F.lit(1).alias("at"), F.lit(0).alias("first")), lambda a, p: after(a, p, body))
        nth = lambda i: F.length(F.left(body, i)) - F.length(F.replace(F.left(body, i), F.lit(" "), F.lit(""))) - 1
        return tx.let(ends, lambda e: F.when(e["at"] > 0, F.struct(nth(e["first"]).alias("first"), nth(e["at"]).alias("last"))))

    return F.when(F.size(parts) > 0, tx.let(_spaced(words), place))


def budgeted(quotes: DataFrame, results: DataFrame, most: int | None = None) -> DataFrame:
    """quotes_given() with what is left of most comparisons for a filing: tie_left before its case, left before the
    quote. Cases come in order; one that several judgments may be costs a comparison for each of its quotes and
    candidates, and every quote one more. Without most, quotes as they are: all are compared. No query sets it; the
    reference does, for one request to its server."""
    if most is None:
        return quotes
    told = quotes.groupBy("filing_id", "case_no").agg(F.count("*").alias("n"))
    tries = F.when(F.col("result") == "possible_match", F.size("candidates")).otherwise(0)
    costs = results.select("filing_id", "case_no", tries.alias("tries")).join(told, ["filing_id", "case_no"])
    earlier = Window.partitionBy("filing_id").orderBy("case_no").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col("n") * (F.col("tries") + 1)).over(earlier), F.lit(0))
    costs = costs.select("filing_id", "case_no", (F.lit(most) - spent).alias("tie_left"), (F.lit(most) - spent - F.col("n") * F.col("tries")).alias("from_"))
    place = F.row_number().over(Window.partitionBy("filing_id", "case_no").orderBy("quote_no")) - 1
    out = quotes.withColumn("place", place).join(costs, ["filing_id", "case_no"])
    return staged(out.select(*quotes.columns, "tie_left", (F.col("from_") - F.col("place")).alias("left")))


def checked_quotes(quotes: DataFrame, found: DataFrame, documents: DataFrame, most: int | None = None) -> DataFrame:
    """quotes_given() with judgment_id, result, similarity, court_text, char_start, paragraph and ocr. found: (filing_id,
    case_no, judgment_id); documents: (judgment_id, text, has_full_text, ocr_pages).

    not_checked: no case found, or its text missing or not whole. verbatim: all parts stand in order. Else
    the quote's runs of words vote for the place in its own case's text where most of them line up (ties: the
    earliest run, then place); the passage there, of the quote's length, is close or not, and is shown either way.
    A quote is compared with the text of its case only. All quotes are compared, but for a caller who gives most
    quotes for a filing, or quotes with a column left, as budgeted() makes it: those beyond are not_checked.
    """
    if most is not None and "left" not in quotes.columns:
        order = Window.partitionBy("filing_id").orderBy("case_no", "quote_no")
        quotes = quotes.withColumn("left", F.lit(most + 1) - F.row_number().over(order))
    compared = F.col("left") > 0 if "left" in quotes.columns else F.lit(True)
    q = quotes.withColumns({"item_id": F.concat_ws("/", "filing_id", "quote_no"), "parts": quote_parts("quote")}).drop("tie_left")
    q = staged(q.join(found, ["filing_id", "case_no"], "left"))
    held = documents.where("has_full_text AND text IS NOT NULL").join(q.where(compared).select("judgment_id").distinct(), "judgment_id", "left_semi")
    d = staged(held.select("judgment_id", "text", (F.size("ocr_pages") > 0).alias("scan"), text_words("text").alias("w"), cit.numbered_paragraphs("text").alias("marks")))
    whole = q.where(compared).join(d, "judgment_id").withColumn("stands", standing_in_order(F.col("parts"), F.col("w.words")))
    whole = whole.select("item_id", "judgment_id", "parts", "scan", F.col("stands").alias("span"), F.lit(1.0).alias("similarity"))
    whole = staged(whole)
    flat = F.flatten("parts")
    rest = whole.where("span IS NULL").select("item_id", "judgment_id", flat.alias("said"))
    asked = rest.select("item_id", "judgment_id", F.posexplode(mt.runs(F.col("said"))).alias("k", "run"))
    there = d.join(rest.select("judgment_id").distinct(), "judgment_id", "left_semi").select("judgment_id", F.posexplode(mt.runs(F.col("w.words"))).alias("j", "run"))
    votes = there.join(asked, ["judgment_id", "run"]).groupBy("item_id", (F.col("j") - F.col("k")).alias("at")).agg(F.count("*").alias("n"), F.min("k").alias("k"))
    best = votes.groupBy("item_id").agg(F.max_by("at", F.struct("n", -F.col("k"), -F.col("at"))).alias("at"))
    near = rest.join(best, "item_id").join(d.select("judgment_id", "w.words"), "judgment_id")
    first = F.greatest(F.col("at"), F.lit(0))
    near = near.withColumn("span", F.struct(first.alias("first"), F.least(first + F.size("said"), F.size("words")).alias("last")))
    near = near.select("item_id", "span", mt.ratio("said", F.slice("words", F.col("span.first") + 1, F.col("span.last") - F.col("span.first"))).alias("similarity"))
    found_at = whole.where("span IS NOT NULL").select("item_id", "judgment_id", "span", "similarity", F.lit("verbatim").alias("result"))
    found_at = found_at.unionByName(near.join(rest.select("item_id", "judgment_id"), "item_id").withColumn("result", F.when(F.col("similarity") >= mt.CLOSE, "close").otherwise("not_found")).select("item_id", "judgment_id", "span", "similarity", "result"))
    start = F.get("w.starts", F.col("span.first"))
    shown = found_at.join(d.drop("scan"), "judgment_id").withColumn("char_start", start)
    mark = F.try_element_at(F.filter("marks", lambda m: m["at"] <= F.col("char_start")), F.lit(-1))
    shown = shown.select("item_id", "result", "similarity", F.substr("text", F.col("char_start") + 1, F.get("w.ends", F.col("span.last") - 1) - F.col("char_start")).alias("court_text"), "char_start", mark["number"].cast("string").alias("paragraph"))
    out = q.select("filing_id", "quote_no", "case_no", "quote", "judgment_id", "item_id").join(whole.select("item_id", "scan"), "item_id", "left").join(shown, "item_id", "left")
    result = F.when(F.col("scan").isNull(), "not_checked").otherwise(F.coalesce("result", F.lit("not_found")))
    return out.select("filing_id", "quote_no", "case_no", "quote", "judgment_id", result.alias("result"), "similarity", "court_text", "char_start", "paragraph", F.coalesce("scan", F.lit(False)).alias("ocr"))


def case_results(cases: DataFrame, titles: DataFrame) -> DataFrame:
    """(filing_id, case_no, result, basis, judgment_id, candidates) of cited_cases() against titles(title_id,
    citation, title, year, number): a neutral citation finds its judgment, or names another's; an eKLR one is
    matched by year, names and number."""
    cite = cases.withColumn("cite_id", F.concat_ws("/", "filing_id", "case_no"))
    exact = cite.where("form = 'neutral'").join(titles.where("citation IS NOT NULL").select("citation", "title_id", "title"), "citation", "left")
    agree = tx.names_agree(F.col("name"), F.col("title"))
    none = F.array().cast("array<bigint>")
    exact = exact.select("cite_id", F.when(F.col("title_id").isNull(), "not_in_collection").when(agree, "found").otherwise("name_mismatch").alias("result"), F.when(F.col("title_id").isNotNull(), "citation").alias("basis"), F.when(F.col("title_id").isNotNull(), F.array("title_id")).otherwise(none).alias("ids"))
    words = lambda c: tx.name_words(c)
    loose = cite.where("form = 'eklr'").select("cite_id", "year", words(F.col("name")).alias("words"), "number")
    held = titles.select("title_id", "year", words(tx.party_part(F.col("title"))).alias("words"), "number")
    every = exact.unionByName(mt.name_match(loose, held).select("cite_id", "result", "basis", "ids"))
    out = cite.select("cite_id", "filing_id", "case_no").join(every, "cite_id")
    sure = F.col("result").isin("found", "name_mismatch")
    return staged(out.select("filing_id", "case_no", "result", "basis", F.when(sure, F.get("ids", F.lit(0))).alias("judgment_id"), F.when(sure, none).otherwise(F.col("ids")).alias("candidates")))


def settled(results: DataFrame, quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """case_results() where a quote that stands word for word in just one candidate settles which it is. Where
    budgeted() set a most, quotes count only while something is left before their case."""
    if "tie_left" in quotes.columns:
        quotes = quotes.where("tie_left > 0")
    tries = results.where("result = 'possible_match'").select("filing_id", "case_no", F.explode("candidates").alias("judgment_id"))
    tries = tries.join(quotes.select("filing_id", "case_no", quote_parts("quote").alias("parts")), ["filing_id", "case_no"])
    texts = documents.where("has_full_text").join(tries.select("judgment_id").distinct(), "judgment_id", "left_semi").select("judgment_id", text_words("text").alias("w"))
    tries = tries.join(texts, "judgment_id")
    hits = tries.where(standing_in_order(F.col("parts"), F.col("w.words")).isNotNull()).groupBy("filing_id", "case_no").agg(F.collect_set("judgment_id").alias("hits"))  # of three candidates at most
    out = results.join(hits.where(F.size("hits") == 1).select("filing_id", "case_no", F.get("hits", F.lit(0)).alias("one")), ["filing_id", "case_no"], "left")
    hit = F.col("one").isNotNull()
    none = F.array().cast("array<bigint>")
    return staged(out.select("filing_id", "case_no", F.when(hit, "found").otherwise(F.col("result")).alias("result"), F.when(hit, "quote").otherwise(F.col("basis")).alias("basis"), F.coalesce("one", "judgment_id").alias("judgment_id"), F.when(hit, none).otherwise(F.col("candidates")).alias("candidates")))


def section_findings(linked: DataFrame, standing: DataFrame) -> DataFrame:
    """(filing_id, char_start, char_end, raw_text, act_ref, provision_id, result, status) of linked mentions(doc_id,
    ...) with the standing(provision_id, status) of what they link to."""
    m = linked.select(F.col("doc_id").alias("filing_id"), "char_start", "char_end", "raw_text", "act_ref", "provision_id")
    return m.join(standing, "provision_id", "left").withColumn("result", F.when(F.col("provision_id").isNotNull(), "linked").otherwise("not_covered"))


def report(cases: DataFrame, results: DataFrame, quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """(filing_id, finding_no, kind, char_start, raw_text, result, n_quotes, n_verbatim): all findings of a filing in
    its order, a case before a section at the same place."""
    told = quotes.groupBy("filing_id", "case_no").agg(F.count("*").alias("n_quotes"), F.count_if(F.col("result") == "verbatim").alias("n_verbatim"))
    c = cases.join(results, ["filing_id", "case_no"]).join(told, ["filing_id", "case_no"], "left")
    c = c.select("filing_id", F.lit("case").alias("kind"), "char_start", "raw_text", "result", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_verbatim", F.lit(0)).alias("n_verbatim"), F.lit("").alias("ref"))
    s = sections.select("filing_id", F.lit("section").alias("kind"), "char_start", "raw_text", "result", F.lit(0).alias("n_quotes"), F.lit(0).alias("n_verbatim"), F.coalesce("provision_id", F.lit("")).alias("ref"))
    order = Window.partitionBy("filing_id").orderBy("char_start", "kind", "ref", "raw_text")
    return c.unionByName(s).withColumn("finding_no", F.row_number().over(order)).drop("ref")


def draft_flags(findings: DataFrame, parts: DataFrame) -> DataFrame:
    """Of findings(filing_id, char_start, kind, result), those in what the model wrote itself: parts(filing_id, start,
    end, kind) of a rendered draft are its spans, and only those of kind text are judged. flagged: the finding is not
    found, linked or verbatim."""
    own = parts.where("kind = 'text'").select("filing_id", "start", "end")
    return findings.join(own, "filing_id").where("start <= char_start AND char_start < end").select("filing_id", "char_start", "kind", "result", (~F.col("result").isin("found", "linked", "verbatim")).alias("flagged"))

"""Scores of extractions, links and reviews against labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stareflow.operators.relational import left_joined


def is_right(found: Column, gold: Column) -> Column:
    """Whether an id is one of a gold label's alternatives."""
    return F.array_contains(F.split(gold, r"\|"), found)


def link_scores(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of scores for answers(item_id, result, ids) against gold(item_id, gold): ids are in order,
    and gold is not_held where nothing should be found."""
    a = answers.join(gold, "item_id")
    held, found = F.col("gold") != "not_held", F.col("result") == "found"
    right = found & is_right(F.get("ids", F.lit(0)), F.col("gold"))
    near = F.exists("ids", lambda x: F.array_contains(F.split(F.col("gold"), r"\|"), x))
    possible = held & (F.col("result") == "possible_match")
    return a.agg(
        F.count("*").alias("items"),
        F.count_if(held).alias("held"),
        F.count_if(found).alias("found"),
        F.count_if(right).alias("right"),
        F.count_if(found & ~right).alias("wrong"),
        F.count_if(possible).alias("possible"),
        F.count_if(possible & near).alias("possible_hit"),
        F.count_if(found & ~held).alias("false_found"),
    )


def best_thresholds(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """Of grid(found_score, margin), the row with the fewest wrong finds of scored(item_id, top, second,
    right), then the most right ones, then the smallest thresholds. The grid is a small parameter table."""
    each = scored.join(F.broadcast(grid), (F.col("top") >= F.col("found_score")) & (F.col("top") - F.coalesce("second", F.lit(0.0)) >= F.col("margin")), "right")
    sums = each.groupBy("found_score", "margin").agg(F.count_if(~F.col("right")).alias("wrong"), F.count_if("right").alias("cover"))
    return sums.orderBy("wrong", F.desc("cover"), "found_score", "margin").limit(1)


def merged_labels(items: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """(item_id, gold, agreed): two labellers agree, or a third decides; an audit may replace not_held only.
    a, b, c, audit: (item_id, label). Items that a or b has not labelled are left out."""
    name = lambda df, x: df.select("item_id", F.col("label").alias(x))
    out = items.join(name(a, "a"), "item_id").join(name(b, "b"), "item_id").join(name(c, "c"), "item_id", "left")
    agreed = (F.col("a") == F.col("b")) & (F.col("a") != "unsure")
    out = out.select("item_id", F.when(agreed, F.col("a")).otherwise(F.coalesce("c", F.lit(""))).alias("gold"), agreed.alias("agreed"))
    if audit is None:
        return out
    out = out.join(name(audit, "x"), "item_id", "left")
    put = (F.col("gold") == "not_held") & ~F.coalesce("x", F.lit("not_held")).isin("not_held", "unsure", "")
    return out.select("item_id", F.when(put, F.col("x")).otherwise(F.col("gold")).alias("gold"), (F.col("agreed") & ~put).alias("agreed"))


def same_multiset(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, status): verified where two labellers gave a candidate the same rows, in any order; else disagree."""
    rows = lambda df, x: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*values))).alias(x))
    both = rows(a, "a").join(rows(b, "b"), keys, "full")
    return both.select(*keys, F.when(F.col("a").isNotNull() & (F.col("a") == F.col("b")), "verified").otherwise("disagree").alias("status"))


def review_verdict(is_event: Column, section_right: Column, correct_type: Column, claimed: Column) -> Column:
    """A blind reviewer's verdict on a claimed event."""
    return (
        F.when(is_event == "no", "not an event")
        .when(is_event != "yes", "unsure")
        .when(section_right != "yes", "wrong section")
        .when(correct_type == claimed, "right")
        .otherwise(F.concat(F.lit("wrong type ("), correct_type, F.lit(")")))
    )


def agreed_verdicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(verdict, n) of a, b(event_id, verdict): the verdict where reviewers agree, else split."""
    both = a.select("event_id", F.col("verdict").alias("va")).join(b.select("event_id", F.col("verdict").alias("vb")), "event_id")
    return both.groupBy(F.when(F.col("va") == F.col("vb"), F.col("va")).otherwise("split").alias("verdict")).agg(F.count("*").alias("n"))


def checker_rounds(results: DataFrame) -> DataFrame:
    """By round of results(round, right, verdict): wrong events caught and right ones kept by a second check."""
    kept = F.col("verdict") == "pass"
    return results.groupBy("round").agg(
        F.count_if(~F.col("right")).alias("wrong"),
        F.count_if(~F.col("right") & ~kept).alias("caught"),
        F.count_if("right").alias("right"),
        F.count_if(F.col("right") & kept).alias("kept"),
    )


def review_scores(decisions: DataFrame) -> DataFrame:
    """True and false accepts and rejects of decisions(decision, right); unsure ones apart."""
    yes, no = F.col("decision") == "accept", F.col("decision") == "reject"
    return decisions.agg(F.count_if(yes & F.col("right")).alias("tp"), F.count_if(yes & ~F.col("right")).alias("fp"), F.count_if(no & F.col("right")).alias("fn"), F.count_if(no & ~F.col("right")).alias("tn"), F.count_if(F.col("decision") == "unsure").alias("unsure"))


def event_scores(key: DataFrame, got: DataFrame) -> DataFrame:
    """Answer-key events found, of right type, and of right scope. key, got: (judgment_id, provision_id,
    event_type, scope); an event of the key's type is preferred, else the first by type and scope."""
    k = key.withColumn("_k", F.struct("judgment_id", "provision_id", "event_type", "scope"))
    g = got.select("judgment_id", "provision_id", F.struct("event_type", "scope").alias("g"))
    both = k.join(g, ["judgment_id", "provision_id"], "left")
    best = both.groupBy("_k").agg(F.min(F.when(F.col("g").isNotNull(), F.struct((F.col("g.event_type") != F.col("event_type")).alias("other"), F.col("g")))).alias("x"))
    return best.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("x").isNotNull()).alias("found"),
        F.count_if(F.col("x.g.event_type") == F.col("_k.event_type")).alias("type_right"),
        F.count_if(F.col("x.g.scope") == F.col("_k.scope")).alias("scope_right"),
    )


def event_alarms(key: DataFrame, negatives: DataFrame, got: DataFrame) -> DataFrame:
    """(negatives, false_alarms, extras): pairs(judgment_id, provision_id) that hold no event, how many of them got one,
    and the events got in judgments of the key for sections that it does not name."""
    pair = ["judgment_id", "provision_id"]
    alarm = negatives.join(got.select(*pair).distinct().withColumn("_hit", F.lit(True)), pair, "left")
    extra = got.join(key.select("judgment_id").distinct(), "judgment_id", "left_semi").join(key.select(*pair).distinct(), pair, "left_anti")
    return alarm.agg(F.count("*").alias("negatives"), F.count_if("_hit").alias("false_alarms")).crossJoin(extra.agg(F.count("*").alias("extras")))  # each is one row


#: What a citation without a law of its own is said to name.
BARE = ("the Act", "the Code")


def matched_spans(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, number, at, law, got) of gold(doc_id, at, number, law): the law of the span that meets it, and met.

    Golds of a document and number are taken in order of place, and each takes the first span of
    found(doc_id, start, end, number, law), by start and end, that holds its place and is not taken yet.
    """
    keys = ["doc_id", "number"]
    g = gold.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "law"))).alias("golds"))  # of one document each
    s = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "law"))).alias("spans"))
    both = g.join(s, keys, "left")
    free = lambda x, taken: F.array_min(F.filter(F.transform("spans", lambda y, i: F.when((y["start"] <= x["at"]) & (x["at"] < y["end"]) & ~F.array_contains(taken, i), i)), lambda i: i.isNotNull()))
    none = F.array().cast("array<int>")
    picks = F.aggregate("golds", F.struct(none.alias("taken"), none.alias("picks")), lambda a, x: F.struct(*(F.array_append(a[c], F.coalesce(free(x, a["taken"]), F.lit(-1))).alias(c) for c in ("taken", "picks"))), lambda a: a["picks"])
    both = both.withColumn("picks", F.when(F.col("spans").isNotNull(), picks)).select(*keys, "spans", "picks", F.posexplode("golds").alias("i", "gold"))
    pick = F.coalesce(F.get("picks", F.col("i")), F.lit(-1))
    return both.select(*keys, "gold.at", "gold.law", (pick >= 0).alias("met"), F.when(pick >= 0, F.get("spans", pick)["law"]).alias("got"))


def mention_scores(gold: DataFrame, found: DataFrame, held: list[str], bare: tuple[str, ...] = BARE) -> DataFrame:
    """One row: golds matched and missed by matched_spans(), spans extracted and spurious, and the law of matched ones:
    right, wrong, unresolved or, where the gold law is unknown, unscored. Laws that are not held are all alike."""
    met = matched_spans(gold, found).where("met")
    law, got = F.col("law"), F.col("got")
    known = law.isin(*held)
    unscored = law.eqNullSafe(F.lit("unknown"))
    open_ = ~unscored & (got.isNull() | got.isin(*bare))
    right = ~unscored & ~open_ & F.coalesce(F.when(known, got == law).otherwise(~got.isin(*held)), F.lit(False))
    hits = met.agg(F.count("*").alias("matched"), F.count_if(right).alias("law_right"), F.count_if(~unscored & ~open_ & ~right).alias("law_wrong"), F.count_if(open_).alias("law_unresolved"), F.count_if(unscored).alias("law_unscored"))
    sizes = gold.agg(F.count("*").alias("gold")).crossJoin(found.agg(F.count("*").alias("extracted")))  # each is one row
    out = hits.crossJoin(sizes)
    return out.select("gold", "matched", (F.col("gold") - F.col("matched")).alias("missed"), "extracted", (F.col("extracted") - F.col("matched")).alias("spurious"), "law_right", "law_wrong", "law_unresolved", "law_unscored")


def key_errors(events: DataFrame, provisions: DataFrame, texts: DataFrame, types: list[str]) -> DataFrame:
    """(event_key, error): what is wrong with an answer key's events: a quote that its text does not hold, an
    unknown provision, type or scope, a partial scope without words, or a link to no event."""
    e = events.join(texts, "judgment_id", "left").join(provisions.select("provision_id", F.lit(True).alias("_p")).distinct(), "provision_id", "left")
    keys = events.select(F.col("event_key").alias("affects_event"), F.lit(True).alias("_k")).distinct()
    e = left_joined(e, keys, "affects_event", "event_key")
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    checks = [
        (F.col("text").isNull(), "no text"),
        (F.col("text").isNotNull() & ~F.contains(plain("text"), plain("quote")), "quote not found"),
        (F.col("_p").isNull(), "unknown provision"),
        (~F.col("event_type").isin(types), "bad type"),
        (~F.col("scope").isin("total", "partial"), "bad scope"),
        ((F.col("scope") == "partial") & (F.coalesce("scope_text", F.lit("")) == ""), "partial scope needs words"),
        (F.col("affects_event").isNotNull() & F.col("_k").isNull(), "link to no event"),
    ]
    found = F.filter(F.array(*(F.when(bad, F.lit(why)) for bad, why in checks)), lambda x: x.isNotNull())
    return e.select("event_key", F.explode(found).alias("error"))


def multiset_recall(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many expected rows are met by a row of the same keys, each used once, and what is left over."""
    n = lambda df, x: df.groupBy(*keys).agg(F.count("*").alias(x))
    both = n(expected, "e").join(n(got, "g"), keys, "full").fillna(0, ["e", "g"])
    return both.agg(F.sum("e").alias("expected"), F.sum(F.least("e", "g")).alias("met"), F.sum(F.greatest(F.col("g") - F.col("e"), F.lit(0))).alias("extra"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """(qid, invented, sections_found, rulings_found) of answers(qid, refs, seen, expected, key_events)."""
    return answers.select(
        "qid",
        F.size(F.array_except("refs", "seen")).cast("long").alias("invented"),
        F.exists("expected", lambda x: F.array_contains(F.col("refs"), x)).alias("sections_found"),
        (F.size(F.array_except("key_events", "refs")) == 0).alias("rulings_found"),
    )


def planted_quotes(docs: DataFrame, length: int, seed: int = 2026) -> DataFrame:
    """(judgment_id, kind, quote): from each of docs(judgment_id, text) a passage of so many words as it stands
    (control), and the same with a word dropped, swapped or put in; places are chosen by a seeded hash. Texts with fewer
    than two words more are left out."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.select("judgment_id", words.alias("w")).where(F.size("w") >= length + 2)
    start = F.pmod(F.xxhash64(F.lit(seed), "judgment_id"), F.size("w") - length - 1).cast("int") + 1
    at = F.pmod(F.xxhash64(F.lit(seed + 1), "judgment_id"), F.lit(length - 4)).cast("int") + 3
    rows = rows.select("judgment_id", F.slice("w", start, length).alias("p"), at.alias("at"))
    head, rest = F.slice("p", 1, F.col("at") - 1), F.slice("p", F.col("at") + 1, length)
    same = F.slice("p", F.col("at"), 1)
    kinds = [("control", F.col("p")), ("drop a word", F.concat(head, rest)), ("swap a word", F.concat(head, F.array(F.lit("swappedword")), rest)), ("insert a word", F.concat(head, F.array(F.lit("insertedword")), same, rest))]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.array_join(q, " ").alias("quote")) for k, q in kinds)))
    return rows.select("judgment_id", each.alias("x")).select("judgment_id", "x.kind", "x.quote")


def filing_sample(docs: DataFrame, used: DataFrame, sets: int, per_set: int, seed: int = 7) -> DataFrame:
    """(judgment_id, set_no): sets of per_set judgments that cite two cases or more and that no earlier set used, in
    the order of a seeded hash."""
    cites = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[(\d{4})\]\s*eKLR"), F.lit(0))) >= 2
    pool = docs.where(cites).select("judgment_id").join(used, "judgment_id", "left_anti").withColumn("h", F.xxhash64(F.lit(seed), "judgment_id"))
    top = pool.orderBy("h", "judgment_id").limit(sets * per_set)  # then the window sees the sample only
    place = F.row_number().over(Window.orderBy("h", "judgment_id")) - 1
    return top.select("judgment_id", F.floor(place / per_set).cast("int").alias("set_no"))


def answers_by_place(gold: DataFrame, found: DataFrame) -> DataFrame:
    """gold(filing_id, char_start, gold) with verdict: right, wrong or missed by what was found(filing_id, char_start,
    result, judgment_id) at the same place. gold names alternatives, or not_held where nothing should be found."""
    f = found.where("result = 'found'").select("filing_id", "char_start", F.col("judgment_id").alias("_id"))
    out = gold.join(f, ["filing_id", "char_start"], "left")
    held = F.col("gold") != "not_held"
    verdict = F.when(F.col("_id").isNull(), F.when(held, "missed").otherwise("right")).when(held & is_right(F.col("_id"), F.col("gold")), "right").otherwise("wrong")
    return out.select("filing_id", "char_start", "gold", verdict.alias("verdict"))

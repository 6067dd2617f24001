"""What a reader sees: an act's sections, a section's page, sections and cases by the names users give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stareflow.functions import citations as cit
from stareflow.functions import text as tx
from stareflow.operators import relational as rel
from stareflow.operators import status as st

# Words of a title search that tell no case apart.
TITLE_WORD = r"[a-z]{3,}"
WORDS_MOST, TITLES_MOST = 6, 5


def chained(provisions: DataFrame, chains: DataFrame) -> DataFrame:
    """provisions with chain and pos; a provision of no chain is one of its own. chains: (provision_id, chain, pos)."""
    out = provisions.join(chains, "provision_id", "left")
    return out.withColumns({"chain": F.coalesce("chain", "provision_id"), "pos": F.coalesce("pos", F.lit(0))})


def act_sections(provisions: DataFrame, chains: DataFrame, standing: DataFrame, cited: DataFrame) -> DataFrame:
    """Each act's sections(act_id, provision_id, number, heading) by current id only, with status(chain, status),
    cited_by(chain, cited_by) and the place in natural order of numbers."""
    own = chained(provisions, chains)
    last = rel.latest(own, ["chain"], "pos", "provision_id")
    out = last.join(standing, "chain", "left").join(cited, "chain", "left")
    place = Window.partitionBy("act_id").orderBy(rel.natural_number(F.col("number")), "number", "provision_id")
    return out.select("act_id", "provision_id", "number", "heading", F.coalesce("status", F.lit("no_rulings")).alias("status"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"), F.row_number().over(place).alias("place"))


def section_pages(provisions: DataFrame, chains: DataFrame, texts: DataFrame, standing: DataFrame) -> DataFrame:
    """Each section with its latest text(provision_id, version_date, text), its chain's status, and the numbers it had
    before and has next in its chain."""
    own = chained(provisions, chains)
    along = Window.partitionBy("chain").orderBy("pos", "provision_id")
    own = own.withColumns({"was_number": F.lag("number").over(along), "next_number": F.lead("number").over(along)})
    newest = rel.latest(texts, ["provision_id"], "version_date").select("provision_id", "version_date", "text")
    out = own.join(newest, "provision_id", "left").join(standing, "chain", "left")
    return out.select("provision_id", "number", "heading", "version_date", "text", F.coalesce("status", F.lit("no_rulings")).alias("status"), "was_number", "next_number")


def section_records(provisions: DataFrame, told: DataFrame, cited: DataFrame, leads: DataFrame) -> DataFrame:
    """Each of provisions(provision_id, ...) with its whole record: status and summary events from verified events alone,
    history (leads included, newest first) and counts. told: status.with_leads(); cited, leads: (chain, cited_by) and
    (chain, lead_count) of sections that are chains of their own."""
    checked = told.where("verified")
    standing = st.standing(checked).select("provision_id", "status")
    base = st.summary(checked).groupBy("provision_id").agg(F.sort_array(F.collect_list("event_id")).alias("summary"))
    line = F.struct("effective_date", "event_id", "event_type", "state", "superseded_by", "verified")
    past = told.groupBy("provision_id").agg(F.sort_array(F.collect_list(line), asc=False).alias("history"))  # one section's events
    out = provisions.join(standing, "provision_id", "left").join(base, "provision_id", "left").join(past, "provision_id", "left")
    out = out.join(cited.withColumnRenamed("chain", "provision_id"), "provision_id", "left").join(leads.withColumnRenamed("chain", "provision_id"), "provision_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("cited_by", "lead_count")}
    none = F.coalesce("status", F.lit("in force; no recorded court rulings"))
    return out.withColumns(zero | {"status": none, "summary": F.coalesce("summary", F.array().cast("array<bigint>"))})


def held_act(asked: DataFrame, acts: DataFrame) -> DataFrame:
    """asked(ask_id, act, ...) with act_id, or null: by the names that citations use, then a held Cap. number, then a
    held title as a whole. acts: (act_id, title)."""
    name = F.regexp_replace(F.regexp_replace(F.col("act"), r"(?i)\bNo\.?\s*\d+\s+of\s+\d{4}|\(.*?\)|,?\s*\d{4}\s*$", ""), r"(?i)\bCode\s+Act\b", "Code")
    slug = cit.law_slug(name)
    cap = F.nullif(F.lower(F.regexp_extract("act", r"(?i)\bcap\.?\s*(\d+[a-z]?)\b", 1)), F.lit(""))
    tries = F.array(F.concat(F.lit("ke/act/"), slug), F.concat(F.lit("ke/act/cap-"), cap))
    keys = acts.groupBy(tx.act_key(F.col("title")).alias("_key")).agg(F.min("act_id").alias("_titled"))
    out = asked.withColumns({"_key": tx.act_key(name), "_try": F.get(F.filter(tries, lambda x: x.isNotNull()), F.lit(0))})
    held = acts.select(F.col("act_id").alias("_try"), F.lit(True).alias("_held")).distinct()
    out = out.join(held, "_try", "left").join(keys, "_key", "left")
    return out.withColumn("act_id", F.when(F.col("_try").isNull(), F.col("_titled")).when(F.col("_held"), F.col("_try"))).drop("_key", "_try", "_titled", "_held")


def find_sections(asked: DataFrame, acts: DataFrame, provisions: DataFrame, chains: DataFrame) -> DataFrame:
    """(ask_id, found, reason, ids) for asked(ask_id, act, section): the current ids that bear the number, two or more
    being ambiguous; else why there is none: act_not_recognised, no_section_number, section_not_held."""
    a = held_act(asked, acts).withColumn("number", F.nullif(F.regexp_extract(F.upper("section"), r"\d+[A-Z]{0,2}", 0), F.lit("")))
    own = chained(provisions, chains)
    now = rel.latest(own, ["chain"], "pos", "provision_id").select("chain", F.col("provision_id").alias("current"))
    ids = own.join(now, "chain").groupBy("act_id", "number").agg(F.sort_array(F.collect_set("current")).alias("ids"))  # ids of one number in one act
    out = a.join(ids, ["act_id", "number"], "left")
    reason = F.when(F.col("act_id").isNull(), "act_not_recognised").when(F.col("number").isNull(), "no_section_number").when(F.col("ids").isNull(), "section_not_held").when(F.size("ids") > 1, "ambiguous")
    return out.select("ask_id", F.col("ids").isNotNull().alias("found"), reason.alias("reason"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def _words_of(x: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(rf"\b{TITLE_WORD}\b"), F.lit(0)), lambda w: ~w.isin(*tx.NOT_A_PARTY)))


def find_titles(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """(ask_id, title_id, hits, confirmed, year_mismatch) for asked(ask_id, name): the first TITLES_MOST of titles(
    title_id, title, year) that hold all asked words, or where none does and three or more are asked, all but one: those of
    the asked year first, then with a checked ruling (a column ruled, if there is one), then the newest (a column day).
    A title is of a year that it names in brackets, or in which it was decided.

    Filters narrow the titles that hold all words until one is left: every word of the span 'X v Y', the span as the
    title's beginning, then the year in brackets. The only title left is confirmed; if its year is another, it is a year mismatch instead. Words
    find titles by an equi-join.
    """
    span = tx.party_span(F.col("name"))
    year = F.nullif(F.regexp_extract("name", r"[\[(]\s*((?:19|20)\d\d)\s*[\])]", 1), F.lit("")).cast("int")
    a = asked.select("ask_id", F.lower(span).alias("span"), year.alias("asked_year"), F.slice(_words_of(F.coalesce(span, F.col("name"))), 1, WORDS_MOST).alias("words")).where(F.size("words") > 0)
    ruled = F.coalesce(F.col("ruled"), F.lit(False)) if "ruled" in titles.columns else F.lit(False)
    day = F.col("day").cast("date") if "day" in titles.columns else F.lit(None).cast("date")
    t = titles.select("title_id", "title", "year", ruled.alias("ruled"), day.alias("day"), F.explode(_words_of(F.col("title"))).alias("word"))
    hit = a.select("*", F.explode("words").alias("word")).join(t, "word")
    hit = hit.groupBy("ask_id", "title_id").agg(F.count("*").cast("int").alias("hits"), *(F.first(c).alias(c) for c in ("span", "asked_year", "title", "year", "ruled", "day")), F.first(F.size("words")).alias("n"))
    hit = hit.where(F.col("hits") >= F.when(F.col("n") >= 3, F.col("n") - 1).otherwise(F.col("n")))
    low = F.lower("title")
    after = F.substr(low, F.length("span") + 1, F.lit(3))
    as_span = F.col("span").isNull() | (low.startswith(F.col("span")) & ((after == "") | (after == " v ") | after.rlike(r"^(\(|\[| &| \(| \[)")))
    full = F.col("hits") == F.col("n")
    every = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"\b{TITLE_WORD}\b"), F.lit(0))
    spanned = F.size(F.array_except(every(F.col("span")), every(low))) == 0
    in_year = (F.col("year") == F.col("asked_year")) | F.contains("title", F.concat(F.lit("["), F.col("asked_year").cast("string")))
    each = Window.partitionBy("ask_id")
    hit = hit.withColumns({"f1": full & spanned, "f2": full & spanned & as_span, "f3": full & spanned & as_span & F.coalesce(in_year, F.lit(False))})
    hit = hit.withColumns({f"n{i}": F.count_if(f"f{i}").over(each) for i in (1, 2, 3)})
    # The first filter that leaves one decides; one that leaves none ends the search.
    one = F.when(F.col("n1") == 1, F.col("f1")).when(F.col("n2") == 1, F.col("f2")).when((F.col("n2") > 1) & F.col("asked_year").isNotNull() & (F.col("n3") == 1), F.col("f3")).otherwise(False)
    wrong = one & F.col("asked_year").isNotNull() & ~F.coalesce(in_year, F.lit(False))
    keep = (F.col("n1") == 0) | full
    order = Window.partitionBy("ask_id").orderBy(F.desc("hits"), F.desc("_year"), F.desc("ruled"), F.desc_nulls_last("day"), "title_id")
    out = hit.where(keep).withColumns({"_year": F.coalesce(in_year, F.lit(False)), "_one": one, "_wrong": wrong})
    out = out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= TITLES_MOST)
    return out.select("ask_id", "title_id", "hits", (F.col("_one") & ~F.col("_wrong")).alias("confirmed"), F.col("_wrong").alias("year_mismatch"))


def find_cases(cited: DataFrame, titled: DataFrame, events: DataFrame) -> DataFrame:
    """(ask_id, judgment_ids, ambiguous, n_events) for every asked case: judgments found by citation(ask_id, judgment_id)
    go first, else the confirmed titles of find_titles(); rulings(judgment_id, verified) only of confirmed ones."""
    sure = cited.select("ask_id", "judgment_id").where("judgment_id IS NOT NULL")
    rest = titled.join(sure.select("ask_id").distinct(), "ask_id", "left_anti")
    several = rest.groupBy("ask_id").agg((F.count_if("confirmed") == 0).alias("none"), F.count("*").alias("n"))
    ids = sure.unionByName(rest.where("confirmed").select("ask_id", F.col("title_id").alias("judgment_id"))).distinct()
    rulings = events.where("verified").groupBy("judgment_id").agg(F.count("*").alias("n_events"))
    found = ids.join(rulings, "judgment_id", "left").groupBy("ask_id").agg(F.sort_array(F.collect_set("judgment_id")).alias("judgment_ids"), F.sum(F.coalesce("n_events", F.lit(0))).alias("n_events"))
    out = found.join(several, "ask_id", "full")
    return out.select("ask_id", F.coalesce("judgment_ids", F.array().cast("array<bigint>")).alias("judgment_ids"), F.coalesce(F.col("none") & (F.col("n") > 1), F.lit(False)).alias("ambiguous"), F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"))


def standing_by_rules(events: DataFrame, rules: dict) -> DataFrame:
    """The standing of sections whose id begins with a jurisdiction that has rules: {prefix: events -> standing}."""
    out = None
    for prefix, rule in sorted(rules.items()):
        some = rule(events.where(F.col("provision_id").cast("string").startswith(prefix)))
        out = some if out is None else out.unionByName(some)
    return out


def status_export(events: DataFrame) -> DataFrame:
    """(provision_id, status, rulings): each section's standing beside its events in order of date, for an audit."""
    told = st.history(events)
    rows = events.groupBy("provision_id").agg(F.sort_array(F.collect_list(F.struct("effective_date", "event_id", "event_type"))).alias("rulings"))  # the export's row is the section's history
    return st.standing(told).select("provision_id", "status").join(rows, "provision_id")


def appeal_cases(judgments: DataFrame, order: list[str]) -> DataFrame:
    """(party, rulings, place) of parties with more than one judgment(judgment_id, court, party): distinct ones in the
    order of courts, the lowest first."""
    row = F.struct((-rel.list_position(F.col("court"), order)).alias("court"), "judgment_id")
    out = judgments.groupBy("party").agg(F.sort_array(F.collect_set(row)).alias("r")).where(F.size("r") > 1)
    return out.select("party", F.transform("r", lambda r: r["judgment_id"]).alias("rulings"))


def held_names(acts: DataFrame) -> DataFrame:
    """(name, title): the lower-cased ids and titles by which an answer may name a held act."""
    return acts.select(F.explode(F.array(F.lower("act_id"), F.lower("title"))).alias("name"), "title").distinct()


def invented(refs: DataFrame, seen: DataFrame, acts: DataFrame) -> DataFrame:
    """References(answer_id, kind, id) that no tool returned(answer_id, kind, id) and that are not held acts' names."""
    rest = refs.join(seen, ["answer_id", "kind", "id"], "left_anti")
    named = held_names(acts).select(F.lit("act").alias("kind"), F.col("name").alias("_name"))
    return rest.withColumn("_name", F.lower("id")).join(named, ["kind", "_name"], "left_anti").drop("_name")

"""Standing of a section from the history of rulings and statutes that touch it.

An event stops counting when a later appeal reverses it, or when a later ruling of an equal or higher
court points the other way on the same point. What is left gives one label. All of it is relational.
The search for the first displacing ruling runs on distinct (date, issue, direction, rank) rows of a
section, of which there are few however many events a section has, so a section that holds a large
part of all events is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event types by what they do, and the ranks of courts.
STATUTORY = ["repealed_by_statute", "amended_by_statute"]
LIMITING = ["declared_unconstitutional", "read_down", "severed", "repealed_by_statute"]
VALIDATING = ["upheld", "reversed_on_appeal"]
RANKS = {"Supreme Court": 3, "Court of Appeal": 2, "High Court": 1}

_NO_DAY = -(10**7)  # an unknown date stands before all others


def court_rank(court: Column) -> Column:
    found = F.lit(0)
    for name, rank in RANKS.items():
        found = F.when(court == name, rank).otherwise(found)
    return found


def direction(event_type: Column) -> Column:
    return F.when(event_type.isin(LIMITING), "limits").when(event_type.isin(VALIDATING), "validates")


def pull(event_type: Column, stance: Column) -> Column:
    """The way an event pushes others: its direction, or for an interpretation its stance."""
    return F.when((event_type == "interpreted") & (F.coalesce(stance, F.lit("")) != ""), stance).otherwise(direction(event_type))


def is_statutory(event_type: Column) -> Column:
    return event_type.isin(STATUTORY)


def _day(date: Column) -> Column:
    return F.coalesce(F.unix_date(date), F.lit(_NO_DAY))


def reversals(events: DataFrame, counted: dict[str, Column]) -> DataFrame:
    """(provision_id, event_id, a column for each kind of counted events): of each event that an appeal in the same section
    reverses, the last such appeal among those counted."""
    rev = events.where((F.col("event_type") == "reversed_on_appeal") & F.col("affects_event_id").isNotNull())
    order = F.struct(_day(F.col("effective_date")), "event_id")
    last = [F.max_by("event_id", F.when(which, order)).alias(name) for name, which in counted.items()]
    return rev.groupBy("provision_id", F.col("affects_event_id").alias("event_id")).agg(*last)


def displacements(events: DataFrame, counted: dict[str, Column]) -> DataFrame:
    """(provision_id, day, dir, rank, issue, a column for each kind of counted events): for each kind of event that a
    section has, the first later ruling among those counted that displaces it, if any. All are found in one pass."""
    kinds = events.where(~is_statutory(F.col("event_type"))).select(
        "provision_id",
        _day(F.col("effective_date")).alias("day"),
        direction(F.col("event_type")).alias("dir"),
        pull(F.col("event_type"), F.col("stance")).alias("pull"),
        F.nullif("issue", F.lit("")).alias("issue"),
        "rank",
        *(F.when(which, F.col("event_id")).alias(name) for name, which in counted.items()),
    )
    kinds = kinds.groupBy("provision_id", "day", "dir", "pull", "issue", "rank").agg(*(F.min(name).alias(name) for name in counted))
    later = Window.partitionBy("provision_id").orderBy("day").rangeBetween(1, Window.unboundedFollowing)
    on_issue = Window.partitionBy("provision_id", "issue").orderBy("day").rangeBetween(1, Window.unboundedFollowing)
    firsts = {}
    for name in counted:
        what, first = F.struct("day", F.col(name).alias("event_id")), None
        for way, against in (("limits", "validates"), ("validates", "limits")):
            for rank in (3, 2, 1, 0):
                hit = (F.col("pull") == against) & (F.col("rank") >= rank) & F.col(name).isNotNull()
                anything = F.min(F.when(hit, what)).over(later)
                unlabelled = F.min(F.when(hit & F.col("issue").isNull(), what)).over(later)
                same = F.min(F.when(hit, what)).over(on_issue)
                best = F.when(F.col("issue").isNull(), anything).otherwise(F.least(unlabelled, same))
                case = (F.col("dir") == way) & (F.col("rank") == rank)
                first = F.when(case, best) if first is None else first.when(case, best)
        firsts[f"_{name}"] = first
    kinds = kinds.withColumns(firsts).where(" OR ".join(f"{c} IS NOT NULL" for c in firsts))
    return kinds.groupBy("provision_id", "day", "dir", "rank", "issue").agg(*(F.min(F.col(f"_{name}")["event_id"]).alias(name) for name in counted))


def _told(events: DataFrame, counted: dict[str, Column], choose) -> DataFrame:
    """events with state and superseded_by; choose picks the column of counted events that a row goes by."""
    keyed = events.withColumns({"_day": _day(F.col("effective_date")), "_dir": F.when(~is_statutory(F.col("event_type")), direction(F.col("event_type"))), "_issue": F.coalesce(F.nullif("issue", F.lit("")), F.lit(""))})
    back = reversals(events, counted).select("provision_id", "event_id", *(F.col(n).alias(f"_r_{n}") for n in counted))
    moved = displacements(events, counted).select("provision_id", F.col("day").alias("_day"), F.col("dir").alias("_dir"), "rank", F.coalesce("issue", F.lit("")).alias("_issue"), *(F.col(n).alias(f"_d_{n}") for n in counted))
    out = keyed.join(back, ["provision_id", "event_id"], "left").join(moved, ["provision_id", "_day", "_dir", "rank", "_issue"], "left")
    reverser, displacer = choose("_r_"), choose("_d_")
    state = F.when(reverser.isNotNull(), "reversed on appeal").when(displacer.isNotNull(), "displaced by a later ruling").otherwise("in effect")
    return out.withColumns({"state": state, "superseded_by": F.coalesce(reverser, displacer)}).select(*events.columns, "state", "superseded_by")


def history(events: DataFrame) -> DataFrame:
    """events with state and superseded_by.

    events: provision_id, event_id, event_type, scope, rank, effective_date, issue, stance,
    affects_event_id; other columns pass through.
    """
    return _told(events, {"every": F.lit(True)}, lambda kind: F.col(f"{kind}every"))


def standing(told: DataFrame) -> DataFrame:
    """(provision_id, status, n_events, n_reversed, n_displaced) of a history."""
    kind, live = F.col("event_type"), F.col("state") == "in effect"
    target = told.select("provision_id", F.col("event_id").alias("affects_event_id"), direction(F.col("event_type")).alias("_target"), F.lit(True).alias("_known"))
    seen = told.join(target, ["provision_id", "affects_event_id"], "left")
    undid = (kind == "reversed_on_appeal") & (F.col("_known").isNull() | (F.col("_target") == "limits"))
    facts = seen.groupBy("provision_id").agg(
        F.bool_or(live & (kind == "repealed_by_statute") & (F.col("scope") == "total")).alias("repealed"),
        F.bool_or(live & (kind == "declared_unconstitutional") & (F.col("scope") == "total")).alias("declared"),
        F.bool_or(live & (direction(kind) == "limits") & ~is_statutory(kind)).alias("limited"),
        F.bool_or(live & (kind == "reversed_on_appeal")).alias("reversed"),
        F.bool_or(live & undid).alias("undid"),
        F.bool_or(live & (kind == "upheld")).alias("upheld"),
        F.bool_or(~is_statutory(kind)).alias("court"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("state") == "reversed on appeal").alias("n_reversed"),
        F.count_if(F.col("state") == "displaced by a later ruling").alias("n_displaced"),
    )
    status = (
        F.when(F.col("repealed"), "repealed")
        .when(F.col("declared"), "declared unconstitutional")
        .when(F.col("limited"), "limited by a court")
        .when(F.col("reversed") & F.col("undid"), "in force; earlier court limits were reversed")
        .when(F.col("reversed"), "in force; a lower court's ruling on it was set aside on appeal")
        .when(F.col("upheld"), "in force; its validity has been tested in court")
        .when(F.col("court"), "in force; interpreted by a court")
        .otherwise("in force; no recorded court rulings")
    )
    return facts.select("provision_id", status.alias("status"), "n_events", "n_reversed", "n_displaced")


def summary(told: DataFrame) -> DataFrame:
    """(provision_id, event_id): the events that a section's label rests on, and interpretations beside them.

    Of live events: total repeals; else limits; else court events with a direction; else court events.
    Limits leave statutes out unless the label is "declared unconstitutional"; live interpretations
    come along unless the section is repealed.
    """
    kind = F.col("event_type")
    live = told.where("state = 'in effect'").select(
        "provision_id",
        "event_id",
        ((kind == "repealed_by_statute") & (F.col("scope") == "total")).alias("repeal"),
        (direction(kind) == "limits").alias("limit"),
        ((kind == "declared_unconstitutional") & (F.col("scope") == "total")).alias("declared"),
        (~is_statutory(kind)).alias("court"),
        direction(kind).isNotNull().alias("directed"),
        (kind == "interpreted").alias("reads"),
    )
    live = live.fillna(False, ["limit"])
    found = live.groupBy("provision_id").agg(
        F.bool_or("repeal").alias("any_repeal"),
        F.bool_or("declared").alias("any_declared"),
        F.bool_or(F.col("limit") & F.col("court")).alias("any_limit"),
        F.bool_or(F.col("court") & F.col("directed")).alias("any_directed"),
    )
    own = (
        F.when(F.col("any_repeal"), F.col("repeal"))
        .when(F.col("any_declared"), F.col("limit"))
        .when(F.col("any_limit"), F.col("limit") & F.col("court"))
        .when(F.col("any_directed"), F.col("court") & F.col("directed"))
        .otherwise(F.col("court"))
    )
    return live.join(found, "provision_id").where(own | (F.col("reads") & ~F.col("any_repeal"))).select("provision_id", "event_id")


def with_leads(events: DataFrame) -> DataFrame:
    """History where verified events are judged among verified ones only; leads get the state that
    they would have among all. Both are found in one pass over the events."""
    counted = {"every": F.lit(True), "checked": F.col("verified")}
    return _told(events, counted, lambda kind: F.when(F.col("verified"), F.col(f"{kind}checked")).otherwise(F.col(f"{kind}every")))


def visible(events: DataFrame, judgments: DataFrame, include_unverified: bool = False) -> DataFrame:
    """Events of judgments that are no duplicate, and statutory ones without a judgment: verified, or if
    asked for unverified ones whose second check did not fail."""
    fine = F.col("verified")
    if include_unverified:
        fine = fine | ~F.col("check_verdict").eqNullSafe(F.lit("fail"))
    return events.join(judgments.select("judgment_id", "duplicate_of"), "judgment_id", "left").where(fine & F.col("duplicate_of").isNull()).drop("duplicate_of")


def one_per_ruling(events: DataFrame) -> DataFrame:
    """One event for each section, ruling and type: the manual one first, then the smallest id."""
    ruling = F.coalesce(F.col("judgment_id").cast("string"), F.col("event_key").cast("string"), F.col("event_id").cast("string"))
    first = F.min(F.struct((F.col("method") != "manual").alias("later"), "event_id"))
    best = events.groupBy("provision_id", ruling.alias("ruling"), "event_type").agg(first.alias("best"))
    keep = best.select("provision_id", F.col("best.event_id").alias("event_id"))
    return events.join(keep, ["provision_id", "event_id"], "left_semi")


def one_per_chain(events: DataFrame, members: DataFrame) -> DataFrame:
    """(chain, events): a renumbered section's events; one seen under an earlier id is left out under a
    later one, while repeats under one id stay. members: (chain, pos, provision_id)."""
    same = F.coalesce(F.col("judgment_id").cast("string"), F.concat_ws("|", F.coalesce("source_paragraph", F.lit("")), F.coalesce(F.col("effective_date").cast("string"), F.lit(""))))
    own = events.join(members, "provision_id").withColumn("_same", same)
    first = own.groupBy("chain", "_same", "event_type").agg(F.min("pos").alias("_first"))
    return own.join(first, ["chain", "_same", "event_type"]).where("pos = _first").drop("_same", "_first")

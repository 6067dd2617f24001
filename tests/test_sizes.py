"""Work that must not grow faster than the tables: many copies of a key, and what passes through the driver."""

import pyarrow as pa
from pyspark.sql import functions as F

from stareflow.functions import citations as cit
from stareflow.functions import text as tx
from stareflow.operators import filing as fi
from stareflow.operators import matching as mt
from stareflow.operators import relational as rel
from stareflow.operators import sequences as seq


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_that_many_titles_share_are_compared_once(spark):
    n = 30_000  # row by row, n * n pairs
    titles = spark.range(n).selectExpr("id AS title_id", "IF(id = 7, 2001, 2000) AS year", "array('otieno', IF(id = 9, 'kamau', 'wanjiru')) AS words", "IF(id < 3, '4 of 2000', NULL) AS number")
    cited = spark.range(n).selectExpr("id AS cite_id", "IF(id = 7, 2001, 2000) AS year", "array('wanjiru', IF(id = 9, 'kamau', 'otieno')) AS words", "IF(id = 1, '4 of 2000', NULL) AS number")
    found = mt.name_match(cited, titles).select("cite_id", "result", "ids")
    assert found.where("result = 'not_in_collection' AND ids = array()").count() == n - 1
    assert [(r.result, r.ids) for r in found.where("cite_id = 9").collect()] == [("found", [9])]


def test_a_possible_match_names_the_least_ids_and_numbers_come_first(spark):
    rows = [(i, 2000, ["otieno"] if i > 4 else ["kamau"], "4 of 2000" if i in (8, 9) else None) for i in range(10)] + [(i, 1999, [f"w{i}"], None) for i in range(10, 200)]
    titles = spark.createDataFrame(rows, "title_id long, year int, words array<string>, number string")
    cited = spark.createDataFrame([(1, 2000, ["otieno"], None), (2, 2000, ["otieno"], "4 of 2000"), (3, 2000, ["unheard"], "4 of 2000"), (4, 2000, ["kamau"], "4 of 2000"), (5, None, ["kamau"], None)], "cite_id long, year int, words array<string>, number string")
    got = {r.cite_id: (r.result, r.ids) for r in mt.name_match(cited, titles).collect()}
    possible = "possible_match"
    assert got == {1: (possible, [5, 6, 7]), 2: (possible, [5, 6, 7]), 3: (possible, [8, 9]), 4: (possible, [0, 1, 2]), 5: ("not_in_collection", [])}


def test_sections_are_joined_by_a_shuffle(spark):
    notes = spark.range(5).selectExpr("'a' AS act_id", "'2020-01-01' AS version_date", "id AS file_no", "0 AS note_no", "concat('sec_', id, '__p_1') AS eid", "'[Act No. 3 of 2003]' AS text")
    sections = spark.range(5).selectExpr("'a' AS act_id", "concat('sec_', id) AS eid")
    found = seq.statutory_events(notes, sections)
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted(r.provision_id for r in found.collect()) == [f"a/sec_{i}" for i in range(5)]


def test_a_filing_is_searched_once(spark):
    filings = spark.createDataFrame([(1, "As in Okuta v Otieno [2015] eKLR and [2018] KESC 4 (KLR) it was said.")], "filing_id long, text string")
    titles = spark.createDataFrame([(4, "[2018] KESC 4 (KLR)", "Mwangi v Okuta [2018] KESC 4 (KLR)", 2018, None)], "title_id long, citation string, title string, year int, number string")
    cases = fi.cited_cases(filings)
    results = fi.case_results(cases, titles)
    for df in (cases, results, fi.budgeted(fi.quotes_given(filings, cases), results)):
        assert "regexp_extract_all" not in plan(df)
    assert {r.case_no: r.result for r in results.collect()} == {0: "not_in_collection", 1: "found"}


def test_batches_are_python_objects_a_few_at_a_time():
    seen = []

    def lengths(texts):
        seen.append(len(texts))
        return pa.array([len(t or "") for t in texts])

    assert tx.in_slices(pa.array(["ab", None] * 100), lengths, 64).to_pylist() == [2, 0] * 100
    assert seen == [64, 64, 64, 8] and tx.in_slices(pa.array([], pa.string()), lambda t: pa.array(t, pa.int64())).to_pylist() == []


def test_mentions_take_no_expression_over_arrays_for_each_row(spark):
    docs = spark.createDataFrame([(1, "Under the Penal  Code, ss. 12, Article 5 and s. 7(2) of the Act. So do ss. 12–14 of it."), (2, None), (3, "Nothing."), (4, "")], "doc_id long, text string").selectExpr("*", "DATE '2020-01-01' AS decision_date")
    found = cit.mentions(docs)
    assert "lambdafunction" not in plan(found)
    assert sorted(((r.doc_id, r.section_ref, r.act_slug) for r in found.collect()), key=str) == [(1, n, slug) for n, slug in (("12", None), ("12", None), ("13", None), ("14", None), ("5", "constitution"), ("7(2)", None))]


def test_a_law_is_told_by_the_longest_end_that_is_known(spark):
    names = ["The  Kenyan Constitution", "Constitution of Kenya, 2010", "old SOA", "xsoa", "Elections Act", "My Elections Act", "Information and Communications Act", None, ""]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").select("i", cit.law_slug(F.col("name")).alias("slug"))
    assert "lambdafunction" not in plan(got)
    assert [r.slug for r in got.orderBy("i").collect()] == ["constitution", "constitution", "cap-63a", None, "cap-7", None, "cap-411a", None, None]


def test_texts_without_a_head_are_not_searched_for_citations(monkeypatch):
    monkeypatch.setattr(cit, "_CITATION", None)
    assert cit.scan("Under the Employment Act the court sat. 1. One. 2. Two.") and cit.scan("nothing is numbered") == []


def test_places_and_names_take_no_expression_over_words_for_each_row(spark):
    texts = ["In Okuta v Otieno  [2018]  KESC 4 (KLR) and [2015] eKLR", "v Republic v Otieno [2018] KESC 4", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", tx.found_at(F.col("t"), tx.NEUTRAL, tx.EKLR).alias("at"), tx.parts_between(F.col("t"), r"\s+and\s+").alias("parts"), tx.name_before(F.col("t"), F.position(F.lit("["), F.col("t")) - 1).alias("name"))
    assert plan(got).count("lambdafunction") <= 4 and "regexp_extract_all" not in plan(got)
    rows = [([tuple(a) for a in r["at"]], [tuple(p) for p in r.parts], r.name) for r in got.orderBy("i").collect()]
    assert rows[0][0][1][2] == "[2015] eKLR" and all(texts[0][a:b] == raw for a, b, raw in rows[0][0] + rows[0][1]) and rows[0][2] == "Okuta v Otieno"
    assert rows[1][2] is None and rows[2] == ([], [(0, 0, "")], None)


def most_in_a_partition(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    n = 4_000
    events = spark.range(n).selectExpr("CAST(id AS STRING) AS event_key", "IF(id % 9 = 0, CAST(id + 9 AS STRING), NULL) AS affects_event")
    keys = events.select(F.col("event_key").alias("affects_event"), F.lit(True).alias("_k")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert most_in_a_partition(events.join(keys, "affects_event", "left")) > n * 8 / 9
        found = rel.left_joined(events, keys, "affects_event", "event_key")
        assert most_in_a_partition(found) < n / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found.count() == n and found.where("_k").count() == found.where("affects_event IS NOT NULL").count() - 1


def test_the_one_stream_holds_few_calls_of_a_moment(spark, monkeypatch):
    sizes, limited = [], seq.rate_limited
    monkeypatch.setattr(seq, "rate_limited", lambda calls, *limits: sizes.append(calls.count()) or limited(calls, *limits))
    calls = spark.range(3_000).selectExpr("CAST(id AS STRING) AS key", "CAST(id % 10 AS DOUBLE) AS at", "id")
    found = seq.both_limits(calls, 2, 4, 5.0)
    assert sizes == [3_000, 40]
    assert sorted((r.at, r.id) for r in found.where("allowed").collect()) == [(t, t + 10 * i) for t in (0, 6) for i in range(4)] and found.count() == 3_000


def test_a_numbering_is_looked_for_only_where_it_can_begin(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.texts = pattern, 0

        def finditer(self, text):
            self.texts += 1
            return self.pattern.finditer(text)

    counted = {style: Counted(pattern) for style, pattern in cit._PARAGRAPH.items()}
    monkeypatch.setattr(cit, "_PARAGRAPH", counted)
    assert cit._paragraphs("Section 22 of the Penal Code [2018] applies. 2. Next (3) one.") == []
    assert sum(c.texts for c in counted.values()) == 0
    assert cit._paragraphs("Held: 1. The first. 2. The next.") == [(6, 1), (20, 2)]
    assert cit._paragraphs("\u0661. The first. 02. The next.") == [(0, 1), (14, 2)]
    assert cit._paragraphs("".join(f"[{n}] So it was. " for n in range(1, 7)))[0] == (0, 1)


def test_a_draft_s_text_and_parts_are_read_once(spark, monkeypatch):
    from stareflow.operators import drafts as dr

    calls = {"spans": 0, "placed": 0}

    def counted(name):
        own = getattr(dr, name)

        def step(*args):
            calls[name] += "end" not in args[0].columns if name == "spans" else "case_no" in args[0].columns
            return own(*args)

        monkeypatch.setattr(dr, name, step)

    counted("spans"), counted("placed")
    parts = spark.sql("SELECT 1L AS draft_id, 0 AS part_no, 'text' AS kind, 'See [2018] KESC 4 (KLR) here.' AS text, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS STRING) AS quote, CAST(NULL AS STRING) AS provision_id")
    cases = spark.sql("SELECT 1L AS draft_id, 0 AS case_no, 4 AS char_start, '[2018] KESC 4 (KLR)' AS raw_text, 'found' AS result")
    quotes = spark.sql("SELECT 1L AS draft_id, 0 AS case_no, 'a b c d e f g h' AS quote, 'verbatim' AS result").where("false")
    sections = spark.sql("SELECT 1L AS draft_id, 0 AS char_start, '' AS raw_text, 'p' AS provision_id, 'a' AS act_ref, 's' AS status").where("false")
    limits = spark.sql("SELECT 'p' AS provision_id, 1L AS event_id, 'upheld' AS event_type")
    found = dr.draft_items(parts, cases, quotes, sections, limits)
    assert [tuple(r) for r in found.collect()] == [(1, "[2018] KESC 4 (KLR)", "case", "found", False, [])]
    assert calls == {"spans": 1, "placed": 1}


def test_a_citation_s_row_is_whole_without_a_shuffle(spark):
    text = "1. The Evidence Act and the Traffic Code. 2. Section 4 of the Act, s. 5 of the Code. Under the Act 3. Sections 6 to 7 of the Act."
    docs = spark.createDataFrame([(1, text), (2, "Section 8 of the Act. The Evidence Act.")], "doc_id long, text string").selectExpr("*", "DATE '2020-01-01' AS decision_date")
    found = cit.mentions(docs)
    assert "Exchange" not in plan(found) and "Window" not in plan(found)
    got = sorted(((r.doc_id, r.paragraph, r.section_ref, r.act_ref, r.act_slug, r.confidence) for r in found.collect()), key=str)
    act, code, none = ("Evidence Act", "cap-80", 0.6), ("Traffic Code", None, 0.6), ("the Act", None, 0.0)
    assert got == [(1, "2", "4", *act), (1, "2", "5", *code), (1, "3", "6", *act), (1, "3", "7", *act), (2, None, "8", *none)]


def test_a_law_before_a_head_is_looked_for_only_where_one_can_stand(monkeypatch):
    want = cit.scan("See Penal Code, section 5 and Article 6.")
    assert want[0][3] == "See Penal Code, section 5 and Article 6" and want[0][9] == "See Penal Code"
    monkeypatch.setattr(cit, "_CITATION", None)
    found = cit.scan("See sections 5 of the Penal Code. So does SECTION 7 and Article 6 of the Rules.")
    assert [(r[3], r[9]) for r in found] == [("sections 5 of the Penal Code", "Penal Code"), ("SECTION 7 and Article 6 of the Rules", "Rules")]


def test_a_filing_s_cases_are_numbered_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(fi, "staged", lambda df: df)
    filings = spark.createDataFrame([(1, "As in Okuta v Otieno [2015] eKLR and [2018] KESC 4 (KLR), then [2016] eKLR."), (2, "[2018] KESC 5 (KLR)"), (3, None)], "filing_id long, text string")
    cases = fi.cited_cases(filings)
    assert "Exchange" not in plan(cases) and "Window" not in plan(cases)
    got = [(r.filing_id, r.case_no, r.raw_text, r.name) for r in cases.orderBy("filing_id", "case_no").collect()]
    assert got == [(1, 0, "[2015] eKLR", "Okuta v Otieno"), (1, 1, "[2018] KESC 4 (KLR)", None), (1, 2, "[2016] eKLR", None), (2, 0, "[2018] KESC 5 (KLR)", None)]

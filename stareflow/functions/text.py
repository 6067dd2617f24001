"""Scalar functions on titles, numbers, URLs and quotes, as Spark expressions where these can say it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that tell no parties apart, court words before a number, and citation forms.
NOT_A_PARTY = (
    "and another others the of in see per also held case matter court supreme appeal high republic attorney general state county government director public "
    "prosecutions dpp ors anor ltd limited kenya commission national ex parte re klr eklr ag petition civil criminal application suit cause misc miscellaneous "
    "hccc constitutional election judicial review succession reference no consolidated formerly number"
).split()
NEUTRAL = r"\[(\d{4})\]\s*([A-Z]{2,9})\s+(\d+)(?:\s*\(KLR\))?"
WHOLE_NEUTRAL = rf"^{NEUTRAL}$"
CASE_NUMBER = r"(?:No\.?\s*)?\b([A-Z]?\d+[A-Z]?)\s+of\s+((?:19|20)\d{2})\b"
PLACEHOLDER = r"^(spent|deleted|repealed)\b"
HEADING_ALIASES = {"employment and labour relations court": "industrial court"}
TRIGGER = (
    r"(?i)unconstitutional|null and void|inconsistent with the (?:letter and spirit of the )?constitution|read (?:down|so as)|interpreted so as"
    r"|constitutional validity|constitutionality of|per incuriam|we declare|I declare|declaration (?:is|be) (?:hereby )?issued"
    r"|life imprisonment (?:translates|means)|mandatory (?:nature|minimum)|minimum (?:mandatory )?sentence"
)


#: Texts of an Arrow batch that are Python objects at once; a batch may hold ten thousand.
SLICE = 64


def in_slices(values: pa.Array, make: Callable[[list], pa.Array], size: int = SLICE) -> pa.Array:
    """make() of a batch's values, of few at a time: what it makes of them is many times as large before it is Arrow again."""
    return pa.concat_arrays([make(values.slice(i, size).to_pylist()) for i in range(0, max(1, len(values)), size)])


def clean(x: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def reader_quote(x: Column) -> Column:
    """As a reader compares quotes: case, spacing, curly quotes and dashes do not matter."""
    return clean(F.translate(F.lower(x), "‘’“”–—", "''\"\"--"))


def act_heading(x: Column) -> Column:
    """'204. Punishment of murder' as (number, heading); without a number the heading is the whole."""
    number = F.regexp_extract(F.coalesce(x, F.lit("")), r"^(\d+[A-Z]*)\.\s*(.*)$", 1)
    rest = F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"^(\d+[A-Z]*)\.\s*(.*)$", 2), F.lit(""))
    return F.struct(F.nullif(number, F.lit("")).alias("number"), F.when(number != "", rest).otherwise(x).alias("heading"))


def plain_heading(x: Column) -> Column:
    """A heading as it is compared between versions."""
    out = F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))
    for a, b in HEADING_ALIASES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def case_number(x: Column) -> Column:
    """The last 'N of YYYY' in a text; its kind is dropped."""
    at = F.size(F.regexp_extract_all(x, F.lit(CASE_NUMBER), F.lit(1)))
    num, year = F.regexp_extract_all(x, F.lit(CASE_NUMBER), F.lit(1)), F.regexp_extract_all(x, F.lit(CASE_NUMBER), F.lit(2))
    return F.when(at > 0, F.concat(F.upper(F.element_at(num, -1)), F.lit(" of "), F.element_at(year, -1)))


def neutral_citations(x: Column) -> Column:
    """All neutral citations of a text, in one form."""
    year, court, number = (F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(NEUTRAL), F.lit(i)) for i in (1, 2, 3))
    return F.transform(year, lambda y, i: F.concat(F.lit("["), y, F.lit("] "), court[i], F.lit(" "), number[i], F.lit(" (KLR)")))


def party_part(title: Column) -> Column:
    """The parties of a title: what stands before a bracket or a semicolon."""
    return F.get(F.split(F.coalesce(title, F.lit("")), r"\s\(|\s\[|;", 2), F.lit(0))


def name_words(name: Column) -> Column:
    """Party words: three letters or more, or initials in capitals; words that tell no one apart are dropped."""
    found = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(?U)[\w&&[^_]]+"), F.lit(0))
    kept = F.filter(found, lambda w: ((F.length(w) > 2) | ((F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))) & ~w.rlike(r"^\d+$") & ~F.lower(w).isin(*NOT_A_PARTY))
    return F.array_distinct(F.transform(kept, F.lower))


def names_agree(cited: Column, title: Column) -> Column:
    """Not so only if the cited name has party words and shares none with the title."""
    mine = name_words(F.lower(cited))
    return (F.size(mine) == 0) | F.arrays_overlap(mine, name_words(F.lower(title)))


def origin(url: Column) -> Column:
    """The archived page's own URL; any other URL as it is."""
    return F.regexp_replace(url, r"^https?://web\.archive\.org/web/\d{4,14}(?:[a-z]{2}_)?/(.+)$", "$1")


def archived(timestamp: Column, url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit("id_/"), url)


def work_of(url: Column) -> Column:
    """A URL's path before the version or the language, or without a trailing source part."""
    path = F.coalesce(F.try_parse_url(origin(url), F.lit("PATH")), F.lit(""))
    cut = F.regexp_extract(path, r"^(.*?)/[a-z]{3}@", 1)
    by_language = F.regexp_extract(path, r"^(.*?)/(?:eng|swa)(?=/|$)", 1)
    return F.when(path.rlike("/[a-z]{3}@"), cut).when(path.rlike(r"/(?:eng|swa)(?=/|$)"), by_language).otherwise(F.regexp_replace(path, r"/source(\.\w+)?$", ""))


def version_date(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/[a-z]{3}@(\d{4}-\d{2}-\d{2})$", 1), F.lit(""))


def url_slug(url: Column) -> Column:
    """A URL's path as a file name of 200 characters at most."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(path, "[^A-Za-z0-9@._-]+", "_"), F.lit(200)), F.lit("")), F.lit("root"))


def clean_url(url: Column) -> Column:
    """An http URL without utm_ parameters; null for other schemes."""
    gone = F.regexp_replace(url, r"(?<=[?&])utm_[^&#]*&?", "")
    tidy = F.regexp_replace(F.regexp_replace(gone, r"[?&](?=#|$)", ""), r"\?&", "?")
    return F.when(url.rlike(r"^https?://"), tidy)


def page_links(page: Column) -> Column:
    """The targets of all links of a page, navigation included, in order."""
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"'>]*)["']"""), F.lit(1))


def resolved(link: Column, base: Column) -> Column:
    """A page's link as a whole URL without its fragment; null if it is not of the web."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    bare = F.regexp_replace(F.trim(link), r"#.*$", "")
    whole = (
        F.when(bare.rlike(r"^https?://"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), bare))
        .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(bare.startswith("/"), F.concat(root, bare))
        .when(bare == "", F.regexp_replace(base, r"#.*$", ""))
        .when(bare.startswith("?"), F.concat(root, path, bare))
        .otherwise(F.concat(root, folder, F.regexp_replace(bare, r"^(\./)+", "")))
    )
    return F.regexp_replace(whole, r"^(https?://[^/?#]+)$", "$1/")


def first_kind(url: Column, rules: list[tuple[str, str]]) -> Column:
    """The kind of the first rule (pattern, kind) that a URL matches."""
    out = None
    for pattern, kind in rules:
        out = F.when(url.rlike(pattern), kind) if out is None else out.when(url.rlike(pattern), kind)
    return out if out is not None else F.lit(None).cast("string")


def backoff(retries: Column, start: float = 60.0) -> Column:
    """Seconds to wait before another try: start, doubled for each try so far."""
    return F.lit(start) * F.pow(F.lit(2.0), retries - 1)


def checked_by(who: Column) -> Column:
    """How a ruling was checked, from the prefix of who checked it."""
    return F.when(who.startswith("human:"), "checked by a person").when(who.startswith("agent:"), "checked by an AI reviewer").when(who.startswith("source:"), "from the reviser's note").otherwise("unverified")


def tidy_spaces(x: Column) -> Column:
    """Spaces that extraction leaves inside brackets and before punctuation are dropped."""
    out = F.regexp_replace(x, r"(?U)\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\(\s+", "("), r"\s+\)", ")")
    return F.trim(F.regexp_replace(out, r"(\S)\s+([,;:.])(?=\s|$|\))", "$1$2"))


def snippet(x: Column, most: int = 240) -> Column:
    """A cut text ends on a whole word."""
    t = tidy_spaces(F.left(x, F.lit(most)))
    short = F.regexp_replace(F.regexp_replace(t, r" [^ ]*$", ""), "[,;:]$", "")
    return F.when(F.length(x) < most, tidy_spaces(x)).otherwise(F.concat(short, F.lit("…")))


def loose_name(x: Column) -> Column:
    """A law's name for a loose comparison: without brackets, years and punctuation."""
    return clean(F.regexp_replace(F.lower(x), r"\(.*?\)|\bno\.?\s*\d+\s+of\s+\d{4}|\d{4}|[^\w\s]", " "))


def client(forwarded: Column, peer: Column) -> Column:
    """Who calls: the last entry of the forwarding header, which the edge wrote, else the peer."""
    return F.coalesce(F.when(forwarded != "", F.trim(F.element_at(F.split(forwarded, ","), -1))), peer, F.lit(""))


def tidy_text(text: str | None) -> str:
    """Compatibility forms joined, blanks collapsed, one blank line at most between lines."""
    out = re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFKC", text or ""))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", out)).strip()


@F.pandas_udf(T.StringType())
def tidied(text: pd.Series) -> pd.Series:
    return text.map(tidy_text)


# Quotes and dashes of one kind as they are compared, what stands for words left out, and what joins the parts.
_CURLY, _STRAIGHT = "‘’‛“”„«»–—", "'''\"\"\"\"\"--"
_LEFT_OUT, _JOINED = r"(?U)\s*(?:\.\.\.|…)\s*", " [...] "


def squeezed(text: Column) -> Column:
    """A text without white space, its quotes and dashes of one kind: each character stands for one of the text."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), _CURLY, _STRAIGHT)


def _last_place(part: Column, body: Column) -> Column:
    """Where a part last stands in a text, from 0; null if nowhere or empty."""
    back = F.position(F.reverse(part), F.reverse(body))
    return F.when((part != "") & (back > 0), F.length(body) - back - F.length(part) + 1)


def _with_places(text: Column, then) -> Column:
    """then(body, body squeezed, place), body being the text with single blanks and place(k) where its k-th character that
    is no blank stands: as many places on as words have begun before."""

    def of(body: Column) -> Column:
        begins = lambda w: let(F.transform(w, F.length), lambda n: _running(n, lambda upto: F.transform(w, lambda x, i: upto(i))))
        return let(begins(F.split(body, " ")), lambda starts: let(squeezed(body), lambda bare: then(body, bare, lambda k: k + F.size(F.filter(starts, lambda s: s <= k)) - 1)))

    return let(clean(text), of)


def _span(part: Column, bare: Column, place) -> Column:
    return let(_last_place(part, bare), lambda at: F.when(at.isNotNull(), F.struct(place(at).alias("start"), (place(at + F.length(part) - 1) + 1).alias("end"))))


def located(quote: Column, text: Column) -> Column:
    """(start, end) of the last place of a quote in a text with single blanks, or null; blanks and the kind of quotes do not
    count. The last, because orders say again what was said before."""
    return _with_places(text, lambda body, bare, place: let(squeezed(quote), lambda q: _span(q, bare, place)))


def quoted_from(quote: Column, text: Column) -> Column:
    """(quote, start) in the text's own words, or null: each part of a quote around its ellipses is taken where it last
    stands, and the parts must stand there in order, none over another."""
    parts = F.filter(F.split(F.coalesce(quote, F.lit("")), _LEFT_OUT, -1), lambda p: squeezed(p) != "")

    def joined(spans: Column, body: Column) -> Column:
        last = lambda a: F.element_at(a, -1)
        fine = F.forall(spans, lambda s: s.isNotNull()) & F.forall(F.transform(spans, lambda s, i: (i == 0) | (s["start"] >= spans[F.greatest(i - 1, F.lit(0))]["end"])), lambda ok: ok)
        words = F.transform(spans, lambda s: F.substr(body, s["start"] + 1, s["end"] - s["start"]))
        return F.when((F.size(spans) > 0) & fine, F.struct(F.array_join(words, _JOINED).alias("quote"), spans[0]["start"].alias("start")))

    return _with_places(text, lambda body, bare, place: let(F.transform(parts, lambda p: let(squeezed(p), lambda q: _span(q, bare, place))), lambda spans: joined(spans, body)))


# A section's numbering, where a clause may begin, roman numbers, and a reviser's note.
_ROMAN = r"^(i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)$"
_NOTE, _IS_NOTE = r"\[([^\[\]]{3,240})\]", r"\b(Act|L\.N\.|No\.|Deleted|Repealed|Inserted|Sch\.|Rev\.|Cap\.)"
_DASH, _CLAUSE = r"(\w)\s?[-–]\s+\(", r"([.;:—])((?:\s+(?:and|or))?)\s+\(([0-9]+[A-Z]?|[a-z]{1,2}|[ivx]+)\)\s"
_LABELLED = r"^\(([^)]+)\)\s(.*)$"


def reviser_notes(text: Column) -> Column:
    """The reviser's notes of a section's text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(tidy_spaces(text), F.lit(_NOTE), F.lit(1)), lambda n: F.trim(n)), lambda n: n.rlike(_IS_NOTE))


def clauses(text: Column) -> Column:
    """The clauses of a section's text in order, as (level, label, text, parent): 1 for numbers, 2 for letters, 3 for roman
    numbers, 0 for text without a label; parent is the place of the clause that it stands under, null at the top.

    A label begins a clause only behind punctuation. A roman letter counts as a letter if it follows the
    letter before it. Notes are left out, unless there is nothing else.
    """
    tidy = tidy_spaces(text)
    pieces = let(parts_at(tidy, _NOTE), lambda p: F.transform(p, lambda x: x["raw"]))
    notes = F.regexp_extract_all(tidy, F.lit(_NOTE), F.lit(0))
    bare = let(notes, lambda n: let(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(x, F.when(F.get(n, i).rlike(_IS_NOTE), "").otherwise(F.coalesce(F.get(n, i), F.lit(""))))), "")))
    lines = F.split(F.regexp_replace(F.regexp_replace(tidy_spaces(bare), _DASH, "$1— ("), _CLAUSE, "$1$2\n($3) "), "\n")
    one = "struct<level:int,label:string,text:string,parent:int>"

    def step(a: Column, line: Column) -> Column:
        label = F.nullif(F.regexp_extract(line, _LABELLED, 1), F.lit(""))
        rest = F.trim(F.when(label.isNotNull(), F.regexp_extract(line, _LABELLED, 2)).otherwise(line))
        follows = (F.length(label) == 1) & (F.ascii(label) == F.ascii(a["letter"]) + 1)
        level = F.when(label.isNull(), 0).when(label.rlike(r"^\d"), 1).when(label.rlike(_ROMAN) & ~F.coalesce(follows, F.lit(False)), 3).otherwise(2)

        def put(v: Column) -> Column:
            here = F.size(a["out"])
            above = [F.when(v > i, a["open"][i]) for i in range(1, 4)]  # the open clause of each level above
            parent = F.when(v > 0, F.coalesce(*reversed(above)))
            opened = F.array(*(F.when(F.lit(i) == v, here).when(F.lit(i) < v, a["open"][i]) for i in range(4)))
            new = F.struct(v.alias("level"), F.when(label.isNotNull(), F.concat(F.lit("("), label, F.lit(")"))).alias("label"), rest.alias("text"), parent.alias("parent")).cast(one)
            return F.struct(F.array_append(a["out"], new).alias("out"), F.when(v == 2, label).otherwise(a["letter"]).alias("letter"), F.when(v > 0, opened).otherwise(a["open"]).cast("array<int>").alias("open"))

        return F.when(label.isNull() & (rest == ""), a).otherwise(let(level, put))

    start = F.struct(F.array().cast(f"array<{one}>").alias("out"), F.lit(None).cast("string").alias("letter"), F.array(*[F.lit(None).cast("int")] * 4).alias("open"))
    found = F.aggregate(lines, start, step, lambda a: a["out"])
    alone = F.transform(F.slice(reviser_notes(text), 1, 1), lambda n: F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("label"), F.concat(F.lit("["), n, F.lit("]")).alias("text"), F.lit(None).cast("int").alias("parent")).cast(one))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(alone))


def pieces_in_order(text: Column, quote: Column) -> Column:
    """Whether the pieces of a quote around '[...]' stand in a text in order, as a reader compares them."""
    pieces = F.filter(F.transform(F.split(quote, r"\[\.\.\.\]"), reader_quote), lambda p: p != "")
    body = reader_quote(text)
    at = F.aggregate(pieces, F.lit(1), lambda a, p: F.when(a == 0, 0).otherwise(F.when(F.position(p, body, a) > 0, F.position(p, body, a) + F.length(p)).otherwise(0)))
    return at > 0


def let(value: Column, then) -> Column:
    """then(value), with the value named once: it is computed once however often then() uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Sizes that are added up together, so that a running sum over many takes few steps for each.
STRETCH = 128


def _running(sizes: Column, then) -> Column:
    """then(f), f(i) being the sum of the first i of sizes."""
    zero = F.lit(0)
    added = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    whole = F.transform(F.sequence(zero, F.floor(F.size(sizes) / STRETCH).cast("int")), lambda j: added(F.slice(sizes, j * STRETCH + 1, STRETCH)))
    before = F.aggregate(whole, F.array(zero), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    within = lambda i: F.floor(i / STRETCH).cast("int") * STRETCH
    return let(before, lambda b: then(lambda i: F.get(b, F.floor(i / STRETCH).cast("int")) + added(F.slice(sizes, within(i) + 1, i - within(i)))))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("raw", T.StringType())]))


def _spans_of(found: list[list[tuple[int, int, str]]]) -> pa.Array:
    """Arrow lists of (start, end, raw)."""
    columns = [pa.array([m[i] for one in found for m in one], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "end", "raw"]))


def found_at(text: Column, *patterns: str) -> Column:
    """All matches of patterns, of one after the other, each in order, as (start, end, raw); places count code points, ends
    exclusive. White space and digits of a pattern are those of ASCII."""
    compiled = [re.compile(p, re.ASCII) for p in patterns]

    @F.arrow_udf(_SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda some: _spans_of([[(*m.span(), m[0]) for p in compiled for m in p.finditer(t or "")] for t in some]))

    return found(text)


def parts_between(text: Column, pattern: str) -> Column:
    """The parts of a text around the matches of a pattern, as (start, end, raw). White space of a pattern is that of
    Unicode."""
    compiled = re.compile(pattern)

    def parts(t: str) -> list[tuple[int, int, str]]:
        edges = [0, *(x for m in compiled.finditer(t) for x in m.span()), len(t)]
        return [(i, j, t[i:j]) for i, j in zip(edges[::2], edges[1::2], strict=True)]

    @F.arrow_udf(_SPANS)
    def between(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda some: _spans_of([parts(t or "") for t in some]))

    return between(text)


def parts_at(text: Column, between: str | Column) -> Column:
    """parts_between() as an expression, as (start, raw): for patterns of a column, and inside other expressions."""
    body, pattern = F.coalesce(text, F.lit("")), F.lit(between) if isinstance(between, str) else between
    parts = F.split(body, pattern, -1)
    gaps = F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), F.length)

    def spans(p: Column, g: Column) -> Column:
        units = F.transform(p, lambda x, i: F.length(x) + F.coalesce(F.get(g, i), F.lit(0)))
        return let(units, lambda u: _running(u, lambda upto: F.transform(p, lambda x, i: F.struct(upto(i).alias("start"), x.alias("raw")))))

    return let(parts, lambda p: let(gaps, lambda g: spans(p, g)))


# Where a case name ends when read backwards, words inside a name, and lead-ins before it.
# It is looked for by its mark first, which most places do not have.
NAME_BREAK = r"(?=[.;:(\]\n])(?:(?<!\bv)(?<!\bvs)(?<!\bNo)[.;:(]\s|\]\s|\n)"
VERSUS = ("v", "v.", "vs", "vs.")
GLUE = ("and", "another", "others", "of", "the", "&")
LEAD_IN = ("in", "see", "per", "also", "cf")
LIST_MARK = r"^\(?[ivx\d]+[.)]$"
# An eKLR citation, the number right before it, and the court and kind words before that.
EKLR = r"\[(\d{4})\]\s*eKLR"
TAIL_NUMBER = r"(?:No\.?\s*)?\b([A-Z]?\d+[A-Z]?)\s+of\s+((?:19|20)\d{2})(?:\s*of)?[\s,;)]*$"
KIND_TAIL = (
    r"(?i)(?<![\s,(])(?:[\s,(]*\b(?=[ACEFHJMNOPRS])(?:S\.\s?C|Sup|Ct|Pet(?:ition)?|No|Misc|Appl(?:ication)?|Civ(?:il)?|Crim(?:inal)?|Appeal|Advisory|Opinion|Motion|Constitutional|Cause|Case|Suit|Reference"
    r"|Election|Judicial|Review|Succession|Family|HCCC|HC|CA|EP|JR|NRB|Nai|ML|MLD|Formerly|Consolidated|and)\.?)+[\s,(]*$"
)
#: How far back a name, and a name with a number, may stand before a citation.
NAME_REACH, NUMBER_REACH = 200, 300


def _low(word: Column) -> Column:
    """Whether a word begins in lower case."""
    head = F.left(word, F.lit(1))
    return (head == F.lower(head)) & (head != F.upper(head))


def _tail(text: Column, end: Column, reach: int) -> Column:
    """The text right before a place, as far back as reach."""
    return let(F.least(end, F.lit(reach)), lambda n: F.substr(text, end - n + 1, n))


def _places(words: Column, fits) -> Column:
    """The places of the words that fit(word, place), in order."""
    return F.filter(F.transform(words, lambda w, i: F.when(fits(w, i), i)), lambda i: i.isNotNull())


# The words before the first "v" of a name, and the rest from there; an ordinary lower-case word, with all before it; and
# what is skipped at a name's beginning.
_V = rf"(?i:{'|'.join(map(re.escape, VERSUS))})(?![^ ])"
_SAYS_V = rf" {_V}"
_PARTIES = rf"(?s)^((?:(?!{_V})\S+ )+)({_V}.*)\z"
_ORDINARY = rf"(?s)^(?:.* )?(?!(?i:{'|'.join(map(re.escape, GLUE))}) )\p{{IsLowercase}}\S* "
_SKIPPED = rf"^(?:(?i:{'|'.join(map(re.escape, (*LEAD_IN, *GLUE)))}|\(?[ivx\d]+[.)]) )+"


def _name_in(tail: Column) -> Column:
    last = F.regexp_extract(tail, rf"(?s)^(?:.*{NAME_BREAK})?(.*)\z", 1)
    said = F.trim(F.regexp_replace(F.regexp_replace(last, r"^[ ,]+|[ ,]+$", ""), r"\s+", " "))

    def named(x: Column, first: Column) -> Column:
        before = F.regexp_replace(F.regexp_replace(first, _ORDINARY, ""), _SKIPPED, "")
        return F.when(first != "", F.concat(before, F.substr(x, F.length(first) + 1)))

    return let(said, lambda x: F.when(x.rlike(_SAYS_V), let(F.regexp_extract(x, _PARTIES, 1), lambda first: named(x, first))))


def name_before(text: Column, end: Column) -> Column:
    """The case name 'X v Y' that ends right before a place, or null: it reaches back to a sentence break or
    an earlier citation, and starts after the last ordinary lower-case word, lead-in or list mark."""
    return let(_tail(text, end, NAME_REACH), _name_in)


def before_eklr(text: Column, end: Column) -> Column:
    """(name, number) for an eKLR citation at a place: a number counts only right before it and with a name."""

    def read(tail: Column, said: Column) -> Column:
        has = said != ""
        number = F.concat(F.upper(F.regexp_extract(said, TAIL_NUMBER, 1)), F.lit(" of "), F.regexp_extract(said, TAIL_NUMBER, 2))
        rest = F.when(has, F.regexp_replace(F.regexp_replace(tail, TAIL_NUMBER, ""), KIND_TAIL, "")).otherwise(tail)
        name = let(F.right(rest, F.lit(NAME_REACH)), _name_in)
        return let(name, lambda n: F.struct(n.alias("name"), F.when(has & n.isNotNull(), number).alias("number")))

    return let(_tail(text, end, NUMBER_REACH), lambda tail: let(F.regexp_extract(tail, TAIL_NUMBER, 0), lambda said: read(tail, said)))


def party_span(text: Column) -> Column:
    """The 'X v Y' in a question: it ends at a bracketed citation or year, or the first lower-case word after the v."""
    head = F.get(F.split(text, r"\[|\(\s*(?:19|20)\d\d\s*\)", 2), F.lit(0))

    def cut(words: Column, v: Column) -> Column:
        end = F.coalesce(F.array_min(_places(words, lambda x, i: (i > v) & _low(x) & ~x.isin(*GLUE))), F.size(words))
        return F.when(v.isNotNull(), F.nullif(F.regexp_replace(F.array_join(F.slice(words, 1, end), " "), r"[?.,;]+$", ""), F.lit("")))

    words = F.split(F.coalesce(let(F.right(head, F.lit(NAME_REACH)), _name_in), F.lit("")), " ")
    return let(words, lambda w: let(F.array_min(_places(w, lambda x, i: F.lower(x).isin(*VERSUS))), lambda v: cut(w, v)))


def act_key(name: Column) -> Column:
    """A law's name for a comparison as a whole: without brackets, numbers, years, "the" and "Act"."""
    return F.regexp_replace(loose_name(name), r"^the\s+|\s+act$", "")


def act_id(citation: Column, work: Column) -> Column:
    """An act's id from 'Cap. N', else from a named work; anything else is an error."""
    cap = F.nullif(F.regexp_extract(F.coalesce(citation, F.lit("")), r"^Cap\.\s*(\w+)$", 1), F.lit(""))
    slug = F.element_at(F.split(work, "/"), -1)
    wrong = F.raise_error(F.concat(F.lit("no Cap. citation or named work for "), work)).cast("string")
    return F.when(cap.isNotNull(), F.concat(F.lit("ke/act/cap-"), F.lower(cap))).when(~slug.rlike(r"^\d+$"), F.concat(F.lit("ke/act/"), slug)).otherwise(wrong)


def judgment_date(said: Column, fallback: Column) -> Column:
    """A date as judgments write it, else the version's own."""
    return F.coalesce(F.try_to_date(said, "d MMMM yyyy"), fallback)


def listed(text: Column) -> Column:
    """A comma list as an array; null if nothing is in it."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def unit(vector: Column) -> Column:
    """A vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def without_footers(text: Column) -> Column:
    """A text without its page footers, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s*Page \d+ of \d+\s*$", " "), r"(?U)\s+", " "))


def saved_url(page: Column, site: str) -> Column:
    """The URL of a page of a site saved by hand: from the browser's comment, else from the page's own source link."""
    said = F.nullif(F.regexp_extract(F.left(page, F.lit(2000)), r"saved from url=\(\d+\)(\S+?)\s*-->", 1), F.lit(""))
    link = F.nullif(F.regexp_extract(page, rf'href="((?:{re.escape(site)})?/akn/[^"]+?/[a-z]{{3}}@\d{{4}}-\d{{2}}-\d{{2}})/source', 1), F.lit(""))
    return F.coalesce(said, F.when(link.startswith("/"), F.concat(F.lit(site), link)).otherwise(link))


def evidence_window(text: Column, quote: Column, before: int, after: int, tail: int) -> Column:
    """The text around a quote's place, and the end of the text if that does not reach it."""
    at = F.when(quote != "", F.position(F.left(quote, F.lit(80)), text)).otherwise(0)
    start, stop = F.greatest(at - before, F.lit(1)), at - 1 + F.length(quote) + after
    near = F.when(at > 0, F.substr(text, start, stop - start + 1))
    end = F.when((at == 0) | (stop < F.length(text) - tail), F.right(text, F.lit(tail)))
    return F.concat_ws("\n[...]\n", near, end)


def _diff(a: str | None, b: str | None) -> list[dict]:
    """Words of a and b by a longest common subsequence: same, del (only in a) or add (only in b); on ties del."""
    x, y = (a or "").split(), (b or "").split()
    kx, ky = ([re.sub(r"[\W_]+", "", w.lower()) for w in z] for z in (x, y))
    ahead = [[0] * (len(y) + 1)]
    for k in reversed(kx):
        row, below = [0] * (len(y) + 1), ahead[-1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if k == ky[j] else max(below[j], row[j + 1])
        ahead.append(row)
    ahead.reverse()
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and kx[i] == ky[j]:
            out.append({"word": y[j], "op": "same"})
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and ahead[i + 1][j] >= ahead[i][j + 1]:
            out.append({"word": x[i], "op": "del"})
            i += 1
        else:
            out.append({"word": y[j], "op": "add"})
            j += 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("op", T.StringType())])))
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_diff(x, y) for x, y in zip(a, b, strict=True)])

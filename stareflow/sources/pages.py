"""Raw pages to document records: metadata list, sections, remarks, versions, links and text.

Markup is read once, by Arrow batches, into two arrays of a page: its elements in order, each with the
stretch of elements and of strings inside it, and its strings. An ancestor stack gives every element
its parent, the nearest id at or above it and the first heading inside it. All else is expressions on
these arrays, so a record is made where its page is, without a shuffle.
"""

from __future__ import annotations

import html.parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stareflow.functions import text as tx

# What a page's template names its metadata list, content, acts, sections and remarks.
METADATA, CONTENT, ACT, ACT_TAG, SECTION, REMARK = "document-metadata-list", "document-content", "akn-akomaNtoso", "la-akoma-ntoso", "akn-section", "akn-remark"
NAVIGATION, OWN_LINK = "navigation-content", "/akn/"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BLOCKS = frozenset((*"address article aside blockquote div dl fieldset footer form header hr main nav ol p pre section table ul".split(), *_HEADINGS))
#: What an opening tag closes, and how far up it looks.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_NODE = pa.struct(
    [("at", pa.int32()), ("until", pa.int32()), ("parent", pa.int32()), ("head", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("eid", pa.string()), ("near", pa.string()), ("href", pa.string()), ("display", pa.string())]
)
_KINDS = {"classes": T.ArrayType(T.StringType())} | dict.fromkeys(("at", "until", "parent", "head", "first", "last"), T.IntegerType())
MARKUP = T.StructType().add("nodes", T.ArrayType(T.StructType([T.StructField(f.name, _KINDS.get(f.name, T.StringType())) for f in _NODE]))).add("strings", T.ArrayType(T.StringType()))


class _Reader(html.parser.HTMLParser):
    """A page's elements and strings. Buttons, and navigation, scripts and styles inside the content, are left out
    with all that they hold; strings of scripts and styles are left out anywhere."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.strings: list[str] = []
        self.stack: list[dict] = []
        self.dropped: list[str] = []  # open tags inside something that is left out
        self.content = None

    def _close(self, n: int) -> None:
        for node in self.stack[n:]:
            node["until"], node["last"] = len(self.nodes), len(self.strings)
        del self.stack[n:]

    def _left_out(self, tag: str, attrs: dict) -> bool:
        inside = self.content is not None and "until" not in self.content
        return tag == "button" or inside and (tag in ("nav", "script", "style") or attrs.get("id") == NAVIGATION)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.dropped:
            if tag not in _VOID:
                self.dropped.append(tag)
            return
        if tag in _BLOCKS:
            gone, border = {"p"}, {"button", "td", "th", "table"}
        else:
            gone, border = _CLOSES.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] in border or not gone:
                break
            if self.stack[i]["tag"] in gone:
                self._close(i)
        if self._left_out(tag, attrs):
            self.dropped = [tag]
            return
        parent = self.stack[-1] if self.stack else None
        eid = attrs.get("data-eid")
        eid = "" if eid is None and "data-eid" in attrs else eid
        classes = (attrs.get("class") or "").split()
        at = len(self.nodes)
        node = {"at": at, "parent": parent and parent["at"], "head": None, "first": len(self.strings), "tag": tag, "classes": classes, "eid": eid}
        node |= {"near": eid if eid is not None else parent and parent["near"], "href": attrs.get("href"), "display": attrs.get("data-display-type")}
        if tag in _HEADINGS:
            for above in self.stack:
                if above["head"] is None:
                    above["head"] = at
        self.nodes.append(node)
        if tag == "div" and CONTENT in classes and self.content is None:
            self.content = node
        self.stack.append(node)
        if tag in _VOID:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if self.dropped:
            if tag in self.dropped:
                while self.dropped and self.dropped.pop() != tag:
                    pass
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] == tag:
                self._close(i)
                return

    def handle_data(self, data):
        if not self.dropped and not (self.stack and self.stack[-1]["tag"] in ("script", "style")):
            self.strings.append(data)


def _read(source: str | None) -> tuple[list[dict], list[str]]:
    page = _Reader()
    page.feed(source or "")
    page.close()
    page._close(0)
    return page.nodes, page.strings


@F.arrow_udf(MARKUP)
def markup(source: pa.Array) -> pa.Array:
    """The elements and strings of pages, as MARKUP."""

    def found(sources: list[str | None]) -> pa.Array:
        pages = [_read(x) for x in sources]
        nodes = pa.array([p[0] for p in pages], pa.list_(_NODE))
        return pa.StructArray.from_arrays([nodes, pa.array([p[1] for p in pages], pa.list_(pa.string()))], names=["nodes", "strings"])

    return tx.in_slices(source, found)


def _said(strings: Column, node: Column, between: str = " ") -> Column:
    """The text inside an element."""
    return tx.clean(F.array_join(F.slice(strings, node["first"] + 1, node["last"] - node["first"]), between))


def _has(node: Column, name: str) -> Column:
    return F.array_contains(node["classes"], name)


def _one(nodes: Column, fits) -> Column:
    return F.get(F.filter(nodes, fits), F.lit(0))


def page_url(link: Column, base: Column) -> Column:
    """A link as a whole URL, with its fragment."""
    return F.concat(tx.resolved(link, base), F.regexp_extract(link, "#.*$", 0))


def _entries(nodes: Column, strings: Column, box: Column) -> Column:
    """A definition list as (term, definition); of terms alike the last counts."""
    inside = lambda n: (n["at"] > box["at"]) & (n["at"] < box["until"])
    both = F.filter(nodes, lambda n: n["tag"].isin("dt", "dd") & inside(n))

    def pairs(own: Column) -> Column:
        define = lambda t: _one(own, lambda d: (d["tag"] == "dd") & d["parent"].eqNullSafe(t["parent"]) & (d["at"] > t["at"]))
        each = F.transform(F.filter(own, lambda n: n["tag"] == "dt"), lambda t: tx.let(define(t), lambda d: F.struct(_said(strings, t, "").alias("k"), F.when(d.isNotNull(), _said(strings, d)).alias("v"))))
        return tx.let(each, lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"])))

    return F.when(box.isNotNull(), tx.let(both, pairs))


def page_records(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """pages with a column record: work, url, title, expression_date, metadata, display_type, source_url,
    versions, sections (eid, heading, text), remarks (the nearest id at or above, text), akn_links, text.

    Sections may nest: a section's text holds that of the sections inside it. A page without content
    is taken as a whole. A page shown as a PDF has no text of its own. A null page has no elements.
    """
    rows = pages.withColumn("_m", markup(F.col(source)))
    nodes, strings, base = F.col("_m.nodes"), F.col("_m.strings"), F.col(url)
    whole = F.struct(F.lit(-1).alias("at"), F.size(nodes).alias("until"), F.lit(0).alias("first"), F.size(strings).alias("last"))
    span = lambda n: F.struct(n["at"].alias("at"), n["until"].alias("until"), n["first"].alias("first"), n["last"].alias("last"))
    content = _one(nodes, lambda n: (n["tag"] == "div") & _has(n, CONTENT))
    rows = rows.withColumn("_content", content).withColumn("_body", F.when(content.isNotNull(), span(content)).otherwise(whole))
    inside = lambda n, box: (n["at"] > F.col(box)["at"]) & (n["at"] < F.col(box)["until"])
    act = _one(nodes, lambda n: inside(n, "_body") & (_has(n, ACT) | (n["tag"] == ACT_TAG)))
    rows = rows.withColumn("_act", F.coalesce(F.when(act.isNotNull(), span(act)), F.col("_body")))
    rows = rows.withColumn("_links", F.filter(nodes, lambda n: (n["tag"] == "a") & n["href"].isNotNull()))
    rows = rows.withColumn("_list", _one(nodes, lambda n: (n["tag"] == "dl") & _has(n, METADATA)))
    title = _one(nodes, lambda n: n["tag"] == "h1")
    own, work = tx.version_date(base), tx.work_of(base)
    others = F.transform(F.col("_links"), lambda n: page_url(n["href"], base))
    others = F.transform(F.filter(others, lambda u: tx.work_of(u) == work), tx.version_date)
    source_link = _one(F.col("_links"), lambda n: n["href"].rlike(r"/source(\.\w+)?$"))
    sections = F.transform(
        F.filter(nodes, lambda n: inside(n, "_act") & _has(n, SECTION) & n["eid"].isNotNull()),
        lambda s: F.struct(s["eid"].alias("eid"), F.when(s["head"].isNotNull(), _said(strings, F.get(nodes, s["head"]), "")).alias("heading"), _said(strings, s).alias("text")),
    )
    remarks = F.transform(F.filter(nodes, lambda n: inside(n, "_act") & _has(n, REMARK)), lambda r: F.struct(r["near"].alias("eid"), _said(strings, r).alias("text")))
    display = F.col("_content")["display"]
    entries = F.coalesce(_entries(nodes, strings, F.col("_list")), F.array().cast("array<struct<k:string,v:string>>"))
    record = F.struct(
        work.alias("work"),
        base.alias("url"),
        F.when(title.isNotNull(), _said(strings, title, "")).alias("title"),
        F.try_to_date(own, "yyyy-MM-dd").alias("expression_date"),
        F.map_from_entries(entries).alias("metadata"),
        display.alias("display_type"),
        F.when(source_link.isNotNull(), page_url(source_link["href"], base)).alias("source_url"),
        F.array_sort(F.array_distinct(F.filter(F.concat(others, F.array(own)), lambda d: d.isNotNull()))).alias("versions"),
        sections.alias("sections"),
        remarks.alias("remarks"),
        F.transform(F.filter(F.col("_links"), lambda n: inside(n, "_body") & n["href"].contains(OWN_LINK)), lambda n: page_url(n["href"], base)).alias("akn_links"),
        F.when(display.eqNullSafe(F.lit("pdf")), F.lit("")).otherwise(_said(strings, F.col("_act"))).alias("text"),
    )
    return rows.withColumn("record", record).drop("_m", "_content", "_body", "_act", "_links", "_list")


def documents_of(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """Pages as readers.DOCUMENT has them, a row for each page."""
    none = F.lit(None).cast("array<int>")
    fields = ("work", "url", "title", "expression_date", "metadata", "text", "sections", "display_type", "source_url", "versions", "remarks", "akn_links")
    found = page_records(pages, url, source).select("record.*")
    return found.select(*fields[:6], none.alias("ocr_pages"), *fields[6:])

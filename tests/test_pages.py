"""Page records against an XML parser on generated pages, and on hand-made ones."""

import datetime
import random
import re
import xml.etree.ElementTree as ET

from oracle import compare, connect

from stareflow.plans import texts
from stareflow.sources import pages, readers

SITE = "https://law.example.org"
URL = f"{SITE}/akn/ke/act/1930/63/eng@2024-01-01"


def clean(x):
    return re.sub(r"\s+", " ", x).strip()


def page(rng):
    """A well-formed page: nested sections, ids at several levels, remarks, links, things to leave out."""

    def words():
        return " ".join(rng.choice(["the", "law", "é", "a&amp;b", "court", "\n"]) for _ in range(rng.randrange(5)))

    def block(depth):
        kind = rng.randrange(9)
        inner = "".join(block(depth + 1) for _ in range(rng.randrange(3))) if depth < 5 else ""
        eid = f' data-eid="e{rng.randrange(99)}"' if rng.random() < 0.5 else ""
        if kind == 0:
            return f'<section class="x akn-section"{eid}>{words()}<h3>{words()}<i>q</i></h3>{inner}{words()}</section>'
        if kind == 1:
            return f'<span class="akn-remark"{eid}>[{words()}<b>{words()}</b>]</span>'
        if kind == 2:
            return f'<a href="/akn/ke/act/{rng.choice(["1930/63/eng@20" + str(rng.randrange(10, 30)) + "-01-01", "1998/2", "1930/63/eng@2024-01-01/source"])}">{words()}</a>'
        if kind == 3:
            return rng.choice([f"<nav>{words()}{inner}</nav>", f"<button>{words()}{inner}</button>", '<div id="navigation-content"><p>no</p></div>', "<script>var x;</script>"])
        return f"<div{eid}>{words()}<p>{words()}</p>{inner}<br/>{words()}</div>"

    body = "".join(block(0) for _ in range(6))
    terms = "".join(f"<dt>k{rng.randrange(3)} <i>n</i></dt>" + (f"<dd>v <b>{rng.randrange(9)}</b></dd>" if rng.random() < 0.8 else "") for _ in range(4))
    box = rng.choice([f'<div class="document-content" data-display-type="akn"><la-akoma-ntoso>{body}</la-akoma-ntoso>{words()}</div>', f'<div class="a document-content">{body}</div>', f"<div>{body}</div>", f'<div class="document-content" data-display-type="pdf">{body}</div>'])
    return f'<html><head><title>t</title></head><body><h1>The <i>Act</i></h1><dl class="document-metadata-list">{terms}</dl><nav><a href="/akn/ke/act/1930/63/eng@2001-01-01">old</a> menu</nav>{box}</body></html>'


def expected(source):
    root = ET.fromstring(source)
    for b in list(root.iter("button")):
        cut(root, b)
    has = lambda e, c: c in (e.get("class") or "").split()
    said = lambda e, sep=" ": clean(sep.join(strings(e)))
    dl = next(e for e in root.iter("dl") if has(e, "document-metadata-list"))
    metadata, own = {}, list(dl)
    for i, e in enumerate(own):
        if e.tag == "dt":
            metadata[clean("".join(strings(e)))] = next((said(d) for d in own[i + 1 :] if d.tag == "dd"), None)
    content = next((e for e in root.iter("div") if has(e, "document-content")), None)
    display = content.get("data-display-type") if content is not None else None
    if content is not None:
        for e in [e for e in content.iter() if e is not content and (e.tag in ("nav", "script", "style") or e.get("id") == "navigation-content")]:
            cut(root, e)
    body = root if content is None else content
    act = next((e for e in body.iter() if e is not body and e.tag == "la-akoma-ntoso"), body)
    above = {c: p for p in root.iter() for c in p}

    def near(e):
        while e is not None and e.get("data-eid") is None:
            e = above.get(e)
        return None if e is None else e.get("data-eid")

    heads = lambda e: next((clean("".join(strings(h))) for h in e.iter() if re.fullmatch("h[1-6]", h.tag) and h is not e), None)
    links = [e.get("href") for e in root.iter("a")]
    return {
        "metadata": metadata,
        "display_type": display,
        "versions": sorted({m[1] for h in links if (m := re.fullmatch(r"/akn/ke/act/1930/63/eng@(\d{4}-\d\d-\d\d)", h))} | {"2024-01-01"}),
        "source_url": next((SITE + h for h in links if h.endswith("/source")), None),
        "sections": [(e.get("data-eid"), heads(e), said(e)) for e in act.iter() if e is not act and has(e, "akn-section") and e.get("data-eid") is not None],
        "remarks": [(near(e), said(e)) for e in act.iter() if e is not act and has(e, "akn-remark")],
        "akn_links": [SITE + e.get("href") for e in body.iter("a")],
        "text": "" if display == "pdf" else said(act),
    }


def strings(e):
    out = [] if e.tag in ("script", "style") else [e.text or ""]
    for c in e:
        out += [*strings(c), c.tail or ""]
    return out


def cut(root, e):
    """Removes an element and keeps the text behind it."""
    for parent in root.iter():
        own = list(parent)
        if e in own:
            i = own.index(e)
            if i:
                own[i - 1].tail = (own[i - 1].tail or "") + (e.tail or "")
            else:
                parent.text = (parent.text or "") + (e.tail or "")
            parent.remove(e)
            return


def test_records_equal_those_of_an_xml_parser(spark):
    sources = [page(random.Random(i)) for i in range(60)]
    df = spark.createDataFrame([(i, URL, s) for i, s in enumerate(sources)], "id int, url string, html string")
    found = {r.id: r.record for r in pages.page_records(df).collect()}
    for i, source in enumerate(sources):
        want, r = expected(source), found[i]
        got = {k: r[k] for k in want} | {"sections": [tuple(s) for s in r.sections], "remarks": [tuple(s) for s in r.remarks]}
        assert got == want, (i, source)
        assert (r.title, r.work, r.expression_date) == ("The Act", "/akn/ke/act/1930/63", datetime.date(2024, 1, 1))


def test_pages_that_are_not_well_formed(spark):
    cases = {
        "remark": '<h1>Penal Code</h1><div class="document-content"><section class="akn-section" data-eid="sec_194"><h3>194. Defamation</h3><span class="akn-remark">[declared unconstitutional]</section>',
        "unclosed": '<div class="document-content"><p>one<p>two<ul><li>three<li>four</ul><b>five</div>six',
        "list": '<dl class="document-metadata-list"><dt>A<dd>1<dt>B<dt>A<dd>2</dl>',
        "script": "<p>a</p><script>if (x < '<p>no</p>') {}</script><p>b</b> &amp; &copy; c",
        "empty": "",
        "null": None,
        "cut": '<div class="document-content"><section class="akn-section" data-eid="s"',
    }
    df = spark.createDataFrame([(k, URL, v) for k, v in cases.items()], "id string, url string, html string")
    found = {r.id: r.record for r in pages.page_records(df).collect()}
    assert [tuple(r) for r in found["remark"].remarks] == [("sec_194", "[declared unconstitutional]")]
    assert [tuple(s) for s in found["remark"].sections] == [("sec_194", "194. Defamation", "194. Defamation [declared unconstitutional]")]
    assert found["unclosed"].text == "one two three four five"
    assert found["list"].metadata == {"A": "2", "B": "2"}
    assert found["script"].text == "a b & © c"
    for k in ("empty", "null"):
        assert (found[k].text, found[k].title, found[k].sections, found[k].versions) == ("", None, [], ["2024-01-01"])
    assert found["cut"].sections == []
    docs = pages.documents_of(df)
    assert dict(docs.dtypes) == dict(spark.createDataFrame([], readers.DOCUMENT).dtypes)
    judged = readers.judgment_records(docs).where("title = 'Penal Code'").first()
    assert judged.judgment_id == "ke/act/1930/63" and judged.decision_date == datetime.date(2024, 1, 1)


def test_titles_cut_inside_a_reference_are_read_as_in_sql(spark, sf, tmp_path):
    titles = ["Law &amp; order", "Law &amp", "Law &am", "Law & order", "Law &amp;&amp;&quo", "Law &quot", "&", "A&amp;amp;B &amp"]
    rows = [(i, f"<html><body><article><h1>{t}</h1><p>R&amp;D &amp</p></article><footer>&copy; a &middot; b</footer></body></html>") for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = connect(sf)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    ok, n, why = compare(spark, con, texts.page_records, texts.ORACLE_SQL["page_records"], str(tmp_path))
    assert ok and n == len(titles), why
    # The operator itself reads a raw page as HTML has it.
    found = pages.page_records(df.selectExpr("page_id", f"'{URL}' AS url", "html")).where("page_id = 1").first().record
    assert (found.title, found.text) == ("Law &", "Law & R&D & © a · b")

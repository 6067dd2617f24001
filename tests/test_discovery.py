"""Discovery against a breadth-first search in plain Python."""

import random
import re

from stareflow.operators.discovery import Scope, discovered

SITE = "https://law.example.org"
SCOPE = Scope(
    hosts=("law.example.org", "www.example.org"),
    kinds=((r"/akn/act/", "act"), (r"/akn/judgment/", "judgment"), (r"/search", "search"), (r"/akn/", "other")),
    follow={"act": ("act", "judgment"), "judgment": ("act", "judgment"), "search": ("other",)},
    same_work=("act",),
    max_depth=4,
)


def kind_of(url):
    return next((k for p, k in SCOPE.kinds if re.search(p, url)), None)


def work(url):
    path = re.sub(r"^https?://[^/]+", "", url)
    m = re.search(r"/[a-z]{3}@", path)
    return path[: m.start()] if m else path


def search(pages, seeds, known=()):
    found = {u: (k, d, p) for u, k, d, p in known} | {}
    for u, k in seeds:
        found.setdefault(u, (k, 0, None))
    for depth in range(SCOPE.max_depth):
        new = {}
        for src in sorted(u for u, (_, d, _) in found.items() if d == depth):
            for dst in sorted(pages.get(src, [])):
                k = kind_of(dst)
                if re.match(r"https://(law|www)\.example\.org/", dst) and k in SCOPE.follow.get(found[src][0], ()) and (k not in SCOPE.same_work or work(src) == work(dst)) and dst not in found and dst != src:
                    new.setdefault(dst, (k, depth + 1, src))
        found |= new
    return {(u, *v) for u, v in found.items()}


def graph(rng, n=60):
    urls = [f"{SITE}/akn/{rng.choice(['act', 'act', 'judgment', 'page'])}/{rng.randrange(4)}/eng@20{i:02d}-01-01" for i in range(n)] + ["https://other.org/akn/act/1", f"{SITE}/search?q=1", "https://www.example.org/akn/judgment/7"]
    return {u: [rng.choice(urls) for _ in range(rng.randrange(5))] for u in urls}


def html(links):
    return "<nav>" + "".join(f'<p><a class="x" href="{u.removeprefix(SITE) if i % 2 else u}#top">t</a>' for i, u in enumerate(links)) + '<a href="mailto:x@y">m</a>'


def test_depths_and_parents_are_those_of_a_breadth_first_search(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pages = graph(rng)
        seeds = [(u, kind_of(u)) for u in rng.sample(sorted(pages), 3)] + [(f"{SITE}/akn/act/9", "act")]
        df = spark.createDataFrame([(u, html(x)) for u, x in pages.items()], "url string, html string")
        start = spark.createDataFrame(seeds, "url string, kind string")
        got = {tuple(r) for r in discovered(df, start, SCOPE).collect()}
        assert got == search(pages, seeds) and len(got) > 4
        # half of the pages first, the rest later: what was found stays, and nothing is lost
        half = set(sorted(pages)[::2])
        first = discovered(df.where(df.url.isin(*half)), start, SCOPE)
        rest = {tuple(r) for r in discovered(df, start, SCOPE, first).collect()}
        early = search({u: x for u, x in pages.items() if u in half}, seeds)
        assert rest == search(pages, seeds, early) and {r[0] for r in rest} >= {r[0] for r in got}


def test_nothing_to_follow(spark):
    df = spark.createDataFrame([(SITE, None), (f"{SITE}/akn/act/1", "<a href=''>x</a><a href='http://[bad'>y</a>")], "url string, html string")
    start = spark.createDataFrame([(f"{SITE}/akn/act/1", "act")] * 2, "url string, kind string")
    assert [tuple(r) for r in discovered(df, start, SCOPE).collect()] == [(f"{SITE}/akn/act/1", "act", 0, None)]

from __future__ import annotations

from gleaner.llm import url_filter as uf
from gleaner.llm.queries import QUERIES
from tests.llm.cases import LOWER


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(LOWER), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return host, path


def rule(host, path):
    best = None
    for verdict, text in uf.RULES:
        h, p = text[: text.index("/")], text[text.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(text) > len(best[1])):
            best = (verdict, text)
    return best


URLS = [
    None, "", "no scheme.org/", "http://EXAMPLE.org/es/x", "https://a.example.org/en/123?q=1", "https://example.org?x=/es/", "ftp://org/", "x://badexample.org/es/1",
    "https://example.com/fr/2#top", "https://m.example.com/de/1", "https://example.com", "http://a://b.org/c", "https://İ.ORG/\nz", "https://" + "a" * 5000 + ".net/b",
]


def test_rules_and_edges(spark):
    model = uf.fit(uf.labelled_urls(spark))
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] * 2
    got = uf.judge(spark.createDataFrame(rows, "page_id long, url string, _t string"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = by_hand(r.url)
        assert (r._url.host, r._url.path) == (host, path)
        found = rule(host, path)
        assert r._url.rule == (found[1] if found else None)
        assert r._url.verdict == (found[0] if found else "block" if r._url.p_block > 0.5 else "allow")
    assert uf.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_query_keeps_every_page(spark, folder):
    pages = dict(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect())
    rows = QUERIES["op3_url_filter"](spark, folder).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        found = rule(*by_hand(pages[r.page_id]))
        assert (r.rule, r.verdict) == (found[::-1] if found else (None, r.verdict))


def test_held_out_names(spark):
    model = uf.fit(uf.labelled_urls(spark))
    bad = ["https://best-casino.example.net/en/5", "https://adult-x9.example.net/a", "http://my-spam-farm.example.net/q", "https://cheap-pills4u.example.net/z"]
    good = ["https://library-city.example.net/en/5", "https://cookingschool.example.net/a", "http://musicjournal.example.net/q", "https://weathermaps.example.net/z"]
    frame = spark.createDataFrame([(u,) for u in bad + good], "url string")
    verdicts = {r.url: r._url.verdict for r in uf.judge(frame, model, rules=()).collect()}
    assert [verdicts[u] for u in bad] == ["block"] * 4 and [verdicts[u] for u in good] == ["allow"] * 4


def test_names_that_were_not_learned_from(spark):
    """One name of each word, every time in other surroundings, is left out of the fit."""
    names = uf.labelled_names()
    out = lambda k: (k + k // 5) % 5 == 0
    kept, held = [n for k, n in enumerate(names) if not out(k)], [n for k, n in enumerate(names) if out(k)]
    model = uf.fit(uf.labelled_urls(spark, kept))
    frame = spark.createDataFrame([(f"http://{name}.example.org/en/7", label) for name, label in held], "url string, label int")
    rows = uf.judge(frame, model, rules=()).collect()
    right = sum((r._url.verdict == "block") == (r.label == 1) for r in rows)
    assert right >= 0.9 * len(rows)


def test_the_column_scores_like_plain_python(spark):
    """A plain page's verdict follows from its probability, and both from the same weights for the same text."""
    model = uf.fit(uf.labelled_urls(spark))
    frame = spark.createDataFrame([("http://casino.example.org/x",), ("HTTP://CASINO.example.org/x",), ("http://library.example.org/x",)], "url string")
    a, b, c = (r._url.p_block for r in uf.judge(frame, model, rules=()).collect())
    assert a == b > 0.5 > c


def test_one_label_only(spark):
    one = spark.createDataFrame([("https://a.net/", 1), (None, 0), ("https://b.net/", None)], "url string, label int")
    assert uf.judge(spark.createDataFrame([("https://c.net/",)], "url string"), uf.fit(one)).first()._url.verdict == "block"

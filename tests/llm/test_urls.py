import re
from collections import Counter

import numpy as np
import pytest

from wortnetz.llm import urls
from wortnetz.llm.urls import Rule


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.host), default=None)


def standing(pages, rules, damping=urls.DAMPING, rounds=urls.ROUNDS):
    """Dense matrices over hosts."""
    seed, links = {}, set()
    for _, url, html in pages:
        host, path = split(url)
        if not host:
            continue
        r = rule_of(host, path, rules)
        seed.setdefault(host, []).append(r.verdict if r else None)
        for x in re.findall(r"""(?i)<a(?:\s|\s[^<>]*?[\s"'])href\s*+=\s*+["']?+\s*+([^"'\s<>]++)""", html or ""):
            m = re.match("(?i)(?:https?:)?//([^/?#]*)", x)
            if m and m[1] and m[1].lower() != host:
                links.add((host, m[1].lower()))
    names = sorted(set(seed) | {x for pair in links for x in pair})
    at = {h: i for i, h in enumerate(names)}
    a = np.eye(len(names))
    for s, d in links:
        a[at[s], at[d]] = 1
    for h in names:
        up = h.split(".", 1)[-1]
        if "." in up and up in at and up != h:
            a[at[h], at[up]] = a[at[up], at[h]] = 1
    part = lambda h, v: seed.get(h, []).count(v) / max(1, len(seed.get(h, [])))
    share = lambda v: np.array([part(h, v) if part(h, v) > 0.5 else 0 for h in names])
    t0, d0 = share("allow"), share("block")
    t, d = t0, d0
    for _ in range(rounds):
        t = (1 - damping) * t0 + damping * (a / a.sum(1, keepdims=True)).T @ t
        d = (1 - damping) * d0 + damping * (a / a.sum(0, keepdims=True)) @ d
    return {h: (round(t[i], 9), round(d[i], 9)) for h, i in at.items()}


def brute(pages, rules, least=urls.LEAST_DISTRUST, **kw):
    marks, out = standing(pages, rules, **kw), []
    for i, url, _ in pages:
        host, path = split(url)
        r = rule_of(host, path, rules)
        t, d = marks.get(host, (None, None))
        verdict = r.verdict if r else "block" if t is not None and d > least and d > t else "allow"
        out.append((i, host, path, r.host + r.path if r else None, verdict, t, d))
    return out


RULES = [Rule("bad.test", "/", "block"), Rule("ok.bad.test", "/x", "allow"), Rule("good.test", "", "allow"), Rule("a.good.test", "", "block"), Rule("net", "/", "block")]
A = '<a href="{}">x</a>'.format
PAGES = [
    (1, "http://bad.test/", A("http://www.spam.test/1") + A("/own") + A("mailto:a@good.test")),
    (2, "http://WWW.spam.test/p?q://z#f", A("//bad.test/") + "<a class=b href = http://other.test/?x>"),
    (3, "https://spam.test", A("HTTP://BAD.test") * 3),
    (4, "https://good.test/a/b#c", A("https://friend.test/")),
    (5, "https://friend.test?x=1", None),
    (6, "https://a.good.test/", "<area href='http://spam.test/'><b data-href='http://spam.test'>"),
    (7, "https://ok.bad.test/x/y", ""), (8, "https://ok.bad.test/y", "<a\nid='h'href='http://friend.test'>"),
    (9, None, A("http://bad.test/")), (10, "no scheme", "x"), (11, "", None), (12, "://", A("http://bad.test/")), (13, "http:///only/path", None),
    (14, "http://net", None), (15, "http://net/", None), (16, "http://x.net/é ü", None), (17, "ftp://a.b://c/d", "<a href=''>"), (18, "http://user@h.test:80/z", A("javascript:x")),
    (None, "http://bad.test/", None), (1, "http://bad.test/", A("http://www.spam.test/1")), (19, "http://ünï.test/\n?", A("http://bad.test/")), (20, "http://lone.test/", ""),
]


def rounded(rows):
    return Counter((*r[:5], *(None if x is None else f"{x:.6f}" for x in r[5:])) for r in rows)


def collected(df):
    return rounded([tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()])


def test_against_dense_matrices(spark):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, host string, n int").repartition(5)
    assert collected(urls.filter_urls(df, RULES)) == rounded(brute(PAGES, RULES))
    want = brute(PAGES, RULES, least=0.02)
    assert collected(urls.filter_urls(df, RULES, least=0.02)) == rounded(want)
    by = {r[0]: r[4] for r in want}
    assert by[2] == "block" and by[5] == by[9] == by[20] == "allow"  # distrust runs against links, trust along them


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert urls.filter_urls(df.limit(0)).count() == 0
    bare = [(i, u, None) for i, u, _ in PAGES]
    assert collected(urls.filter_urls(spark.createDataFrame(bare, df.schema), RULES)) == rounded(brute(bare, RULES))
    assert collected(urls.filter_urls(df.where("url IS NULL"), RULES)) == rounded(brute([p for p in PAGES if p[1] is None], RULES))


@pytest.mark.parametrize("rounds", [1, 6])
def test_hubs_and_a_hot_host(spark, monkeypatch, rounds):
    for name, value in (("HUB_ROWS", 5), ("HUBS", 10)):
        monkeypatch.setattr(urls, name, value)
        monkeypatch.setattr("wortnetz.llm.common." + name, value)
    pages = [(i, f"http://h{i % 40}.site.test/{i}", A("http://hub.test/") if i % 3 else A(f"http://h{i % 7}.site.test/")) for i in range(200)]
    pages += [(1000 + i, "http://hub.test/x", A(f"http://h{i % 40}.site.test/")) for i in range(300)] + [(2000, "http://site.test/", A("http://bad.test")), (2001, "http://bad.test/", A("http://hub.test"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    got = collected(urls.filter_urls(df, RULES, rounds=rounds))
    assert got == rounded(brute(pages, RULES, rounds=rounds))


def test_long_pages_and_ties_of_rules(spark):
    rules = [Rule("x.test", "/a", "block"), Rule("test", "/abc/d", "allow"), Rule("y.x.test", "/a", "allow"), Rule("x.test", "/a/b", "block")]  # the last two are equally long
    html = "<a " * 50_000 + " href " * 50_000 + "href=" + " " * 50_000 + ">" + A("http://far.test/")
    pages = [(1, "http://y.x.test/a/b", html), (2, "http://x.test/abc/d" + "e" * 100_000, html), (3, "http://far.test/", None)]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules)
    assert collected(got) == rounded(brute(pages, rules))
    assert {r["page_id"]: r["rule"] for r in got.collect()} == {1: "y.x.test/a", 2: "test/abc/d", 3: None}


def test_tables_of_a_call_are_dropped(spark):
    urls.filter_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string"), RULES).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("flows_")]

import re

import numpy as np

from millrace.llm.url_filter import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("bad.net", "/", "block")]
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0].translate(UP)
    tail = re.match(r"[^/?#]*([^#]*)", rest)[1]
    return host, re.match(r"[^?#]*", tail)[0], host + tail if host else None


def rule(host, path):
    fits = [(len(h) + len(p), h, p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[1] + max(fits)[2], max(fits)[3]) if fits else (None, None)


def brute(pages, edges):
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a and b:
            group[root(a)] = root(b)
    passed = {}
    for node in list(group):
        host = re.match(r"[^/?#]*", node)[0]
        v = rule(host, re.match(r"[^?#]*", node[len(host) :])[0])[1]
        if v:
            passed[root(node)] = min(v, passed.get(root(node), v))
    out = []
    for i, url in pages:
        host, path, key = parts(url)
        r, v = rule(host, path)
        out.append((i, host, path, r, v or (passed.get(root(key)) if key in group else None) or "allow"))
    return sorted(out, key=str)


def test_rules_aliases_and_odd_urls(spark):
    canonical = lambda u: f'<html><LINK rel="canonical" href="{u}"></html>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    plain = "http://none.io/"
    rows = [
        (1, "http://A.Example.ORG/es/x?q#f", ""), (2, "https://x.com/de/1", None), (3, "x.com/de/1", ""), (4, None, canonical("http://x.com/de/1")), (5, "http://", ""), (6, "http://x.com?/de/", ""),
        (10, plain + "a", canonical("http://x.com/de/1")), (11, plain + "b", refresh(plain + "a")), (12, plain + "c", canonical("/b")), (13, plain + "d", canonical("http://x.com/fr/2") + refresh("http://x.com/de/3")),
        (14, plain + "e", canonical(plain + "e")), (15, plain + "f", canonical("//bad.net/z")), (16, "http://x.com/de/9", canonical("http://x.org/")), (17, plain + "a#frag", ""), (17, plain + "a#frag", ""),
        (18, plain + "dir/g", canonical("h")), (19, plain + "dir/h", canonical("http://bad.net/")), (20, plain + "i", '<a rel="canonical" href="http://bad.net/">'),
    ]
    n = "none.io/"
    edges = [(n + "a", "x.com/de/1"), (n + "b", n + "a"), (n + "c", n + "b"), (n + "d", "x.com/fr/2"), (n + "d", "x.com/de/3"), (n + "f", "bad.net/z"), ("x.com/de/9", "x.org/"), (n + "dir/g", n + "dir/h"), (n + "dir/h", "bad.net/")]
    found = sorted((tuple(r) for r in judge_urls(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string"), RULES).collect()), key=str)
    assert found == brute([r[:2] for r in rows], edges)


def test_large_component_and_redirect_table(spark):
    rows = [(i, f"http://p.io/{i}", "") for i in range(400)]
    hops = [(f"http://p.io/{i}", f"http://p.io/{i + 1}") for i in range(0, 199)] + [(f"http://p.io/{i}", "http://hub.io/") for i in range(200, 400)] + [("http://hub.io/", "http://bad.net/"), (None, "http://bad.net/"), ("http://p.io/0", "http://p.io/0")]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, spark.createDataFrame(hops, "from_url string, to_url string"))
    assert {r.page_id: r.verdict for r in found.collect()} == {i: "allow" if i < 200 else "block" for i in range(400)}


def test_shuffled_chains_of_links(spark):
    """Chains of canonical links and redirects in random order of their names; one of them ends at a blocked url."""
    rng = np.random.default_rng(4)
    names = [f"http://q.io/{i}" for i in rng.permutation(1_200)]
    chains = [names[:600], names[600:]]
    rows = []
    for chain, last in zip(chains, ("http://x.com/de/1", "http://free.io/")):
        for k, (a, b) in enumerate(zip(chain, [*chain[1:], last])):
            rows.append((a, f'<link rel="canonical" href="{b}">' if k % 2 else f"<meta http-equiv=refresh content='0; url={b}'>" + "<p>text</p>" * (5_000 if k == 7 else 1)))
    pages = [(i, url, html) for i, (url, html) in enumerate(rows)]
    found = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert found == {i: "block" if i < 600 else "allow" for i in range(1_200)}


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).collect() == []

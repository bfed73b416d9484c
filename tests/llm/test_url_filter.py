"""Host reputation against the same formulas in plain Python; hosts, paths and rules of odd urls."""

import re
from collections import defaultdict

import pytest

from tableglass.llm import url_filter as U

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def test_hosts_paths_and_rules(spark):
    rows = [(1, "http://WWW.Example.COM/en/1?x#y"), (2, "https://example.com/en/"), (3, "https://a.example.com/EN/"), (4, "http://b.net/es/x"), (5, "http://net?/es/"), (6, None),
            (7, "no scheme"), (8, "x://"), (9, "http://a.com"), (10, "http://u://v/w"), (11, "http://notnet/es/"), (12, "http://h\n/p\nq"), (None, "http://b.net/fr/"), (4, "http://b.net/es/x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS rate", "3 AS key")
    none = spark.createDataFrame([], "key bigint, bad int")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, none, RULES).collect()), key=str)
    want = []
    for i, url in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(r, v) for r, v in RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h):])]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        want.append((i, host, path, rule, verdict))
    assert got == sorted(want, key=str)


def test_posterior(spark):
    pages, outcomes = [], []
    for h, n, bad in (("a.x.com", 40, 38), ("b.x.com", 30, 2), ("c.y.com", 2, 2), ("d.y.co.uk", 25, 1), ("e.y.co.uk", 0, 0), ("f.org", 12, 6)):
        for k in range(n + 1):
            pages.append((len(pages), f"http://{h}/{k}"))
            if k < n:
                outcomes.append((pages[-1][0], int(k < bad)))
    outcomes += [(0, None), (None, 1), (10_000, 1)]
    df, out = spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(outcomes, "key bigint, bad int")
    got = {r["host"]: (r["rate"], r["lower"], r["verdict"]) for r in U.judge(df, out).collect()}
    hosts, label = defaultdict(lambda: [0, 0]), dict(o for o in outcomes if None not in o)
    for i, u in pages:
        h = u.split("/")[2]
        hosts[h][0] += i in label
        hosts[h][1] += label.get(i, 0)
    suffix = lambda h: "co.uk" if h.endswith("co.uk") else h.split(".")[-1]
    domain = lambda h: ".".join(h.split(".")[-3:] if h.endswith("co.uk") else h.split(".")[-2:])
    levels = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for h, (n, b) in hosts.items():
        for level, key in zip(levels, (suffix(h), domain(h))):
            level[key][0] += n
            level[key][1] += b
    every = [sum(x) for x in zip(*hosts.values())]
    mean = (every[1] + 0.5) / (every[0] + 1)

    def weight(groups):
        g = [(n, b) for n, b in groups.values() if n > 1]
        if len(g) < 2:
            return 10.0
        between = sum(n * (b / n - mean) ** 2 for n, b in g)
        rho = (between / (mean * (1 - mean)) - len(g)) / (sum(n for n, _ in g) - len(g))
        return max(1, min(1000, 1 / rho - 1)) if rho > 0 else 1000.0
    post = lambda prior, w, n, b: (prior * w + b) / (w + n)
    ws, wd, wh = weight(levels[0]), weight(levels[1]), weight(hosts)
    for h, (n, b) in hosts.items():
        s = post(mean, ws, *levels[0][suffix(h)])
        rate = post(post(s, wd, *levels[1][domain(h)]), wh, n, b)
        lower = max(0, rate - 1.645 * (rate * (1 - rate) / (wh + n + 1)) ** 0.5)
        assert got[h] == (pytest.approx(rate), pytest.approx(lower), "block" if lower > 0.5 else "allow"), h
    assert got["a.x.com"][2] == "block" and got["b.x.com"][2] == "allow"


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert U.judge(pages, spark.createDataFrame([], "key bigint, bad int"), RULES).collect() == []

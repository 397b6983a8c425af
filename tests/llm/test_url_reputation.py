import pytest
from pyspark.sql import functions as F

from scoreline.llm import queries
from scoreline.llm import url_reputation as u


def test_split_and_registered(spark):
    cases = [
        ("http://A.Example.COM/x/Y?q#f", "a.example.com", "/x/Y"), ("https://h?q=/a", "h", ""), ("x://h#f/", "h", ""), ("no scheme", "", ""), (None, "", ""), ("", "", ""), ("://h/p", "h", "/p"),
        ("a://b://c/d", "b:", "//c/d"), ("http://ÀB.de/ü", "Àb.de", "/ü"), ("http:///p", "", "/p"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string")
    host, path = u.split_url(F.col("url"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [c[1:] for c in cases]
    hosts = [("a.b.example.com", "example.com", "com"), ("x.y.co.uk", "y.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("me@h.org:80", "h.org", "org"), ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("localhost", "localhost", "localhost"), ("", "", ""), ("h.com.", "h.com", "com")]
    d, s = u.registered(F.col("h"))
    df = spark.createDataFrame([(h[0],) for h in hosts], "h string")
    assert [tuple(r) for r in df.select("h", d, s).collect()] == hosts


def test_longest_rule_wins(spark):
    cases = [
        ("http://shop.com/en/1", "com/en/", "block"), ("http://www.example.com/en/71", "example.com/en/7", "allow"), ("http://example.com/en/8", "com/en/", "block"), ("http://badexample.com/en/7", "com/en/", "block"),
        ("http://x.net/de/", "net/de/", "allow"), ("http://a.example.net/de/8", "example.net/de/8", "block"), ("http://com/en/", "com/en/", "block"), ("http://x.org/es", None, "allow"), ("http://x.org/es/q", "org/es/", "block"), (None, None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in u.judge(pages, spark.createDataFrame([], "page_id long, bad long"), queries.RULES).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def reference(pages, outcomes, low=1.0, high=1000.0, z=1.645):
    """The hierarchy in plain Python over {host: (n, bad)}."""
    n, bad = {}, {}
    for p, b in outcomes:
        h = pages[p]
        n[h], bad[h] = n.get(h, 0) + 1, bad.get(h, 0) + b
    hosts = {h: (n.get(h, 0), bad.get(h, 0)) for h in set(pages.values())}
    up = lambda level, parent: {k: tuple(map(sum, zip(*(v for c, v in level.items() if parent(c) == k), strict=True))) for k in {parent(c) for c in level}}
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda d: d.split(".")[-1])
    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    total = tuple(map(sum, zip(*suffixes.values(), strict=True)))
    mean = {"": (total[1] + 1) / (total[0] + 2)}
    k = None
    for level, parent in ((suffixes, lambda s: ""), (domains, suffix), (hosts, domain)):
        prior = {c: mean[parent(c)] for c in level}
        use = [c for c in level if level[c][0]]
        seen = sum(level[c][0] * (level[c][1] / level[c][0] - prior[c]) ** 2 for c in use)
        spread = {c: prior[c] * (1 - prior[c]) for c in use}
        more = sum((level[c][0] - 1) * spread[c] for c in use)
        rho = 1 / (1 + high) if not more else min(max((seen - sum(spread.values())) / more, 1 / (1 + high)), 1 / (1 + low))
        k = 1 / rho - 1
        mean = {c: (level[c][1] + k * prior[c]) / (level[c][0] + k) for c in level}
    out = {}
    for h, (m, b) in hosts.items():
        a, c = b + k * prior[h], m - b + k * (1 - prior[h])
        out[h] = (a / (a + c), a / (a + c) - z * (a * c / ((a + c) ** 2 * (a + c + 1))) ** 0.5)
    return out


def test_shrinkage_against_plain_python(spark):
    hosts = [f"{h}.{d}.{s}" for h in ("a", "b", "c") for d in ("x", "y") for s in ("com", "net")]
    pages = {i: hosts[i * 7 % len(hosts)] if i % 3 else "a.x.com" for i in range(400)}
    outcomes = [(i, int(pages[i].startswith("a.x") or i % 11 == 0)) for i in range(0, 400, 2)] + [(2, 1), (2, 1)]
    df = spark.createDataFrame(list(pages.items()), "page_id long, host string")
    got = {r.host: (r.mean, r.lower) for r in u.reputation(df, spark.createDataFrame(outcomes, "page_id long, bad long")).collect()}
    want = reference(pages, outcomes)
    assert set(got) == set(want)
    for h in want:
        assert got[h] == pytest.approx(want[h])
    assert got["a.x.com"][1] > 0.5 > got["b.y.net"][0]


def test_the_largest_bounds_are_blocked(spark):
    rates = {f"h{k}.s{k % 3}.com": k / 20 for k in range(20)}
    hosts = [h for h in rates for _ in range(100)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    out = spark.createDataFrame([(i, int(i % 100 < 100 * rates[h])) for i, h in enumerate(hosts)], "page_id long, bad long")
    blocked = lambda **how: sorted({r.host for r in u.judge(pages, out, [], **how).where("verdict = 'block'").collect()})
    assert blocked() == ["h18.s0.com", "h19.s1.com"] and blocked(share=0.26) == ["h15.s0.com", "h16.s1.com", "h17.s2.com", "h18.s0.com", "h19.s1.com"]
    assert blocked(share=0.04) == [] and len(blocked(share=1)) == 20
    assert blocked(limit=0.95) == [] and blocked(limit=0.7) == ["h16.s1.com", "h17.s2.com", "h18.s0.com", "h19.s1.com"]
    rules = [u.Rule("h19.s1.com", "/", "allow"), u.Rule("h0.s0.com", "/", "block")]
    judged = {r.host: (r.verdict, r.method) for r in u.judge(pages, out, rules).collect()}
    assert judged["h19.s1.com"] == ("allow", "block") and judged["h0.s0.com"] == ("block", "allow") and judged["h18.s0.com"] == ("block", "block")


def test_suffixes_are_a_parameter(spark):
    df = spark.createDataFrame([("a.b.city.jp",), ("x.co.uk",)], "h string")
    assert [tuple(r) for r in df.select(*u.registered(F.col("h"), ("city.jp",))).collect()] == [("b.city.jp", "city.jp"), ("co.uk", "uk")]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://h.com/", "q"), (1, "http://h.com/", "q"), (None, None, None), (2, None, "rule")], "page_id long, url string, host string")
    out = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "page_id long, bad long")
    assert u.judge(pages, out, []).count() == 4 and u.judge(pages.where("false"), out, queries.RULES).count() == 0

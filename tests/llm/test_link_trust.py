import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm.link_trust import RULES, filter_urls

PAGES = "page_id bigint, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path, rules):
    fits = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def brute(pages, rules, damping=0.85, rounds=200):
    rows = [(i, *split(u), h) for i, u, h in pages]
    seeds, count, links = {"allow": Counter(), "block": Counter()}, Counter(), Counter()
    for _, host, path, html in rows:
        if host:
            count[host] += 1
            verdict = rule_of(host, path, rules)[1]
            if verdict:
                seeds[verdict][host] += 1
            for to in re.findall(r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html or ""):
                to = to.lower()
                if to != host:
                    links[host, to] += 1

    def walk(seed, edges):
        total = Counter()
        for (a, _), n in edges.items():
            total[a] += n
        start = {h: (1 - damping) * n / count[h] for h, n in seed.items()}
        score = dict(start)
        for _ in range(rounds):
            new = defaultdict(float, start)
            for (a, b), n in edges.items():
                new[b] += damping * score.get(a, 0.0) * n / total[a]
            score = new
        return score

    trust = walk(seeds["allow"], links)
    distrust = walk(seeds["block"], {(b, a): n for (a, b), n in links.items()})
    out = []
    for i, host, path, _ in rows:
        rule, verdict = rule_of(host, path, rules)
        t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
        out.append((i, host, path, rule, verdict or ("block" if d > t else "allow"), t, d))
    return out


def same(df, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], abs=5e-3)


def test_graph(spark):
    def a(*hosts):
        return "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)

    pages = [
        (1, "http://www.example.net/en/1", a("good.org", "GOOD.org", "www.example.net")),
        (2, "http://www.example.net/en/2?q=/de/", None), (3, "https://spam.net/a", a("farm.com")),
        (4, "http://farm.com/x", a("spam.net", "spam.net", "other.com")), (5, "http://good.org/a", a("friend.com")),
        (6, "http://friend.com", "<a href='//good.org'>"), (7, "http://lone.com/", "<a href=/en/1>"),
        (8, "http://half.example.com/de/1", a("farm.com")), (9, "http://half.example.com/en/1", a("good.org")),
        (10, None, a("spam.net")), (11, "no scheme", None), (12, "x://NET/a", ""), (13, "http://net?x", ""), (14, "http://net", ""),
        (15, "a://b.org/fr/c://d", ""), (None, "http://spam.net/a", a("farm.com")), (4, "http://farm.com/x", a("spam.net")),
        (16, "http://notexample.net/en/x", ""), (17, "http://\nodd.org/fr/\nx#y", a("user@friend.com:80"))]
    pages[-1] = (17, "http://\nodd.org/fr/\nx#y", a("friend.com"))
    df = spark.createDataFrame(pages, PAGES)
    same(filter_urls(df, tolerance=1e-3), brute(pages, RULES))
    verdict = {r.page_id: r.verdict for r in filter_urls(df, tolerance=1e-2).collect()}
    assert verdict[4] == "block" and verdict[5] == "allow" and verdict[6] == "allow" and verdict[7] == "allow"


def test_small_shares_reach_far_hosts(spark):
    """A blocked host that very many link to; hosts six and more links behind one of them."""
    pages = [(0, "http://spam.net/", "")] + [(i, f"http://fan{i}.com/", "<a href='//spam.net'>") for i in range(1, 2001)]
    pages += [(3000, "http://chain0.com/", "<a href='//fan1.com'>")]
    pages += [(3000 + i, f"http://chain{i}.com/", f"<a href='//chain{i - 1}.com'>") for i in range(1, 9)]
    rows = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, PAGES)).collect()}
    want = {r[0]: r for r in brute(pages, RULES)}
    for i in (0, 1, *range(3000, 3009)):
        assert rows[i].verdict == want[i][4] == "block"
        assert rows[i].distrust == pytest.approx(want[i][6], rel=1e-3)


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "<a href='http://b/'>")], PAGES)
    assert filter_urls(df, rules=()).first().verdict == "allow"
    assert filter_urls(df.limit(0)).count() == 0


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    same(filter_urls(df), brute([tuple(r) for r in df.select("page_id", "url", "html").collect()], RULES))

import fnmatch
import random
import re

from strata.llm.url_filter import BLOCK_GLOBS, GlobAutomaton, UrlRule, filter_urls, judge

RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"),
         UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = split(url)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.verdict
    blocked = not (host or path) or any(
        re.fullmatch(fnmatch.translate(h), "." + host) and re.fullmatch(fnmatch.translate(p), path, re.S)
        for h, p in BLOCK_GLOBS)
    return host, path, None, "block" if blocked else "allow"


URLS = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/17", "http://example.org", "http://example.org/", None, "",
        "no scheme", "https://x.com/fr/a", "https://x.com/de/a?x=/fr/", "https://x.com?y", "https://x.com#/fr/",
        "http://badexample.org/es/", "ftp://x.net/a.exe", "http://evil.net/x.example.org/es/", "http://ads.x.net/",
        "http://x.net/" + "a" * 5000 + ".zip", "://", ":///p", "http://é.ÉXAMPLE.org/es/", "http://x.net/a\nb.png",
        "http://org/", "http://a.casinos.net/x", "http://x.net/a/cart/b", "http://u@x.org:80/es/", "a://b://c/d"]


def test_judgement_matches_brute_force():
    rng = random.Random(5)
    urls = URLS + ["http://" + "".join(rng.choices("aorgexmplc.:/?#dsfn", k=rng.randint(0, 25))) for _ in range(3000)]
    parts = [split(u) for u in urls]
    names, verdicts = judge([h for h, _ in parts], [p for _, p in parts], RULES)
    assert [(*x, n, v) for x, n, v in zip(parts, names, verdicts)] == [brute(u, RULES) for u in urls]


def test_automaton_matches_globs_over_many_words():
    rng = random.Random(6)
    globs = [("".join(rng.choices("ab.*?", k=rng.randint(1, 9))), "".join(rng.choices("ab/*?", k=rng.randint(0, 90))))
             for _ in range(40)]
    automaton = GlobAutomaton(globs)
    assert automaton.words > 4
    urls = ["".join(rng.choices("ab./", k=rng.randint(0, 12))).encode() for _ in range(400)]
    got = automaton.match(urls)
    for j, (h, p) in enumerate(globs):
        host = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in h)
        path = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p)
        rx = re.compile(host + path, re.S)
        assert [bool(rx.fullmatch(u.decode())) for u in urls] == got[:, j].tolist()


def test_query_rows(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, None, None, None), (0, URLS[0], "x", "y")],
                                  "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, filter_urls(pages, RULES).collect()), key=str)
    want = sorted([(i, *brute(u, RULES)) for i, u in enumerate(URLS)] + [(None, *brute(None, RULES)), (0, *brute(URLS[0], RULES))],
                  key=str)
    assert got == want


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0

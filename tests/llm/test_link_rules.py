"""Link verdicts against every rule tried on every link."""

import random
import re

from mediacat.llm import link_rules

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.example.net", "/", "block"), ("a.example.net", "/en/x", "allow"), ("EXAMPLE.org", None, "block"),
    ("example.org", "", "allow"), ("", "/", "block"), (None, "/", "block"), ("localhost", "/", "block"),
    ("notexample.net", "/", "allow"),
]


def plain(url):
    found = re.match(link_rules._URL, url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    best = None
    for h, p, verdict in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            one = (len(h + p), len(h), verdict, h + p)
            best = max(best, one) if best else one
    return (host, path, best[3], best[2]) if best else (host, path, None, "allow")


def test_against_every_rule(spark):
    rnd = random.Random(3)
    hosts = ["example.net", "a.example.net", "b.a.Example.net", "xexample.net", "net", "example.com", "w.example.com", "x.org",
             "example.org", "w.example.org", "localhost", "", "notexample.net", "..", "example.net.", "tld.", "user@example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/xy?q=/fr/", "/de/1#top", "/fr/?a", "?q", "#f", "/DE/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "http:/x.net/", "HTTP://X\nY.NET/a\nb"]
    urls += ["http://hot.example.net/en/%d" % i for i in range(3000)]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://w.net/", "y"), (1, urls[1], "z")]
    rnd.shuffle(rows)
    items = spark.createDataFrame(rows, "media_item_id bigint, media_google_url string, bucket string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = link_rules.judge_links(items, rules).collect()
    have = sorted((str(r.media_item_id), r.host, r.path, r.rule or "", r.verdict) for r in got)
    want = []
    for i, u, _ in rows:
        host, path, rule, verdict = plain(u)
        want.append((str(i), host, path, rule or "", verdict))
    assert have == sorted(want)


def test_no_links_or_no_rules(spark):
    items = spark.createDataFrame([], "media_item_id bigint, media_google_url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert link_rules.judge_links(items, rules).collect() == []
    some = spark.createDataFrame([(1, "http://a.net/")], items.schema)
    assert link_rules.judge_links(some, rules.limit(0), "block").first().verdict == "block"

import re

import __spark_entry__ as entry
from ledgerloom.llm import url_rules
from tests.conftest import SMALL
from tests.llm.helpers import clashing, sample

SCHEMA = "page_id long, url string, html string"


def plain(url):
    host = path = ""
    if url and "://" in url:
        after = url.split("://", 1)[1]
        raw = re.match("[^/?#]*", after)[0]
        path = re.match("[^?#]*", after[len(raw):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_rules.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def checked(found, urls):
    assert len(found) == len(urls)
    for r in found:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or rule is None and r.verdict in ("allow", "block")


def test_query(spark):
    found = entry.queries()["op4_association_url_filter"](spark, SMALL).collect()
    checked(found, dict(sample(SMALL, "page_id, url", "pages")))


def test_awkward_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "a://b://c/d",
            "http://example.com", "http://example.com?x=/en/", "http://notexample.com/en/",
            "http://x.net/es/#f", "http://net/fr/a?b", "http://É.com/ü", "http://x.org/" + "a/" * 5000,
            "http://com/", "http://.com/", "http://x.org/a\nb"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA)
    found = url_rules.judged(clashing(df, "row", "tokens", "host", "verdict", "key")).collect()
    checked(found, dict(enumerate(urls)))
    assert url_rules.judged(df.limit(0)).count() == 0
    repeated = url_rules.judged(df.unionByName(df)).collect()
    assert len(repeated) == 2 * len(urls)


def test_mined_rules_decide_where_no_rule_fits(spark):
    rows = [(f"http://h{i}.net/es/shop/{i}", None) for i in range(30)]
    rows += [(f"http://h{i}.com/news/{i}", None) for i in range(30)]
    rows += [("http://x.org/es/shop/1", "block"), ("http://x.org/news/1", "allow"),
             ("http://x.org/other", "allow")]
    df = spark.createDataFrame([(i, u, None) for i, (u, _) in enumerate(rows)], SCHEMA)
    verdict = {r.page_id: r.verdict for r in url_rules.judged(df).collect()}
    for i, (_, expected) in enumerate(rows):
        assert expected is None or verdict[i] == expected


def test_rules_equal_counting(spark):
    """Confidence and support of every mined rule, and no redundant ones."""
    drawn = [(["a", "b", "c"][: 1 + i % 3] + (["d"] if i % 2 else []),
              "block" if i % 3 == 2 or i % 7 == 0 else "allow") for i in range(200)]
    df = spark.createDataFrame(drawn, "tokens array<string>, verdict string")
    rules = url_rules.mined(df, 0.05, 0.7).collect()
    assert rules
    for r in rules:
        has = [v for t, v in drawn if set(r.antecedent) <= set(t)]
        hits = has.count(r.verdict)
        assert abs(r.confidence - hits / len(has)) < 1e-9 and abs(r.support - hits / 200) < 1e-9
        assert r.confidence >= 0.7 and r.support >= 0.05 and r.key in r.antecedent
        assert not any(set(o.antecedent) < set(r.antecedent) and o.verdict == r.verdict
                       and o.confidence >= r.confidence for o in rules)

import re

import pytest
from pyspark.sql import functions as F
from tableproof.llm.queries import URL_RULES
from tableproof.llm.url_filter import TemplateTree, judge_urls

SCHEMA = "page_id bigint, url string, host string, shape string"
NO_LABELS = "page_id bigint, good int"


def judge(spark, urls, labels=(), **kw):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], SCHEMA)
    known = spark.createDataFrame(list(labels), NO_LABELS)
    return {r.page_id: r for r in judge_urls(pages, known, URL_RULES, TemplateTree(**kw)).collect()}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://A.Example.ORG/", "https://ÄB.org/x?q=/y", "http://org/es/",
            "http://example.org/es/1", "http://x.example.org/es/1#f", "http://badexample.org/es/1", "http://example.org/en/17",
            "http://example.org/en/2", "http://a.com/fr/1", "http://a.com/de/1?x", "http://a.com/de", "a://b://c.com/de/2", "http://u:p@h.net:80/a//b/",
            "http://x.org?y://z.com/de/"]
    got = judge(spark, urls)
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path) == parts(u), u
        best = None
        for rule, says in URL_RULES:
            h, _, p = rule.partition("/")
            host, path = parts(u)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = (rule, says)
        assert got[i].rule == (best and best[0]), u
        assert got[i].verdict == (best[1] if best else "allow"), u


def test_impure_branch_is_blocked_and_its_like_merged(spark):
    urls = [f"http://s.net/{d}/{i}" for d in ("spam", "a", "b") for i in range(100)]
    labels = [(n, 0 if "/spam/" in u else 1) for n, u in enumerate(urls)]
    got = judge(spark, urls, labels)
    for n, u in enumerate(urls):
        assert got[n].verdict == ("block" if "/spam/" in u else "allow"), (u, got[n])


def test_many_children_become_one_wildcard(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    urls = [f"http://s.net/user/{name(i)}/post" for i in range(200)] + [f"http://s.net/help/{x}/post" for x in "ab" for _ in range(50)]
    labels = [(n, int("/user/" in u)) for n, u in enumerate(urls)]
    got = judge(spark, urls, labels, similar=-1.0)
    assert {got[n].template for n in range(200)} == {"s.net/user/*/post"}
    assert {got[n].template for n in range(200, 300)} == {"s.net/help/a/post", "s.net/help/b/post"}


def name_of(i):
    return "".join(chr(97 + int(c)) for c in str(i))


@pytest.mark.parametrize("sections", [30, 40, 4000])
def test_a_bad_section_is_blocked_among_any_number_of_good_ones(spark, sections):
    pages = 100 if sections < 1000 else 12
    urls = [f"http://s.net/{name_of(d)}/{i}" for d in range(sections) for i in range(pages)]
    labels = [(n, int(not u.startswith(f"http://s.net/{name_of(7)}/"))) for n, u in enumerate(urls)]
    got = judge(spark, urls, labels)
    for n, good in labels:
        assert got[n].verdict == ("allow" if good else "block"), (urls[n], got[n])


def test_a_bad_branch_below_sections_of_the_average_share(spark):
    """Every section is half bad, so only the branches below tell good from bad; other hosts are clean."""
    urls = [f"http://hot.net/{name_of(d)}/{x}/{i}" for d in range(50) for x in ("aa" if d % 2 else "bb", "bb" if d % 2 else "aa") for i in range(20)]
    urls += [f"http://h{name_of(j)}.net/x/{i}" for j in range(100) for i in range(40)]
    bad = {n for n, u in enumerate(urls) if "hot.net" in u and ("/aa/" in u) == (len(u.split("/")[3]) == 1)}
    got = judge(spark, urls, [(n, int(n not in bad)) for n in range(len(urls))])
    assert {n for n in got if got[n].verdict == "block"} == bad


def test_unlabelled_children_become_one_wildcard_and_long_urls_pass(spark):
    urls = [f"http://s.net/{name_of(i)}" for i in range(100)] + ["http://s.net/" + "ab/" * 50_000]
    got = judge(spark, urls, [(i, 1) for i in range(5)])
    assert {r.verdict for r in got.values()} == {"allow"} and len({got[n].template for n in range(100)}) == 1


def test_empty_tables(spark):
    assert judge(spark, []) == {}
    got = judge(spark, ["http://a.net/1", "http://a.net/1"], [(0, None), (None, 1)])
    assert {r.verdict for r in got.values()} == {"allow"}


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/1", "", "")], SCHEMA)
    plan = judge_urls(pages, spark.createDataFrame([], NO_LABELS), URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

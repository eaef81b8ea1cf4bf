"""Rules, and block decisions spread over links."""

import __spark_entry__ as entry
from tests.oracle import compare, duck
from tracemill.llm.urls import RULE_SCHEMA, filter_urls

RULES = [("com", "/", "allow"), ("bad.org", "/", "block"), ("ok.bad.org", "/", "allow"), ("net", "/es/", "block")]


def test_query_equals_sql(spark, sf_dir):
    assert compare(entry.queries()["op5_url_filter"](spark, sf_dir), duck(sf_dir), entry.oracle_sql()["op5_url_filter"]) is None


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def verdicts(df):
    return {r["page_id"]: r["verdict"] for r in df.collect()}


def test_blocks_spread_over_links_but_not_over_allows(spark):
    canonical = '<LINK href="{}" rel=canonical>'.format
    refresh = "<meta http-equiv='Refresh' content='0; url={}'>".format
    rows = [
        ("http://a.io/1", canonical("https://bad.org/x#top")), ("http://a.io/2", refresh("/1")), ("http://b.io/d/3", canonical("../3")),
        ("http://good.com/4", canonical("http://a.io/2")), ("http://c.io/5", canonical("//good.com/4")), ("http://d.io/6", ""),
        ("https://a.io/1#frag", None), ("http://OK.bad.org/7", None), ("http://x.net/es/8", None), ("http://x.net/e", None),
        ("http://e.io/q?x=1", canonical("q")), ("http://f.io/9", '<link rel="stylesheet" href="http://bad.org/x">'),
    ]
    got = verdicts(filter_urls(pages_of(spark, rows), spark.createDataFrame(RULES, RULE_SCHEMA)))
    blocked = {0, 1, 4, 6, 8}  # 4 is tied to the block through 3, which its own rule allows
    assert got == {i: "block" if i in blocked else "allow" for i in range(len(rows))}


def test_canonical_in_any_case_and_place_of_rel(spark):
    tags = ['<LINK REL="CANONICAL" HREF="{}">', "<link rel='Canonical' href='{}'>", '<link rel="alternate canonical" href="{}">',
            '<link href="{}" rel=\'nofollow\n CANONICAL alternate\' />', "<link rel=Canonical href={}>", "<link href={} rel=CANONICAL/>"]
    others = ['<link rel="canonical-like" href="{}">', '<link rel="alternate" title="canonical" href="{}">',
              '<link rel="not-canonical" href="{}">', '<link data-rel="canonical" href="{}">']
    rows = [(f"http://s{i}.io/", t.format("http://bad.org/x")) for i, t in enumerate(tags + others)]
    got = verdicts(filter_urls(pages_of(spark, rows), spark.createDataFrame(RULES, RULE_SCHEMA)))
    assert got == {i: "block" if i < len(tags) else "allow" for i in range(len(rows))}


def test_given_links_and_long_chains(spark):
    rows = [(f"http://h{i}.io/", None) for i in range(40)] + [("http://bad.org/", None)]
    links = spark.createDataFrame([(f"h{i}.io/", f"h{i + 1}.io/") for i in range(29)] + [("h29.io/", "bad.org/")], "a string, b string")
    got = verdicts(filter_urls(pages_of(spark, rows), spark.createDataFrame(RULES, RULE_SCHEMA), links))
    assert got == {i: "block" if i < 30 or i == 40 else "allow" for i in range(41)}


def test_odd_urls_and_empty(spark):
    rows = [(None, None), ("", ""), ("no scheme", None), ("http://", None), ("x://HOST.Bad.ORG?q#f", ""), ("a://b://c/d", ""),
            ("http://é.com/ü", None), ("http://bad.org/\nx", None), ("http://bad.org/", "<link"), ("http://bad.org/", "<link")]
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    got = [tuple(r)[1:5] for r in filter_urls(pages_of(spark, rows), rules).orderBy("page_id").collect()]
    assert got[:6] == [("", "", None, "allow")] * 4 + [("host.bad.org", "", None, "allow"), ("b:", "//c/d", None, "allow")]
    assert got[6] == ("é.com", "/ü", "com/", "allow") and got[7][:2] == ("bad.org", "/\nx")
    assert all(g[3] == "block" for g in got[7:])
    assert filter_urls(pages_of(spark, rows).limit(0), rules).count() == 0
    assert all(v == "allow" for v in verdicts(filter_urls(pages_of(spark, rows), rules.limit(0))).values())

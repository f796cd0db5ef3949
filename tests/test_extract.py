import pytest
from helpers import make, values

from feedtide.operators import extract
from feedtide.sources.registry import registry_violations
from feedtide.sources.fetches import fetch_failures, scan_fetches

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
RSS = """<?xml version="1.0" encoding="UTF-8"?><!-- head --><rss version="2.0" xmlns:media="m" xmlns:dc="d"><channel>
<title>Channel</title><link>http://site/</link>
<item><title>One &amp; <![CDATA[<b>two</b>]]></title><link> http://site/1 </link>
  <pubDate>Sat, 03 Feb 2024 08:05:00 GMT</pubDate><media:title>other</media:title></item>
<item><title>no link</title></item>
<item><guid>http://site/guid</guid><dc:date>2024-02-01</dc:date></item>
<item><guid isPermaLink="false">tag:7</guid><title>no link either</title></item>
<item><title>undated</title><link>http://site/4?utm_source=x</link></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>
<entry><title type="html">First</title><link rel="self" href="http://site/self"/><link href="http://site/a"/>
  <updated>2024-02-03T08:05:00+02:00</updated></entry>
<entry><title>Second</title><link rel="alternate" type="text/html" href="http://site/b"/>
  <published>2024-01-01T00:00:00Z</published><updated>2024-02-03T08:05:00Z</updated></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d"><channel><title>c</title></channel>
<item><title>Old</title><link>http://site/old</link><dc:date>2024-01-02T03:04:05Z</dc:date></item></rdf:RDF>"""
URLSET = f"""<?xml version="1.0"?><urlset {NS}><url><loc>
  http://site/p1.html </loc><lastmod> 2024-02-03 </lastmod></url><url><lastmod>2024</lastmod></url>
  <url><loc>http://site/p2</loc></url></urlset>"""
PREFIXED = """<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>http://site/q</s:loc></s:url></s:urlset>"""
FOREIGN = "<urlset><url><loc>http://site/none</loc></url></urlset>"


def index(*children):
    inner = "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children)
    return f"<sitemapindex {NS}>{inner}</sitemapindex>"


@pytest.fixture(scope="module")
def registry(spark):
    rows = [
        ("rss", "rss", None), ("atom", "rss", None), ("rdf", "rss", None), ("broken", "rss", None),
        ("map", "sitemap", r".*\.html$"), ("prefixed", "sitemap", None), ("foreign", "sitemap", None),
        ("index", "sitemap", None), ("down", "rss", None), ("page", "sitemap", None), ("mixed", "sitemap", None),
    ]
    return make(
        spark,
        "REGISTRY",
        *[dict(source=s, type=t, url_pattern=p, exhaustive=False, source_ord=i) for i, (s, t, p) in enumerate(rows)],
    )


@pytest.fixture(scope="module")
def fetches(spark):
    def doc(source, body, url="top", parent=None, status=200):
        return dict(run_id="r1", source=source, source_ord=1, fetch_url=url, parent_url=parent, http_status=status, body=body)

    return make(
        spark,
        "FETCHES",
        doc("rss", RSS), doc("atom", ATOM), doc("rdf", RDF),
        doc("broken", "<rss><channel><item><title>open<link>http://x</link></item>"),
        doc("map", URLSET), doc("prefixed", PREFIXED), doc("foreign", FOREIGN),
        doc("down", RSS, status=503), doc("page", "<html><body/></html>"), doc("mixed", RSS),
        doc("index", index("c2", "deep", "c1", "missing", "gone")),
        doc("index", URLSET, "c1", "top"), doc("index", PREFIXED, "c2", "top"),
        doc("index", index("c3"), "deep", "top"), doc("index", URLSET, "gone", "top", 404),
    )


def test_failed_fetches_contribute_nothing(fetches):
    assert scan_fetches(fetches).filter("source = 'down'").count() == 0


def test_rss_flavours(fetches, registry):
    rows = extract.rss_items(fetches, registry)
    assert values(rows, "source", "item_ord", "url", "title", "published_at") == sorted(
        [
            ("rss", 0, "http://site/1", "One & <b>two</b>", "2024-02-03T08:05:00Z"),
            ("rss", 2, "http://site/guid", None, "2024-02-01T00:00:00Z"),
            ("rss", 4, "http://site/4?utm_source=x", "undated", None),
            ("atom", 0, "http://site/a", "First", "2024-02-03T06:05:00Z"),
            ("atom", 1, "http://site/b", "Second", "2024-01-01T00:00:00Z"),
            ("rdf", 0, "http://site/old", "Old", "2024-01-02T03:04:05Z"),
        ],
        key=repr,
    )


def test_sitemaps(fetches, registry):
    rows = extract.sitemap_urls(fetches, registry)
    assert values(rows, "source", "item_ord", "url", "published_at") == [
        ("map", 0, "http://site/p1.html", "2024-02-03"),
        ("map", 2, "http://site/p2", None),
        ("prefixed", 0, "http://site/q", None),
    ]


def test_index_is_followed_one_level_in_order(fetches, registry):
    rows = extract.sitemap_index_expand(fetches, registry)
    order = [r.url for r in rows.orderBy("item_ord").collect()]
    assert order == ["http://site/q", "http://site/p1.html", "http://site/p2"]


def test_index_expansion_without_broadcast(fetches, registry, no_broadcast):
    assert extract.sitemap_index_expand(fetches, registry).count() == 3


def test_frontier(fetches, registry):
    assert values(extract.sitemap_frontier(fetches, registry), "source", "fetch_url") == [("index", "missing")]


def test_failures(fetches, registry):
    found = values(fetch_failures(fetches, registry), "source", "reason", "failures")
    assert found == [
        ("broken", "malformed", 1),
        ("down", "http_error", 1),
        ("index", "http_error", 1),
        ("mixed", "unexpected_root", 1),
        ("page", "unexpected_root", 1),
    ]


def test_pattern_is_anchored_at_the_start_only(spark, registry):
    rows = [("map", "http://x/a.html"), ("map", "http://x/a.html?b"), ("prefixed", "anything")]
    df = spark.createDataFrame(rows, "source string, url string")
    assert values(extract.url_pattern_filter(df, registry), "url") == [("anything",), ("http://x/a.html",)]
    inner = make(spark, "REGISTRY", dict(source="map", url_pattern="a[.]html"))
    assert extract.url_pattern_filter(df.filter("source = 'map'"), inner).count() == 0


def test_discover_applies_patterns_to_sitemaps_and_quarantines_bad_urls(spark, registry):
    bad = f"<urlset {NS}><url><loc>http://[x/1</loc></url><url><loc>http://site/2#f</loc></url></urlset>"
    docs = make(spark, "FETCHES", dict(run_id="r", source="index", source_ord=7, fetch_url="m", http_status=200, body=bad))
    assert values(extract.discover(docs, registry), "norm_url", "source_ord") == [("http://site/2", 7)]
    assert values(extract.quarantined(docs, registry), "url") == [("http://[x/1",)]


def test_discover_all(fetches, registry):
    found = extract.discover(fetches, registry)
    counts = {r["source"]: r["count"] for r in found.groupBy("source").count().collect()}
    assert counts == {"rss": 3, "atom": 2, "rdf": 1, "map": 1, "prefixed": 1, "index": 3}


def test_a_broken_pattern_stops_only_its_source(spark):
    registry = make(spark, "REGISTRY", dict(source="a", url_pattern="("), dict(source="b", url_pattern="http://x/[0-9]"), dict(source="c"))
    items = make(spark, "DISCOVERED", *[dict(source=s, url="http://x/1") for s in "abc"])
    assert values(extract.url_pattern_filter(items, registry), "source") == [("b",), ("c",)]
    raw = make(spark, "RAW_REGISTRY", dict(source_ord=1, name="a", type="sitemap", url="u", url_pattern="("), dict(source_ord=2, name="b", type="rss", url="u", url_pattern="x+"))
    assert values(registry_violations(raw), "source_ord", "rule") == [(1, "invalid_pattern")]


RELATIVE_ATOM = """<a:feed xmlns:a="http://www.w3.org/2005/Atom" xmlns:m="media" xml:base="/blog/">
<a:entry xml:base="2024/"><a:title>One</a:title><m:title>other</m:title><a:link href="3"/><a:updated>2024-01-01T00:00:00Z</a:updated></a:entry>
<a:entry><a:title>Two</a:title><a:link href="../x/./y?q#f" xml:base="http://other/a/b/"/></a:entry>
<a:entry><a:title>Three</a:title><a:link href="//cdn/z"/></a:entry>
<a:entry><a:title>Four</a:title><a:link rel="self" href="self"/></a:entry>
<a:entry><a:title>Five</a:title><a:link href="https://site/abs/../kept"/></a:entry></a:feed>"""
RELATIVE_RSS = """<rss version="2.0"><channel xml:base="http://site/news/"><item><link>a.html</link></item><item xml:base="old/"><link>/b</link></item>
<item xml:base="old/"><guid>c</guid></item><item><link>http://site/d</link></item></channel></rss>"""


def test_relative_links_and_prefixed_atom(spark, registry):
    docs = make(
        spark, "FETCHES",
        dict(run_id="r", source="atom", fetch_url="http://site/feeds/atom.xml", http_status=200, body=RELATIVE_ATOM),
        dict(run_id="r", source="rss", fetch_url="http://site/feeds/rss.xml", http_status=200, body=RELATIVE_RSS),
        dict(run_id="r", source="rdf", fetch_url="http://site/feeds/rdf.xml", http_status=200, body=RDF.replace("http://site/old", "old?x=1")),
    )
    assert values(extract.rss_items(docs, registry), "source", "item_ord", "url", "title") == sorted(
        [
            ("atom", 0, "http://site/blog/2024/3", "One"), ("atom", 1, "http://other/a/x/y?q#f", "Two"), ("atom", 2, "http://cdn/z", "Three"),
            ("atom", 4, "https://site/abs/../kept", "Five"),
            ("rss", 0, "http://site/news/a.html", None), ("rss", 1, "http://site/b", None), ("rss", 2, "http://site/news/old/c", None), ("rss", 3, "http://site/d", None),
            ("rdf", 0, "http://site/feeds/old?x=1", "Old"),
        ],
        key=repr,
    )


def test_a_feed_without_entries_because_of_its_root_is_listed(spark, registry):
    docs = make(
        spark, "FETCHES",
        dict(run_id="r", source="rss", fetch_url="a", http_status=200, body="<html><body><entry/></body></html>"),
        dict(run_id="r", source="rss", fetch_url="b", http_status=200, body="<rss><channel/></rss>"),
        dict(run_id="r", source="atom", fetch_url="c", http_status=200, body=RELATIVE_ATOM),
        dict(run_id="r", source="rdf", fetch_url="d", http_status=200, body=URLSET),
    )
    assert values(fetch_failures(docs, registry), "source", "reason", "failures") == [("rdf", "unexpected_root", 1), ("rss", "unexpected_root", 1)]


def test_a_body_is_parsed_once(spark, fetches, registry):
    for frame in (extract.rss_items(fetches, registry), extract.sitemap_urls(fetches, registry)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml(") <= 2  # one for feeds, one for sitemaps


def test_patterns_of_a_million_sources_stay_on_the_executors(spark, no_broadcast):
    """No job runs while the query is built, and the pattern is not among its literals."""
    sources = spark.range(1_000_000).selectExpr("concat('s', id) AS source", "concat('http://s', id, '/a.*', if(id = 3, '(', '')) AS url_pattern", "'sitemap' AS type")
    items = spark.range(2000).selectExpr("concat('s', id % 1000) AS source", "concat('http://s', id % 1000, if(id < 1000, '/a', '/b')) AS url")
    spark.sparkContext.setJobGroup("building", "")
    try:
        kept = extract.url_pattern_filter(items, sources)
        broken = registry_violations(sources.selectExpr("cast(substr(source, 2) AS bigint) AS source_ord", "source AS name", "type", "'u' AS url", "url_pattern", "'true' AS exhaustive"))
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept.count() == 999 and kept.filter("source = 's3'").isEmpty()
    assert values(broken, "source_ord", "rule") == [(3, "invalid_pattern")]

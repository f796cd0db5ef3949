from helpers import by, values
from pyspark.sql import functions as F

from feedtide.functions import normalize_url, replay_link
from feedtide.operators.lookup import tracking_params_report

CANONICAL = {
    "https://a.org/x": "https://a.org/x",
    "https://a.org/x#part": "https://a.org/x",
    "https://a.org/x?": "https://a.org/x",
    "https://a.org/x?utm_source=feed": "https://a.org/x",
    "https://a.org/x?UTM_x=1&fbclid2=q&id=7#t": "https://a.org/x?id=7",
    "https://a.org/x?id=7&gclid=1&mc_cid=2&mc_eid=3&rts_source=4": "https://a.org/x?id=7",
    "https://a.org/x?%75tm_source=1&b=2": "https://a.org/x?b=2",
    "https://a.org/x?b=2&a=1": "https://a.org/x?b=2&a=1",
    "https://a.org/x?q&r=&&s=1": "https://a.org/x?q=&r=&s=1",
    "https://a.org/x?q=a%20b+c~*": "https://a.org/x?q=a+b+c~%2A",
    "https://a.org/x?q=a b;c": "https://a.org/x?q=a+b%3Bc",
    "https://a.org/x?q=%zz": "https://a.org/x?q=%25zz",
    "https://a.org/x?q=é": "https://a.org/x?q=%C3%A9",
    "https://a.org/x?q=a=b?c": "https://a.org/x?q=a%3Db%3Fc",
    "https://a.org/x?=v": "https://a.org/x?=v",
    "HTTPS://A.org:80/X/": "https://A.org:80/X/",
    "https://a.org/x;p=1/y;": "https://a.org/x;p=1/y",
    "https://a.org/x;;": "https://a.org/x;;",
    " \t https://a.org/\nx\t": "https://a.org/x",
    "https://a.org/a|b c?d|e": "https://a.org/a|b c?d%7Ce=",
    "http:/x": "http:///x",
    "///x": "/x",
    "mailto:a@b.org": "mailto:a@b.org",
    "https://[::1]/x?b": "https://[::1]/x?b=",
    "https://[::1/x": None,
    "https://a]b/x": None,
    "": "",
    None: None,
}


def test_canonical_form(spark):
    df = spark.createDataFrame([(u,) for u in CANONICAL], "url string")
    assert by(df.withColumn("n", normalize_url(F.col("url"))), "url", "n") == CANONICAL


def test_canonical_form_is_stable(spark):
    once = spark.createDataFrame([(u,) for u in CANONICAL.values() if u], "url string")
    changed = once.filter(normalize_url(F.col("url")) != F.col("url"))
    assert changed.count() == 0


def test_no_python_in_the_expression(spark):
    plan = spark.range(1).select(normalize_url(F.concat(F.lit("http://a/?b="), "id")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_tracking_report(spark):
    rows = [("s", "http://a?utm_x=1&b=2"), ("s", "http://c?utm_x=&UTM_x=4"), ("t", "http://a"), ("t", "http://a?gclid#utm_y=1")]
    df = spark.createDataFrame(rows, "source string, url string")
    found = values(tracking_params_report(df), "source", "param", "stripped")
    assert found == [("s", "UTM_x", 1), ("s", "utm_x", 2), ("t", "gclid", 1)]


def test_replay_link(spark):
    rows = [
        (1, "success", "20240102030405", "http://a/x"),
        (2, "success", "", "http://a/x"),
        (3, "success", "20240102030405", None),
        (4, "error", "20240102030405", "http://a/x"),
    ]
    df = spark.createDataFrame(rows, "id int, status string, ts string, url string")
    links = by(df.withColumn("l", replay_link(F.col("status"), F.col("ts"), F.col("url"))), "id", "l")
    assert links == {1: "https://web.archive.org/web/20240102030405/http://a/x", 2: None, 3: None, 4: None}


# The examples of RFC 3986 5.4, at http://a/b/c/d;p?q
RFC_EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/",
    "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
    "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x",
}


def test_references_are_resolved_as_in_the_rfc(spark):
    from pyspark.sql import functions as F

    from feedtide.functions import resolve_reference

    rows = [("http://a/b/c/d;p?q", r, w) for r, w in RFC_EXAMPLES.items()]
    rows += [("http://a", "g", "http://a/g"), ("http://a?x", "g/../h", "http://a/h"), (None, "g", "g"), ("top", "../g", "../g"), ("http://a/b", None, None), ("http://a/b#f", "", "http://a/b")]
    df = spark.createDataFrame(rows, "base string, ref string, expected string")
    got = df.select("ref", resolve_reference(F.col("base"), F.col("ref")).alias("got"), "expected").collect()
    assert [(r.ref, r.got) for r in got] == [(r.ref, r.expected) for r in got]

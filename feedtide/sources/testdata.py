"""Engine tables derived by Spark from the star-schema test tables `pages`, `events` and `orders`.

Nothing is sampled: every row of the input takes part. Documents are built in chunks of 200 pages, so
that no group grows with a busy host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.functions.dates import ISO_SECONDS
from feedtide.functions.urls import normalize_url
from feedtide.operators.skew import join_dimension

RUN = "2024-01-31T00:00:00Z"
EVENTS_AS_OF = "2024-01-31T00:00:00Z"
CAPTURES_AS_OF = "2001-08-01T03:00:00Z"
AGGREGATOR = "aggregator"
AGGREGATOR_ORD = 1 << 40
CHUNK = 200
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


SCHEMAS = {
    "pages": "page_id BIGINT, url STRING, html STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _utc(column: Column) -> Column:
    return column.cast("timestamp")


def _text(ts: Column) -> Column:
    return F.date_format(ts, ISO_SECONDS)


# --- from pages ---------------------------------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host and the page's made-up date; the html column is never read."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"),
        F.timestamp_seconds(1704067200 + (F.col("page_id") % 87600) * 3600).alias("page_ts"),
    )


def _with_param(url: Column, param: str) -> Column:
    head = F.substring_index(url, "#", 1)
    fragment = F.substring(url, F.length(head) + 1, F.length(url))
    joint = F.when(F.contains(head, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(head, joint, F.lit(param), fragment)


def page_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = (
        pages(spark, sf_dir)
        .groupBy(F.col("host").alias("source"))
        .agg(F.min("page_id").alias("source_ord"))
        .withColumn("exhaustive", F.startswith(F.col("source"), F.lit("blog.")))
    )
    extra = spark.range(1).select(
        F.lit(AGGREGATOR).alias("source"),
        F.lit(AGGREGATOR_ORD).cast("bigint").alias("source_ord"),
        F.lit(False).alias("exhaustive"),
    )
    return hosts.unionByName(extra).withColumn(
        "url_pattern",
        F.when(F.startswith("source", F.lit("blog.")), F.lit("https?://[^/]+/(en|fr)/"))
        .when(F.startswith("source", F.lit("www.")), F.lit(".*[.]html$"))
        .when(F.startswith("source", F.lit("m.")), F.lit("[.]html")),
    )


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page under its host, and again under the aggregator: a third of those copies differ only by
    tracking parameters, the others are URLs of their own."""
    page = pages(spark, sf_dir)
    order = page_registry(spark, sf_dir).select("source", "source_ord")
    own = join_dimension(page.withColumn("source", F.col("host")), order, ["source"], ["page_id"])
    again = page.withColumn("source", F.lit(AGGREGATOR)).withColumn(
        "source_ord", F.lit(AGGREGATOR_ORD).cast("bigint")
    )
    again = again.withColumn(
        "url",
        F.when(F.col("page_id") % 3 == 0, _with_param(F.col("url"), "utm_medium=agg&UTM_x=1")).otherwise(
            _with_param(F.col("url"), "via=agg")
        ),
    )
    columns = ["page_id", "url", "page_ts", "source", "source_ord"]
    return (
        own.select(*columns)
        .unionByName(again.select(*columns))
        .select(
            F.lit(RUN).alias("run_id"),
            "source",
            "source_ord",
            F.col("page_id").alias("item_ord"),
            "url",
            normalize_url(F.col("url")).alias("norm_url"),
            F.lit(None).cast("string").alias("title"),
            F.when(F.col("page_id") % 7 == 0, F.lit(None))
            .when(F.col("page_id") % 11 == 0, F.lit(""))
            .otherwise(_text(F.col("page_ts")))
            .alias("published_at"),
        )
    )


def page_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state table: a quarter each success, error_retry and pending, a quarter for URLs long gone."""
    n = F.col("page_id")
    status = (
        F.when(n % 4 == 0, F.lit("success"))
        .when(n % 4 == 1, F.lit("error_retry"))
        .when(n % 4 == 2, F.lit("pending"))
        .otherwise(F.lit("error"))
    )
    gone = F.concat(F.lit("https://gone.example.org/"), n)
    rows = pages(spark, sf_dir).select(
        F.when(n % 4 == 3, gone).otherwise(normalize_url(F.col("url"))).alias("norm_url"), "page_id"
    )
    one = rows.groupBy("norm_url").agg(F.min("page_id").alias("page_id"))
    first_seen = F.timestamp_seconds(1704067200 + (n % 87600) * 3600)
    kind = F.when(n % 4 == 0, F.lit("success")).when(n % 4 == 2, F.lit("submitted"))
    return one.select(
        "norm_url",
        first_seen.alias("first_seen"),
        F.when(n % 4 == 2, F.concat(F.lit("job-"), n)).alias("job_id"),
        status.alias("status"),
        (n % 3).alias("attempts"),
        (first_seen + F.expr("interval 1 hour")).alias("last_checked"),
        n.alias("last_seq"),
        kind.otherwise(F.lit("job_error")).alias("last_kind"),
        (n % 4 == 1).alias("last_retryable"),
        F.when(n % 4 == 2, n).alias("job_seq"),
    )


def raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An all-text registry with every kind of mistake in it, one entry per page."""
    n = F.col("page_id")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select(
        n.alias("source_ord"),
        F.when(n % 17 == 0, F.lit(None))
        .when(n % 2 == 0, F.concat(host, F.lit("/"), n))
        .otherwise(host)
        .alias("name"),
        F.when(n % 13 == 0, F.lit("atom")).when(n % 19 == 0, F.lit("")).when(n % 3 == 0, F.lit("rss"))
        .otherwise(F.lit("sitemap")).alias("type"),
        F.when(n % 23 == 0, F.lit(None)).otherwise(F.col("url")).alias("url"),
        F.lit(None).cast("string").alias("url_pattern"),
        F.when(n % 5 == 0, F.lit(None)).when(n % 29 == 0, F.lit("maybe")).otherwise(F.lit("true"))
        .alias("exhaustive"),
    )


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (host, chunk of pages) with each page's feed item and sitemap entry."""
    n = F.col("page_id")
    dated = n % 7 != 0
    mail_date = F.concat(F.date_format("page_ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    lastmod = F.when(n % 5 == 0, F.date_format("page_ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(
        _text(F.col("page_ts"))
    )
    item = F.concat(
        F.lit("<item><title>Page "), n, F.lit("</title><link>"), _escaped(F.col("url")), F.lit("</link>"),
        F.when(dated, F.concat(F.lit("<pubDate>"), mail_date, F.lit("</pubDate>"))).otherwise(F.lit("")),
        F.lit("</item>"),
    )
    entry = F.concat(
        F.lit("<url><loc>\n "), _escaped(F.col("url")), F.lit(" </loc>"),
        F.when(dated, F.concat(F.lit("<lastmod>"), lastmod, F.lit("</lastmod>"))).otherwise(F.lit("")),
        F.lit("</url>"),
    )
    return (
        pages(spark, sf_dir)
        .select("host", F.floor(n / CHUNK).cast("bigint").alias("chunk"), "page_id", item.alias("item"), entry.alias("entry"))
        .groupBy("host", "chunk")
        .agg(
            F.min("page_id").alias("first"),
            F.sort_array(F.collect_list(F.struct("page_id", "item", "entry"))).alias("parts"),
        )
    )


def _feed_body(parts: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>'), F.array_join(parts["item"], ""), F.lit("</channel></rss>"))


def _map_body(parts: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(parts["entry"], ""), F.lit("</urlset>"))


def _document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (host, chunk of pages) with the bodies of its feed and its sitemap."""
    parts = F.col("parts")
    return _page_parts(spark, sf_dir).select("host", "chunk", "first", _feed_body(parts).alias("feed"), _map_body(parts).alias("map"))


def _site(path: str) -> Column:
    return F.concat(F.lit("https://"), F.col("host"), F.lit(f"/{path}-"), F.col("chunk"), F.lit(".xml"))


def _source_name(kind: str) -> Column:
    return F.concat(F.col("host"), F.lit("/"), F.col("chunk"), F.lit(f" {kind}"))


def document_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed source and one sitemap source per (host, chunk)."""
    docs = (
        pages(spark, sf_dir)
        .groupBy("host", F.floor(F.col("page_id") / CHUNK).cast("bigint").alias("chunk"))
        .agg(F.min("page_id").alias("first"))
    )
    direct = F.startswith(F.col("host"), F.lit("www."))
    feeds = docs.select(
        _source_name("feed").alias("source"),
        F.lit("rss").alias("type"),
        _site("feed").alias("url"),
        F.lit(None).cast("string").alias("url_pattern"),
        F.lit(False).alias("exhaustive"),
        (F.col("first") * 2).alias("source_ord"),
    )
    maps = docs.select(
        _source_name("map").alias("source"),
        F.lit("sitemap").alias("type"),
        F.when(direct, _site("map")).otherwise(_site("index")).alias("url"),
        F.when(F.startswith("host", F.lit("blog.")), F.lit("https?://[^/]+/(en|fr)/"))
        .when(F.startswith("host", F.lit("m.")), F.lit("[.]html"))
        .alias("url_pattern"),
        F.startswith(F.col("host"), F.lit("blog.")).alias("exhaustive"),
        (F.col("first") * 2 + 1).alias("source_ord"),
    )
    return feeds.unionByName(maps)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `fetches` table: feeds, sitemaps (some behind an index), failed and broken ones among them."""
    docs = _document_parts(spark, sf_dir)
    first = F.col("first")
    fault = first % 10
    direct = F.startswith(F.col("host"), F.lit("www."))
    index = F.concat(
        F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        *[
            part
            for path in ("archive", "nested", "map")
            for part in (F.lit("<sitemap><loc>"), _site(path), F.lit("</loc></sitemap>"))
        ],
        F.lit("</sitemapindex>"),
    )

    cut_feed = F.when(fault == 8, F.expr("left(feed, length(feed) - 12)")).otherwise(F.col("feed"))
    cut_map = (
        F.when(fault == 6, F.expr("left(map, length(map) - 12)"))
        .when(fault == 5, F.lit("<html><body>moved</body></html>"))
        .otherwise(F.col("map"))
    )
    ok = F.lit(200)
    feed_status = F.when(fault == 9, F.lit(500)).otherwise(ok)
    map_status = F.when(fault == 7, F.lit(404)).otherwise(ok)

    def document(kind: str, path: str, parent: Column, status: Column, body: Column) -> Column:
        return F.struct(
            _source_name(kind).alias("source"),
            (first * 2 + int(kind == "map")).alias("source_ord"),
            _site(path).alias("fetch_url"),
            parent.cast("string").alias("parent_url"),
            status.cast("int").alias("http_status"),
            body.alias("body"),
        )

    no_parent = F.lit(None)
    site = F.array(
        document("feed", "feed", no_parent, feed_status, cut_feed),
        document("map", "map", F.when(~direct, _site("index")), map_status, cut_map),
        F.when(~direct, document("map", "index", no_parent, ok, index)),
        F.when(~direct, document("map", "nested", _site("index"), ok, index)),
    )
    return docs.select(F.explode(F.array_compact(site)).alias("doc")).select(
        F.lit(RUN).alias("run_id"),
        "doc.source",
        "doc.source_ord",
        "doc.fetch_url",
        "doc.parent_url",
        "doc.http_status",
        F.lit(RUN).cast("timestamp").alias("fetched_at"),
        "doc.body",
    )


HISTORY_RUNS = ("2024-01-01", "2024-01-02", "2024-01-03")


def history_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of `history_documents`: per (host, chunk) a feed and a sitemap index."""
    columns = ["source", "type", "url", "url_pattern", "exhaustive", "source_ord"]
    plain = document_registry(spark, sf_dir).withColumn("url_pattern", F.lit(None).cast("string")).withColumn("exhaustive", F.lit(False))
    return plain.select(*columns)


def history_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of feeds and sitemap indexes of two children. The second lists three quarters of the pages, the third a half. In
    the second, by `first % 6`: 1 the feed is cut and a child not found, 2 the feed is a web page and a child was not fetched, 3 the feed
    fails and a child is cut, 4 feed and index are empty, 5 the index is a web page."""
    docs = _page_parts(spark, sf_dir)
    fault = F.when(F.col("run_id") == HISTORY_RUNS[1], F.col("first") % 6).otherwise(F.lit(0))
    run = F.explode(F.array(*[F.lit(r) for r in HISTORY_RUNS])).alias("run_id")
    left = F.array_position(F.array(*[F.lit(r) for r in HISTORY_RUNS]), F.col("run_id"))  # pages with page_id % 4 + 1 below it are gone

    def listed(which: Column, keep) -> Column:
        return F.filter(which, lambda p: (p["page_id"] % 4 + 1 >= F.col("left")) & keep(p["page_id"]))

    parts = F.col("parts")
    rows = docs.select("host", "chunk", "first", "parts", run).withColumn("fault", fault).withColumn("left", left)
    feed = _feed_body(listed(parts, lambda n: F.lit(True)))
    even, odd = (_map_body(listed(parts, lambda n, r=r: n % 2 == r)) for r in (0, 1))
    page = F.lit("<html><body>moved</body></html>")
    head = F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    children = F.concat(*[x for path in ("even", "odd") for x in (F.lit("<sitemap><loc>"), _site(path), F.lit("</loc></sitemap>"))])
    index = F.when(F.col("fault") == 5, page).when(F.col("fault") == 4, F.concat(head, F.lit("</sitemapindex>"))).otherwise(
        F.concat(head, children, F.lit("</sitemapindex>"))
    )

    def cut(body: Column) -> Column:
        return F.substring(body, F.lit(1), F.length(body) - 12)

    def document(kind: str, path: str, parent: Column, status: Column, body: Column) -> Column:
        return F.struct(
            _source_name(kind).alias("source"), (F.col("first") * 2 + int(kind == "map")).alias("source_ord"), _site(path).alias("fetch_url"),
            parent.cast("string").alias("parent_url"), status.cast("int").alias("http_status"), body.alias("body"),
        )

    ok, fault = F.lit(200), F.col("fault")
    feed_body = F.when(fault == 1, cut(feed)).when(fault == 2, page).when(fault == 4, _feed_body(F.filter(parts, lambda p: F.lit(False)))).otherwise(feed)
    site = F.array(
        document("feed", "feed", F.lit(None), F.when(fault == 3, 503).otherwise(ok), feed_body),
        document("map", "index", F.lit(None), ok, index),
        document("map", "even", _site("index"), ok, even),
        F.when(fault != 2, document("map", "odd", _site("index"), F.when(fault == 1, 404).otherwise(ok), F.when(fault == 3, cut(odd)).otherwise(odd))),
    )
    return rows.select("run_id", F.explode(F.array_compact(site)).alias("doc")).select(
        "run_id", "doc.source", "doc.source_ord", "doc.fetch_url", "doc.parent_url", "doc.http_status",
        F.col("run_id").cast("timestamp").alias("fetched_at"), "doc.body",
    )


# --- from events --------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_read(table(spark, sf_dir, "events"))


def events_as_read(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        _utc(F.col("ts")).alias("ts"),
        "user_id",
        "event_type",
        F.date_format(_utc(F.col("ts")), "yyyy-MM-dd").alias("day"),
    )


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: one file, or a folder of files that are read one per batch. The pattern matches that name
    alone; without a pattern a stream accepts folders only."""
    raw = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events[.]parquet")
    return events_as_read(raw)


def user_url() -> Column:
    return F.concat(F.lit("https://example.org/u/"), F.col("user_id"))


def event_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per event type; `signup` lists its whole history."""
    order = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type"))
    return (
        events(spark, sf_dir)
        .select("event_type")
        .distinct()
        .select(
            F.col("event_type").alias("source"),
            (F.col("event_type") == "signup").alias("exhaustive"),
            order.alias("source_ord"),
        )
    )


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    order = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type"))
    return (
        events(spark, sf_dir)
        .select(
            F.col("day").alias("run_id"),
            F.col("event_type").alias("source"),
            order.alias("source_ord"),
            n.alias("item_ord"),
            F.concat(user_url(), F.lit("?utm_campaign="), F.col("day"), F.lit("#top")).alias("url"),
            F.lit(None).cast("string").alias("title"),
            F.when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, F.lit("")).otherwise(_text(F.col("ts")))
            .alias("published_at"),
        )
        .withColumn("norm_url", normalize_url(F.col("url")))
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, source, ts, exhaustive), one per day and event type."""
    return (
        events(spark, sf_dir)
        .groupBy(F.col("day").alias("run_id"), F.col("event_type").alias("source"))
        .agg(F.max("ts").alias("ts"))
        .withColumn("exhaustive", F.col("source") == "signup")
    )


def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_items(spark, sf_dir).select("run_id", "source", "norm_url").distinct()


def outcomes_of(event_rows: DataFrame, per_day: bool = False) -> DataFrame:
    """The outcome log. Users with a number divisible by ten are captured at another address, so their
    feed URL is never attempted. `per_day` gives every day its own URL: short histories."""
    n = F.col("event_id")
    page = F.when(F.col("user_id") % 10 == 0, F.lit("https://example.org/v/")).otherwise(
        F.lit("https://example.org/u/")
    )
    url = F.concat(page, F.col("user_id"))
    if per_day:
        url = F.concat(url, F.lit("/"), F.col("day"))
    kind = F.col("kind")
    return (
        event_rows.withColumn(
            "kind",
            F.when(F.col("event_type") == "purchase", F.lit("success"))
            .when(F.col("event_type") == "view", F.lit("already_archived"))
            .when((F.col("event_type") == "click") & (n % 4 == 0), F.lit("poll_timeout"))
            .when(F.col("event_type") == "click", F.lit("submitted"))
            .when((F.col("event_type") == "error") & (n % 6 == 0), F.lit("stale"))
            .when(F.col("event_type") == "error", F.lit("job_error"))
            .otherwise(F.lit("submit_error")),
        )
        .withColumn("norm_url", url)
        .select(
            F.col("day").alias("run_id"),
            F.element_at(
                F.array(*[F.lit(t) for t in EVENT_TYPES]), (F.col("user_id") % 5 + 1).cast("int")
            ).alias("source"),
            "norm_url",
            n.alias("seq"),
            "ts",
            "kind",
            F.when(kind.isin("submitted", "poll_timeout"), F.concat(F.lit("job-"), n)).alias("job_id"),
            F.when(
                kind == "job_error",
                F.when(n % 5 == 0, F.lit("error:blocked")).when(n % 7 == 0, F.lit(None)).otherwise(F.lit("error:bad-gateway")),
            ).alias("status_ext"),
            F.lit(None).cast("string").alias("message"),
            F.when(n % 9 != 0, F.col("norm_url")).alias("original_url"),
            F.when(kind.isin("success", "already_archived"), F.when(n % 8 == 0, F.lit("")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))).alias("capture_ts"),
            F.when(n % 10 == 0, 1 + n % 3).otherwise(F.lit(0)).cast("int").alias("n_rate_limited"),
        )
    )


def outcomes(spark: SparkSession, sf_dir: str, per_day: bool = False) -> DataFrame:
    return outcomes_of(events(spark, sf_dir), per_day)


def submits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return events(spark, sf_dir).select(
        F.col("event_type").alias("account"),
        n.alias("submit_id"),
        "ts",
        F.when(n % 6 == 0, F.lit("already_archived")).when(n % 7 == 0, F.lit("rate_limited"))
        .otherwise(F.lit("submitted")).alias("kind"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account status answers: free slots, unknown (NULL) for purchase."""
    return (
        events(spark, sf_dir)
        .groupBy(F.col("event_type").alias("account"))
        .agg((F.max("event_id") % 15 - 2).alias("free"))
        .select("account", F.when(F.col("account") != "purchase", F.col("free")).alias("available"))
    )


# --- from orders --------------------------------------------------------------------------------


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://example.org/u/"), F.col("o_custkey")).alias("norm_url"),
        F.when(F.col("o_orderkey") % 37 != 0, _utc(F.col("o_orderdate"))).alias("captured_at"),
        (F.col("o_orderstatus") != "F").alias("available"),
        (F.col("o_orderkey") % 50 == 0).alias("check_failed"),
        _utc(F.col("o_orderdate")).alias("checked_at"),
    )

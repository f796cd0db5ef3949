"""Discovery: from fetched documents to items.

Documents are parsed where they are read; only the exploded, narrow item rows are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide.functions.dates import feed_date, feed_date_text
from feedtide.functions.urls import normalize_url, resolve_below
from feedtide.operators.skew import join_dimension
from feedtide.session import durable
from feedtide.sources.fetches import SITEMAP_NAMESPACE, SITEMAP_ROOTS, judged_documents, root_element, root_tag, scan_fetches, tag_name
from feedtide.sources.registry import is_pattern

# RSS 2.0 keeps items under channel, RSS 1.0 next to it, Atom calls them entries. Prefixes are kept
# (dc:date, media:title), so that extension elements cannot overwrite the feed's own.
_BASE = "`_xml:base` STRING"
_ITEM = (
    f"STRUCT<{_BASE}, title STRING, link STRING, guid STRUCT<_VALUE STRING, _isPermaLink STRING>, "
    "pubDate STRING, published STRING, updated STRING, `dc:date` STRING>"
)
_ENTRY = (
    f"STRUCT<{_BASE}, title STRING, link ARRAY<STRUCT<{_BASE}, _href STRING, _rel STRING, _type STRING>>, "
    "published STRING, updated STRING>"
)
FEED_XML = (
    f"STRUCT<{_BASE}, channel STRUCT<{_BASE}, item ARRAY<{_ITEM}>>, item ARRAY<{_ITEM}>, entry ARRAY<{_ENTRY}>>"
)
SITEMAP_XML = (
    "STRUCT<url ARRAY<STRUCT<loc STRING, lastmod STRING>>, sitemap ARRAY<STRUCT<loc STRING>>>"
)

ITEM_COLUMNS = ["run_id", "source", "source_ord", "item_ord", "url", "title", "published_at"]
# positions inside nested documents share one BIGINT: child position, then position in the child
CHILD_STRIDE = 1 << 32


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _item_link(item: Column, bases: list[Column]) -> Column:
    permalink = F.coalesce(F.lower(item["guid"]["_isPermaLink"]), F.lit("true")) == "true"
    link = F.coalesce(
        _filled(_trim(item["link"])), F.when(permalink, _filled(_trim(item["guid"]["_VALUE"])))
    )
    return resolve_below([*bases, _trim(item["_xml:base"])], link)


def _entry_link(entry: Column, bases: list[Column]) -> Column:
    pages = F.filter(
        entry["link"],
        lambda link: (F.coalesce(link["_rel"], F.lit("alternate")) == "alternate")
        & F.coalesce(link["_type"], F.lit("text/html")).isin("text/html", "application/xhtml+xml")
        & link["_href"].isNotNull(),
    )
    last = F.slice(pages, F.greatest(F.size(pages), F.lit(1)), 1)
    chosen = F.transform(last, lambda link: resolve_below([*bases, _trim(entry["_xml:base"]), _trim(link["_xml:base"])], _filled(_trim(link["_href"]))))
    return F.try_element_at(chosen, F.lit(1))


def _published(item: Column) -> Column:
    return F.coalesce(
        feed_date_text(item["pubDate"]),
        feed_date_text(item["published"]),
        feed_date_text(item["updated"]),
        feed_date_text(item["dc:date"]),
    )


FEED, PAGE, CHILD = "feed", "page", "child"


def _row(kind: str, url: Column, title: Column, published_at: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        url.alias("url"),
        title.cast("string").alias("title"),
        published_at.cast("string").alias("published_at"),
    )


def _unprefixed(body: Column, tag: Column) -> Column:
    """A feed whose elements all carry the root's prefix (`<a:feed xmlns:a=...>`) without that prefix; others keep theirs. RSS 1.0
    has a prefix at its root alone."""
    prefix = F.regexp_extract(tag, r"^<([\w.\-]+):", 1)
    prefixed = (prefix != "") & tag_name(tag).isin("feed", "rss")
    return F.when(prefixed, F.regexp_replace(body, F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1"))).otherwise(body)


def _feed_rows(feed: Column, address: Column) -> Column:
    top = [address, _trim(feed["_xml:base"]), _trim(feed["channel"]["_xml:base"])]
    items = F.transform(
        F.coalesce(feed["channel"]["item"], feed["item"]),
        lambda item: _row(FEED, _item_link(item, top), item["title"], _published(item)),
    )
    entries = F.transform(
        feed["entry"],
        lambda entry: _row(
            FEED,
            _entry_link(entry, top[:2]),
            entry["title"],
            F.coalesce(feed_date_text(entry["published"]), feed_date_text(entry["updated"])),
        ),
    )
    return F.coalesce(items, entries)


def _sitemap_rows(listing: Column, part: str, kind: str) -> Column:
    nothing = F.lit(None)
    return F.transform(
        listing[part],
        lambda node: _row(
            kind, _filled(_trim(node["loc"])), nothing, _trim(node["lastmod"]) if part == "url" else nothing
        ),
    )


def document_rows(fetches: DataFrame) -> DataFrame:
    """What the fetched documents say, one narrow row per feed item, sitemap URL or index child.

    Each body is read and parsed once, where it lies; it never takes part in a shuffle. Rows keep their
    position in the document. Links of feeds that are relative are resolved at their xml:base, or else at the document's
    address. Documents below an index contribute URLs only: indexes are followed one
    level, feeds not at all."""
    tag, body, top = F.col("tag"), F.col("body"), F.col("parent_url").isNull()
    sitemap = F.contains(tag, F.lit(SITEMAP_NAMESPACE))
    name = tag_name(tag)
    lists = sitemap & ((name == "urlset") | ((name == "sitemapindex") & top))
    is_feed = top & ~name.isin(*SITEMAP_ROOTS)
    listing, feed = F.col("listing"), F.col("feed")
    rows = (
        F.when(lists & (name == "urlset"), _sitemap_rows(listing, "url", PAGE))
        .when(lists, _sitemap_rows(listing, "sitemap", CHILD))
        .when(is_feed, _feed_rows(feed, F.col("fetch_url")))
    )
    place = ["run_id", "source", "source_ord", "fetch_url", "parent_url", "fetched_at"]
    return (
        scan_fetches(fetches)
        .withColumn("tag", root_tag(body))
        .withColumn("listing", F.when(lists, F.from_xml(body, SITEMAP_XML, {"ignoreNamespace": "true"})))
        .withColumn("feed", F.when(is_feed, F.from_xml(_unprefixed(body, tag), FEED_XML)))
        .select(*place, F.posexplode(rows).alias("position", "row"))
        .select(*place, "position", "row.*")
        .filter(F.col("url").isNotNull())
    )


def _of_type(rows: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """Rows of sources of one type."""
    names = registry.filter(F.col("type") == kind).select("source")
    return join_dimension(rows, names, ["source"], spread=["url"], how="inner")


def _as_items(rows: DataFrame) -> DataFrame:
    if "item_ord" not in rows.columns:
        rows = rows.withColumn("item_ord", F.col("position").cast("bigint"))
    return rows.select(*ITEM_COLUMNS)


def rss_items_of(rows: DataFrame, registry: DataFrame) -> DataFrame:
    return _as_items(_of_type(rows.filter(F.col("kind") == FEED), registry, "rss"))


def sitemap_urls_of(rows: DataFrame, registry: DataFrame) -> DataFrame:
    pages = rows.filter((F.col("kind") == PAGE) & F.col("parent_url").isNull())
    return _as_items(_of_type(pages, registry, "sitemap"))


def index_children_of(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Children listed by sitemap indexes that are themselves registry entries."""
    return _of_type(rows.filter(F.col("kind") == CHILD), registry, "sitemap").select(
        "run_id",
        "source",
        "source_ord",
        F.col("fetch_url").alias("index_url"),
        F.col("fetched_at").alias("index_at"),
        F.col("position").alias("child_position"),
        F.col("url").alias("fetch_url"),
    )


def index_urls_of(rows: DataFrame, registry: DataFrame, within: str | None = None) -> DataFrame:
    """URLs of index children. A child with 50,000 URLs is salted. On streams `within` bounds how far
    apart an index and its child are fetched, so that state expires."""
    return join_children(index_children_of(rows, registry), child_pages(rows), within)


def child_pages(rows: DataFrame) -> DataFrame:
    """URLs listed by documents below an index."""
    return rows.filter((F.col("kind") == PAGE) & F.col("parent_url").isNotNull()).drop("source_ord")


def join_children(children: DataFrame, pages: DataFrame, within: str | None = None) -> DataFrame:
    """Items from the children that indexes list and the URLs that child documents list."""
    joined = join_dimension(
        pages, children.drop("index_url"), ["run_id", "source", "fetch_url"], spread=["position"], how="inner"
    )
    if within is not None:
        span = F.expr(f"interval {within}")
        joined = joined.filter(
            F.col("fetched_at").between(F.col("index_at") - span, F.col("index_at") + span)
        )
    order = F.col("child_position") * F.lit(CHILD_STRIDE) + F.col("position")
    return _as_items(joined.withColumn("item_ord", order))


def rss_items(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """Items of all RSS 2.0, RSS 1.0 and Atom feeds. Malformed feeds yield nothing (see S2)."""
    return rss_items_of(document_rows(fetches.filter(F.col("parent_url").isNull())), registry)


def sitemap_urls(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """URLs of sitemaps that are fetched directly (not through an index). lastmod stays verbatim."""
    return sitemap_urls_of(document_rows(fetches.filter(F.col("parent_url").isNull())), registry)


def sitemap_index_expand(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """URLs of the children of sitemap indexes. An index inside an index yields nothing."""
    return index_urls_of(durable(document_rows(fetches)), registry)


def sitemap_frontier(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """Children of indexes with no fetched document yet: the work list of the fetching system."""
    rows = document_rows(fetches.filter(F.col("parent_url").isNull()))
    fetched = fetches.select("run_id", "source", "fetch_url")
    return (
        index_children_of(rows, registry)
        .select("run_id", "source", "index_url", "fetch_url")
        .distinct()
        .join(fetched, ["run_id", "source", "fetch_url"], "left_anti")
    )


def complete_listings(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """(run_id, source) of the runs that were read to the end: every document fetched for the source itself, and every child
    that its indexes list, has a usable answer (see S2; a sitemap outside the sitemap namespace lists nothing and is not usable). A feed without items is usable; a cut, failed or missing document is
    not, since the URLs it would have listed are unknown. An index below an index lists nothing and must only be usable.

    Indexes alone are parsed for their children; the rest is two aggregates, so a source with very many children is combined on
    the map side."""
    keys = ["run_id", "source", "fetch_url"]
    top = fetches.filter(F.col("parent_url").isNull())
    indexes = document_rows(top.filter(root_element(F.col("body")) == "sitemapindex"))
    needed = top.select(*keys).unionByName(index_children_of(indexes, registry).select(*keys))
    says_something = F.col("reason").isNull() & ((F.col("type") != "sitemap") | F.col("in_namespace"))
    usable = judged_documents(fetches, registry).filter(says_something).select(*keys)
    marked = needed.withColumn("needed", F.lit(True)).withColumn("usable", F.lit(False)).unionByName(
        usable.withColumn("needed", F.lit(False)).withColumn("usable", F.lit(True))
    )
    per_document = marked.groupBy(*keys).agg(F.bool_or("needed").alias("needed"), F.bool_or("usable").alias("usable"))
    per_run = per_document.filter("needed").groupBy("run_id", "source").agg(F.bool_and("usable").alias("complete"))
    return per_run.filter("complete").select("run_id", "source")


def url_pattern_filter(items: DataFrame, registry: DataFrame) -> DataFrame:
    """E5: keep items whose URL starts with a match of their source's pattern; no pattern keeps all. A source whose
    pattern is no regular expression (S6 lists it) yields nothing; the others go on."""
    none = F.coalesce(F.col("url_pattern"), F.lit("")) == ""
    anchored = F.concat(F.lit("^(?:"), F.col("url_pattern"), F.lit(")"))
    # one row per source: a broken pattern becomes one that matches nothing, no pattern one that is not tried
    patterns = registry.select("source", F.when(none, F.lit(None)).when(is_pattern(F.col("url_pattern")), anchored).otherwise(F.lit("(?!)")).alias("_anchored"))
    joined = join_dimension(items, patterns, ["source"], spread=["url"])
    # unlike rlike, regexp_instr keeps the compiled pattern while it stays the same, and a source's items lie together
    kept = F.col("_anchored").isNull() | (F.regexp_instr(F.col("url"), F.col("_anchored")) == 1)
    return joined.filter(kept).drop("_anchored")


def with_canonical_url(items: DataFrame) -> DataFrame:
    """Adds norm_url. A URL that cannot be parsed keeps a NULL norm_url instead of failing its source."""
    return items.withColumn("norm_url", normalize_url(F.col("url")))


def with_instant(items: DataFrame) -> DataFrame:
    """Adds published_ts for ordering by instant instead of by text."""
    return items.withColumn("published_ts", feed_date(F.col("published_at")))


def items_of(rows: DataFrame, registry: DataFrame, within: str | None = None) -> DataFrame:
    """All items in a table of document rows, with their canonical URL."""
    listed = sitemap_urls_of(rows, registry).unionByName(index_urls_of(rows, registry, within))
    kept = rss_items_of(rows, registry).unionByName(url_pattern_filter(listed, registry))
    return with_canonical_url(kept)


def discover(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """All items of a run, canonicalised; (source_ord, item_ord) is the reference order.

    The document rows are kept, since feeds, sitemaps and both sides of the index join come from them."""
    items = items_of(durable(document_rows(fetches)), registry)
    return items.filter(F.col("norm_url").isNotNull())


def quarantined(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """Items left out of `discover` because their URL cannot be parsed."""
    items = items_of(durable(document_rows(fetches)), registry)
    return items.filter(F.col("norm_url").isNull()).drop("norm_url")

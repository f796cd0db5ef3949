"""Fetched documents: the input of discovery.

A fetch that did not answer 2xx contributes no items and never fails a run; why it failed is a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.operators.skew import join_dimension

SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
SITEMAP_ROOTS = ("urlset", "sitemapindex")
FEED_ROOTS = ("rss", "RDF", "feed")

_PROLOG = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*"


def read_fetches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.FETCHES).format(fmt).load(path)


def stream_fetches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schemas.FETCHES).format(fmt).load(path)


def scan_fetches(fetches: DataFrame) -> DataFrame:
    """The documents that arrived."""
    return fetches.filter(F.col("http_status").between(200, 299))


def root_tag(body: Column) -> Column:
    """The start tag of the root element, '' when there is none. The match is anchored at the head."""
    return F.regexp_extract(body, _PROLOG + r"(<[^>]*>)", 1)


def tag_name(tag: Column) -> Column:
    """Local name of a start tag."""
    return F.regexp_extract(tag, r"^<(?:[\w.\-]+:)?([\w.\-]+)", 1)


def root_element(body: Column) -> Column:
    return tag_name(root_tag(body))


def is_malformed(body: Column) -> Column:
    """True when the body is not well-formed XML."""
    parsed = F.from_xml(body, "_corrupt_record STRING", {"ignoreNamespace": "true"})
    return body.isNull() | (root_element(body) == "") | parsed["_corrupt_record"].isNotNull()


def judged_documents(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """Fetches without their bodies, with `reason` (http_error, malformed, unexpected_root, or NULL when the document is usable)
    and `in_namespace`: whether the start tag of the root mentions the sitemap namespace.

    A document whose root is none of its type gives no item, which is not the same as a feed without items."""
    types = registry.select("source", "type")
    judged = fetches.withColumn(
        "_fault",
        F.when(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), F.lit("http_error"))
        .when(is_malformed(F.col("body")), F.lit("malformed")),
    ).withColumn("_tag", F.when(F.col("_fault").isNull(), root_tag(F.col("body"))))
    slim = judged.drop("body")
    typed = join_dimension(slim, types, ["source"], spread=["fetch_url"])
    root = tag_name(F.col("_tag"))
    wrong_root = F.when(F.col("type") == "sitemap", ~root.isin(*SITEMAP_ROOTS)).when(F.col("type") == "rss", ~root.isin(*FEED_ROOTS))
    return (
        typed.withColumn("reason", F.coalesce(F.col("_fault"), F.when(wrong_root, F.lit("unexpected_root"))))
        .withColumn("in_namespace", F.contains("_tag", F.lit(SITEMAP_NAMESPACE)))
        .drop("_fault", "_tag")
    )


def with_failure_reason(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds `reason`; see `judged_documents`."""
    return judged_documents(fetches, registry).drop("in_namespace")


def fetch_failures(fetches: DataFrame, registry: DataFrame) -> DataFrame:
    """Number of unusable documents per run, source and reason."""
    return (
        with_failure_reason(fetches, registry)
        .filter(F.col("reason").isNotNull())
        .groupBy("run_id", "source", "reason")
        .agg(F.count("*").alias("failures"))
    )

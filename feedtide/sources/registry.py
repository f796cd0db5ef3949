"""Checks of the source registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide.operators.skew import join_dimension

SOURCE_TYPES = ("rss", "sitemap")


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def is_pattern(pattern: Column) -> Column:
    """Whether Java can compile the text as a regular expression; checked where the row is."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("^(?:"), pattern, F.lit(")"))).isNotNull()


def registry_violations(raw: DataFrame) -> DataFrame:
    """Every broken rule of a raw (all-text) registry as (source_ord, rule).

    A repeated name is reported for every entry after its first. An empty registry is one row without
    source_ord."""
    rules = {
        "missing_name": _blank("name"),
        "missing_type": _blank("type"),
        "missing_url": _blank("url"),
        "invalid_type": ~_blank("type") & ~F.col("type").isin(*SOURCE_TYPES),
        "non_boolean_exhaustive": F.col("exhaustive").isNotNull()
        & ~F.lower(F.col("exhaustive")).isin("true", "false"),
    }
    if "url_pattern" in raw.columns:
        rules["invalid_pattern"] = F.col("url_pattern").isNotNull() & ~is_pattern(F.col("url_pattern"))
    broken = raw.select(
        "source_ord",
        F.explode(
            F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
        ).alias("rule"),
    )
    firsts = (
        raw.filter(~_blank("name"))
        .groupBy("name")
        .agg(F.min("source_ord").alias("first_ord"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("name", "first_ord")
    )
    repeated = (
        join_dimension(raw, firsts, ["name"], spread=["source_ord"], how="inner")
        .filter(F.col("source_ord") > F.col("first_ord"))
        .select("source_ord", F.lit("duplicate_name").alias("rule"))
    )
    empty = (
        raw.agg(F.count("*").alias("n"))
        .filter(F.col("n") == 0)
        .select(F.lit(None).cast("bigint").alias("source_ord"), F.lit("empty_registry").alias("rule"))
    )
    return broken.unionByName(repeated).unionByName(empty)

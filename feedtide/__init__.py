"""Feed coverage and page-capture analytics as Spark DataFrame operators."""

from feedtide.params import Params, parse_duration

__all__ = ["Params", "parse_duration"]

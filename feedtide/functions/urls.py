"""URL canonicalisation as built-in expressions.

`normalize_url` drops the fragment and tracking parameters and re-encodes what is left of the query.
The split is the RFC 3986 one, done with anchored patterns, because Spark's `parse_url` rejects many
URLs that occur in feeds (spaces, pipes). The part before the query is a chain of replacements, each using
the one before once, which keeps the expression small wherever Catalyst copies it. Array functions over the
query run only for URLs that have one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of query keys that only track where a reader came from.
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "rts_source")

# Schemes whose URLs are always written with "//" (the list of Python's urllib.parse).
HIERARCHICAL_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
    "git+ssh", "ws", "wss", "itms-services",
)

# Schemes whose last path segment may carry ";parameters" ("" = relative URL).
PARAMETER_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip",
    "sips", "mms", "sftp", "tel",
)

_CONTROLS = "".join(map(chr, range(0x21)))
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_HIERARCHICAL = "(?:" + "|".join(x.replace("+", "[+]") for x in HIERARCHICAL_SCHEMES) + "):"
_WITH_PARAMETERS = "(?:(?:" + "|".join(x for x in PARAMETER_SCHEMES if x) + f"):|(?!{_SCHEME}))"

# a host in brackets must be an IPv6 or IPvFuture address
_BAD_BRACKETS = (
    rf"^(?:{_SCHEME})?//(?=[^/?#]*[\[\]])"
    r"(?![^/?#]*\[(?:v[0-9A-Fa-f]+\.[^/?#]+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]/?#]*)?)\])"
)

# URLs that need no rewriting before the query, unless they end in ";"
_PLAIN = r"^https?://[^/\[\]]+(?:/|$)"

# queries of unreserved characters with at most one "=" per pair, and the steps that rewrite them:
# no tracking pairs, no empty pairs, "=" after a lone key
_PLAIN_QUERY = r"^(?:[A-Za-z0-9_.~\-]*+(?:=[A-Za-z0-9_.~\-]*+)?+(?:&|$))*+$"
_PLAIN_QUERY_STEPS = (
    (r"(?i)(?<=^|&)(?:" + "|".join(TRACKING_PREFIXES) + r")[^&]*", ""),
    (r"^&+|&+$|&+(?=&)", ""),
    (r"(?<=^|&)([^&=]+)(?=&|$)", "$1="),
)

# rewriting steps of the part before the query, after its scheme is in lower case
_HEAD_STEPS = (
    # empty ";parameters" of the last path segment
    (rf"(?s)^({_WITH_PARAMETERS}(?://[^/]*+)?+(?:.*/)?[^/;]*);$", "$1"),
    # an empty host is written out for hierarchical schemes and left out for all others
    (rf"^({_HIERARCHICAL})(?=/(?!/)|$)", "$1//"),
    (rf"^((?!{_HIERARCHICAL})(?:{_SCHEME})?)//(?=$|/(?!/))", "$1"),
)


def is_tracking_key(key: Column) -> Column:
    lowered = F.lower(key)
    return reduce(Column.__or__, (F.startswith(lowered, F.lit(p)) for p in TRACKING_PREFIXES))


def _decode(text: Column) -> Column:
    stray_percent_escaped = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(stray_percent_escaped)


def _encode(text: Column) -> Column:
    # url_encode follows HTML form rules; RFC 3986 keeps "~" and escapes "*"
    form = F.url_encode(text)
    return F.replace(F.replace(form, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _without_noise(url: Column) -> Column:
    """Leading control characters and spaces go, and tabs and line breaks anywhere."""
    return F.translate(F.ltrim(url, F.lit(_CONTROLS)), "\t\r\n", "")


def _located(clean: Column) -> Column:
    return F.substring_index(clean, "#", 1)


def _query(located: Column) -> Column:
    """What follows the first "?"; to be used on URLs that have one."""
    return F.substring(located, F.instr(located, "?") + 1, F.length(located))


def _pairs(query: Column) -> Column:
    parts = F.filter(F.split(query, "&"), lambda part: part != "")
    return F.transform(
        parts,
        lambda part: F.struct(
            _decode(F.substring_index(part, "=", 1)).alias("key"),
            _decode(F.regexp_extract(part, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )


def query_pairs(url: Column) -> Column:
    """Decoded query of a URL: ARRAY<STRUCT<key, value>> in written order."""
    located = _located(_without_noise(url))
    return _pairs(F.when(F.contains(located, F.lit("?")), _query(located)).otherwise(F.lit("")))


def _head(raw: Column) -> Column:
    """Scheme, host and path of a URL, from its part before the query."""
    scheme = F.lower(F.regexp_extract(raw, f"^({_SCHEME})", 1))
    head = F.concat(scheme, F.regexp_replace(raw, f"^{_SCHEME}", ""))
    for pattern, replacement in _HEAD_STEPS:
        head = F.regexp_replace(head, pattern, replacement)
    return head


def _kept_pairs(query: Column) -> Column:
    """The query without tracking pairs, decoded and encoded again."""
    kept = F.transform(
        F.filter(_pairs(query), lambda pair: ~is_tracking_key(pair["key"])),
        lambda pair: F.concat(_encode(pair["key"]), F.lit("="), _encode(pair["value"])),
    )
    return F.array_join(kept, "&")


def _kept_plain(query: Column) -> Column:
    """The same for a query of unreserved characters, where decoding and encoding change nothing."""
    for pattern, replacement in _PLAIN_QUERY_STEPS:
        query = F.regexp_replace(query, pattern, replacement)
    return query


def normalize_url(url: Column) -> Column:
    """Canonical form of a URL; NULL if its host part is malformed (broken IPv6 brackets)."""
    located = _located(_without_noise(url))
    raw = F.substring_index(located, "?", 1)
    plain = F.rlike(raw, F.lit(_PLAIN)) & ~F.endswith(raw, F.lit(";"))
    head = F.when(plain, raw).when(~F.rlike(raw, F.lit(_BAD_BRACKETS)), _head(raw))
    query = _query(located)
    kept = F.when(F.rlike(query, F.lit(_PLAIN_QUERY)), _kept_plain(query)).otherwise(_kept_pairs(query))
    marked = F.regexp_replace(F.concat(F.lit("?"), kept), r"^\?$", "")
    return F.concat(head, F.when(F.contains(located, F.lit("?")), marked).otherwise(F.lit("")))


_REFERENCE_PATH = r"(?s)^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4: `.` goes, `..` takes the segment before it along."""

    def step(done: Column, part: Column) -> Column:
        kept = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(F.slice(done, 1, F.when(F.element_at(done, 1) == "", 1).otherwise(0)))
        up = F.when(F.size(done) == 0, done).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    def joined(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        ends_in_dots = F.element_at(parts, -1).isin(".", "..")
        return F.array_join(F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")

    return F.when(F.rlike(path, F.lit(r"(?:^|/)\.\.?(?:/|$)")), _bound(F.split(path, "/"), joined)).otherwise(path)


def _resolved(b: Column, r: Column) -> Column:
    """`r` at the base `b`; both should be bound, since they are named many times."""
    scheme = F.regexp_extract(b, f"^({_SCHEME})", 1)
    authority = F.regexp_extract(b, r"^(?:[^:/?#]+:)?(//[^/?#]*)", 1)
    base_path = F.regexp_extract(b, _REFERENCE_PATH, 1)
    path = F.regexp_extract(r, "(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(r, "(?s)^[^?#]*(.*)$", 1)
    beside = F.when((authority != "") & (base_path == ""), F.lit("/")).otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    whole = F.when(F.startswith(r, F.lit("/")), path).otherwise(F.concat(beside, path))
    return (
        F.when(F.rlike(r, F.lit(f"^{_SCHEME}")) | ~F.coalesce(F.rlike(b, F.lit(f"^{_SCHEME}")), F.lit(False)), r)
        .when(F.startswith(r, F.lit("//")), F.concat(scheme, r))
        .when(r == "", F.substring_index(b, "#", 1))
        .when(F.startswith(r, F.lit("#")), F.concat(F.substring_index(b, "#", 1), r))
        .when(F.startswith(r, F.lit("?")), F.concat(scheme, authority, base_path, r))
        .otherwise(F.concat(scheme, authority, _bound(whole, without_dot_segments), tail))
    )


def resolve_reference(base: Column, reference: Column) -> Column:
    """The URL that a reference means at a base (RFC 3986 5.2). References with a scheme, and any where the base has none, stay as
    they are. NULL for a NULL reference."""
    return _bound(reference, lambda r: _bound(base, lambda b: _resolved(b, r)))


def resolve_below(bases: list[Column], reference: Column) -> Column:
    """The same at nested bases, outermost first; an inner one may itself be relative, empty or NULL. An empty reference is the base. References with a scheme, most of
    all, need no base and compute none."""

    def step(outer: Column, inner: Column) -> Column:
        return F.when(F.coalesce(inner, F.lit("")) == "", outer).otherwise(_resolved(outer, inner))

    def at(r: Column) -> Column:
        chained = F.aggregate(F.array(*bases[1:], r), bases[0], step)
        return F.when(r.isNull() | F.rlike(r, F.lit(f"^{_SCHEME}")), r).otherwise(chained)

    return _bound(reference, at)


def replay_link(status: Column, capture_ts: Column, original_url: Column) -> Column:
    """Replay address of a finished capture, or NULL when a part of it is missing."""
    complete = (status == "success") & (capture_ts != "") & (original_url != "")
    return F.when(
        complete, F.concat(F.lit("https://web.archive.org/web/"), capture_ts, F.lit("/"), original_url)
    )

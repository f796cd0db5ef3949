"""The catalogue in DuckDB SQL, written from the semantics of each query, for checking results."""

from __future__ import annotations

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_PAGE_TS = "(TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id % 87600))"
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def _form(text: str) -> str:
    """Decode a query part and encode it again the way HTML forms do."""
    return f"replace(url_encode(url_decode(replace({text}, '+', ' '))), '%20', '+')"


def _canonical(url: str) -> str:
    head = f"regexp_replace({url}, '#.*$', '')"
    parts = f"string_split(regexp_extract({head}, '[?](.*)$', 1), '&')"
    tracked = (
        "regexp_matches(lower(url_decode(replace(split_part(x, '=', 1), '+', ' '))), "
        "'^(utm_|fbclid|gclid|mc_cid|mc_eid|rts_source)')"
    )
    kept = f"list_filter({parts}, lambda x: x <> '' AND NOT {tracked})"
    key, value = _form("split_part(y, '=', 1)"), _form("regexp_replace(y, '^[^=]*=?', '')")
    query = f"array_to_string(list_transform({kept}, lambda y: {key} || '=' || {value}), '&')"
    base = f"regexp_extract({head}, '^[^?]*')"
    return f"CASE WHEN len({kept}) = 0 THEN {base} ELSE {base} || '?' || {query} END"


def _added(url: str, param: str) -> str:
    head = f"split_part({url}, '#', 1)"
    joint = f"CASE WHEN contains({head}, '?') THEN '&' ELSE '?' END"
    tail = f"CASE WHEN contains({url}, '#') THEN '#' || split_part({url}, '#', 2) ELSE '' END"
    return f"{head} || {joint} || '{param}' || {tail}"


_RUN = "'2024-01-31T00:00:00Z'"
_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
_CAP_AS_OF = "TIMESTAMP '2001-08-01 03:00:00'"

_PAGES = f"""
page AS (SELECT page_id, url, {_HOST} AS host, {_PAGE_TS} AS page_ts FROM pages),
host_order AS (SELECT host, min(page_id) AS source_ord FROM page GROUP BY host),
registry AS (
  SELECT host AS source, source_ord, starts_with(host, 'blog.') AS exhaustive,
    CASE WHEN starts_with(host, 'blog.') THEN 'https?://[^/]+/(en|fr)/'
         WHEN starts_with(host, 'www.') THEN '.*[.]html$'
         WHEN starts_with(host, 'm.') THEN '[.]html' END AS url_pattern
  FROM host_order
  UNION ALL SELECT 'aggregator', 1099511627776, false, NULL),
listed AS (
  SELECT host AS source, source_ord, page_id, url, page_ts FROM page JOIN host_order USING (host)
  UNION ALL
  SELECT 'aggregator', 1099511627776, page_id,
    CASE WHEN page_id % 3 = 0 THEN {_added("url", "utm_medium=agg&UTM_x=1")}
         ELSE {_added("url", "via=agg")} END, page_ts
  FROM page),
items AS (
  SELECT {_RUN} AS run_id, source, source_ord, page_id AS item_ord, url, {_canonical("url")} AS norm_url,
    CAST(NULL AS VARCHAR) AS title,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN ''
         ELSE strftime(page_ts, {_ISO}) END AS published_at
  FROM listed),
seen_key AS (
  SELECT CASE WHEN page_id % 4 = 3 THEN 'https://gone.example.org/' || page_id ELSE {_canonical("url")} END
    AS norm_url, page_id FROM page),
seen AS (
  SELECT norm_url, {_PAGE_TS} AS first_seen,
    CASE WHEN page_id % 4 = 2 THEN 'job-' || page_id END AS job_id,
    CASE page_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'error_retry' WHEN 2 THEN 'pending' ELSE 'error' END
      AS status,
    page_id % 3 AS attempts, {_PAGE_TS} + INTERVAL 1 HOUR AS last_checked, page_id AS last_seq,
    CASE page_id % 4 WHEN 0 THEN 'success' WHEN 2 THEN 'submitted' ELSE 'job_error' END AS last_kind,
    page_id % 4 = 1 AS last_retryable, CASE WHEN page_id % 4 = 2 THEN page_id END AS job_seq
  FROM (SELECT norm_url, min(page_id) AS page_id FROM seen_key GROUP BY norm_url)),
firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, norm_url ORDER BY source_ord, item_ord) AS rn
    FROM items) WHERE rn = 1),
backlog AS (
  SELECT f.* FROM firsts f
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.norm_url = f.norm_url AND s.status <> 'error_retry')),
ranked AS (
  SELECT *,
    row_number() OVER (PARTITION BY run_id, source ORDER BY published_at ASC NULLS LAST, source_ord, item_ord) AS k,
    count(*) OVER (PARTITION BY run_id, source) AS n,
    first_value(item_ord) OVER (PARTITION BY run_id, source ORDER BY source_ord, item_ord) AS turn_item
  FROM backlog),
keyed AS (
  SELECT r.*, g.exhaustive, (k - 1) / n AS share, CASE WHEN k <= 1 THEN 0 ELSE 1 END AS phase,
    CASE WHEN k > 1 AND g.exhaustive THEN 1 ELSE 0 END AS tier,
    dense_rank() OVER (PARTITION BY run_id ORDER BY r.source_ord, turn_item) AS turn
  FROM ranked r JOIN registry g USING (source)),
grouped AS (
  SELECT *, dense_rank() OVER (ORDER BY phase, tier, CASE WHEN phase = 0 THEN k ELSE share END) AS g FROM keyed),
served AS (
  SELECT CAST(0 AS BIGINT) AS g, CAST(1000000000 AS BIGINT) AS p
  UNION ALL
  SELECT s.g + 1, (
    SELECT coalesce(max(m.turn) FILTER (WHERE m.turn <= s.p), max(m.turn)) FROM grouped m WHERE m.g = s.g + 1)
  FROM served s WHERE s.g < (SELECT max(g) FROM grouped)),
planned AS (
  SELECT m.*, row_number() OVER (ORDER BY m.g, m.turn <= s.p AND m.g > 1, m.turn) AS slot
  FROM grouped m JOIN served s ON s.g = m.g - 1)
"""

_DOCS = f"""
page AS (SELECT page_id, url, {_HOST} AS host, page_id // 200 AS chunk, {_PAGE_TS} AS page_ts FROM pages),
doc AS (SELECT host, chunk, min(page_id) AS first, min(page_id) % 10 AS fault, starts_with(host, 'www.') AS direct
        FROM page GROUP BY host, chunk),
placed AS (
  SELECT p.*, d.first, d.fault, d.direct,
    row_number() OVER (PARTITION BY p.host, p.chunk ORDER BY page_id) - 1 AS pos
  FROM page p JOIN doc d USING (host, chunk)),
feed_rows AS (
  SELECT {_RUN} AS run_id, host || '/' || chunk || ' feed' AS source, first * 2 AS source_ord, pos AS item_ord,
    url, 'Page ' || page_id AS title,
    CASE WHEN page_id % 7 <> 0 THEN strftime(page_ts, {_ISO}) END AS published_at
  FROM placed WHERE fault NOT IN (8, 9)),
map_rows AS (
  SELECT {_RUN} AS run_id, host || '/' || chunk || ' map' AS source, first * 2 + 1 AS source_ord,
    CASE WHEN direct THEN pos ELSE 2 * 4294967296 + pos END AS item_ord,
    url, CAST(NULL AS VARCHAR) AS title,
    CASE WHEN page_id % 7 = 0 THEN NULL
         WHEN page_id % 5 = 0 THEN strftime(page_ts, '%Y-%m-%dT%H:%M:%S+02:00')
         ELSE strftime(page_ts, {_ISO}) END AS published_at,
    direct, host
  FROM placed WHERE fault NOT IN (5, 6, 7)),
kept_map_rows AS (
  SELECT * FROM map_rows
  WHERE CASE WHEN starts_with(host, 'blog.') THEN regexp_matches(url, '^(?:https?://[^/]+/(en|fr)/)')
             WHEN starts_with(host, 'm.') THEN regexp_matches(url, '^(?:[.]html)') ELSE true END)
"""

_LISTINGS = f"""
page AS (SELECT page_id, {_canonical("url")} AS norm_url, {_HOST} AS host, page_id // 200 AS chunk FROM pages),
doc AS (SELECT host, chunk, min(page_id) % 6 AS fault FROM page GROUP BY host, chunk),
history_run AS (SELECT n, '2024-01-0' || n AS run_id FROM range(1, 4) r(n)),
read AS (
  SELECT n, run_id, host, chunk, kind, fault = 4 AND n = 2 AS bare
  FROM doc, history_run, (VALUES ('feed'), ('map')) k(kind)
  WHERE n <> 2 OR fault IN (0, 4) OR (fault = 5 AND kind = 'feed')),
snapshot AS (
  SELECT DISTINCT n, run_id, host || '/' || chunk || ' ' || kind AS source, norm_url
  FROM read JOIN page USING (host, chunk) WHERE NOT bare AND page_id % 4 + 1 >= n),
successor AS (
  SELECT run_id, host || '/' || chunk || ' ' || kind AS source,
    lead(run_id) OVER (PARTITION BY host, chunk, kind ORDER BY n) AS next_run FROM read)
"""

_EVENTS = f"""
event AS (SELECT event_id, ts, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events),
feed_item AS (
  SELECT day AS run_id, event_type AS source, 'https://example.org/u/' || user_id AS norm_url,
    list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) AS source_ord, event_id,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '' ELSE strftime(ts, {_ISO}) END
      AS published_at
  FROM event),
run AS (
  SELECT day AS run_id, event_type AS source, max(ts) AS ts, event_type = 'signup' AS exhaustive
  FROM event GROUP BY day, event_type),
logged AS (
  SELECT day AS run_id, event_id AS seq, ts, hour(ts) AS hour_of_day,
    CASE user_id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup'
      ELSE 'error' END AS source,
    CASE WHEN user_id % 10 = 0 THEN 'https://example.org/v/' ELSE 'https://example.org/u/' END || user_id
      AS user_url,
    CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'already_archived'
      WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'poll_timeout' ELSE 'submitted' END
      WHEN 'error' THEN CASE WHEN event_id % 6 = 0 THEN 'stale' ELSE 'job_error' END
      ELSE 'submit_error' END AS kind,
    CASE WHEN event_type = 'click' THEN 'job-' || event_id END AS job_id,
    CASE WHEN event_type = 'error' AND event_id % 6 <> 0 THEN
      CASE WHEN event_id % 5 = 0 THEN 'error:blocked' WHEN event_id % 7 = 0 THEN NULL
           ELSE 'error:bad-gateway' END END AS status_ext,
    CASE WHEN event_id % 10 = 0 THEN 1 + event_id % 3 ELSE 0 END AS n_rate_limited
  FROM event),
outcome AS (
  SELECT *, kind NOT IN ('poll_timeout', 'poll_failed') AS changes,
    kind IN ('job_error', 'submit_error', 'stale') AS is_error,
    kind IN ('submit_error', 'stale') OR (kind = 'job_error' AND coalesce(status_ext, '') <> 'error:blocked')
      AS retryable
  FROM logged)
"""


def _status(kind: str, retryable: str, attempts: str) -> str:
    return (
        f"CASE WHEN {kind} = 'submitted' THEN 'pending' WHEN {kind} IN ('success', 'already_archived') THEN {kind} "
        f"WHEN {retryable} AND {attempts} < 5 THEN 'error_retry' ELSE 'error' END"
    )


def _fold(url: str) -> str:
    """State per URL by window functions over the ordered events."""
    return f"""
ordered AS (
  SELECT *, {url} AS norm_url,
    row_number() OVER (PARTITION BY {url} ORDER BY seq DESC) AS back,
    CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER (
      PARTITION BY {url} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt,
    min(ts) OVER (PARTITION BY {url}) AS first_seen, max(ts) OVER (PARTITION BY {url}) AS last_checked,
    max(CASE WHEN job_id IS NOT NULL THEN seq END) OVER (PARTITION BY {url}) AS job_seq
  FROM outcome WHERE changes),
folded AS (
  SELECT norm_url, first_seen, CASE WHEN job_seq IS NOT NULL THEN 'job-' || job_seq END AS job_id,
    {_status("kind", "retryable", "attempt")} AS status, attempt AS attempts, last_checked, seq AS last_seq,
    kind AS last_kind, retryable AS last_retryable, job_seq
  FROM ordered WHERE back = 1)
"""


_USER_FOLD = _fold("user_url")
_DAY_FOLD = _fold("user_url || '/' || run_id")

_LOSSES = f"""
next_run AS (
  SELECT source, run_id, lead(run_id) OVER (PARTITION BY source ORDER BY run_id) AS following
  FROM run WHERE NOT exhaustive),
shot AS (SELECT DISTINCT run_id, source, norm_url FROM feed_item),
gone AS (
  SELECT n.following AS run_id, s.source, s.norm_url
  FROM shot s JOIN next_run n USING (source, run_id)
  WHERE n.following IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM shot t WHERE t.source = s.source AND t.norm_url = s.norm_url AND t.run_id = n.following)),
change AS (
  SELECT user_url AS norm_url, run_id, arg_max(kind, seq) AS kind, arg_max(retryable, seq) AS retryable,
    count(*) FILTER (WHERE is_error) AS failures
  FROM outcome WHERE changes GROUP BY ALL),
state_after AS (
  SELECT norm_url, run_id, kind, retryable,
    sum(failures) OVER (PARTITION BY norm_url ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS attempts
  FROM change),
asked AS (SELECT DISTINCT norm_url, run_id FROM feed_item UNION SELECT norm_url, run_id FROM gone),
status_at AS (
  SELECT a.norm_url, a.run_id, {_status("s.kind", "s.retryable", "s.attempts")} AS status
  FROM (SELECT norm_url, run_id, run_id AS asked_at FROM asked) a
  ASOF JOIN state_after s ON a.norm_url = s.norm_url AND a.run_id > s.run_id),
judged AS (SELECT g.*, t.status FROM gone g LEFT JOIN status_at t USING (norm_url, run_id)),
lost AS (
  SELECT run_id, source, norm_url,
    CASE WHEN status IS NULL THEN 'never_attempted' WHEN status = 'error' THEN 'gave_up'
         WHEN status = 'error_retry' THEN 'still_retrying' ELSE 'still_pending' END AS reason
  FROM judged WHERE status IS NULL OR status NOT IN ('success', 'already_archived')),
loss_log AS (SELECT CAST(run_id AS TIMESTAMP) AS ts, source, norm_url, reason, run_id FROM lost),
archived_count AS (
  SELECT run_id, source, count(*) AS c FROM outcome WHERE kind = 'already_archived' GROUP BY ALL),
limited_count AS (
  SELECT run_id, source, sum(n_rate_limited) AS c FROM outcome WHERE n_rate_limited > 0 GROUP BY ALL),
item_counts AS (
  SELECT run_id, source, count(*) AS item_count,
    count(*) FILTER (WHERE status IS NULL OR status = 'error_retry') AS new_count,
    min(nullif(published_at, '')) AS oldest_published_at, max(nullif(published_at, '')) AS newest_published_at
  FROM feed_item LEFT JOIN status_at USING (norm_url, run_id) GROUP BY ALL),
loss_counts AS (
  SELECT run_id, source, count(*) AS gone,
    count(*) FILTER (WHERE status IS NULL OR status NOT IN ('success', 'already_archived')) AS lost
  FROM judged GROUP BY ALL),
bare_stats AS (
  SELECT r.run_id, r.source, r.ts, item_count, new_count,
    CASE WHEN NOT exhaustive THEN coalesce(gone, 0) END AS dropped_count,
    CASE WHEN NOT exhaustive THEN coalesce(lost, 0) END AS dropped_unarchived_count,
    oldest_published_at, newest_published_at
  FROM run r JOIN item_counts USING (run_id, source) LEFT JOIN loss_counts USING (run_id, source)),
stats AS (
  SELECT b.*, coalesce(a.c, 0) AS already_archived_count, CAST(coalesce(l.c, 0) AS BIGINT) AS rate_limited_count
  FROM bare_stats b LEFT JOIN archived_count a USING (run_id, source)
  LEFT JOIN limited_count l USING (run_id, source)),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, run_id DESC) AS rn FROM stats)
  WHERE rn = 1)
"""

_TOTALS = """
totals AS (
  SELECT run_id, count(*) FILTER (WHERE kind = 'success') AS success, count(*) FILTER (WHERE is_error) AS error,
    count(*) FILTER (WHERE kind = 'already_archived') AS already_archived,
    count(*) FILTER (WHERE is_error AND retryable AND attempt < 5) AS error_retry,
    count(*) FILTER (WHERE is_error AND NOT (retryable AND attempt < 5)) AS error_permanent
  FROM ordered GROUP BY run_id),
open_jobs AS (SELECT run_id, count(*) FILTER (WHERE NOT changes) AS pending FROM outcome GROUP BY run_id)
"""

_HISTORY = """
history AS (
  SELECT r.run_id, r.ts, r.sources_processed, d.discovered, t.success, t.error, t.error_retry,
    t.error_permanent, t.already_archived, o.pending, CAST(coalesce(l.c, 0) AS BIGINT) AS rate_limited,
    greatest(coalesce(b.c, 0) - 700, 0) AS deferred, coalesce(p.c, 0) AS purged
  FROM (SELECT run_id, max(ts) AS ts, count(*) AS sources_processed FROM run GROUP BY run_id) r
  JOIN (SELECT run_id, count(*) AS discovered FROM feed_item GROUP BY run_id) d USING (run_id)
  JOIN totals t USING (run_id)
  JOIN open_jobs o USING (run_id)
  LEFT JOIN (SELECT run_id, sum(c) AS c FROM limited_count GROUP BY run_id) l USING (run_id)
  LEFT JOIN (
    SELECT run_id, count(*) AS c FROM (SELECT DISTINCT run_id, norm_url FROM feed_item)
    LEFT JOIN status_at USING (run_id, norm_url)
    WHERE status IS NULL OR status = 'error_retry' GROUP BY run_id) b USING (run_id)
  LEFT JOIN (
    SELECT strftime(CAST(first_seen AS DATE) + 20, '%Y-%m-%d') AS run_id, count(*) AS c
    FROM folded WHERE status <> 'pending' GROUP BY ALL) p USING (run_id))
"""

_CAPTURES = f"""
capture AS (
  SELECT 'https://example.org/u/' || o_custkey AS norm_url,
    CASE WHEN o_orderkey % 37 <> 0 THEN o_orderdate END AS captured_at, o_orderstatus <> 'F' AS available,
    o_orderkey % 50 = 0 AS check_failed, o_orderdate AS checked_at
  FROM orders),
known AS (
  SELECT * FROM capture WHERE checked_at <= {_CAP_AS_OF} AND coalesce(captured_at <= {_CAP_AS_OF}, true)),
newest AS (
  SELECT norm_url, captured_at, available,
    row_number() OVER (PARTITION BY norm_url ORDER BY captured_at DESC NULLS LAST, available DESC) AS rn
  FROM known WHERE NOT check_failed),
latest_check AS (
  SELECT norm_url, check_failed,
    row_number() OVER (PARTITION BY norm_url ORDER BY checked_at DESC, check_failed DESC) AS rn
  FROM known),
checked AS (
  SELECT u.norm_url,
    CASE WHEN f.norm_url IS NOT NULL THEN NULL
         WHEN n.norm_url IS NULL OR NOT n.available THEN false
         WHEN n.captured_at > {_CAP_AS_OF} - INTERVAL 5 HOUR THEN false ELSE true END AS archived
  FROM (SELECT DISTINCT norm_url FROM capture) u
  LEFT JOIN (SELECT norm_url FROM latest_check WHERE rn = 1 AND check_failed) f USING (norm_url)
  LEFT JOIN (SELECT * FROM newest WHERE rn = 1) n USING (norm_url))
"""


def _with(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip() for c in ctes) + "\n" + body.strip()


_PLAN_COLUMNS = "run_id, slot, source, k, norm_url, url, published_at, phase, tier, share"
_ITEM = "run_id, source, source_ord, item_ord, url, title, published_at"
_SEEN = (
    "norm_url, first_seen, job_id, status, attempts, last_checked, last_seq, last_kind, last_retryable, job_seq"
)
_STATS = (
    "run_id, source, ts, item_count, new_count, dropped_count, dropped_unarchived_count, "
    "oldest_published_at, newest_published_at, already_archived_count, rate_limited_count"
)
_HISTORY_CTES = (_EVENTS, _USER_FOLD, _LOSSES, _TOTALS, _HISTORY)

ORACLE: dict[str, str] = {
    "scan_fetches": _with(
        f"""
        SELECT {_RUN} AS run_id, host || '/' || chunk || ' feed' AS source, first * 2 AS source_ord,
          'https://' || host || '/feed-' || chunk || '.xml' AS fetch_url, NULL AS parent_url,
          CAST(200 AS BIGINT) AS http_status
        FROM doc WHERE fault <> 9
        UNION ALL
        SELECT {_RUN}, host || '/' || chunk || ' map', first * 2 + 1, 'https://' || host || '/map-' || chunk || '.xml',
          CASE WHEN NOT direct THEN 'https://' || host || '/index-' || chunk || '.xml' END, 200
        FROM doc WHERE fault <> 7
        UNION ALL
        SELECT {_RUN}, host || '/' || chunk || ' map', first * 2 + 1, 'https://' || host || '/index-' || chunk || '.xml',
          NULL, 200 FROM doc WHERE NOT direct
        UNION ALL
        SELECT {_RUN}, host || '/' || chunk || ' map', first * 2 + 1, 'https://' || host || '/nested-' || chunk || '.xml',
          'https://' || host || '/index-' || chunk || '.xml', 200 FROM doc WHERE NOT direct
        """,
        _DOCS,
    ),
    "fetch_failures": _with(
        f"""
        SELECT {_RUN} AS run_id, host || '/' || chunk || ' feed' AS source,
          CASE fault WHEN 9 THEN 'http_error' ELSE 'malformed' END AS reason, CAST(1 AS BIGINT) AS failures
        FROM doc WHERE fault IN (8, 9)
        UNION ALL
        SELECT {_RUN}, host || '/' || chunk || ' map',
          CASE fault WHEN 7 THEN 'http_error' WHEN 6 THEN 'malformed' ELSE 'unexpected_root' END, 1
        FROM doc WHERE fault IN (5, 6, 7)
        """,
        _DOCS,
    ),
    "scan_state": _with(f"SELECT {_SEEN} FROM seen", _PAGES),
    "write_state": _with(
        f"SELECT {_SEEN} FROM seen WHERE status = 'pending' OR first_seen >= {_AS_OF} - INTERVAL 20 DAY", _PAGES
    ),
    "append_log": _with("SELECT * FROM loss_log", _EVENTS, _LOSSES),
    "registry_violations": f"""
        WITH entry AS (
          SELECT page_id AS n,
            CASE WHEN page_id % 17 = 0 THEN NULL WHEN page_id % 2 = 0 THEN {_HOST} || '/' || page_id
                 ELSE {_HOST} END AS name,
            CASE WHEN page_id % 13 = 0 THEN 'atom' WHEN page_id % 19 = 0 THEN '' WHEN page_id % 3 = 0 THEN 'rss'
                 ELSE 'sitemap' END AS type,
            CASE WHEN page_id % 23 = 0 THEN NULL ELSE url END AS url,
            CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 29 = 0 THEN 'maybe' ELSE 'true' END AS exhaustive
          FROM pages)
        SELECT n AS source_ord, 'missing_name' AS rule FROM entry WHERE name IS NULL
        UNION ALL SELECT n, 'missing_type' FROM entry WHERE type = ''
        UNION ALL SELECT n, 'missing_url' FROM entry WHERE coalesce(url, '') = ''
        UNION ALL SELECT n, 'invalid_type' FROM entry WHERE type = 'atom'
        UNION ALL SELECT n, 'non_boolean_exhaustive' FROM entry WHERE exhaustive = 'maybe'
        UNION ALL SELECT n, 'duplicate_name' FROM (
          SELECT n, row_number() OVER (PARTITION BY name ORDER BY n) AS nth FROM entry WHERE name IS NOT NULL)
          WHERE nth > 1
        """,
    "rss_items": _with(f"SELECT {_ITEM} FROM feed_rows", _DOCS),
    "sitemap_urls": _with(f"SELECT {_ITEM} FROM map_rows WHERE direct", _DOCS),
    "sitemap_index_expand": _with(f"SELECT {_ITEM} FROM map_rows WHERE NOT direct", _DOCS),
    "sitemap_frontier": _with(
        f"""
        SELECT {_RUN} AS run_id, host || '/' || chunk || ' map' AS source,
          'https://' || host || '/index-' || chunk || '.xml' AS index_url,
          'https://' || host || '/archive-' || chunk || '.xml' AS fetch_url
        FROM doc WHERE NOT direct
        """,
        _DOCS,
    ),
    "url_pattern_filter": _with(
        """
        SELECT source, item_ord, url FROM items JOIN registry USING (source)
        WHERE url_pattern IS NULL OR regexp_matches(url, '^(?:' || url_pattern || ')')
        """,
        _PAGES,
    ),
    "discover": _with(
        f"""
        SELECT {_ITEM}, {_canonical("url")} AS norm_url
        FROM (SELECT {_ITEM} FROM feed_rows UNION ALL SELECT {_ITEM} FROM kept_map_rows)
        """,
        _DOCS,
    ),
    "pending_leftovers": _with("SELECT norm_url, job_id FROM seen WHERE status = 'pending' AND job_id <> ''", _PAGES),
    "stale_pending": _with(
        f"""
        SELECT norm_url, first_seen, job_id, attempts FROM folded
        WHERE status = 'pending' AND first_seen < {_AS_OF} - INTERVAL 6 HOUR
        """,
        _EVENTS,
        _DAY_FOLD,
    ),
    "normalize_urls": _with("SELECT source, item_ord, url, norm_url FROM items", _PAGES),
    "tracking_params_report": _with(
        """
        SELECT source, param, count(*) AS stripped FROM (
          SELECT source, split_part(unnest(string_split(
            regexp_extract(regexp_replace(url, '#.*$', ''), '[?](.*)$', 1), '&')), '=', 1) AS param FROM items)
        WHERE lower(param) LIKE 'utm%' GROUP BY ALL
        """,
        _PAGES,
    ),
    "dedupe_first_wins": _with("SELECT * FROM firsts", _PAGES),
    "capture_links": _with(
        """
        SELECT user_url AS norm_url, seq, kind,
          CASE WHEN kind = 'success' AND seq % 8 <> 0 AND seq % 9 <> 0 THEN
            'https://web.archive.org/web/' || strftime(ts, '%Y%m%d%H%M%S') || '/' || user_url END AS replay_url
        FROM outcome
        """,
        _EVENTS,
    ),
    "new_urls": _with("SELECT * FROM backlog", _PAGES),
    "archived_urls": _with(
        """
        SELECT f.* FROM firsts f JOIN seen s USING (norm_url) WHERE s.status IN ('success', 'already_archived')
        """,
        _PAGES,
    ),
    "status_lookup": _with(
        "SELECT norm_url, status FROM (SELECT DISTINCT norm_url FROM items) LEFT JOIN seen USING (norm_url)", _PAGES
    ),
    "feed_drops": _with("SELECT * FROM gone", _EVENTS, _LOSSES),
    "dropped_unarchived": _with("SELECT * FROM lost", _EVENTS, _LOSSES),
    "capture_availability": _with("SELECT * FROM checked", _CAPTURES),
    "recheck_dropped": _with(
        """
        SELECT l.* FROM loss_log l LEFT JOIN checked c USING (norm_url) WHERE c.archived IS DISTINCT FROM true
        """,
        _EVENTS,
        _LOSSES,
        _CAPTURES,
    ),
    "recapture_needed": _with(
        f"""
        SELECT norm_url, last_capture, last_capture IS NULL OR last_capture < {_CAP_AS_OF} - INTERVAL 7 DAY
          AS needs_capture
        FROM (SELECT norm_url FROM capture UNION SELECT norm_url FROM items)
        LEFT JOIN (SELECT norm_url, max(captured_at) AS last_capture FROM capture
                   WHERE captured_at <= {_CAP_AS_OF} GROUP BY norm_url) USING (norm_url)
        """,
        _PAGES,
        _CAPTURES,
    ),
    "error_classification": _with(
        """
        SELECT user_url AS norm_url, seq, status_ext, coalesce(status_ext = 'error:blocked', false) AS permanent
        FROM outcome WHERE kind = 'job_error'
        """,
        _EVENTS,
    ),
    "outcomes_to_jobs": _with(
        """
        SELECT user_url AS norm_url, job_id, CASE WHEN seq % 5 = 1 THEN 'error:no-access' END AS answer_ext,
          CASE WHEN seq % 5 = 1 THEN 'error' WHEN seq % 5 IN (3, 4) THEN 'success' ELSE 'pending' END AS result
        FROM outcome WHERE job_id IS NOT NULL
        """,
        _EVENTS,
    ),
    "seen_from_outcomes": _with(f"SELECT {_SEEN} FROM folded", _EVENTS, _USER_FOLD),
    "seen_merge": _with(f"SELECT {_SEEN} FROM folded", _EVENTS, _DAY_FOLD),
    "attempts_timeline": _with(
        """
        SELECT norm_url, seq, kind, attempt, retryable AND attempt < 5 AS will_retry FROM ordered WHERE is_error
        """,
        _EVENTS,
        _DAY_FOLD,
    ),
    "retry_candidates": _with(
        """
        SELECT f.norm_url, f.source, f.url, s.attempts FROM firsts f JOIN seen s USING (norm_url)
        WHERE s.status = 'error_retry'
        """,
        _PAGES,
    ),
    "feed_run_stats": _with(
        f"""
        SELECT {_STATS} FROM (
          SELECT *, CAST(0 AS BIGINT) AS already_archived_count, CAST(0 AS BIGINT) AS rate_limited_count
          FROM bare_stats)
        """,
        _EVENTS,
        _LOSSES,
    ),
    "published_coverage": _with(
        """
        SELECT run_id, source, min(nullif(published_at, '')) AS oldest_published_at,
          max(nullif(published_at, '')) AS newest_published_at
        FROM feed_item GROUP BY run_id, source
        """,
        _EVENTS,
    ),
    "run_outcome_totals": _with(
        "SELECT * FROM totals JOIN open_jobs USING (run_id)", _EVENTS, _DAY_FOLD, _TOTALS
    ),
    "already_archived_by_source": _with(
        "SELECT run_id, source, c AS already_archived_count FROM archived_count", _EVENTS, _LOSSES
    ),
    "rate_limited_by_source": _with(
        "SELECT run_id, source, CAST(c AS BIGINT) AS rate_limited_count FROM limited_count", _EVENTS, _LOSSES
    ),
    "drop_reason_counts": _with(
        "SELECT run_id, source, reason, count(*) AS losses FROM lost GROUP BY ALL", _EVENTS, _LOSSES
    ),
    "run_summary": _with("SELECT * FROM history", *_HISTORY_CTES),
    "attach_outcomes_to_stats": _with(f"SELECT {_STATS} FROM stats", _EVENTS, _LOSSES),
    "dropped_count_by_run": _with(
        "SELECT run_id, count(*) AS dropped_count FROM lost GROUP BY run_id", _EVENTS, _LOSSES
    ),
    "urgency_rank": _with("SELECT run_id, source, norm_url, k, published_at, item_ord FROM keyed", _PAGES),
    "reserved_floor": _with(
        """
        SELECT run_id, source, norm_url, k, row_number() OVER (PARTITION BY run_id ORDER BY k, turn) AS slot
        FROM keyed WHERE phase = 0
        """,
        _PAGES,
    ),
    "proportional_share": _with("SELECT run_id, source, norm_url, k, n, share FROM keyed", _PAGES),
    "exhaustive_demotion": _with(
        """
        SELECT run_id, source, norm_url, k, exhaustive, CAST(phase AS BIGINT) AS phase, CAST(tier AS BIGINT) AS tier
        FROM keyed
        """,
        _PAGES,
    ),
    "capture_plan": _with(
        f"SELECT {_PLAN_COLUMNS} FROM planned WHERE slot <= 70".replace(
            "phase, tier", "CAST(phase AS BIGINT) AS phase, CAST(tier AS BIGINT) AS tier"
        ),
        _PAGES,
    ),
    "planned_vs_deferred": _with(
        """
        SELECT run_id, source, count(*) AS queued, count(*) FILTER (WHERE slot <= 70) AS planned,
          count(*) FILTER (WHERE slot > 70) AS deferred
        FROM planned GROUP BY run_id, source
        """,
        _PAGES,
    ),
    "pacing": _with(
        "SELECT run_id, slot, norm_url, (slot - 1) // 7 AS minute FROM planned WHERE slot <= 70", _PAGES
    ),
    "rate_budget_audit": """
        WITH submit AS (
          SELECT event_type AS account, event_id AS submit_id, ts, epoch_us(ts) AS us FROM events
          WHERE event_id % 6 <> 0),
        framed AS (
          SELECT *, count(*) OVER w AS in_window, min(us) OVER w AS oldest FROM submit
          WINDOW w AS (PARTITION BY account ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
        SELECT account, submit_id, ts, in_window, in_window > 3 AS over_limit,
          CASE WHEN in_window < 3 THEN CAST(0 AS DOUBLE)
               ELSE greatest(CAST(0 AS DOUBLE), CAST(3600 AS DOUBLE) - (us - oldest) / CAST(1000000 AS DOUBLE)
                 + CAST(0.1 AS DOUBLE)) END AS wait_seconds
        FROM framed
        """,
    "slot_capacity": """
        SELECT event_type AS account,
          CASE WHEN event_type = 'purchase' THEN CAST(10 AS BIGINT)
               ELSE greatest(1, least(10, max(event_id) % 15 - 2)) END AS slots
        FROM events GROUP BY event_type
        """,
    "latest_per_source": _with(f"SELECT {_STATS} FROM latest", _EVENTS, _LOSSES),
    "dropped_sample": _with(
        """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, source ORDER BY norm_url) AS position FROM lost)
        WHERE position <= 10
        """,
        _EVENTS,
        _LOSSES,
    ),
    "purge_seen": _with(
        f"""
        SELECT norm_url, status, first_seen, (
          SELECT count(*) FROM folded WHERE status <> 'pending' AND first_seen < {_AS_OF} - INTERVAL 20 DAY) AS purged
        FROM folded WHERE status = 'pending' OR first_seen >= {_AS_OF} - INTERVAL 20 DAY
        """,
        _EVENTS,
        _DAY_FOLD,
    ),
    "purge_feed_stats": _with(
        f"SELECT {_STATS} FROM stats WHERE ts >= {_AS_OF} - INTERVAL 20 DAY", _EVENTS, _LOSSES
    ),
    "purge_dropped": _with(
        f"SELECT * FROM loss_log WHERE ts >= {_AS_OF} - INTERVAL 20 DAY", _EVENTS, _LOSSES
    ),
    "purge_runs": _with(f"SELECT * FROM history WHERE ts >= {_AS_OF} - INTERVAL 20 DAY", *_HISTORY_CTES),
    "run_health": _with(
        """
        SELECT run_id, ts, success, error, success_rate,
          CASE WHEN success_rate >= 80 THEN 'ok' WHEN success_rate >= 50 THEN 'warn' ELSE 'bad' END AS rate_class,
          error_retry, error_permanent, error_permanent > 0 AS permanent_warn, rate_limited,
          rate_limited > 150 AS rate_limited_warn, deferred
        FROM (SELECT *, CASE WHEN success + error = 0 THEN 100 ELSE
                CAST(floor(CAST(100 AS DOUBLE) * success / (success + error) + 0.5) AS BIGINT) END AS success_rate
              FROM history)
        """,
        *_HISTORY_CTES,
    ),
    "coverage_alerts": _with(
        "SELECT source, run_id, dropped_unarchived_count FROM latest WHERE dropped_unarchived_count > 0",
        _EVENTS,
        _LOSSES,
    ),
    "source_status": _with(
        """
        SELECT source, exhaustive, item_count, new_count,
          floor(CAST(1000 AS DOUBLE) * new_count / item_count + 0.5) / 10 AS new_pct, dropped_count,
          floor(CAST(1000 AS DOUBLE) * dropped_count / item_count + 0.5) / 10 AS dropped_pct,
          dropped_unarchived_count, already_archived_count, rate_limited_count, newest_published_at,
          CASE WHEN exhaustive THEN NULL WHEN hours < 48 THEN hours
               ELSE CAST(floor(hours / 24 + 0.5) AS BIGINT) END AS span,
          CASE WHEN exhaustive THEN NULL WHEN hours < 48 THEN 'h' ELSE 'd' END AS span_unit
        FROM (SELECT *, dropped_count IS NULL AS exhaustive,
                CAST(floor(date_diff('second', CAST(oldest_published_at AS TIMESTAMP),
                  CAST(newest_published_at AS TIMESTAMP)) / 3600 + 0.5) AS BIGINT) AS hours FROM latest)
        """,
        _EVENTS,
        _LOSSES,
    ),
    "run_trend": _with(
        """
        SELECT run_id, ts, series, n FROM (
          UNPIVOT (SELECT run_id, ts, success, already_archived, pending, error_retry, error_permanent,
                     rate_limited, deferred FROM history)
          ON success, already_archived, pending, error_retry, error_permanent, rate_limited, deferred
          INTO NAME series VALUE n)
        WHERE (SELECT count(*) FROM history) > 1
        """,
        *_HISTORY_CTES,
    ),
    "recent_runs": _with(
        """
        SELECT h.run_id, ts, success, error_retry, error_permanent, already_archived, pending, rate_limited, deferred,
          coalesce(c, 0) AS dropped_count
        FROM (SELECT * FROM history ORDER BY ts DESC, run_id DESC LIMIT 20) h
        LEFT JOIN (SELECT run_id, count(*) AS c FROM lost GROUP BY run_id) l ON h.run_id = l.run_id
        """,
        *_HISTORY_CTES,
    ),
    "recent_dropped": _with(
        """
        SELECT ts, source, norm_url,
          CASE reason WHEN 'never_attempted' THEN 'jamais tentée' WHEN 'gave_up' THEN 'abandon définitif'
            WHEN 'still_retrying' THEN 'réessai en cours à la perte' ELSE 'capture en cours à la perte' END AS label,
          (SELECT count(*) FROM lost) AS total
        FROM loss_log ORDER BY ts DESC, source, norm_url LIMIT 100
        """,
        _EVENTS,
        _LOSSES,
    ),
    "data_freshness": _with(
        f"""
        SELECT last_run,
          CASE WHEN minutes < 60 THEN minutes WHEN hours < 48 THEN hours
               ELSE CAST(floor(hours / 24 + 0.5) AS BIGINT) END AS age,
          CASE WHEN minutes < 60 THEN 'min' WHEN hours < 48 THEN 'h' ELSE 'd' END AS unit
        FROM (SELECT *, CAST(floor(minutes / 60 + 0.5) AS BIGINT) AS hours FROM (
          SELECT max(ts) AS last_run,
            CAST(floor((epoch_us({_AS_OF}) - epoch_us(max(ts))) / 60000000 + 0.5) AS BIGINT) AS minutes FROM event))
        """,
        _EVENTS,
    ),
    "recheck_worklist": _with(
        """
        SELECT DISTINCT l.norm_url FROM loss_log l
        WHERE NOT EXISTS (SELECT 1 FROM checked c WHERE c.norm_url = l.norm_url AND c.archived)
        """,
        _EVENTS,
        _LOSSES,
        _CAPTURES,
    ),
    "stream_seen_state": _with(f"SELECT {_SEEN} FROM folded", _EVENTS, _DAY_FOLD),
    "stream_dedupe": _with("SELECT DISTINCT norm_url FROM feed_item", _EVENTS),
    "stream_rate": """
        SELECT event_type AS account, window_start, count(*) AS submits FROM (
          SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * CAST(i AS BIGINT)) AS window_start
          FROM events, range(6) t(i))
        GROUP BY ALL
        """,
    "stream_feed_drops": _with("SELECT * FROM gone", _EVENTS, _LOSSES),
    "stream_stale_pending": _with(
        """
        SELECT norm_url, first_seen FROM folded
        WHERE status = 'pending' AND first_seen < (SELECT max(ts) FROM event) - INTERVAL 6 HOUR
        """,
        _EVENTS,
        _DAY_FOLD,
    ),
    "stream_run_totals": _with(
        """
        SELECT t.*, o.pending, r.rate_limited FROM totals t JOIN open_jobs o USING (run_id) JOIN (
          SELECT run_id, CAST(sum(n_rate_limited) AS BIGINT) AS rate_limited FROM outcome GROUP BY run_id) r
        USING (run_id)
        """,
        _EVENTS,
        _USER_FOLD,
        _TOTALS,
    ),
}
ORACLE["indexed_availability"] = _with(
    """
    SELECT u.norm_url, CASE WHEN c.norm_url IS NULL THEN false ELSE c.archived END AS archived
    FROM (SELECT DISTINCT 'https://example.org/u/' || user_id AS norm_url FROM events) u LEFT JOIN checked c USING (norm_url)
    """,
    _CAPTURES,
)
ORACLE["feed_runs"] = _with(
    """
    SELECT run_id, host || '/' || chunk || ' ' || kind AS source, CAST(run_id AS TIMESTAMP) AS ts, false AS exhaustive FROM read
    """,
    _LISTINGS,
)
ORACLE["document_drops"] = _with(
    """
    SELECT next_run AS run_id, source, norm_url FROM snapshot JOIN successor USING (run_id, source)
    WHERE next_run IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM snapshot s WHERE s.run_id = next_run AND s.source = snapshot.source AND s.norm_url = snapshot.norm_url)
    """,
    _LISTINGS,
)
ORACLE["stream_discover"] = ORACLE["discover"]

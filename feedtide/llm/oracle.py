"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations


def _least(cost: str, letter: str, end: str, said: str = "''") -> str:
    return f"{{'cost': {cost} + w[{end}].cost, 'audit': '{letter}' || w[{end}].audit, 'said': {said} || w[{end}].said}}"


def _done(state: int, kept: list[tuple[str, int]], turned: int, role: str) -> str:
    """The best way from a state over one row, without inserts: states are 1 start, 2 system, 3 user, 4 assistant."""
    worst = "{'cost': 1000000000::BIGINT, 'audit': '', 'said': ''}"
    keep = " ".join(f"WHEN initial = '{initial}' THEN {_least('cut', 'K', str(end), said())}" for initial, end in kept)
    return (
        f"least({_least('3', 'D', str(state))}, CASE WHEN gone THEN {worst} {keep} ELSE {worst} END, "
        f"CASE WHEN gone THEN {worst} ELSE {_least('2 + cut', 'R', str(turned), said(role))} END)"
    )


def said(role: str | None = None) -> str:
    who = "role" if role is None else f"'{role}'"
    return f"chr(10) || {who} || ':' || text"


def _inserted(state: int, first: tuple[int, str], second: tuple[int, str]) -> str:
    def after(letters: str, end: int, text: str) -> str:
        return f"{{'cost': {2 * len(letters)} + a[{end}].cost, 'audit': '{letters}' || a[{end}].audit, 'said': {text} || a[{end}].said}}"

    one = f"chr(10) || '{first[1]}:'"
    return f"least(a[{state}], {after('I', first[0], one)}, {after('II', second[0], one + f' || chr(10) || {chr(39)}{second[1]}:{chr(39)}')})"


CONVERSATIONS = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations, crc
), chosen AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM chosen, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64), role, text) AS place,
         NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open_end
  FROM damaged
), judged AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS previous FROM placed
), rows_of AS (
  SELECT conv_id, place, role, text, initial, blank OR duplicate AS gone, (NOT blank AND NOT duplicate AND open_end)::BIGINT AS cut,
         blank, duplicate, turn, previous FROM judged
), totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
         count_if(duplicate)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated,
         count_if(previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM rows_of GROUP BY conv_id
), best AS (
  SELECT conv_id, n AS left_rows, [
      {{'cost': 0::BIGINT, 'audit': '', 'said': ''}}, {{'cost': 4::BIGINT, 'audit': 'II', 'said': chr(10) || 'user:' || chr(10) || 'assistant:'}},
      {{'cost': 2::BIGINT, 'audit': 'I', 'said': chr(10) || 'assistant:'}}, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}}] AS w FROM totals
  UNION ALL
  SELECT conv_id, left_rows - 1, [{_inserted(1, (3, "user"), (4, "assistant"))}, {_inserted(2, (3, "user"), (4, "assistant"))},
      {_inserted(3, (4, "assistant"), (3, "user"))}, {_inserted(4, (3, "user"), (4, "assistant"))}]
  FROM (
    SELECT b.conv_id, left_rows, [{_done(1, [("s", 2), ("u", 3)], 3, "user")}, {_done(2, [("u", 3)], 3, "user")},
      {_done(3, [("a", 4)], 4, "assistant")}, {_done(4, [("u", 3)], 3, "user")}] AS a
    FROM best b JOIN rows_of r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND r.place = left_rows
  )
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(w[1].cost, 0) AS cost, coalesce(w[1].audit, '') AS audit, sha256(coalesce(w[1].said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.left_rows = 0
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH asked AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL
), texts AS (
  SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents
), sizes AS (
  SELECT count_if(len(terms) > 0)::BIGINT AS n_documents, sum(len(terms))::BIGINT AS n_terms FROM texts
), counted AS (
  SELECT place, doc_id, n, term, count(*) AS tf
  FROM (SELECT place, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM texts) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2.0 * n_documents + 2)::DOUBLE / (2.0 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, sizes GROUP BY term, n_documents
), scored AS (
  SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_documents) // n_terms))))::BIGINT AS score
  FROM counted JOIN asked USING (term) JOIN weighed USING (term), sizes GROUP BY ALL
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

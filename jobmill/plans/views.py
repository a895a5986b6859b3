"""The domain's tables as SQL for DuckDB, written apart from their DataFrame form."""

from __future__ import annotations

from ..functions.dictionaries import CITIES, SENIORITY, SKILLS, SOURCES, STATUSES, STOPWORDS
from ..sources.domain import BASE, PLACES, TEXTS, TITLES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def hours(x: str) -> str:
    return f"(TIMESTAMP '{BASE}' + to_hours(CAST({x} AS BIGINT)))"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda w: length(w) >= 2 AND NOT list_contains({listed(STOPWORDS)}, w)))"


def whole(x: str, words: tuple[str, ...]) -> str:
    """Whether folded text x holds one of these as whole words."""
    return "(" + " OR ".join(f"contains(' ' || {x} || ' ', ' {w} ')" for w in words) + ")"


def city(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {whole(x, words)} THEN {text(name)}" for name, words in CITIES) + " END"


def level(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {whole(x, words)} THEN {text(name)}" for name, words in SENIORITY) + " END"


def skill_list(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {whole(x, words)} THEN {text(name)} END" for name, words in SKILLS) + "], lambda s: s IS NOT NULL)"


JOB = f"""job AS (
  SELECT p_partkey AS id, {listed(TITLES)}[p_partkey % {len(TITLES)} + 1] AS title, p_brand AS company,
    nullif({listed(PLACES)}[p_size % {len(PLACES)} + 1], '') AS location,
    {listed(TEXTS)}[(p_partkey // 3) % {len(TEXTS)} + 1] || ' ' || p_name || ' ' || p_type AS description,
    {listed(SOURCES)}[p_partkey % {len(SOURCES)} + 1] AS source,
    'https://www.' || lower({listed(SOURCES)}[p_partkey % {len(SOURCES)} + 1]) || '.example/job/' || p_partkey || '?utm_source=x&b=2&a=' || (p_partkey % 5) AS source_url,
    CASE WHEN p_partkey % 3 <> 0 THEN (floor(p_retailprice) * 40)::INT || ' - ' || ((floor(p_retailprice) * 40)::INT + 20000) || ' Kč / měsíc' END AS salary,
    (floor(p_retailprice) * 40)::INT AS price,
    CASE p_partkey % 5 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Full office' END AS work_type,
    'CZ' AS country, {hours("p_partkey % 2000")} AS first_seen_at, {hours("p_partkey % 2000 + (p_partkey % 7) * 24")} AS scraped_at,
    CASE WHEN p_partkey % 4 <> 0 THEN {hours("p_partkey % 2000 - (p_partkey % 40) * 24")} END AS posted_at,
    CASE WHEN p_partkey % 11 = 0 THEN {hours("p_partkey % 2000 + 240")} END AS expired_at,
    CASE WHEN p_partkey % 13 <> 0 THEN p_brand || '|' || {listed(TITLES)}[p_partkey % {len(TITLES)} + 1] END AS group_key
  FROM part)"""

APPLICATION = f"""app AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, l.job_id, {listed(STATUSES)}[o_orderkey % {len(STATUSES)} + 1] AS status, o_orderdate AS created_at, o_orderpriority AS notes
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS job_id FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey)"""

EVENT = """ev AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, event_type AS kind, value, ts FROM events)"""

FAVOURITE = """fav AS (SELECT user_id, job_id FROM ev WHERE kind = 'click' GROUP BY user_id, job_id HAVING count(*) % 2 = 1)"""

INTERVIEW = "iv AS (SELECT id AS application_id, created_at + INTERVAL 7 DAY AS scheduled_at, CAST(id % 90 AS INT) AS duration_minutes FROM app WHERE status = 'INTERVIEW')"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

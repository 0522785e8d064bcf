"""The reports as plain SQL for a single-node engine, to compare results with.

Written differently from the Spark jobs where that is possible: range joins
instead of carried values, plain windows over raw events instead of pieces,
stripping hidden markup instead of tokenizing. Equal results are therefore
expected on the given tables, not on malformed pages.
"""

from __future__ import annotations

# Page text without comments and script or style elements.
_VISIBLE = (
    "regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>"
    "|<style[^>]*>.*?</style>', '', 'g')"
)
_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)"""
_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '')"
_TITLE = (
    f"trim(regexp_replace(regexp_extract({_VISIBLE}, "
    r"'(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
)
_LINKS = f"regexp_extract_all({_VISIBLE}, '{_HREF}', 1)"


def _matches(pattern: str) -> str:
    return f"len(regexp_extract_all({_VISIBLE}, '{pattern}'))"


CHECK_SQL: dict[str, str] = {
    "page_audit": rf"""
        SELECT page_id,
               {_HOST} AS host,
               length({_TITLE}) AS title_length,
               {_matches(r'(?i)<h1[\s>]')} AS n_h1,
               len({_LINKS}) AS n_links,
               {_matches(r'(?i)<img[\s>]')} AS n_images,
               regexp_matches({_VISIBLE}, '(?i)<meta\s[^>]*name="description"') AS has_meta_description
        FROM pages""",
    "link_edges": f"""
        WITH found AS (SELECT page_id, {_LINKS} AS links FROM pages),
        numbered AS (
            SELECT page_id, unnest(range(1, len(links) + 1)) AS link_no, links FROM found
        )
        SELECT page_id, link_no,
               regexp_replace(links[link_no], '^["'']|["'']$', '', 'g') AS href
        FROM numbered""",
    "duplicate_titles": f"""
        WITH titles AS (SELECT {_TITLE} AS title FROM pages)
        SELECT title, count(*) AS n_pages FROM titles
        WHERE title <> '' GROUP BY title HAVING count(*) > 1""",
    "canonical_url_groups": r"""
        WITH parts AS (
            SELECT regexp_replace(
                       lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)),
                       '^(www|m)\.([^.]+\.)', '\2') AS site,
                   regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        )
        SELECT rtrim(site || path, '/') AS canonical_url, count(*) AS n_pages
        FROM parts WHERE site <> '' GROUP BY 1 HAVING count(*) > 1""",
    "top_pages_by_links": f"""
        WITH counted AS (
            SELECT page_id, {_HOST} AS host, len({_LINKS}) AS n_links FROM pages
        )
        SELECT host,
               row_number() OVER (PARTITION BY host ORDER BY n_links DESC, page_id) AS rank,
               page_id, n_links
        FROM counted WHERE host IS NOT NULL
        QUALIFY rank <= 3""",
    "event_report": """
        SELECT CAST(ts AS DATE) AS day, event_type,
               CAST(grouping(CAST(ts AS DATE), event_type) AS BIGINT) AS level,
               count(*) AS n_events
        FROM events GROUP BY ROLLUP (CAST(ts AS DATE), event_type)""",
    "daily_activity": """
        WITH daily AS (
            SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n_users,
                   sum(CAST(value AS DECIMAL(38, 9))) AS total
            FROM events WHERE ts IS NOT NULL GROUP BY 1
        )
        SELECT day, n_users, CAST(total AS DOUBLE) AS value,
               CAST(sum(total) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
                    AS DOUBLE) AS rolling_value
        FROM daily""",
    "user_sessions": """
        WITH marked AS (
            SELECT user_id, ts,
                   CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
            FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
            WINDOW w AS (PARTITION BY user_id ORDER BY ts)
        ),
        numbered AS (
            SELECT user_id, ts, CAST(sum(starts) OVER (
                PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session_no
            FROM marked
        )
        SELECT user_id, session_no, count(*) AS n_events,
               min(ts) AS session_start, max(ts) AS session_end
        FROM numbered GROUP BY user_id, session_no""",
    "signup_funnel": """
        WITH s AS (
            SELECT user_id, min(ts) AS signup_ts FROM events
            WHERE event_type = 'signup' GROUP BY user_id
        ),
        v AS (
            SELECT s.user_id, s.signup_ts, min(e.ts) AS view_ts
            FROM s JOIN events e
              ON e.user_id = s.user_id AND e.event_type = 'view' AND e.ts > s.signup_ts
            GROUP BY ALL
        )
        SELECT v.user_id, v.signup_ts, v.view_ts, min(e.ts) AS purchase_ts
        FROM v JOIN events e
          ON e.user_id = v.user_id AND e.event_type = 'purchase' AND e.ts > v.view_ts
        GROUP BY ALL""",
    "weekly_retention": """
        WITH first_days AS (
            SELECT user_id, CAST(min(ts) AS DATE) AS first_day FROM events GROUP BY user_id
        )
        SELECT (CAST(e.ts AS DATE) - f.first_day) // 7 AS week,
               count(DISTINCT e.user_id) AS n_users
        FROM events e JOIN first_days f ON f.user_id = e.user_id
        GROUP BY 1""",
    "last_click_before_purchase": """
        WITH ranked AS (
            SELECT p.event_id AS purchase_id, p.user_id, p.ts AS purchase_ts,
                   c.event_id AS click_id, c.ts AS click_ts
            FROM events p LEFT JOIN events c
              ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts
            WHERE p.event_type = 'purchase' AND p.user_id IS NOT NULL AND p.ts IS NOT NULL
            QUALIFY row_number() OVER (
                PARTITION BY p.event_id ORDER BY c.ts DESC NULLS LAST, c.event_id DESC) = 1
        )
        SELECT * FROM ranked""",
    "stream_daily_counts": """
        SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events
        FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "stream_deduplicated": """
        SELECT event_id, ts, user_id, event_type, value, props FROM events
        QUALIFY event_id IS NULL OR row_number() OVER (
            PARTITION BY event_id
            ORDER BY ts NULLS LAST, user_id NULLS FIRST, event_type NULLS FIRST,
                     value NULLS FIRST, props NULLS FIRST) = 1""",
}

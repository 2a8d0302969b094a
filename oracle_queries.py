"""DuckDB SQL for each registered query, on the same Parquet tables."""

from __future__ import annotations

# The events table seen as page edits.
EDITS = """
edits AS (
  SELECT event_id, ts AS "timestamp", 'page_' || k AS title, 'user_' || user_id AS "user",
         user_id % 7 = 0 AS anonymous, user_id % 10 = 0 AS bot, event_kind || ' ' || props AS "comment",
         CASE event_kind WHEN 'signup' THEN 'new' WHEN 'error' THEN 'log' ELSE 'edit' END AS event_type,
         CAST(k % 4 AS INTEGER) AS namespace, wiki, wiki || '.example.org' AS server_name,
         k, user_id
  FROM (SELECT event_id, ts, user_id, event_type AS event_kind, props,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CASE WHEN event_id % 3 = 0 THEN 'dewiki' ELSE 'enwiki' END AS wiki
        FROM events)
)"""

EVENT_COLUMNS = '"timestamp", title, "user", anonymous, bot, "comment", event_type, namespace, wiki, server_name'

# UTC ISO text without a fraction of zero.
ISO = """strftime("timestamp", '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN microsecond("timestamp") % 1000000 = 0 THEN '' ELSE strftime("timestamp", '.%f') END || '+00:00'"""

RECENT = """
recent AS (SELECT * FROM edits WHERE "timestamp" >= (SELECT max("timestamp") FROM edits) - INTERVAL 86400 SECOND),
counts AS (SELECT title, count(*) AS recent_edits FROM recent GROUP BY title)"""

BASELINE_OF = """
hours AS (SELECT title, date_trunc('hour', "timestamp") AS edit_hour, count(*) AS hourly_edits FROM {source} GROUP BY 1, 2),
baseline AS (SELECT title, avg(hourly_edits) AS baseline_edits_per_hour FROM hours GROUP BY title)"""

PAST = """
past AS (SELECT * FROM edits WHERE "timestamp" < (SELECT max("timestamp") FROM edits) - INTERVAL 86400 SECOND),""" + BASELINE_OF.format(source="past")

SCORED = """
scored AS (
  SELECT {carried} c.title, c.recent_edits,
         round(c.recent_edits * (CAST(3600 AS DOUBLE) / 86400), 2) AS current_edits_per_hour,
         round(b.baseline_edits_per_hour, 2) AS baseline_edits_per_hour,
         round(c.recent_edits * (CAST(3600 AS DOUBLE) / 86400) / b.baseline_edits_per_hour, 2) AS trend_score,
         b.title IS NOT NULL AS baseline_available
  FROM counts c LEFT JOIN baseline b ON b.title = c.title
)"""

RATE_ORDER = """baseline_available DESC,
  CASE WHEN baseline_available THEN trend_score ELSE current_edits_per_hour END DESC, recent_edits DESC, title"""

RATE_ALL_ORDER = """baseline_available DESC, coalesce(trend_score, -1) DESC, current_edits_per_hour DESC, title"""

# Six-hour panes and the one-day windows that contain them.
SLIDING = """
panes AS (SELECT time_bucket(INTERVAL 6 HOUR, "timestamp", TIMESTAMP '1970-01-01') AS pane, title, count(*) AS edits FROM edits GROUP BY 1, 2),
counts AS (
  SELECT pane - i * INTERVAL 6 HOUR AS window_start, pane - i * INTERVAL 6 HOUR + INTERVAL 1 DAY AS window_end,
         title, CAST(sum(edits) AS BIGINT) AS recent_edits
  FROM panes, range(4) r(i) GROUP BY 1, 2, 3
)"""

# Windows of half an hour every ten minutes, up to ten minutes before the record that ends the stream.
TEN_MINUTES = """
panes AS (SELECT time_bucket(INTERVAL 10 MINUTE, "timestamp", TIMESTAMP '1970-01-01') AS pane, title, count(*) AS edits FROM edits GROUP BY 1, 2),
sums AS (
  SELECT pane + i * INTERVAL 10 MINUTE AS window_end, CAST(sum(edits) AS BIGINT) AS n, count(DISTINCT title) AS articles
  FROM panes, range(1, 4) r(i) GROUP BY 1
),
bounds AS (
  SELECT (SELECT min(pane) FROM panes) + INTERVAL 10 MINUTE AS first, time_bucket(INTERVAL 10 MINUTE,
    (SELECT max("timestamp") FROM edits) + INTERVAL 3 DAY - INTERVAL 10 MINUTE, TIMESTAMP '1970-01-01') AS last
),
grid AS (SELECT unnest(generate_series(first, last, INTERVAL 10 MINUTE)) AS window_end FROM bounds)"""

# After each fifth of the time: the day that ends with the six-hour pane of the newest edit.
TICKS = """
bounds AS (SELECT epoch_us(min("timestamp")) AS first, epoch_us(max("timestamp")) AS last FROM edits),
sliced AS (SELECT e.*, least((epoch_us("timestamp") - first) * 5 // (last - first), 4) AS slice FROM edits e, bounds),
ticks AS (
  SELECT t.tick, time_bucket(INTERVAL 6 HOUR, max(s."timestamp"), TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end
  FROM range(5) t(tick) JOIN sliced s ON s.slice <= t.tick GROUP BY t.tick
),
counts AS (
  SELECT t.tick, t.window_end, s.title, count(*) AS recent_edits FROM ticks t JOIN sliced s
  ON s.slice <= t.tick AND s."timestamp" >= t.window_end - INTERVAL 1 DAY AND s."timestamp" < t.window_end GROUP BY ALL
),
totals AS (
  SELECT tick, window_end, CAST(sum(recent_edits) AS BIGINT) AS total_events_in_window, count(*) AS distinct_articles_in_window
  FROM counts GROUP BY ALL
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tick ORDER BY recent_edits DESC, title) AS INTEGER) AS rank
  FROM counts WHERE recent_edits > 3 QUALIFY rank <= 10
)"""

RATIO = """
hours AS (SELECT title, date_trunc('hour', "timestamp") AS edit_hour, count(*) AS n FROM edits SEMI JOIN counts USING (title) GROUP BY 1, 2),
baseline AS (SELECT title, round(sum(n)::DOUBLE / greatest(count(edit_hour), 1), 4) AS b FROM hours GROUP BY title),
joined AS (SELECT c.title, recent_edits, coalesce(b, 0.0) AS b FROM counts c LEFT JOIN baseline USING (title)),
scored AS (SELECT title, recent_edits, round(b, 4) AS baseline,
                  CASE WHEN b > 0.5 THEN round(recent_edits::DOUBLE / b, 4) ELSE recent_edits::DOUBLE END AS trend_score
           FROM joined
           WHERE CASE WHEN b > 0.5 THEN round(recent_edits::DOUBLE / b, 4) >= 0.5 ELSE recent_edits > 1 END),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY trend_score DESC, title) AS INTEGER) AS rank FROM scored)"""

# What the normaliser must make of each raw record.
EXPECTED = """
expected AS (
  SELECT event_id,
         date_trunc('second', "timestamp") AS "timestamp", title,
         CASE WHEN event_id % 5 = 0 THEN 'unknown'
              WHEN event_id % 5 = 1 THEN '10.0.0.' || (event_id % 300) ELSE "user" END AS "user",
         event_id % 5 = 1 AND event_id % 300 <= 255 AS anonymous,
         bot, '' AS "comment", event_type, namespace, wiki, server_name,
         CASE WHEN event_id % 23 = 0 THEN 'not_a_json_object' WHEN event_id % 17 = 0 THEN 'title'
              WHEN event_id % 19 = 0 THEN 'user' END AS reject_reason
  FROM edits
),
passing AS (SELECT * FROM expected WHERE reject_reason IS NULL
            AND event_type = 'edit' AND namespace = 0 AND NOT bot AND wiki = 'enwiki'),
counters AS (
  SELECT count(*) FILTER (reject_reason IS NULL) AS total_received,
         (SELECT count(*) FROM passing) AS total_accepted,
         count(*) FILTER (reject_reason IS NULL) - (SELECT count(*) FROM passing) AS total_filtered,
         count(*) FILTER (reject_reason IS NOT NULL) AS total_parse_errors
  FROM expected
),
rated AS (
  SELECT *, round((total_filtered + total_parse_errors)::DOUBLE / total_received, 4) AS drop_rate,
         round((total_filtered + total_parse_errors)::DOUBLE / (total_received + total_parse_errors), 4) AS reject_share
  FROM counters
)"""

RATES = """
rates AS (
  SELECT time_bucket(INTERVAL 10 SECOND, "timestamp", TIMESTAMP '1970-01-01') AS interval_start,
         count(*) AS events_published, count(*)::DOUBLE / 10 AS events_per_second
  FROM edits GROUP BY 1
)"""

METRIC_ROWS = """
SELECT 'EditPulse' AS namespace, 'IngestionEventsPerSecond' AS metric_name, events_per_second AS value,
       'Count/Second' AS unit, interval_start AS ts FROM rates
UNION ALL
SELECT 'EditPulse', 'IngestionEventsPublished', events_published::DOUBLE, 'Count', interval_start FROM rates"""

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _with(*parts: str) -> str:
    return "WITH " + ",".join([EDITS, *parts]) + "\n"


def _all(sql: str, *parts: str) -> str:
    return _with(*parts) + sql


_TOP = "SELECT title, count(*) AS edit_count FROM edits GROUP BY title ORDER BY edit_count DESC, title LIMIT 50"
_BOTS = "SELECT bot, count(*) AS edit_count FROM edits GROUP BY bot"
_NAMESPACES = "SELECT namespace, count(*) AS edit_count FROM edits GROUP BY namespace ORDER BY edit_count DESC, namespace"
_HOURLY = """SELECT date_trunc('hour', "timestamp") AS edit_hour, count(*) AS edit_count FROM edits GROUP BY 1 ORDER BY 1"""
_TOTALS = """SELECT count(*) AS total_stored_events, count(DISTINCT title) AS total_articles,
 count(DISTINCT "user") AS total_editors FROM edits"""
_BASELINE = "SELECT * FROM baseline"
_ALL_BASELINE = BASELINE_OF.format(source="edits")
_BASELINE_FOR = """SELECT title, round(count(*)::DOUBLE / greatest(count(DISTINCT date_trunc('hour', "timestamp")), 1), 4)
 AS baseline_edits_per_hour FROM edits WHERE title IN ({titles}) GROUP BY title"""
_BUCKETS = """SELECT * FROM (SELECT time_bucket(INTERVAL '{n} minutes', "timestamp") AS bucket, count(*) AS count
 FROM edits GROUP BY 1 ORDER BY 1 DESC LIMIT {limit}) ORDER BY bucket"""
_TOP_STORED = "SELECT title, count(*) AS edit_count FROM edits GROUP BY title ORDER BY edit_count DESC, title LIMIT 10"
_SHOWN_BASELINE = """SELECT title AS "Article", round(baseline_edits_per_hour, 2) AS "Historical Edits/Hour"
 FROM baseline ORDER BY baseline_edits_per_hour DESC, title LIMIT 10"""
_RANKED = "SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM {source}"
_TOP_TEN = "SELECT * FROM ranked WHERE rank <= 10"
_NO_BASELINE = "baseline AS (SELECT NULL::VARCHAR AS title, NULL::DOUBLE AS baseline_edits_per_hour WHERE false)"
_REPLAY = f"""ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY {RATE_ORDER}) AS INTEGER) AS rank
 FROM scored WHERE recent_edits >= 3)"""
_PARTS_NULLED = """nulled AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN title END AS title,
 CASE WHEN event_id % 5 <> 0 THEN "user" END AS "user" FROM edits)"""
_METRICS = """metrics AS (
  SELECT CAST(86400 AS INTEGER) AS window_size, count(*) AS total_events, count(DISTINCT "user") AS unique_editors,
         count(DISTINCT title) AS active_articles,
         round(count(*) FILTER (anonymous)::DOUBLE / count(*), 4) AS anonymous_ratio,
         round(count(*)::DOUBLE / 86400, 4) AS events_per_second
  FROM recent)"""

ORACLE: dict[str, str] = {
    "events_total_and_distinct": _all(_TOTALS),
    "top_articles": _all(_TOP),
    "article_counts": _all("SELECT title, count(*) AS edit_count FROM edits GROUP BY title"),
    "bot_rows": _all(_BOTS),
    "bot_vs_human": _all("SELECT count(*) FILTER (bot) AS bot, count(*) FILTER (NOT bot) AS human FROM edits"),
    "namespace_breakdown": _all(_NAMESPACES),
    "edit_rate_hourly": _all(_HOURLY),
    "article_hourly": _all("SELECT * FROM hours", _ALL_BASELINE),
    "article_baseline": _all(_BASELINE, _ALL_BASELINE),
    "hour_rollup": _all(
        """SELECT title, date_trunc('hour', "timestamp") AS edit_hour, bot, namespace, count(*) AS edits
 FROM edits GROUP BY ALL"""
    ),
    "baseline_for_titles": _all(_BASELINE_FOR.format(titles="SELECT title FROM recent"), RECENT),
    "baseline_for_list": _all(_BASELINE_FOR.format(titles="SELECT 'page_' || i FROM range(40) r(i)")),
    "baseline_for_long_list": _all(_BASELINE_FOR.format(titles="SELECT 'page_' || (2 * i) FROM range(2000) r(i)")),
    "edit_rate_buckets_5m": _all(_BUCKETS.format(n=5, limit=48)),
    "edit_rate_buckets_7m": _all(_BUCKETS.format(n=7, limit=500)),
    "event_time_columns": _all(
        """SELECT event_id, "timestamp", CAST("timestamp" AS DATE) AS edit_date,
 date_trunc('hour', "timestamp") AS edit_hour FROM edits"""
    ),
    "batch_layer_top_articles": _all(_TOP),
    "batch_layer_baseline": _all(_BASELINE, _ALL_BASELINE),
    "batch_layer_summary": _all(_TOTALS),
    "batch_layer_hourly": _all(_HOURLY),
    "batch_layer_bots": _all(_BOTS),
    "batch_layer_namespaces": _all(_NAMESPACES),
    "normalised_events": _all(f"SELECT event_id, {EVENT_COLUMNS} FROM expected WHERE reject_reason IS NULL", EXPECTED),
    "rejected_records": _all("SELECT event_id, reject_reason FROM expected WHERE reject_reason IS NOT NULL", EXPECTED),
    "ingest_counters": _all("SELECT * FROM rated", EXPECTED),
    "ingest_filter": _all(
        """SELECT event_id, "timestamp", title, "user" FROM edits
 WHERE event_type = 'edit' AND namespace = 0 AND NOT bot AND wiki = 'enwiki'"""
    ),
    "looks_anonymous": _all(
        f"""SELECT event_id, editor,
 starts_with(trim(editor), '~') OR kind = 1
 OR (kind = 2 AND regexp_full_match(substr(editor, 8), '{_V4}'))
 OR (kind = 3 AND regexp_full_match(trim(editor), '{_V4}')) AS anonymous
 FROM (SELECT event_id, user_id % 5 AS kind, CASE user_id % 5
   WHEN 0 THEN '~2024-' || user_id
   WHEN 1 THEN '2001:db8::' || lower(printf('%X', user_id)) || ':' || k || '/64'
   WHEN 2 THEN '::ffff:10.0.' || k || '.' || (user_id * 3)
   WHEN 3 THEN ' 10.0.' || (user_id * 3) || '.' || k
   ELSE "user" END AS editor FROM edits)"""
    ),
    "json_title_extract": _all("SELECT event_id, title FROM edits WHERE event_id % 7 NOT IN (2, 3)"),
    "json_title_counts": _all(
        """SELECT title, count(*) AS recent_edits FROM edits
 WHERE event_id % 17 <> 0 AND event_id % 23 <> 0 GROUP BY title"""
    ),
    "keyed_bus_rows": _all(
        f"""SELECT title AS key, '{{"timestamp":"' || {ISO} || '","title":"' || title || '","user":"' || "user"
 || '","anonymous":' || anonymous || ',"bot":' || bot || ',"comment":"' || replace("comment", '"', '\\"')
 || '","event_type":"' || event_type || '","namespace":' || namespace || ',"wiki":"' || wiki
 || '","server_name":"' || server_name || '"}}' AS value FROM edits"""
    ),
    "landing_split": _all(
        """SELECT event_id, title, '{a}{b}' AS "comment", NULL::VARCHAR AS "user" FROM edits
 UNION ALL SELECT event_id, NULL, NULL, "user" FROM edits"""
    ),
    "landing_split_large": _all("""SELECT event_id, title, '}{ " \\' AS "comment", "user" FROM edits"""),
    "stored_event_json": _all(f"SELECT {EVENT_COLUMNS} FROM edits"),
    "trending_rate": _all(
        _TOP_TEN, RECENT, PAST, SCORED.format(carried=""),
        f"ranked AS ({_RANKED.format(order=RATE_ORDER, source='scored WHERE recent_edits >= 3')})",
    ),
    "trending_rate_all": _all(
        _TOP_TEN, RECENT, PAST, SCORED.format(carried=""),
        f"ranked AS ({_RANKED.format(order=RATE_ALL_ORDER, source='scored')})",
    ),
    "trending_no_baseline": _all(
        _TOP_TEN, RECENT, _NO_BASELINE, SCORED.format(carried=""),
        f"ranked AS ({_RANKED.format(order=RATE_ORDER, source='scored WHERE recent_edits >= 3')})",
    ),
    "trending_partial_baseline": _all(
        _TOP_TEN, RECENT, PAST.replace("GROUP BY title)", "GROUP BY title HAVING CAST(split_part(title, '_', 2) AS INTEGER) % 3 <> 0)"),
        SCORED.format(carried=""), f"ranked AS ({_RANKED.format(order=RATE_ORDER, source='scored WHERE recent_edits >= 3')})",
    ),
    "trending_count": _all(
        """SELECT title, recent_edits, recent_edits::DOUBLE AS trend_score,
 CAST(row_number() OVER (ORDER BY recent_edits DESC, title) AS INTEGER) AS rank
 FROM counts WHERE recent_edits > 3 QUALIFY rank <= 10""",
        RECENT,
    ),
    "trending_ratio": _all(_TOP_TEN, RECENT, RATIO),
    "scored_articles": _all("SELECT * FROM scored", RECENT, PAST, SCORED.format(carried="")),
    "hourly_rates": _all(
        "SELECT title, count(*) AS edit_count, count(*) * (CAST(3600 AS DOUBLE) / 86400) AS rate FROM edits GROUP BY title"
    ),
    "live_metrics": _all("SELECT * FROM metrics", RECENT, _METRICS),
    "snapshot_totals": _all(
        """SELECT CAST(sum(recent_edits) AS BIGINT) AS total_events_in_window, count(*) AS distinct_articles_in_window
 FROM counts""",
        RECENT,
    ),
    "snapshot_nested": _all(
        """SELECT '2024-01-31T00:00:00+00:00' AS generated_at, CAST(86400 AS INTEGER) AS window_seconds,
 (SELECT CAST(sum(recent_edits) AS BIGINT) FROM counts) AS total_events_in_window,
 (SELECT count(*) FROM counts) AS distinct_articles_in_window,
 (SELECT CAST(to_json(coalesce(list({'title': title, 'recent_edits': recent_edits,
    'current_edits_per_hour': current_edits_per_hour, 'baseline_edits_per_hour': baseline_edits_per_hour,
    'trend_score': trend_score, 'baseline_available': baseline_available} ORDER BY rank), [])) AS VARCHAR)
  FROM ranked WHERE rank <= 10) AS trending_articles""",
        RECENT, PAST, SCORED.format(carried=""),
        f"ranked AS ({_RANKED.format(order=RATE_ORDER, source='scored WHERE recent_edits >= 3')})",
    ),
    "trailing_counts": _all(
        """SELECT DISTINCT title, "timestamp", count(*) OVER (PARTITION BY title, "timestamp") AS edits,
 count(*) OVER (PARTITION BY title ORDER BY "timestamp" RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)
 AS trailing_edits FROM edits"""
    ),
    "trailing_total": _all(
        """SELECT DISTINCT "timestamp", count(*) OVER (PARTITION BY "timestamp") AS edits,
 count(*) OVER (ORDER BY "timestamp" RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW)
 AS trailing_edits FROM edits"""
    ),
    "sliding_counts": _all("SELECT * FROM counts", SLIDING),
    "topn_per_window": _all(
        """SELECT *, recent_edits::DOUBLE AS trend_score,
 CAST(row_number() OVER (PARTITION BY window_start ORDER BY recent_edits DESC, title) AS INTEGER) AS rank
 FROM counts WHERE recent_edits > 3 QUALIFY rank <= 10""",
        SLIDING,
    ),
    "trending_replay": _all(
        _TOP_TEN, SLIDING, _ALL_BASELINE, SCORED.format(carried="window_start, window_end,"), _REPLAY
    ),
    "ingest_rate_10s": _all("SELECT * FROM rates", RATES),
    "ingest_rate_5m_rollup": _all(
        """SELECT time_bucket(INTERVAL 5 MINUTE, interval_start, TIMESTAMP '1970-01-01') AS bucket,
 sum(events_published)::DOUBLE / (count(*) * 10) AS average_eps, max(events_per_second) AS maximum_eps FROM rates GROUP BY 1""",
        RATES,
    ),
    "ingest_metric_samples": _all(METRIC_ROWS, RATES),
    "snapshot_metric_samples": _all(
        """SELECT 'EditPulse' AS namespace, 'SpeedLayerWindowEvents' AS metric_name, sum(recent_edits)::DOUBLE AS value,
 'Count' AS unit, TIMESTAMP '2024-01-31' AS ts FROM counts
 UNION ALL SELECT 'EditPulse', 'SpeedLayerTrendingArticleCount',
 least(count(*) FILTER (recent_edits >= 3), 10)::DOUBLE, 'Count', TIMESTAMP '2024-01-31' FROM counts""",
        RECENT,
    ),
    "trend_bars": _all("SELECT title, trend_score FROM ranked WHERE rank <= 10 ORDER BY trend_score, title", RECENT, RATIO),
    "number_coercion": _all("SELECT event_id, CASE WHEN bot THEN NULL ELSE k::DOUBLE END AS number FROM edits"),
    "event_rows": _all(f"SELECT {EVENT_COLUMNS} FROM edits"),
    "run_speedup": """
WITH runs AS (SELECT user_id % 8 + 1 AS executors, sum(CAST(trunc(value * 100) AS BIGINT))::DOUBLE AS runtime_seconds
              FROM events GROUP BY 1)
SELECT *, (SELECT min_by(runtime_seconds, executors) FROM runs) / runtime_seconds AS speedup FROM runs""",
    "display_trending": _all(
        """SELECT title AS "Article", recent_edits AS "Recent Edits", round(current_edits_per_hour, 1) AS "Current Edits/Hour",
 CASE WHEN baseline_available THEN printf('%.2f', baseline_edits_per_hour) ELSE 'No historical data' END
   AS "Historical Baseline/Hour",
 CASE WHEN baseline_available THEN printf('%.2f', trend_score) || '×' ELSE 'N/A' END AS "Trend vs Baseline"
 FROM ranked WHERE rank <= 10""",
        RECENT, PAST, SCORED.format(carried=""),
        f"ranked AS ({_RANKED.format(order=RATE_ALL_ORDER, source='scored')})",
    ),
    "display_baseline": _all(_SHOWN_BASELINE, _ALL_BASELINE),
    "display_top_articles": _all(_TOP_STORED),
    "stored_summary": _all(_TOTALS),
    "stored_top_articles": _all(_TOP_STORED),
    "stored_baseline": _all(_SHOWN_BASELINE, _ALL_BASELINE),
    "history_view": _all(
        f"""SELECT *,
 (SELECT CAST(to_json({{'bot': count(*) FILTER (bot), 'human': count(*) FILTER (NOT bot)}}) AS VARCHAR) FROM edits) AS bot_vs_human,
 (SELECT CAST(to_json(list({{'namespace': namespace, 'edit_count': n}} ORDER BY n DESC, namespace)) AS VARCHAR)
  FROM (SELECT namespace, count(*) AS n FROM edits GROUP BY 1)) AS namespace_breakdown,
 (SELECT CAST(to_json(list({{'title': title, 'edit_count': n}} ORDER BY n DESC, title)) AS VARCHAR)
  FROM (SELECT title, count(*) AS n FROM edits GROUP BY 1 ORDER BY n DESC, title LIMIT 10)) AS top_edited_articles,
 (SELECT CAST(to_json(list({{'bucket': strftime(bucket, '%Y-%m-%dT%H:%M:%S+00:00'), 'count': "count"}} ORDER BY bucket)) AS VARCHAR)
  FROM ({_BUCKETS.format(n=60, limit=24)})) AS edit_rate_history
 FROM ({_TOTALS})"""
    ),
    "live_view": _all(
        """SELECT *, (SELECT CAST(to_json(coalesce(list({'title': title, 'recent_edits': recent_edits, 'baseline': baseline,
 'trend_score': trend_score} ORDER BY rank), [])) AS VARCHAR) FROM ranked WHERE rank <= 10) AS trending_articles,
 '2024-01-31T00:00:00+00:00' AS generated_at FROM metrics""",
        RECENT, _METRICS, RATIO,
    ),
    "health_view": _all(
        """SELECT *, CAST(86400 AS INTEGER) AS window_size_seconds,
 (SELECT count(*) FROM passing WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31') AS events_in_window,
 (SELECT round(epoch(TIMESTAMP '2024-01-31' - max("timestamp")), 2) FROM passing) AS seconds_since_last_event
 FROM rated""",
        EXPECTED,
    ),
    "recent_events": _all(
        f"""SELECT {ISO} AS "timestamp", title, "user", anonymous, bot, "comment", namespace, wiki, server_name
 FROM (SELECT * FROM edits ORDER BY "timestamp" DESC, event_id DESC LIMIT 50) newest"""
    ),
    "event_stream_columns": _all('SELECT "timestamp", title, "user", "comment" FROM edits'),
    "sql_view_param": _all(
        """SELECT title, count(*) AS edits, count(DISTINCT "user") AS editors FROM edits
 WHERE namespace = 0 AND wiki = 'enwiki' GROUP BY title"""
    ),
    "union_parts": _all("SELECT event_id, title, CASE WHEN bot THEN true END AS bot FROM edits"),
    "stored_parts": _all("SELECT event_id, title, namespace FROM edits"),
    "dropna_any": _all('SELECT * FROM nulled WHERE title IS NOT NULL AND "user" IS NOT NULL', _PARTS_NULLED),
    "dropna_all": _all('SELECT * FROM nulled WHERE title IS NOT NULL OR "user" IS NOT NULL', _PARTS_NULLED),
    "with_title": _all("SELECT * FROM nulled WHERE title IS NOT NULL", _PARTS_NULLED),
    "trailing_events": _all('SELECT event_id, "timestamp", title FROM recent', RECENT),
    "distinct_editors": _all('SELECT DISTINCT "user" FROM edits'),
    "stream_window_counts": _all("SELECT * FROM counts", SLIDING),
    "stream_trending": _all(
        _TOP_TEN, SLIDING, _ALL_BASELINE, SCORED.format(carried="window_start, window_end,"), _REPLAY
    ),
    "stream_snapshot": _all(
        """SELECT CAST(86400 AS INTEGER) AS window_seconds, CAST(sum(recent_edits) AS BIGINT) AS total_events_in_window,
 count(*) AS distinct_articles_in_window FROM counts WHERE window_end = (SELECT max(window_end) FROM counts)""",
        SLIDING,
    ),
    "stream_all_windows": _all(
        """SELECT window_end - INTERVAL 30 MINUTE AS window_start, window_end, coalesce(n, 0) AS total_events_in_window,
 coalesce(articles, 0) AS distinct_articles_in_window FROM grid LEFT JOIN sums USING (window_end)""",
        TEN_MINUTES,
    ),
    "stream_current_window": _all(
        """SELECT DISTINCT window_end - INTERVAL 1 DAY AS window_start, window_end, total_events_in_window,
 distinct_articles_in_window, title, recent_edits, rank FROM totals LEFT JOIN ranked USING (tick, window_end)""",
        TICKS,
    ),
    "sql_event_table": _all(
        """SELECT CAST("timestamp" AS DATE) AS event_date, title, count(*) AS edits FROM edits WHERE namespace = 0 GROUP BY ALL"""
    ),
    "stream_store": _all(f"SELECT {EVENT_COLUMNS} FROM edits"),
    "stream_store_compacted": _all(f"SELECT {EVENT_COLUMNS} FROM edits"),
    "stream_ingest": _all(f"SELECT {EVENT_COLUMNS} FROM passing", EXPECTED),
    "stream_ingest_bus": _all(
        """SELECT title AS key, CAST(row_number() OVER (PARTITION BY title ORDER BY "timestamp", "user" || '"', anonymous) AS INTEGER) AS place,
 strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '+00:00' AS "timestamp", "user", wiki FROM passing""",
        EXPECTED,
    ),
    "stream_recent_events": _all(
        f"""SELECT {ISO} AS "timestamp", title, "user", anonymous, bot, "comment", namespace, wiki, server_name
 FROM (SELECT * FROM edits ORDER BY "timestamp" DESC, event_id DESC LIMIT 50) newest"""
    ),
    "sliding_distincts": _all(
        """SELECT pane - i * INTERVAL 6 HOUR AS window_start, pane - i * INTERVAL 6 HOUR + INTERVAL 1 DAY AS window_end,
 count(*) AS edits, count(DISTINCT "user") AS distinct_user, count(DISTINCT title) AS distinct_title, true AS within
 FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, "timestamp", TIMESTAMP '1970-01-01') AS pane FROM edits), range(4) r(i) GROUP BY 1, 2"""
    ),
    "incremental_top_articles": _all(_TOP),
    "incremental_article_baseline": _all(_BASELINE, _ALL_BASELINE),
    "incremental_summary": _all(_TOTALS),
    "incremental_edit_rate_hourly": _all(_HOURLY),
    "incremental_bot_vs_human": _all(_BOTS),
    "incremental_namespace_breakdown": _all(_NAMESPACES),
    "stream_landing": _all(
        """SELECT strftime("timestamp", '%Y-%m-%d') AS event_date, CAST(hour("timestamp") AS INTEGER) AS event_hour,
 title AS value, count(*) AS count FROM edits GROUP BY ALL"""
    ),
    "stream_ingest_metrics": _all(METRIC_ROWS, RATES),
}

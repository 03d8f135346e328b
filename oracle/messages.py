"""Conversations, feedback, streaming twins."""

from __future__ import annotations

from oracle.gold import SQL as GOLD
from oracle.prelude import div, r

_MSG = """, msg AS (SELECT conv_id AS conversation_id, turn, role, text AS content,
    TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 100000 AS INTEGER)) + to_seconds(turn * 37) AS ts,
    CASE WHEN role = 'assistant' THEN length(text) % 5 * 100 END AS rt,
    CASE WHEN role = 'assistant' THEN CASE WHEN length(text) % 2 = 0 THEN 'agent' ELSE 'analyst' END END AS backend FROM conversations)"""


def _type(text: str) -> str:
    def any_of(*words: str) -> str:
        return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"
    return (f"CASE WHEN {any_of('error', 'failed', 'unable to')} THEN 'error' "
            f"WHEN {any_of('created', 'scheduled', 'completed', 'work order')} THEN 'action' "
            f"WHEN {any_of('query results')} OR contains({text}, chr(128202)) THEN 'data' ELSE 'assistant' END")


_WINDOW = """, n AS (SELECT conversation_id, count(*) AS n, sum(length(content)) / 4.0 AS tokens FROM msg GROUP BY 1),
  m AS (SELECT msg.*, n.n, (n.n > 4 AND tokens >= 200) AS cut, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS i
    FROM msg JOIN n USING (conversation_id)),
  p AS (SELECT *, CASE WHEN NOT cut THEN 'whole' WHEN i = 1 THEN 'first' WHEN i > n - 3 THEN 'recent' ELSE 'middle' END AS part FROM m),
  s AS (SELECT conversation_id, count(*) FILTER (role = 'user') AS q, string_agg(content, '; ' ORDER BY turn) FILTER (role = 'user') AS t
    FROM p WHERE part = 'middle' GROUP BY 1)
  SELECT conversation_id, part, turn, role, content FROM p WHERE part <> 'middle'
  UNION ALL SELECT conversation_id, 'summary', NULL, 'system', '[Previous conversation summary: ' ||
    CASE WHEN q = 0 THEN 'No significant conversation history' WHEN q <= 3 THEN 'Previous questions: ' || t
    ELSE 'User asked ' || q || ' questions about asset health, maintenance, and OEE metrics' END || ']' FROM s"""

SQL: dict[str, str] = {
    "conv_analytics": f"""{_MSG} SELECT conversation_id, count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_queries,
      count(*) FILTER (role = 'assistant') AS assistant_responses,
      {r(div("coalesce(sum(rt) FILTER (rt > 0), 0)", "count(*) FILTER (rt > 0)"), 4)} AS avg_response_time_ms,
      CASE WHEN count(*) < 2 THEN 0e0 ELSE {r("date_diff('microsecond', min(ts), max(ts)) / 60000000e0", 2)} END AS duration_minutes
      FROM msg GROUP BY 1""",
    "conv_backends": f"""{_MSG} SELECT conversation_id, backend, count(*) AS responses FROM msg WHERE role = 'assistant' GROUP BY 1, 2""",
    "conv_alternating": f"""{_MSG}, u AS (SELECT * FROM msg WHERE role = 'user' OR (role = 'assistant' AND turn % 3 <> 1)),
      l AS (SELECT *, lead(role) OVER (PARTITION BY conversation_id ORDER BY turn) AS nx FROM u),
      k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS i FROM l WHERE nx IS NULL OR nx <> role)
      SELECT conversation_id, turn, role, content FROM k WHERE NOT (i = 1 AND role <> 'user')""",
    "conv_context": f"{_MSG}{_WINDOW}",
    "response_type": f"{_MSG} SELECT conversation_id, turn, {_type('content')} AS response_type FROM msg WHERE role = 'assistant'",
    "response_type_documents": f"SELECT lang, {_type('text')} AS response_type, count(*) AS texts FROM documents GROUP BY 1, 2",
    "feedback_summary": """SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' ELSE 'negative' END AS rating, lang, source, count(*) AS ratings
      FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3""",
    "feedback_daily": """, a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')
      SELECT CAST(TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 100000 AS INTEGER)) + to_seconds(turn * 37) AS DATE) AS day,
        count(*) AS messages_rated, CAST(sum(CASE WHEN conv_id % 4 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS ratings,
        count(*) FILTER (turn % 3 <> 0) AS positive, count(*) FILTER (turn % 3 = 0 OR conv_id % 4 = 1) AS last_negative FROM a GROUP BY 1""",
    "conv_export_back": f"""{_MSG} SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS message_no, role, content FROM msg""",
    "conv_export_rows": f"""{_MSG} SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS message_no, role, content FROM msg""",
    "last_user_message": f"{_MSG} SELECT conversation_id, arg_max(content, turn) AS content, max(turn) AS turn FROM msg WHERE role = 'user' GROUP BY 1",
    "last_messages": f"""{_MSG} SELECT conversation_id, turn, role, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS from_end
      FROM msg QUALIFY from_end <= 2""",
}

_REASON = """CASE WHEN event_id % 97 = 5 THEN 'not json' WHEN event_id % 83 = 9 THEN 'missing deviceId'
    WHEN event_id % 89 = 7 THEN 'wrong type value' END"""

SQL.update({
    "stream_ingest": f"SELECT event_id, {_REASON} AS reject_reason FROM events",
    "stream_hourly": GOLD["hourly_health"],
    "stream_sliding": f""", t AS (SELECT * FROM telemetry WHERE temperature_c IS NOT NULL),
      w AS (SELECT asset_id, temperature_c, unnest(generate_series(date_trunc('hour', recorded_at) + INTERVAL 1 HOUR,
        date_trunc('hour', recorded_at) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS window_end FROM t)
      SELECT window_end, asset_id, {r("CAST(sum(temperature_c) AS DOUBLE) / count(*)", 2)} AS avg_temperature_c, count(*) AS readings
      FROM w GROUP BY 1, 2""",
    "stream_session": """, t AS (SELECT asset_id, recorded_at, lag(recorded_at) OVER (PARTITION BY asset_id ORDER BY recorded_at) AS p
        FROM telemetry WHERE is_anomalous),
      u AS (SELECT *, sum(CASE WHEN p IS NULL OR recorded_at - p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY asset_id ORDER BY recorded_at) AS s FROM t)
      SELECT asset_id, min(recorded_at) AS session_start, max(recorded_at) + INTERVAL 12 HOUR AS session_end, count(*) AS readings
      FROM u GROUP BY asset_id, s""",
    "stream_dedup": "SELECT telemetry_id, asset_id, recorded_at FROM telemetry",
    "stream_alerts": """SELECT telemetry_id, asset_id, asset_name, recorded_at, CAST(health_score AS DOUBLE) AS health_score
      FROM telemetry JOIN placed USING (asset_id) WHERE health_score < 80 OR (class_name = 'MACHINERY' AND vibration_mm_s > 1.2)""",
    "stream_state": """, x AS (SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY recorded_at DESC, telemetry_id DESC) = 1)
      SELECT asset_id, recorded_at, CAST(health_score AS DOUBLE) AS health_score, CAST(failure_probability AS DOUBLE) AS failure_probability,
        rul_days, is_anomalous FROM x""",
    "stream_late_kept": """, n AS (SELECT telemetry_id % 3 AS b, max(recorded_at) AS newest FROM telemetry GROUP BY 1)
      SELECT telemetry_id, asset_id, recorded_at, telemetry_id % 3 AS batch_id FROM telemetry
      WHERE recorded_at < (SELECT max(newest) FROM n WHERE b < telemetry_id % 3) - INTERVAL 2 HOUR""",
    "stream_silent": """, g AS (SELECT asset_id, recorded_at, lead(recorded_at) OVER (PARTITION BY asset_id ORDER BY recorded_at, telemetry_id) AS next FROM telemetry)
      SELECT asset_id, date_trunc('millisecond', recorded_at) AS silent_since, date_trunc('millisecond', recorded_at) + INTERVAL 48 HOUR AS told_at FROM g
      WHERE coalesce(date_trunc('millisecond', next), (SELECT max(recorded_at) FROM telemetry) - INTERVAL 2 HOUR) >= date_trunc('millisecond', recorded_at) + INTERVAL 48 HOUR""",
    "conversation_reloaded": """SELECT conv_id || '-' || turn AS message_id, role, text AS content FROM conversations WHERE conv_id = 7 ORDER BY turn DESC LIMIT 3""",
    "stream_late": "SELECT count(*) AS rows_seen, CAST(0 AS BIGINT) AS late_rows FROM telemetry",
})

"""Jobs over ``conversations``. Repeats and tool turns, which the table lacks, are derived from it
and from ``events``, so they grow with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as cv
from ..sources.tables import table

BUDGET, KEEP_FIRST = 300, 1
LATER = 1 << 40  # behind any turn


def _messages(spark, sf):
    return table(spark, sf, "conversations")


def _with_repeats(spark, sf):
    """Every message, and every user message once more right after itself and once at the end."""
    m = _messages(spark, sf).withColumn("turn", F.col("turn").cast("long") * 4)
    users = m.filter(F.col("role") == "user")
    return m.unionByName(users.withColumn("turn", F.col("turn") + 1)).unionByName(users.withColumn("turn", F.col("turn") + LATER))


def _with_tools(spark, sf):
    """Assistant turns of few words count as tool calls; events become tool results of a user."""
    m = _messages(spark, sf).withColumn("has_tool_calls", (F.col("role") == "assistant") & (F.length("text") < 150))
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") + LATER).alias("turn"), F.lit("tool").alias("role"), F.col("props").alias("text"), F.lit(False).alias("has_tool_calls"))
    return m.unionByName(e)


def token_estimates(spark, sf):
    m = _with_tools(spark, sf)
    extra = F.when(F.col("has_tool_calls"), "{'tool_calls': []}")
    return m.select("conv_id", "turn", "role", cv.message_tokens(F.col("role"), F.col("text"), extra, F.col("has_tool_calls")).alias("tokens"))


def distinct_messages(spark, sf):
    return cv.distinct_messages(_with_repeats(spark, sf))


def collapsed_repeats(spark, sf):
    m = _with_repeats(spark, sf)
    # conversations with a system turn come once more, under other ids and without user turns: those take the fallback
    head = m.filter(F.col("role") == "system").select("conv_id").distinct()
    m = m.unionByName(m.join(head, "conv_id", "left_semi").filter(F.col("role") != "user").withColumn("conv_id", -F.col("conv_id") - 1))
    return cv.collapse_repeats(m, m.filter(F.col("role") == "system").select("conv_id", "turn", "text"))


def latest_user_messages(spark, sf):
    return cv.latest_user_message(_messages(spark, sf))


def topic_texts(spark, sf):
    return cv.topic_text(cv.collapse_repeats(_with_repeats(spark, sf)))


def trimmed_conversations(spark, sf):
    return cv.trim_to_budget(_messages(spark, sf), BUDGET, KEEP_FIRST)


def validated_contents(spark, sf):
    """Missing texts become empty, long ones are capped (here at 200 characters)."""
    m = _messages(spark, sf).withColumn("text", F.when(F.col("role") != "system", F.col("text")))
    return cv.validate_content(m, 200)


def replayable_messages(spark, sf):
    return cv.replayable(_with_tools(spark, sf), keep_system=False)


REPEATS = """rep AS (SELECT conv_id, turn * 4 AS turn, role, text FROM conversations UNION ALL SELECT conv_id, turn * 4 + 1, role, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn::BIGINT * 4 + 1099511627776, role, text FROM conversations WHERE role = 'user')"""
TOOLS = """tl AS (SELECT conv_id, turn, role, text, role = 'assistant' AND length(text) < 150 AS has_tool_calls FROM conversations UNION ALL SELECT user_id, event_id + 1099511627776, 'tool', props, false FROM events)"""


def _tokens_sql(source: str, name: str, more: str = "0") -> str:
    other = r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))"
    return f"""{name} AS (SELECT *, greatest(1, CAST(floor((( length(text) - {other}) // 4 + {other} + length(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END) // 4)
  * CASE role WHEN 'system' THEN 1.1::DOUBLE WHEN 'assistant' THEN 1.2::DOUBLE WHEN 'tool' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) + {more}) AS tokens FROM {source})"""


_COLLAPSED = """u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {src} WHERE role = 'user' AND text <> ''), col AS (SELECT conv_id, turn, text FROM u WHERE before IS NULL OR before <> text)"""

QUERIES = {
    "token_estimates": token_estimates,
    "distinct_messages": distinct_messages,
    "collapsed_repeats": collapsed_repeats,
    "latest_user_messages": latest_user_messages,
    "topic_texts": topic_texts,
    "trimmed_conversations": trimmed_conversations,
    "validated_contents": validated_contents,
    "replayable_messages": replayable_messages,
}
ORACLES = {
    "token_estimates": "WITH " + TOOLS + ", " + _tokens_sql("tl", "tk", "CASE WHEN has_tool_calls THEN 4 + 50 ELSE 0 END") + " SELECT conv_id, turn, role, tokens FROM tk",
    "distinct_messages": "WITH " + REPEATS + " SELECT conv_id, role, text, min(turn) AS turn FROM rep GROUP BY 1, 2, 3",
    "collapsed_repeats": "WITH " + REPEATS + ", m AS (SELECT * FROM rep UNION ALL SELECT -conv_id - 1, turn, role, text FROM rep WHERE conv_id IN (SELECT conv_id FROM rep WHERE role = 'system') AND role <> 'user'), " + _COLLAPSED.format(src="m") + """
SELECT * FROM col UNION ALL SELECT conv_id, turn, text FROM m WHERE role = 'system' AND conv_id NOT IN (SELECT conv_id FROM m WHERE role = 'user')""",
    "latest_user_messages": "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'user' AND text <> '' GROUP BY 1",
    "topic_texts": "WITH " + REPEATS + ", " + _COLLAPSED.format(src="rep") + """, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM col)
SELECT conv_id, string_agg(CASE n WHEN 1 THEN '' WHEN 2 THEN ' - ' ELSE ', ' END || text, '' ORDER BY n) AS text FROM n GROUP BY 1""",
    "trimmed_conversations": "WITH " + _tokens_sql("conversations", "tk") + f""", s AS (SELECT *, row_number() OVER w AS r, sum(tokens) OVER w AS cum, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM tk WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT *, coalesce(max(cum) FILTER (r <= {KEEP_FIRST}) OVER (PARTITION BY conv_id), 0) AS head FROM s),
l AS (SELECT *, CASE WHEN r <= {KEEP_FIRST} THEN {BUDGET} - (cum - tokens) WHEN head <= {BUDGET} THEN {BUDGET} - head - (total - cum) ELSE 0 END AS room FROM h)
SELECT conv_id, turn, role, CASE WHEN room >= tokens THEN text ELSE left(text, CAST(room AS INTEGER)) END AS text, CASE WHEN room >= tokens THEN 'kept' ELSE 'cut' END AS fate FROM l WHERE room > 0""",
    "validated_contents": r"""SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN '' WHEN length(text) > 200 THEN regexp_replace(left(text, 200), '\s+$', '') || '...' ELSE text END AS text FROM conversations""",
    "replayable_messages": "WITH " + TOOLS + """ SELECT conv_id, turn, CASE WHEN role = 'tool' THEN 'assistant' ELSE role END AS role, CASE WHEN role = 'tool' THEN '(tool result):' || chr(10) || text ELSE text END AS text
FROM tl WHERE role <> 'system' AND NOT (role = 'assistant' AND (has_tool_calls OR text = ''))""",
}

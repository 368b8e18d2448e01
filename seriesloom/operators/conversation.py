"""Jobs over ``conversations(conv_id, turn, role, text)``.

A conversation may be of any length, so nothing here sorts a whole one in a task: order-dependent
steps use the two-level scans, the others are map-side combined aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped, token_estimate
from .scan import joined_text, last_before, running_sums

# Weight per role.
ROLE_WEIGHTS = {"system": 1.1, "assistant": 1.2, "tool": 1.3}
# Role names as the estimate counts them.
ROLE_NAMES = {"user": "human", "assistant": "ai", "system": "system", "tool": "tool"}


# Fixed value: what a message with tool calls counts besides.
TOOL_CALL_TOKENS = 50


def message_tokens(role: Column, text: Column, extra: Column | None = None, has_tool_calls: Column | None = None) -> Column:
    """Estimate for text and role name, weighted by role, whole tokens, at least 1. The text of
    extra fields, where there are any, and a surcharge for tool calls are added unweighted."""
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    base = token_estimate(text) + token_estimate(F.coalesce(F.try_element_at(names, role), role))
    weight = None
    for name, factor in ROLE_WEIGHTS.items():
        weight = F.when(role == name, F.lit(factor)) if weight is None else weight.when(role == name, F.lit(factor))
    tokens = F.floor(base * weight.otherwise(F.lit(1.0)))
    if extra is not None:
        tokens = tokens + token_estimate(extra)
    if has_tool_calls is not None:
        tokens = tokens + F.when(has_tool_calls, TOOL_CALL_TOKENS).otherwise(0)
    return F.greatest(F.lit(1), tokens).cast("bigint")


def distinct_messages(messages: DataFrame) -> DataFrame:
    """First occurrence of every (role, text) of a conversation."""
    return messages.groupBy("conv_id", "role", "text").agg(F.min("turn").alias("turn"))


def collapse_repeats(messages: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Non-empty user messages, without those equal to the user message just before. A
    conversation without any takes the rows of ``fallback(conv_id, turn, text)``."""
    users = messages.filter((F.col("role") == "user") & (F.col("text") != ""))
    kept = last_before(users, ["conv_id"], "turn", F.col("text"), "_before").filter(
        F.col("_before").isNull() | (F.col("_before") != F.col("text"))
    )
    kept = kept.select("conv_id", "turn", "text")
    if fallback is None:
        return kept
    rest = fallback.filter(F.col("text") != "").join(users.select("conv_id").distinct(), "conv_id", "left_anti")
    return kept.unionByName(rest.select("conv_id", "turn", "text"))


def latest_user_message(messages: DataFrame) -> DataFrame:
    users = messages.filter((F.col("role") == "user") & (F.col("text") != ""))
    return users.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def topic_text(history: DataFrame) -> DataFrame:
    """"head - t1, t2, …" per conversation, in parts when it outgrows one row."""
    items = history.filter(F.col("text") != "")
    ordered = running_sums(items, ["conv_id"], "turn", {"_n": F.lit(1)})
    mark = F.when(F.col("_n") == 1, "").when(F.col("_n") == 2, " - ").otherwise(", ")
    return joined_text(ordered.withColumn("_item", F.concat(mark, F.col("text"))), ["conv_id"], "turn", "_item")


def trim_to_budget(messages: DataFrame, budget: int, keep_first: int = 0) -> DataFrame:
    """Keeps the first messages, then the newest ones that fit the token budget; the message at
    the border is cut to as many characters as tokens are left, the rest is dropped."""
    sized = messages.withColumn("_t", message_tokens(F.col("role"), F.col("text")))
    summed = running_sums(sized, ["conv_id"], "turn", {"_cum": F.col("_t"), "_rank": F.lit(1)})
    in_head = F.col("_rank") <= keep_first
    totals = summed.groupBy("conv_id").agg(
        F.max("_cum").alias("_total"), F.coalesce(F.max(F.when(in_head, F.col("_cum"))), F.lit(0)).alias("_head")
    )
    joined = summed.join(totals, "conv_id")
    t, cum = F.col("_t"), F.col("_cum")
    left = F.when(in_head, F.lit(budget) - (cum - t)).otherwise(F.lit(budget) - F.col("_head") - (F.col("_total") - cum))
    usable = in_head | (F.col("_head") <= budget)
    kept = F.when(usable & (left >= t), F.col("text")).when(usable & (left > 0), F.left(F.col("text"), left.cast("int")))
    fate = F.when(usable & (left >= t), "kept").when(usable & (left > 0), "cut").otherwise("dropped")
    return (
        joined.withColumns({"fate": fate, "kept_text": kept})
        .filter(F.col("fate") != "dropped")
        .select("conv_id", "turn", "role", F.col("kept_text").alias("text"), "fate")
    )


def validate_content(messages: DataFrame, limit: int = 100_000) -> DataFrame:
    return messages.withColumn("text", capped(F.coalesce("text", F.lit("")), limit))


def replayable(messages: DataFrame, keep_system: bool = True, fact_prefix: str = "(tool result):\n") -> DataFrame:
    """Turns that can be sent again: no tool-call turns, no empty assistant turns, tool results
    rewritten as assistant statements, system turns on request. A row-wise projection."""
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    drop = (role == "assistant") & (F.col("has_tool_calls") | (text == ""))
    if not keep_system:
        drop = drop | (role == "system")
    is_tool = role == "tool"
    return messages.filter(~drop).select(
        "conv_id", "turn",
        F.when(is_tool, "assistant").otherwise(role).alias("role"),
        F.when(is_tool, F.concat(F.lit(fact_prefix), text)).otherwise(text).alias("text"),
    )

"""Event-stream text to typed events, per row of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_events(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, event_no, type, data): the events of a text, split at blank lines. ``data: [DONE]``
    gives a ``done`` event; an event without a type or without parseable data is left out. Works
    on a stream as it does on a table."""
    events = texts.select(key, F.posexplode(F.split(text, "\n\n")).alias("event_no", "e"))
    # of several lines of a kind the last one counts
    lines = F.transform(F.split(F.trim("e"), "\n"), lambda x: F.rtrim(x))
    last = lambda prefix: F.trim(F.element_at(F.filter(F.col("lines"), lambda x: x.startswith(prefix)), -1).substr(F.lit(len(prefix) + 1), F.lit(2**31 - 1)))
    parsed = events.withColumn("lines", F.concat(F.array(F.lit("event: "), F.lit("data: ")), lines)).select(
        key, "event_no", last("event: ").alias("kind"), last("data: ").alias("data")
    )
    done = F.col("data") == "[DONE]"
    good = done | ((F.col("kind") != "") & F.try_parse_json(F.col("data")).isNotNull())
    return parsed.filter(good).select(
        key, "event_no", F.when(done, "done").otherwise(F.col("kind")).alias("type"), F.when(~done, F.col("data")).alias("data")
    )

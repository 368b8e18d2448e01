"""Message chunks per thread, glued until a finish marker.

Chunks are ``(thread_id, seq, message, finish_reason)``. The stream keeps, per thread, only the
open message; the batch form numbers messages by a two-level scan and glues each on its own, so a
thread that holds a large share of all chunks is spread by message and by block."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import joined_text, running_sums
from . import keyed_table

# Reasons that close a message.
FINISHED = ("stop", "interrupt")
MESSAGE_SCHEMA = "thread_id string, first_seq long, last_seq long, n_chunks long, text string, finish_reason string"
STATE_SCHEMA = "seqs array<long>, messages array<string>"


def valid_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.coalesce("thread_id", F.lit("")) != "") & (F.coalesce("message", F.lit("")) != ""))


def producer_chunks(chunks: DataFrame, agent: str = "reporter") -> DataFrame:
    """Chunks of one producer."""
    return chunks.filter(F.col("agent") == agent)


def _glue(timeout_ms: int | None):
    """The open message of a thread is kept as its chunks, so one that comes late takes its place."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [(int(q), m, None) for q, m in zip(*state.get)] if state.exists else []
        done, chunks = [], []

        def glued(reason: str) -> tuple:
            return key[0], chunks[0][0], chunks[-1][0], len(chunks), "".join(m for _, m in chunks), reason

        if state.hasTimedOut:
            state.remove()
            if held:
                chunks = [(q, m) for q, m, _ in held]
                yield pd.DataFrame([glued("timeout")], columns=MESSAGE_COLUMNS)
            return
        for frame in batches:
            held += [(int(q), m, f) for q, m, f in zip(frame["seq"], frame["message"], frame["finish_reason"])]
        for seq, message, reason in sorted(held, key=lambda c: c[0]):
            chunks.append((seq, message))
            if reason in FINISHED:
                done.append(glued(reason))
                chunks = []
        if chunks:
            state.update(([q for q, _ in chunks], [m for _, m in chunks]))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=MESSAGE_COLUMNS)

    return update


MESSAGE_COLUMNS = [part.split()[0] for part in MESSAGE_SCHEMA.split(", ")]


def assemble_stream(chunks: DataFrame, timeout_minutes: int | None = None) -> DataFrame:
    """Finished messages of a stream of chunks. What a key can bring into one task is a
    micro-batch's share of it (bound it with maxFilesPerTrigger or maxBytesPerTrigger). With a
    timeout, a thread silent for longer gives up its open message, marked as such; that is for
    queries that keep running (a drained query with a clock-based timeout would never end)."""
    timeout = GroupStateTimeout.NoTimeout if timeout_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    timeout_ms = None if timeout_minutes is None else timeout_minutes * 60_000
    return (
        valid_chunks(chunks)
        .select("thread_id", "seq", "message", "finish_reason")
        .groupBy("thread_id")
        .applyInPandasWithState(_glue(timeout_ms), MESSAGE_SCHEMA, STATE_SCHEMA, "append", timeout)
    )


def assemble_batch(chunks: DataFrame) -> DataFrame:
    """The same over a finished table: (thread_id, first_seq, last_seq, n_chunks, finish_reason,
    text). Open messages at the end of a thread are left out."""
    ended = F.coalesce(F.col("finish_reason").isin(*FINISHED), F.lit(False))
    numbered = running_sums(valid_chunks(chunks), ["thread_id"], "seq", {"_done": ended.cast("int")})
    numbered = numbered.withColumn("message_no", F.col("_done") - ended.cast("int"))
    meta = numbered.groupBy("thread_id", "message_no").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_chunks"),
        F.max(F.when(ended, F.col("finish_reason"))).alias("finish_reason"),
    )
    texts = joined_text(numbered, ["thread_id", "message_no"], "seq", "message")
    return meta.filter(F.col("finish_reason").isNotNull()).join(texts, ["thread_id", "message_no"]).drop("message_no")


def report_text(chunks: DataFrame, agent: str = "reporter") -> DataFrame:
    """Text of one producer per thread; threads where it wrote nothing give all their chunks."""
    valid = valid_chunks(chunks)
    own = producer_chunks(valid, agent)
    rest = valid.join(own.select("thread_id").distinct(), "thread_id", "left_anti")
    return joined_text(own.unionByName(rest), ["thread_id"], "seq", "message")


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Tool calls from fragments ``(thread_id, seq, index, id, name, args)``: the first name and
    id seen for an index, arguments in order. Fragments without an index stand on their own, as
    index 0."""
    indexed = fragments.filter(F.col("index").isNotNull())
    seen = lambda c: F.when(F.col(c) != "", F.col("seq"))
    head = indexed.groupBy("thread_id", "index").agg(
        F.coalesce(F.min_by("name", seen("name")), F.lit("")).alias("name"), F.coalesce(F.min_by("id", seen("id")), F.lit("")).alias("id")
    )
    args = joined_text(
        indexed.withColumn("args", F.coalesce("args", F.lit(""))), ["thread_id", "index"], "seq", "args"
    ).withColumnRenamed("text", "args")
    loose = fragments.filter(F.col("index").isNull()).select(
        "thread_id", F.lit(0).cast(dict(fragments.dtypes)["index"]).alias("index"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("id", F.lit("")).alias("id"), F.coalesce("args", F.lit("")).alias("args"),
    )
    return head.join(args, ["thread_id", "index"]).unionByName(loose)


def merge_fragments_stream(fragments: DataFrame, at: str, late: str = "10 minutes", quiet: str = "10 minutes") -> DataFrame:
    """Streaming form (append mode): a call is finished when no fragment of it has come for ``quiet`` of
    event time ``at``, and is given once, when the watermark (``late`` behind the newest event) has passed
    that end. The state holds open calls only; fragments further apart than ``quiet`` are calls of their own,
    and so is every fragment without an index."""
    seen = lambda c: F.when(F.col(c) != "", F.col("seq"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("seq"), F.coalesce("args", F.lit("")).alias("a"))))
    own = F.when(F.col("index").isNull(), F.col("seq")).alias("_own")
    return (
        fragments.withWatermark(at, late)
        .groupBy("thread_id", "index", own, F.session_window(at, quiet).alias("_open"))
        .agg(
            F.coalesce(F.min_by("name", seen("name")), F.lit("")).alias("name"),
            F.coalesce(F.min_by("id", seen("id")), F.lit("")).alias("id"),
            F.array_join(F.transform(ordered, lambda x: x["a"]), "").alias("args"),
        )
        .select("thread_id", F.coalesce("index", F.lit(0)).alias("index"), "name", "id", "args")
    )


def write_finished(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished rows appended to Parquet, exactly once, until the source is drained."""
    return (
        messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def upsert_conversations(messages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Latest message per thread as a table in hash buckets; a micro-batch rewrites the buckets it touches."""
    return keyed_table.upsert_stream(messages, folder, checkpoint, "thread_id", "last_seq")


def latest_version(spark, folder: str) -> DataFrame:
    """The last committed version, whether or not a query is running."""
    return keyed_table.read(spark, folder)

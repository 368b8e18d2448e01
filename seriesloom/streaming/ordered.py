"""Messages from chunks that arrive in any order.

Chunks ``(thread_id, place, seq, message, finish_reason)`` are numbered within their thread by ``place``, one
after the other from ``first``. A thread's state is the place it waits for, the chunks of its open message,
and the chunks that came before their turn. A finish marker closes a message only when everything before it
has come, so a message is the same whatever the order of arrival; a chunk that comes twice counts once. Every call
to the state is a message to the JVM, so a visit makes few: the open message is a list that is appended to, early
chunks are kept by blocks of ``BLOCK`` places, and a block that a chunk enters or leaves is read and written once.

With ``give_up_minutes`` a gap that stays open so long is left behind: the open message ends there, marked
``gap``, and the thread goes on with the next chunk it holds. ``keep_minutes`` drops the state of threads that
were silent for longer. Chunks without a thread or place are left out; chunks without a message hold a place."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .threads import FINISHED, MESSAGE_COLUMNS, MESSAGE_SCHEMA

BLOCK = 64
EARLY_SCHEMA = "places array<long>, seqs array<long>, messages array<string>, reasons array<string>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = Row(*MESSAGE_COLUMNS)


class Assemble(StatefulProcessor):
    def __init__(self, first: int, give_up_minutes: float | None, keep_minutes: float | None):
        self.first = first
        self.give_up = None if give_up_minutes is None else int(give_up_minutes * 60_000)
        self.keep = None if keep_minutes is None else int(keep_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spot = handle.getValueState("spot", "next long, early long", self.keep)
        self.opened = handle.getListState("open", "seq long, message string", self.keep)
        self.early = handle.getMapState("early", "block long", EARLY_SCHEMA, self.keep)

    def _run(self, key: tuple, chunks: list[tuple], timer_at: int | None = None, skip: bool = False) -> list[tuple]:
        spot = self.spot.get()
        turn, early = (int(spot[0]), int(spot[1])) if spot else (self.first, 0)
        stored = early > 0  # whether the state may hold blocks
        fresh: list[tuple] = []  # of the open message, not in the state yet
        held = None if spot else []  # its chunks in the state, read when needed
        blocks: dict[int, dict[int, tuple]] = {}  # early chunks by place, read when needed
        there: dict[int, bool] = {}  # whether the state holds a block
        touched: set[int] = set()  # blocks to write
        done: list[tuple] = []

        def closed(reason: str) -> None:
            nonlocal held, fresh
            if held is None:
                held = [(int(s), m) for s, m in self.opened.get()]
            whole = held + fresh
            if whole:
                done.append((key[0], whole[0][0], whole[-1][0], len(whole), "".join(m for _, m in whole), reason))
            if held:
                self.opened.clear()
            held, fresh = [], []

        def take(seq, message, reason) -> None:
            if message:
                fresh.append((int(seq), message))
            if reason in FINISHED and message:
                closed(reason)

        def block(place: int) -> dict[int, tuple]:
            k = place // BLOCK
            if k not in blocks:
                there[k] = stored and self.early.containsKey((k,))
                blocks[k] = {int(p): c for p, *c in zip(*self.early.getValue((k,)))} if there[k] else {}
            return blocks[k]

        waiting = dict(sorted((int(p), (s, m, r)) for p, s, m, r in chunks if int(p) >= turn))
        if skip and early:  # the gap is given up
            closed("gap")
            turn = min(block(min(int(k[0]) for k in self.early.keys()) * BLOCK))
        while True:
            before = block(turn).pop(turn, None) if early else None
            if before is not None:
                touched.add(turn // BLOCK)
                early -= 1
            chunk = waiting.pop(turn, before)  # it may have come before, too
            if chunk is None:
                break
            take(*chunk)
            turn += 1
        for place, chunk in waiting.items():
            in_block = block(place)
            early += place not in in_block
            in_block[place] = (int(chunk[0]), chunk[1], chunk[2])
            touched.add(place // BLOCK)
        for k in touched:
            if blocks[k]:
                places = sorted(blocks[k])
                self.early.updateValue((k,), (places, *(list(x) for x in zip(*(blocks[k][p] for p in places)))))
            elif there[k]:
                self.early.removeKey((k,))
        if fresh:
            self.opened.appendList(fresh)
        if spot is None or (turn, early) != (int(spot[0]), int(spot[1])) or self.keep is not None:
            self.spot.update((turn, early))
        if self.give_up is not None and early and timer_at is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timer_at + self.give_up)
        return done

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        chunks = [(r["place"], r["seq"], r["message"], r["finish_reason"]) for r in rows]
        now = timerValues.getCurrentProcessingTimeInMs() if self.give_up is not None else None
        yield from (MESSAGE(*m) for m in self._run(key, chunks, now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from (MESSAGE(*m) for m in self._run(key, [], timerValues.getCurrentProcessingTimeInMs(), skip=True))

    def close(self) -> None:
        pass


def assemble_in_order(chunks: DataFrame, first: int = 1, give_up_minutes: float | None = None, keep_minutes: float | None = None) -> DataFrame:
    """Finished messages of a stream of numbered chunks. The session's state store must be RocksDB (``PROVIDER``)."""
    mode = "None" if give_up_minutes is None and keep_minutes is None else "ProcessingTime"
    kept = chunks.filter((F.coalesce("thread_id", F.lit("")) != "") & F.col("place").isNotNull())
    kept = kept.select("thread_id", "place", F.coalesce("seq", "place").alias("seq"), "message", "finish_reason")
    return kept.groupBy("thread_id").transformWithState(
        statefulProcessor=Assemble(first, give_up_minutes, keep_minutes), outputStructType=MESSAGE_SCHEMA, outputMode="Append", timeMode=mode
    )


def place_chunks(chunks: DataFrame) -> DataFrame:
    """``place`` for chunks numbered by a ``seq`` with gaps: their position in the thread, from 1."""
    from ..operators.scan import running_sums

    return running_sums(chunks, ["thread_id"], "seq", {"place": F.lit(1).cast("long")})

"""Scoring, pruning and monitoring of rollouts as they land. STM-1..5."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from ..functions import as_col
from ..operators.pruning import mark_kept
from ..operators.scoring import group_advantage, score
from ..sources.writers import commit, read_committed


def score_stream(stream: DataFrame, style: str = "boxed") -> DataFrame:
    """STM-1. Score completions as they arrive; no state."""
    return score(stream, style)


_KEYS = ("run_id", "group_id", "sample_idx")


def _once(rows: DataFrame, delay: str, event_time: str) -> DataFrame:
    """Deliveries of a completion that repeat are dropped; rows without a position aren't compared by it."""
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind]
    marked = rows.withColumn("_row", F.when(F.col("sample_idx").isNull(), F.xxhash64(*hashed)))
    keys = [*_KEYS, "_row"]
    if not rows.isStreaming:
        return marked.dropDuplicates(keys).drop("_row")
    return marked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys).drop("_row")


#: What a group is: its rows are held, it gave out its best, or more came than it has places for.
_OPEN, _WHOLE, _SURPLUS = "open", "whole", "surplus"
#: A bucket of groups: for each its key, status, deadline and number of rows; the rows of all of them in that order.
_STATE = ("keys array<string>, status array<string>, deadline array<long>, held array<long>, "
          "payload array<string>, reward array<double>, place array<long>")
_MARKED = "_payload string, advantage double, whole boolean, kept boolean"
#: JSON that gives instants back to the microsecond.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _group_types() -> tuple[type, type]:
    """The classes below; made in here, they go to the executors by value."""

    class Given:
        """Rows that leave, as lists of the columns of ``_MARKED``."""

        def __init__(self):
            self.payload, self.advantage, self.whole, self.kept = [], [], [], []

        def add(self, payload: Sequence[str], whole: bool, advantage=None, kept=None) -> None:
            size = len(payload)
            self.payload += payload
            self.advantage += [np.nan] * size if advantage is None else advantage
            self.whole += [whole] * size
            self.kept += [True] * size if kept is None else kept

        def frames(self) -> Iterator[pd.DataFrame]:
            if self.payload:
                yield pd.DataFrame({"_payload": self.payload, "advantage": np.array(self.advantage, float),
                                    "whole": self.whole, "kept": self.kept})

    class Group:
        """What is held of a group, and what it does with rows and at the end of its time."""

        def __init__(self, status: str = _OPEN, payload=(), reward=(), place=(), deadline: int = 0):
            self.status, self.payload, self.reward, self.place = status, list(payload), list(reward), list(place)
            self.deadline = deadline

        def take(self, payload: list, reward: list, place: list, group_size: int, given: Given) -> None:
            if self.status != _OPEN:
                given.add(payload, False)
                return
            self.payload += payload
            self.reward += [None if pd.isna(r) else float(r) for r in reward]
            self.place += [None if pd.isna(p) else int(p) for p in place]
            if len(self.payload) > group_size:
                given.add(self.payload, False)
                self.status, self.payload, self.reward, self.place = _SURPLUS, [], [], []

        def leave(self, group_size: int, k: int, eps: float, given: Given) -> None:
            """The rows of a group that is complete or out of time."""
            payload, reward, place = self.payload, self.reward, self.place
            self.status, self.payload, self.reward, self.place = _WHOLE, [], [], []
            if not payload:
                return
            values = np.array([np.nan if r is None else r for r in reward], float)
            deviation = values.std(ddof=1) if len(values) > 1 else 0.0
            advantage = ((values - values.mean()) / (deviation + eps)).tolist()
            if len(payload) != group_size:
                given.add(payload, False, advantage)
                return
            # By magnitude in single precision, ties by position; rows without one first, as in a sort.
            order = sorted(range(group_size), key=lambda i: (
                -np.float32(abs(advantage[i])), place[i] is not None, place[i] or 0, i))
            best = set(order[:k])
            given.add(payload, True, advantage, [i in best for i in range(group_size)])

    return Given, Group


def _group_machine(group_size: int, k: int, eps: float, early: bool) -> Callable:
    """What one group does with the rows of a micro-batch and at the end of its time."""
    Given, Group = _group_types()  # noqa: N806

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group = Group(*state.get) if state.exists else Group()
        if state.hasTimedOut:
            state.remove()
            given = Given()
            group.leave(group_size, k, eps, given)
            yield from given.frames()
            return
        deadline = state.getCurrentWatermarkMs() + 1
        for rows in batches:
            deadline, given = max(deadline, int(rows["_deadline"].max())), Given()
            group.take(*(rows[c].tolist() for c in ("_payload", "_reward", "_place")), group_size, given)
            yield from given.frames()
        given = Given()
        if early and len(group.payload) == group_size:
            group.leave(group_size, k, eps, given)
        yield from given.frames()
        state.update((group.status, group.payload, group.reward, group.place))
        state.setTimeoutTimestamp(deadline)

    return run


def _bucket_machine(group_size: int, k: int, eps: float, early: bool) -> Callable:
    """The same for a bucket of groups, told apart by ``_key``, in one call.

    As with a state for each group, the time of a group that got rows in this micro-batch starts anew, and of
    the others those leave whose time the watermark has passed.
    """
    Given, Group = _group_types()  # noqa: N806

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        groups, watermark, touched = {}, state.getCurrentWatermarkMs(), set()
        if state.exists:
            keys, status, deadlines, held, *rows = state.get
            at = 0
            for name, now, deadline, size in zip(keys, status, deadlines, held):
                groups[name] = Group(now, *(column[at:at + size] for column in rows), deadline)
                at += size
        for rows in () if state.hasTimedOut else batches:
            given, numbers = Given(), {}
            for n, name in enumerate(rows["_key"].tolist()):
                numbers.setdefault(name, []).append(n)
            columns = [rows[c].tolist() for c in ("_payload", "_reward", "_place", "_deadline")]
            for name, own in numbers.items():
                group = groups.setdefault(name, Group())
                if name not in touched:
                    touched.add(name)
                    group.deadline = watermark + 1
                payload, reward, place, deadline = ([column[n] for n in own] for column in columns)
                group.deadline = max(group.deadline, int(max(deadline)))
                group.take(payload, reward, place, group_size, given)
            yield from given.frames()
        given = Given()
        for name, group in list(groups.items()):
            if name in touched:
                if early and len(group.payload) == group_size:
                    group.leave(group_size, k, eps, given)
            elif group.deadline < watermark:
                group.leave(group_size, k, eps, given)
                del groups[name]
        yield from given.frames()
        if groups:
            every = groups.values()
            state.update((
                list(groups), [g.status for g in every], [g.deadline for g in every], [len(g.payload) for g in every],
                *([value for g in every for value in getattr(g, c)] for c in ("payload", "reward", "place"))))
            state.setTimeoutTimestamp(min(g.deadline for g in every))
        elif state.exists:
            state.remove()

    return run


def mark_stream(
    stream: DataFrame,
    group_size: int,
    k: int,
    delay: str = "10 minutes",
    eps: float = 1e-4,
    event_time: str = "ts",
    on_ragged: str = "keep",
    emit: str = "closed",
    buckets: int = 1024,
) -> DataFrame:
    """STM-2. Every row, all columns, with ``advantage``, ``whole`` and ``kept`` (replaced if there).

    State is kept per ``(run_id, group_id)``, of ``group_size`` rows at most, and stored by ``buckets`` of groups: a
    micro-batch costs a call of Python per bucket that it touches, and rewrites what these hold.
    Set it for the open groups you expect, a few hundred to a bucket; a checkpoint is bound to its number. With ``emit="complete"`` a group leaves
    in the micro-batch that brings its last completion; what comes for it later is
    surplus, and ragged. With ``"closed"`` it waits until none of its rows has come for ``delay``
    of event time, so that surplus rows make all of it ragged. Either way a group that has
    more rows than places gives out what it holds and passes the rest on, and one that is
    still too small when its time is over is ragged. Ragged rows are kept unpruned (``"keep"``)
    or discarded (``"drop"``); surplus ones have no advantage, as nobody saw their whole group.
    Null keys are keys. Rows without event time belong to no group: see
    :func:`without_event_time`. Groups still open at the end of the data are given out by
    :func:`with_open_groups`. Over a batch frame all groups are closed, and native windows do the work.
    """
    if on_ragged not in ("keep", "drop"):
        raise ValueError(f"on_ragged must be keep or drop, got {on_ragged!r}")
    if emit not in ("complete", "closed"):
        raise ValueError(f"emit must be complete or closed, got {emit!r}")
    stream = stream.drop("advantage", "whole", "kept")
    rows = _once(stream.where(F.col(event_time).isNotNull()), delay, event_time)
    if not stream.isStreaming:
        marked = mark_kept(group_advantage(rows, eps=eps), group_size, k, on_ragged="keep").withColumn(
            "whole", F.col("group_rows") == group_size)
        marked = marked.withColumn("advantage", F.when(F.col("group_rows") <= group_size, F.col("advantage")))
        marked = marked.select(*[F.col(f"`{c}`") for c in stream.columns], "advantage", "whole", "kept")
        return marked.where("whole") if on_ragged == "drop" else marked
    packed = rows.select(
        F.pmod(F.xxhash64("run_id", "group_id"), F.lit(buckets)).alias("_bucket"),
        F.to_json(F.struct("run_id", "group_id"), _EXACT).alias("_key"),
        F.col("reward").cast("double").alias("_reward"), F.col("sample_idx").cast("long").alias("_place"),
        F.unix_millis(F.col(event_time) + F.expr(f"interval {delay}")).alias("_deadline"), F.col(event_time).alias("_time"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), _EXACT).alias("_payload"))
    marked = packed.groupBy("_bucket").applyInPandasWithState(
        _bucket_machine(group_size, k, eps, emit == "complete"), _MARKED, _STATE, "append", "EventTimeTimeout")
    if on_ragged == "drop":
        marked = marked.where("whole")
    row = F.from_json("_payload", stream.schema, _EXACT)
    return marked.select(row.alias("_row"), "advantage", "whole", "kept").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in stream.columns], "advantage", "whole", "kept")


def prune_stream(stream: DataFrame, group_size: int, k: int, **options) -> DataFrame:
    """STM-2. The kept rows of :func:`mark_stream`, all columns."""
    return mark_stream(stream, group_size, k, **options).where("kept").drop("kept")


def without_event_time(stream: DataFrame, event_time: str = "ts") -> DataFrame:
    """Rows that no window can hold, for a sink of their own where they can be counted."""
    return stream.where(F.col(event_time).isNull())


@dataclass
class Drained:
    """What a stream wrote, the watermark at which it ended, and how many rows it dropped as late."""

    rows: DataFrame
    watermark: dt.datetime | None
    dropped: int

    def still_open(self, end: Column, timer: bool = False) -> Column:
        """Whether what ends then can't have been given out yet; without a watermark nothing was.

        A window is given out when the watermark reaches its end, a timer runs when it is past.
        """
        if self.watermark is None:
            return F.lit(True)
        mark = F.timestamp_millis(F.lit(int(self.watermark.timestamp() * 1000)))
        return end >= mark if timer else end > mark


def _ended(query: StreamingQuery) -> tuple[dt.datetime | None, int]:
    """The final watermark of a query that has stopped, and the rows its states dropped as late."""
    marks, dropped = [], 0
    for progress in query.recentProgress:
        mark = progress.eventTime.get("watermark")
        if mark:
            marks.append(dt.datetime.fromisoformat(mark.replace("Z", "+00:00")))
        dropped += sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
    return max(marks, default=None), dropped


def closed(drained: Drained, batch: DataFrame, end: str) -> DataFrame:
    """What a stream gave out, and what was still open when its data ended.

    ``batch`` is the same operator over the same data as a batch. Of it only what ends after
    the stream's final watermark is added; what the stream should have given out before stays
    missing if it did not.
    """
    # Spark moves a filter on a session's end below the merging of its events; one that isn't deterministic stays.
    late = F.when(F.monotonically_increasing_id() >= 0, drained.still_open(F.col(end)))
    return drained.rows.unionByName(batch.where(late))


def with_open_groups(
    drained: Drained, rows: DataFrame, group_size: int, k: int, delay: str = "10 minutes",
    event_time: str = "ts", emit: str = "closed", **options,
) -> DataFrame:
    """STM-2. What :func:`mark_stream` gave out, and the groups that were open when its data ended.

    ``rows`` is the stream's data as a batch. A group is open if its last row is so late that
    its time lasts beyond the final watermark; with ``emit="complete"`` a whole one is not, as it left
    when it was complete. Rows that already left as ragged are not repeated.
    """
    last = rows.where(F.col(event_time).isNotNull()).groupBy(
        F.col("run_id").alias("_run"), F.col("group_id").alias("_group")).agg(F.max(event_time).alias("_last"))
    late = last.where(drained.still_open(F.col("_last") + F.expr(f"interval {delay}"), timer=True))
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("group_id").eqNullSafe(F.col("_group"))
    open_ = mark_stream(rows.join(late, same, "left_semi"), group_size, k, delay, event_time=event_time, **options)
    if emit == "complete":
        open_ = open_.where("not whole")
    given = drained.rows.select(*[F.col(key).alias(f"_{key}") for key in _KEYS]).distinct()
    known = F.lit(True)
    for key in _KEYS:
        known &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    return drained.rows.unionByName(open_.join(given, known, "left_anti"))


def metrics_stream(
    stream: DataFrame,
    window: str = "1 day",
    slide: str | None = None,
    delay: str = "1 hour",
    cap: int | Column = 1024,
    event_time: str = "ts",
) -> DataFrame:
    """STM-3. Reward, retention and clipped ratio per run and event-time window.

    ``stream`` has ``reward``, ``kept`` and ``n_tokens``; rows later than the watermark
    are dropped. Partial sums are formed before the exchange.
    """
    span = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(span.alias("window"), "run_id")
        .agg(
            F.count(F.lit(1)).alias("completions"),
            F.avg("reward").alias("reward"),
            F.avg(F.col("kept").cast("double")).alias("retention"),
            F.avg((F.col("n_tokens") >= as_col(cap)).cast("double")).alias("clipped_ratio"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "run_id", "completions", "reward", "retention", "clipped_ratio",
        )
    )


def timings_stream(
    stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", event_time: str = "ts"
) -> DataFrame:
    """STM-4. Stage seconds per run and session of activity.

    Build the session with ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    set to true, so that a busy run shuffles sessions and not events.
    """
    kind = F.col("kind")
    seconds = lambda name: F.sum(F.when(kind == name, F.col("seconds")).otherwise(0.0))
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.session_window(event_time, gap).alias("session"), "run_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            seconds("train_step").alias("train_step_seconds"),
            seconds("rollout").alias("rollout_seconds"),
        )
        .select(
            F.col("session.start").alias("session_start"),
            F.col("session.end").alias("session_end"),
            "run_id", "events", "train_step_seconds", "rollout_seconds",
            F.greatest(
                F.lit(0.0), F.col("train_step_seconds") - F.col("rollout_seconds")
            ).alias("update_seconds"),
        )
    )


def land_rounds(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """STM-5. Land pruned rounds exactly once, for readers of :func:`read_rounds`.

    Each micro-batch writes a folder of its own and is committed by a manifest that names the
    folder, written last. A batch that is run again after a failure writes another folder; what an
    attempt left without a manifest is never read. A batch with a manifest isn't landed again.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        commit(batch, path, str(batch_id), ["run_id"])

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_rounds(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """STM-5. The rows of all committed batches; none before the first commit."""
    return read_committed(spark, path, schema)


def land_available(stream: DataFrame, path: str, checkpoint: str) -> Drained:
    """Land everything that is available, and read what was committed."""
    query = land_rounds(stream, path, checkpoint)
    query.awaitTermination()
    return Drained(read_rounds(stream.sparkSession, path, stream.schema), *_ended(query))


def drain(stream: DataFrame, path: str, checkpoint: str) -> Drained:
    """Run a stream over everything that is available; what it wrote and where it ended."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return Drained(stream.sparkSession.read.schema(stream.schema).parquet(path), *_ended(query))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over everything that is available, and read what it wrote."""
    return drain(stream, path, checkpoint).rows

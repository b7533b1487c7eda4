"""Spaced-repetition state and the sliding-window limiter, as folds over ordered events.

A key's events are sorted in one partition and read in Arrow batches; the fold carries its state from batch to batch, so a key
of any number of events takes the memory of one batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import PROMOTE_AFTER, box_weight


def _in_order(events: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    at = F.unix_micros(F.col("attempted_at").cast("timestamp")).alias("__at")
    return events.select(*keys, at, "event_id", *more).repartition(*keys).sortWithinPartitions(*keys, "__at", "event_id")


def leitner_state(events: DataFrame, keys: tuple[str, ...] = ("study_code_id", "question_id")) -> DataFrame:
    """Box, streak and last review of each student and question after all their answers, in order of time and event id."""
    width = len(keys)
    kinds = [events.schema[k].dataType.simpleString() for k in keys]
    out = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), "box int, consecutive_correct int, __at bigint"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, box, streak, last = None, 1, 0, None
        for batch in batches:
            rows: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for *name, at, _, correct in zip(*columns, strict=True):
                if name != key:
                    if key is not None:
                        rows.append((*key, box, streak, last))
                    key, box, streak = name, 1, 0
                if not correct:
                    box, streak = 1, 0
                elif streak + 1 >= PROMOTE_AFTER.get(box, 1 << 30):
                    box, streak = box + 1, 0
                else:
                    streak += 1
                last = at
            yield made(rows, batch)
        if key is not None:
            yield made([(*key, box, streak, last)], batch)

    def made(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        types = [*(like.schema.field(i).type for i in range(width)), pa.int32(), pa.int32(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else ([] for _ in types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[*keys, "box", "consecutive_correct", "__at"])

    state = _in_order(events, keys, "is_correct").mapInArrow(fold, out)
    return state.select(*keys, "box", "consecutive_correct", F.timestamp_micros("__at").cast(events.schema["attempted_at"].dataType).alias("last_reviewed"))


def question_weights(questions: DataFrame, state: DataFrame, student) -> DataFrame:
    """Every question with one student's box (null: unseen) and its draw weight."""
    mine = state.where(F.col("study_code_id") == F.lit(student)).select(F.col("question_id").alias("id"), "box")
    return questions.join(mine, "id", "left").withColumn("weight", box_weight(F.col("box")))


def rate_limit(events: DataFrame, key: str, window_seconds: int, most: int) -> DataFrame:
    """Each event with `allowed`, how many more are, and, in microseconds, when the window opens again.

    An event is allowed while fewer than `most` allowed ones lie less than the window before it; refused ones use up nothing.
    After an allowed event reset_at is a window later than it; after a refused one, a window later than the oldest that is held.
    """
    span = window_seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, deque()
        for batch in batches:
            allowed, remaining, reset = [], [], []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != name:
                    name, held = k, deque()
                while held and at - held[0] >= span:
                    held.popleft()
                allowed.append(len(held) < most)
                if allowed[-1]:
                    held.append(at)
                remaining.append(most - len(held))
                reset.append((at if allowed[-1] else held[0] if held else at) + span)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int32()), pa.array(reset, pa.int64())], names=[key, "event_id", "allowed", "remaining", "reset_at"])

    return _in_order(events, (key,)).mapInArrow(fold, f"`{key}` {events.schema[key].dataType.simpleString()}, event_id bigint, allowed boolean, remaining int, reset_at bigint")

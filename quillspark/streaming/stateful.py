"""Structured Streaming twins of the ordered folds.

Each keeps its state by key and handles the rows of a micro-batch in order of (attempted_at, event_id). An event that arrives in a
later batch than a newer one is applied when it comes, as the processing order decides; feed events in order where that matters.
The watermark and the idle timeout that evicts keys are additions of this library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scoring import PROMOTE_AFTER


def advance(box: int, streak: int, correct: bool) -> tuple[int, int]:
    """F30 for one answer."""
    if not correct:
        return 1, 0
    need = PROMOTE_AFTER.get(box)
    if need is not None and streak + 1 >= need:
        return box + 1, 0
    return box, streak + 1


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["attempted_at", "event_id"], kind="stable")


def leitner_updates(events: DataFrame) -> DataFrame:
    """After each micro-batch the new state of every student and question that it touched (update mode)."""

    def step(key, frames, state: GroupState):
        box, streak = state.get if state.exists else (1, 0)
        rows = _ordered(frames)
        for correct in rows["is_correct"]:
            box, streak = advance(box, streak, bool(correct))
        state.update((box, streak))
        yield pd.DataFrame({"study_code_id": [key[0]], "question_id": [key[1]], "box": [box], "consecutive_correct": [streak], "last_reviewed": [rows["attempted_at"].iloc[-1]]})

    out = "study_code_id bigint, question_id bigint, box int, consecutive_correct int, last_reviewed timestamp"
    return events.groupBy("study_code_id", "question_id").applyInPandasWithState(step, out, "box int, streak int", "update", GroupStateTimeout.NoTimeout)


def rate_limited(events: DataFrame, key: str, window_seconds: int, most: int, idle_ms: int | None = 300_000) -> DataFrame:
    """Each event with `allowed`, `remaining` and `reset_at`; the allowed times of a key are its state, evicted after `idle_ms` without events (None: never)."""
    span = window_seconds * 1_000_000
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(name, frames, state: GroupState):
        if idle_ms is not None and state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows, allowed, remaining, reset = _ordered(frames), [], [], []
        for at in rows["attempted_at"].astype("datetime64[us]").astype("int64"):
            held = [t for t in held if at - t < span]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(int(at))
            remaining.append(most - len(held))
            reset.append(int(at if allowed[-1] else held[0]) + span)
        state.update((held,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [name[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "allowed": allowed, "remaining": remaining, "reset_at": reset})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, allowed boolean, remaining int, reset_at bigint", "held array<bigint>", "append", timeout)


def live_streaks(events: DataFrame) -> DataFrame:
    """Each student's running streak and the milestones it reaches, an event at a time."""

    def step(key, frames, state: GroupState):
        streak = state.get[0] if state.exists else 0
        rows, values = _ordered(frames), []
        for correct in rows["is_correct"]:
            streak = streak + 1 if correct else 0
            values.append(streak)
        state.update((streak,))
        yield pd.DataFrame({"study_code_id": [key[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "streak": values, "milestone": [v in (3, 5, 10) for v in values]})

    return events.groupBy("study_code_id").applyInPandasWithState(step, "study_code_id bigint, event_id bigint, streak bigint, milestone boolean", "streak bigint", "append", GroupStateTimeout.NoTimeout)


def last_active_stream(quizzes: DataFrame, delay: str = "7 days") -> DataFrame:
    """The last quiz of each student, kept up to date; rows later than the watermark are dropped."""
    return quizzes.withWatermark("quiz_date", delay).groupBy("study_code_id").agg(F.max("quiz_date").alias("last_active_at"))

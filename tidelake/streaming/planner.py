"""When a group of staged records is flushed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bytes that flush at once; seconds after which anything flushes; seconds after which at least `FLOOR` bytes flush.
SIZE, SLOW, AGE, FLOOR = 256 << 20, 6 * 3600, 900, 1 << 20


def lane(staged_bytes: Column, age_seconds: Column, size: int = SIZE, slow: int = SLOW, age: int = AGE, floor: int = FLOOR) -> Column:
    """size, slow, age or none; slow outranks age, and an age below zero (a clock set back) trips nothing."""
    return (
        F.when(staged_bytes >= size, "size")
        .when((staged_bytes > 0) & (age_seconds >= slow), "slow")
        .when((staged_bytes >= floor) & (age_seconds >= age), "age")
        .otherwise("none")
    )


def decide(staged_bytes: int, age_seconds: float, size: int = SIZE, slow: float = SLOW, age: float = AGE, floor: int = FLOOR) -> str:
    """The rule of `lane` for one group."""
    if staged_bytes >= size:
        return "size"
    if staged_bytes > 0 and age_seconds >= slow:
        return "slow"
    return "age" if staged_bytes >= floor and age_seconds >= age else "none"


def flushes(staged: DataFrame, group: list[str], size: str, staged_at: str, size_at: int = SIZE, slow: float = SLOW, age: float = AGE, floor: int = FLOOR) -> DataFrame:
    """A stream of flushes: a group's row comes when it is due, by its bytes in a batch or by a timer after its last record.

    State is three numbers a group, so what a group stages may be of any
    size.  A due group starts anew with its next record.  Null sizes count
    nothing, null times stage at once (the batch's time); null keys are a group.
    Timers keep a query running: one with the availableNow trigger does not end.
    """
    keys = T.StructType([staged.schema[g] for g in group])
    out = T.StructType([*keys.fields, *T._parse_datatype_string("records long, staged_bytes long, first_ms long, lane string").fields])

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        records, held, first = state.get if state.exists else (0, 0, now)
        if not state.hasTimedOut:
            for b in batches:
                records += len(b)
                held += int(b["__size"].sum())
                first = min(first, int(b["__ms"].min()) if b["__ms"].notna().any() else now)
        lane = decide(held, (now - first) / 1000, size_at, slow, age, floor)
        if lane != "none":
            state.remove()
            yield pd.DataFrame([[*key, records, held, first, lane]], columns=out.names)
            return
        state.update((records, held, first))
        due = first + 1000 * (min(age, slow) if held >= floor else slow)
        state.setTimeoutDuration(max(1, int(due - now) + 1))

    rows = staged.select(*group, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"), F.unix_millis(F.col(staged_at).cast("timestamp")).alias("__ms"))
    due = rows.groupBy(*group).applyInPandasWithState(step, out, "records long, staged_bytes long, first_ms long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return due.withColumn("first_staged", F.timestamp_millis("first_ms")).drop("first_ms")

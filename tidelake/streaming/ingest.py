"""Streams into tables: an exactly-once sink, record classification and flush groups."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from ..errors import CommitConflict, DdlSinceReadSnapshot
from ..functions.coerce import coerce_json
from ..operators.table import Table
from . import planner

#: Tries of a commit that lost to another one, and of one whose table's definition changed.
CONFLICT_TRIES, DDL_TRIES = 5, 3


def with_retries(run: Callable[[], dict], wait: float = 0.05) -> dict:
    """Retry by kind of failure: conflicts a few times, definition changes fewer, anything else not at all."""
    conflicts = ddl = 0
    while True:
        try:
            return run()
        except DdlSinceReadSnapshot:
            ddl += 1
            if ddl >= DDL_TRIES:
                raise
        except CommitConflict:
            conflicts += 1
            if conflicts >= CONFLICT_TRIES:
                raise
        time.sleep(wait * 2 ** (conflicts + ddl))


def sink(table: Table, query: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: each micro-batch is one append whose key is the query and batch, so a replay adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        key = f"{query}/{number}"
        rows = prepare(batch) if prepare else batch
        with_retries(lambda: table.append(rows, key=key))

    return write


def classify(records: DataFrame, value: Column, fields: list[ty.Field]) -> DataFrame:
    """Records with their coerced columns and a drop_reason; a bad record never fails a batch."""
    return records.withColumn("__record", coerce_json(value, fields)).select(*records.columns, "__record.*")


def keyed(records: DataFrame, partition: list[Column], source: tuple[str, str, str] = ("topic", "partition", "offset")) -> DataFrame:
    """Records with a staging key, their table partition and place in the log; a record that came twice is there once."""
    group = F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in partition)) if partition else F.lit("")
    return records.dropDuplicates(list(source)).withColumn("staging_key", F.struct(group.alias("group"), *source))


def drop_counts(classified: DataFrame) -> DataFrame:
    return classified.where("drop_reason is not null").groupBy("drop_reason").count()


def flush_groups(staged: DataFrame, group: list[str], size: str, staged_at: str, now: Column) -> DataFrame:
    """Per group: bytes, age of its first record, and the lane by which it is flushed."""
    found = staged.groupBy(*group).agg(F.count("*").alias("records"), F.sum(size).alias("staged_bytes"), F.min(staged_at).alias("first_staged"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("first_staged"))
    return found.withColumn("lane", planner.lane(F.col("staged_bytes"), age))


def derive_event_columns(events: DataFrame, ts: str = "ts", props: str = "props") -> DataFrame:
    """Event columns that follow from others: the UTC date and month, and the properties as a variant."""
    from ..functions.variant import to_variant

    return events.withColumn("event_date", F.to_date(ts)).withColumn("event_month", F.date_format(ts, "yyyy-MM")).withColumn("properties", to_variant(F.col(props)))


def uuid_text(blob: Column) -> Column:
    """Sixteen bytes as a UUID's text; null for any other number of bytes."""
    h = F.lower(F.hex(blob))
    dashed = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    return F.when(F.octet_length(blob) == 16, dashed)


def by_month(tables: Callable[[str], Table], query: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: each month's rows go to the table that `tables` names for it, once whatever is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        months = batch.select(F.date_format(ts, "yyyy-MM").alias("m")).distinct().orderBy("m")
        for m in [r.m for r in months.collect()]:  # a few months a batch
            own = F.lit(m).eqNullSafe(F.date_format(ts, "yyyy-MM"))
            with_retries(lambda m=m, own=own: tables(m).append(batch.where(own), key=f"{query}/{number}/{m}"))

    return write

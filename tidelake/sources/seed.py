"""Growing a table for benchmarks: doubling, so that a large input takes few passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.table import Table


def double_until(table: Table, rows: int, reshape: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Append the table to itself until it has `rows` rows; the last time only as many as are missing.

    The last rows are whole files and the first rows of one more, so no task
    gathers more than the rows of one file.
    """
    while 0 < (have := table.count()) < rows:
        more = table.scan()
        if have * 2 > rows:
            plan, fields, missing, whole = table.plan(), table.fields(), rows - have, []
            for f, x in plan:
                live = f["record_count"] - (x["count"] if x else 0)
                if live > missing:
                    break
                whole.append((f, x))
                missing -= live
            more = table.read(whole, fields)
            if missing:
                more = more.union(table.read([plan[len(whole)]], fields).limit(missing))
        table.append(reshape(more) if reshape else more)
    return table.count()

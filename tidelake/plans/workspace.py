"""Catalogs for the registered queries, in the session's shared folder, one for each input."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import types as ty
from ..operators.catalog import Catalog
from ..operators.table import Table

_catalogs: dict[tuple[str, str], Catalog] = {}
_tables: dict[tuple[str, str, str], Table] = {}


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tidelake-")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The input's catalog, made on first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogs:
        _catalogs[key] = fresh(spark)
    return _catalogs[key]


def fresh(spark: SparkSession) -> Catalog:
    made = Catalog.create(spark, f"{root(spark)}/lake-{uuid.uuid4().hex}")
    made.create_namespace("lake")
    return made


def table(spark: SparkSession, sf_dir: str, name: str, make: Callable[[Catalog], Table]) -> Table:
    """A table that queries only read, made on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = make(catalog(spark, sf_dir))
    return _tables[key]


def new_table(lake: Catalog, df: DataFrame, partition=None, sort=None, name: str | None = None) -> Table:
    """An empty table with the frame's columns."""
    fields = [{**f, "nullable": True} for f in ty.fields_from_spark(df.schema)]
    return lake.create_table("lake", name or f"t_{uuid.uuid4().hex}", fields, partition, sort)


def filled(lake: Catalog, *parts: DataFrame, partition=None, sort=None, max_rows: int | None = None) -> Table:
    """A table with one snapshot of rows for each frame."""
    t = new_table(lake, parts[0], partition, sort)
    for df in parts:
        t.append(df, max_rows=max_rows)
    return t

"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, for_one_action, fresh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that Spark hands to Python, unless the session says otherwise than Spark does: texts may be long, and
#: both sides hold a batch whole.
BATCH, SPARKS_BATCH = 256, "10000"
#: Keys, of some 50 bytes each, up to which they are broadcast.
BROADCAST_KEYS = 500_000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == SPARKS_BATCH:
        spark.conf.set(key, str(BATCH))


#: What a worker keeps between tasks, by what empties it; and the operator that it last ran.
KEPT: list[Callable[[], None]] = []
LAST = {"operator": ""}


def give_back() -> None:
    """Returns memory that is free to the machine, where the C library can: workers stay, and what one operator needed for
    a while would else be missing to the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def entering(operator: str) -> None:
    """Empties what other operators have kept in this worker."""
    if LAST["operator"] != operator:
        LAST["operator"] = operator
        for empty in KEPT:
            empty()
        give_back()


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., Any]], step: int = 256) -> DataFrame:
    """Applies a Python function to lists of values, Arrow batches in and out.

    make() runs once for each task and returns f(*lists), which gets lists of the columns' values and
    returns one list for each column of schema. A batch is worked through in runs of `step` rows, so what
    Python holds as objects stays bounded however many rows Spark puts into an Arrow batch. What is free is
    given back at a task's end, as workers stay.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    who = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By import, as a function that is sent along has globals of its own.
        from glyphsift.llm import common

        common.entering(who)
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(f(*(c.to_pylist() for c in part.columns)), out, strict=True)], schema=out)
        del f
        common.give_back()

    return df.select(*columns).mapInArrow(run, schema)


def scored(docs: DataFrame, make: Callable[[], Callable[[list], tuple[list, ...]]], schema: str, keep: bool = False) -> DataFrame:
    """(doc_id, held_out) and what f, which make() returns, gives for the texts, in schema; if keep is set, all
    columns of docs, whatever their names, as kept_0, kept_1 and so on, instead of those two."""
    own = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(docs.columns)] if keep else [F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")]
    rows = docs.select(F.col("text").alias("_text"), *own)

    def run_all():
        f = make()
        return lambda texts, *rest: (*rest, *f(texts))

    return map_rows(rows, rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]) + ", " + schema, run_all, 64)


def kept(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows that scored() kept."""
    return rows.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _keys(of: DataFrame, key: str) -> DataFrame:
    """The distinct keys: up to BROADCAST_KEYS of them, which are counted, are broadcast, so that the rows they are joined to
    stay where they are; more are joined by a shuffle."""
    keys = checkpointed(of.select(key).distinct())
    with for_one_action(keys.sparkSession):
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return F.broadcast(fresh(keys)) if few else fresh(keys)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in gone(key)."""
    return rows.join(_keys(gone, key), key, "left_anti")


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in wanted(key)."""
    return rows.join(_keys(wanted, key), key, "left_semi")


def once(rows: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """rows with but one for each of repeated(key), the least by a hash of its columns; no other row moves."""
    repeated = checkpointed(repeated)
    if repeated.isEmpty():
        return rows
    parts = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    first = only(rows, repeated, key).groupBy(key).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != key)), F.xxhash64(*parts)).alias("_row"))
    chosen = first.select(*(F.col(key) if c == key else F.col("_row")[c].alias(c) for c in rows.columns))
    return without(rows, repeated, key).union(chosen)

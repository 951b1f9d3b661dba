"""Shared pieces of the text operators: registry, tables, written tables, worker state."""

from __future__ import annotations

import ctypes
import hashlib
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
BATCH_ROWS = 512
KEPT_KINDS = 4  # values of a worker


def query(name: str, sql: str | None = None):
    """Register a query function under *name* with its oracle SQL, where SQL can express it."""

    def add(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, else below the session's warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/offerloom-llm/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of *df*: write it as a Parquet table in the shared folder and read it back.

    Lost executors re-read the table instead of computing again what led to it. The folder is the caller's
    scratch space; it is cleaned between jobs.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to *rows* rows, so that few texts are Python objects at a time.

    What a task has freed goes back to the system at its end, as the worker lives on beside others.
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    release_memory()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def add_columns(docs: DataFrame, compute: Callable[[list], dict[str, Sequence]], schema: str, source: str = "text") -> DataFrame:
    """*docs* with the columns of *schema* that compute(values of *source*) gives per batch.

    Batches stay in Arrow, so the other columns pass through as they are. Columns of *docs* with the new names
    are replaced.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    rest = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            new = compute(batch.column(batch.schema.get_field_index(source)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(new[n]) for n in names]], names=[*batch.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{kept}, {schema}")


def keep_rows(docs: DataFrame, decide: Callable[[list], Sequence[bool]]) -> DataFrame:
    """The rows of *docs* whose text decide() keeps; all columns pass through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(decide(batch.column(batch.schema.get_field_index("text")).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def worker_value(kind: str, key: Hashable, make: Callable[[], object]):
    """A value that a Python worker keeps for its later tasks: one per kind, another key replaces it.

    The package's functions travel to workers by value, so their module globals start anew in each task; what is
    dear to build (tokenizers, character tables) is kept on a module of its own. The kind that was not asked for
    longest goes beyond KEPT_KINDS, so a worker does not carry the tables of earlier stages.
    """
    store = sys.modules.setdefault("_offerloom_worker", types.ModuleType("_offerloom_worker")).__dict__.setdefault("values", {})
    held = store.pop(kind, None)
    if held is None or held[0] != key:
        held = None  # let the old value go before the new one is built
        while len(store) >= KEPT_KINDS:
            store.pop(next(iter(store)))
        held = (key, make())
    store[kind] = held
    return held[1]


HASH_BASE = 0xD6E8FEB86659FD93


def hash_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of HASH_BASE and of its inverse modulo 2**64; a worker keeps one pair, which grows."""
    size = 1 << max(16, (n - 1).bit_length())
    held = worker_value("powers", None, lambda: [np.ones(1, np.uint64)] * 2)
    if len(held[0]) < size:
        held[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (HASH_BASE, pow(HASH_BASE, -1, 2**64))]
    return held[0], held[1]


_shared: list = []


def digest(value: object) -> str:
    """A name for a value by its content."""
    return hashlib.sha256(pickle.dumps(value)).hexdigest()


def share(spark: SparkSession, value: object):
    """A broadcast of *value*, whose size the caller bounds.

    Executors let go of what was shared before; where a plan still needs it, it is sent again.
    """
    context = spark.sparkContext
    for owner, old in _shared:
        if owner is context:
            old.unpersist()
    new = context.broadcast(value)
    _shared[:] = [(context, new)]
    return new

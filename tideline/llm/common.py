"""Shared helpers: table paths, durable intermediate tables, column hygiene."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import durable

#: Words are the runs between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Durable intermediate tables below the shared folder; they cut lineage, survive lost executors and are deleted when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{durable.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        durable.delete_at_end(self.spark, self.root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        files, at = durable.file_system(self.spark, f"{self.root}/{name}")
        files.delete(at, True)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(df[name], F.lit(""))


_held: dict = {}


def held(name: tuple, make):
    """What a Python worker keeps between tasks, under one name at a time: workers serve one stage after another, and
    what an earlier one kept would count against the memory of the next. Without ``make`` it only lets go."""
    if name not in _held:
        if _held:
            _held.clear()
            give_back()
        if make:
            _held[name] = make()
    return _held.get(name)


@cache
def _trim() -> Callable:
    """glibc's malloc_trim; without it nothing is done."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """What this process has freed goes back to the system, as far as it can."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The map, after whose end the worker gives its memory back: an idle worker of an earlier stage counts beside the next one's."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added while a column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

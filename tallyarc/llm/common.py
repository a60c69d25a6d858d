"""Helpers shared by the operators: tables, stored intermediate results, words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyarc.session import cut_lineage

#: The words of a text, and the characters that part them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared folder and read back: what follows reads files, not a long lineage."""
    return cut_lineage(df)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other letter stays as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null or blank gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def require_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a table whose size has a stated bound; more rows are an error, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def exact(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``df`` with its long columns as text, and the columns as they were: pandas holds longs beside nulls as doubles, which lose digits."""
    longs = {f.name for f in df.schema if f.dataType.typeName() == "long"}
    return df.withColumns({c: F.col(c).cast("string") for c in longs}) if longs else df, [F.col(c).cast("long").alias(c) if c in longs else F.col(c) for c in df.columns]


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str], list[Column]]:
    """``docs`` with its columns under neutral names beside the ``used`` ones, those neutral names, and the columns as they were.

    So an operator's own columns can't clash with columns that ride along. A used column isn't kept twice.
    """
    neutral = [c if c in used else f"in_{i}" for i, c in enumerate(docs.columns)]
    renamed = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, neutral, strict=True)])
    return renamed, neutral, [F.col(n).alias(c) for c, n in zip(docs.columns, neutral, strict=True)]


def give_back() -> None:
    """Return freed memory to the system: workers live on from task to task, and what one stage has freed stays with them otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back when its task ends."""
    @wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inner


def cuts(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Frames of about ``chars`` characters in ``column`` at most; a longer text comes alone."""
    for frame in frames:
        sizes = frame[column].map(lambda t: len(t) if isinstance(t, str) else 0).cumsum()
        for _, part in frame.groupby(sizes // chars, sort=False) if len(frame) else ():
            yield part.reset_index(drop=True)

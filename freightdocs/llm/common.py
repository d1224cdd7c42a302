"""What the operators of this subpackage share: tables, written steps, words, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Whole texts travel in them, so the default of 10,000 could be gigabytes.
BATCH_ROWS = 500
#: Removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a file; every executor has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset a local session gets a folder of its own; on a cluster that is an error, as no other
    executor could read what one of them has written there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="freightdocs-llm-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries in here go as soon as their result is written, not when the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and go on from there: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """For a join in which no side may be broadcast, whatever its size is taken for.

    Spark sizes a frame by the bytes of its files and the width of its rows: not by the rows that an ``explode`` makes, nor
    by what compression saves. A table far over the threshold then goes through the driver.
    """
    return df.hint("merge")


#: Functions that give up what a Python worker keeps from task to task; each tells whether it held anything.
KEPT: list[Callable[[], bool]] = []


def release() -> None:
    """Gives up what other steps keep in this Python worker: workers stay for all steps, and share an executor's memory."""
    if any([give_up() for give_up in KEPT]):
        gc.collect()
        with suppress(OSError, AttributeError):  # freed memory goes back to the system, where the C library can do that
            ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, in this order: others, whatever their names, are left behind."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def ascii_words(text: str | None, lower: bool) -> list[bytes]:
    """Runs of anything but space and 0x09-0x0D, as UTF-8; ``lower`` changes A-Z alone."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A full 64-bit mix of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each window of ``size`` neighbours; none if there are fewer."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted codes of the distinct ``size``-word windows; of the whole sequence where it is shorter; empty without words."""
    codes = word_codes(ascii_words(text, lower=True))
    return np.unique(window_codes(codes, min(size, max(1, len(codes)))))


@lru_cache(maxsize=64)
def least_matches(trials: int, p: float, miss: float = 1e-9) -> int:
    """The largest t such that fewer than t of ``trials`` coordinates agree with probability under ``miss``, each agreeing with ``p``."""
    below = 0.0
    for t in range(trials + 1):
        below += comb(trials, t) * p**t * (1 - p) ** (trials - t)
        if below > miss:
            return max(1, t)
    return trials

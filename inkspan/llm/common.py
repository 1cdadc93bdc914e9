"""Shared pieces of the training-data operators: readers, code-point arrays, batching.

Texts are handled in Arrow batches: a batch's strings are joined once, encoded as UTF-32 and
worked on as one integer array, so that no per-character Python runs.  Batches are cut by
characters, not by rows, which bounds memory whatever the length of a text.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters worked on at once by a Python task; bounds its memory.
CHUNK_CHARS = 1 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key, the latest by ``order``; columns other than those named are not read.

    Redelivered rows carry the same content, so which of equal rows stays makes no difference.
    Rows with a null key are dropped: they cannot be named in a result.  The aggregate combines
    on the map side, so a key delivered very often never gathers in one task.
    """
    value = F.struct(*columns)
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.coalesce(F.col(order), F.lit("1900-01-01").cast("timestamp"))).alias("v"))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in columns])


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """corpus_doc, each record once."""
    return once(table(spark, sf_dir, "corpus_doc"), "doc_no", "loaded_at", list(columns))


def asked(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """cases, each case once."""
    return once(table(spark, sf_dir, "cases"), "case_no", "asked_at", list(columns))


def shared_dir(spark: SparkSession) -> None:
    """Makes sure of a checkpoint folder: the one the session names, else one of this machine, but only where Spark runs on it alone."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "inkspan-checkpoints"))


def freed(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: Spark deletes them once the driver's garbage is collected, which may else be never in a run.

    One collection does not reach them: the listener bus holds the last query's plan until another query ends, and what
    else holds it lets go of it only some time after the first.
    """
    spark.sql("select 1").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def packed(df: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """(data): the rows (tid, doc_no, text) of each task in compressed batches of about ``limit`` characters, for a checkpoint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for row, texts in chunks(batch, "text", limit):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema, options=how) as writer:
                    writer.write_batch(batch.slice(row, len(texts)))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["data"])

    return df.select("tid", "doc_no", "text").mapInArrow(run, "data binary")


def spread(df: DataFrame) -> DataFrame:
    """(tid, doc_no, text): the rows that ``packed`` packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                yield from pa.ipc.open_stream(data.as_buffer())

    return df.mapInArrow(run, "tid long, doc_no long, text string")


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive rows' texts of a batch, nulls as '', of about ``limit`` characters: (first row, texts)."""
    texts = [x or "" for x in batch.column(column).to_pylist()]
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts together, the texts' lengths and their starts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, lens, np.cumsum(lens) - lens


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants), in wrapping arithmetic."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then those of the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) - np.repeat(skip - first, count)

"""The corpus and its companions as DataFrames in the document model."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions import text

STRINGS = ["book", "chapter", "title", "original", "translation", "decision", "outcome", "cause", "process", "significance", "verdict", "verdict_why"]
ARRAYS = ["figures", "themes", "pros", "cons", "cast_list"]
#: Fields whose grams are indexed.
INDEXED = ["title", "original", "translation", "decision", "outcome", "cause", "process", "significance", "verdict_why"]
INDEXED_ARRAYS = ["figures", "themes", "cast_list"]
DOCUMENT = T.StructType([T.StructField("doc_no", T.LongType())] + [T.StructField(c, T.StringType()) for c in STRINGS] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ARRAYS])
#: Rows up to which a side of a join is broadcast; it is counted first.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> None:
    """Makes sure of a checkpoint folder: the one the session names, else one of this machine, but only where Spark runs on it alone."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "inkspan-checkpoints"))


def freed(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: Spark deletes them once the driver's garbage is collected, which may else be never in a run."""
    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the latest delivery; rows without key are dropped. Equal rows are interchangeable."""
    others = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.coalesce(F.col(order), F.lit("1900-01-01").cast("timestamp"))).alias("v"))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in others])


def lenient(df: DataFrame) -> DataFrame:
    """Missing strings as '', missing arrays as empty, array elements without nulls and outer blanks, the verdict in its closed set."""
    def clean(c: str) -> Column:
        return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x.isNotNull() & (x != ""))

    have = set(df.columns)
    kept = [c for c in df.columns if c not in STRINGS + ARRAYS]
    strings = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in STRINGS if c in have and c != "verdict"]
    verdict = [text.verdict(F.col("verdict")).alias("verdict")] if "verdict" in have else []
    return df.select(*kept, *strings, *verdict, *[clean(c).alias(c) for c in ARRAYS if c in have])


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The records, each once, in the document model; only the columns named are read."""
    raw = read(spark, sf_dir, "corpus_doc")
    wanted = list(columns) or [c for c in raw.columns if c not in ("doc_no", "loaded_at")]
    return lenient(latest(raw.select("doc_no", "loaded_at", *wanted), "doc_no", "loaded_at").drop("loaded_at"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked queries, each case once."""
    df = latest(read(spark, sf_dir, "cases"), "case_no", "asked_at")
    return df.select("case_no", "id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("want", F.array().cast("array<string>")).alias("want"), F.coalesce("confidence", F.lit("")).alias("confidence"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and their triggers, one row each; the label itself is trigger 0. Labels are ordered by their text, which no row order can change.

    Repeated triggers and a trigger equal to its label are dropped. The masked trigger is precomputed.
    """
    raw = read(spark, sf_dir, "label_table").where("label <> ''").groupBy("label").agg(F.first("triggers").alias("triggers"), F.first("short_triggers").alias("short_triggers"))
    empty = F.array().cast("array<string>")
    listed = F.array_distinct(F.concat(F.array("label"), F.filter(F.coalesce("triggers", empty), lambda t: t.isNotNull() & (t != ""))))
    rows = raw.select("label", F.coalesce("short_triggers", empty).alias("short"), F.posexplode(listed).alias("trigger_ord", "trigger"))
    order = raw.select("label").agg(F.array_sort(F.collect_list("label")).alias("all"))
    ord_ = F.array_position(order.select("all").scalar(), F.col("label")).cast("int")
    return rows.select(ord_.alias("label_ord"), "label", "trigger_ord", "trigger", text.mask(F.col("trigger")).alias("core"), F.array_contains("short", F.col("trigger")).alias("is_short_allowed"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if it has at most ``rows`` rows, which is counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

"""Problem 8: filling fixed-capacity containers with items.

Method: vector bin packing by the dot-product heuristic.  An item has a demand in three dimensions,
its tokens, one segment and its loss-bearing tokens (all but its first, which nothing precedes); a
container is limited in each.  The open container takes, among the items that still fit, the one whose
demand has the largest dot product with the room left, both relative to the limits and weighted by the
mean demand.  Items of equal demand are interchangeable, so the choice is made among distinct demands
and costs the same for any number of items.

A text longer than a container is cut into full containers and a rest; no other text is cut.  Items are
spread by a hash over bins of ``BIN`` items, each packed by one task; a bin leaves at most its last
containers partly empty, some hundredths of a percent.

Defined cases: null and '' texts have no tokens and are in no container; equal texts are separate items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import TOKENIZER, counted

#: Limits of a container: tokens, segments, loss-bearing tokens. The last never binds as set: these data have no labels of loss, so an item's is its tokens less one.
CAPACITY, SEGMENTS, LOSS = 2048, 64, 2048
#: Items packed by one task, about.
BIN = 20_000


def pack(tokens: np.ndarray, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS) -> tuple[np.ndarray, np.ndarray]:
    """For each item its container and its place there; no item may exceed a limit by itself."""
    sizes, kind = np.unique(tokens, return_inverse=True)
    demand = np.stack([sizes, np.ones(len(sizes), np.int64), np.maximum(sizes - 1, 0)], 1)
    limit = np.array([capacity, segments, loss], np.float64)
    relative = demand / limit
    left = np.bincount(kind, minlength=len(sizes))
    queue = np.argsort(kind, kind="stable")
    head = np.cumsum(left) - left
    weight = (relative * left[:, None]).sum(0) / max(1, left.sum())
    container, place = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    alive = np.arange(len(sizes))
    k, rest = -1, len(tokens)
    while rest:
        k += 1
        room = np.array([capacity, segments, loss], np.int64)
        at = 0
        while True:
            # sizes ascend, so what fits by tokens and loss is a prefix
            fits = min(int(np.searchsorted(sizes[alive], room[0], "right")), int(np.searchsorted(demand[alive, 2], room[2], "right"))) if room[1] > 0 else 0
            if not fits:
                break
            some = alive[:fits]
            best = some[int(np.argmax(relative[some] @ (weight * room / limit)))]
            item = queue[head[best]]
            head[best] += 1
            left[best] -= 1
            container[item], place[item] = k, at
            at += 1
            room = room - demand[best]
            rest -= 1
            if not left[best]:
                alive = alive[alive != best]
    return container, place


def packed(df: DataFrame, bins: int, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """Of (doc_id, tokens): (container, place, doc_id, piece_no, token_start, token_end), each token once; only ids and counts are shuffled."""
    pieces = F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("long"))
    items = df.where("tokens > 0").select("doc_id", "tokens", F.explode(pieces).alias("piece_no"))
    start = F.col("piece_no") * capacity
    items = items.select(F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(bins)).alias("bin"), "doc_id", "piece_no", start.alias("token_start"), F.least(start + capacity, "tokens").alias("token_end"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], ignore_index=True)
        container, place = pack((pdf.token_end - pdf.token_start).to_numpy(), capacity, segments, loss)
        return pdf.assign(container=pdf.bin * (1 << 32) + container, place=place)[["container", "place", "doc_id", "piece_no", "token_start", "token_end"]]

    # as many partitions as bins: small in bytes, they would otherwise be merged into one task
    return items.repartition(bins, "bin").groupBy("bin").applyInPandas(fill, "container long, place long, doc_id long, piece_no long, token_start long, token_end long")


def p8_packed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """All documents in containers of 2,048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(counted(docs, path=tokenizer), max(1, round(docs.count() / BIN)))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers, their tokens, the share of room used, and the texts cut."""
    rows = p8_packed(spark, sf_dir)
    each = rows.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count("*").alias("segments"), F.count_if(F.col("piece_no") > 0).alias("cuts"))
    return each.agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.max("segments").alias("most_segments"),
        F.sum("cuts").alias("cuts"),
        F.round(F.sum("tokens") / (F.count("*") * CAPACITY), 6).alias("used"),
    )

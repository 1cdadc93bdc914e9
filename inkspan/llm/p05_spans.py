"""Problem 5: long exact spans shared between records.

Method: an exact join of windows within blocks, in place of relative Lempel-Ziv parsing; nothing is
factored.  Every ``SPAN``-character window is held against those of other records by its fingerprint,
and windows that another record has are joined to spans.  To keep this from being one join of all
windows, stretches are put into blocks by content: a stretch belongs to the block of its minimizer, the
least fingerprint of the ``SEED``-grams of a window.  Equal windows have equal minimizers, hence a
window's counterpart is always in its own block, and windows of blocks of one record are not read.

Defined cases: null, '' and texts shorter than ``SPAN`` give no row; a stretch repeated only within
its own record is not shared; a record that is a copy of another is one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunks, codes, mix, ranges, records, shared_dir, table

#: Least length of a shared stretch, and of the seeds by which stretches are assigned to blocks.
SPAN, SEED = 48, 16


def fingerprints(cp: np.ndarray, n: int, levels: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit fingerprint of the n characters from each position on; n is a sum of powers of two."""
    have = {} if levels is None else levels
    if 1 not in have:
        have[1] = mix(cp.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    k = 1
    while 2 * k <= n:
        if 2 * k not in have:
            h = have[k]
            have[2 * k] = mix(h[:-k] * U64(0xD6E8FEB86659FD93) + h[k:]) if len(h) > k else h[:0]
        k *= 2
    if k == n:
        return have[n]
    rest = fingerprints(cp, n - k, have)
    m = max(0, len(cp) - n + 1)
    return mix(have[k][:m] * U64(0xA0761D6478BD642F) + rest[k : k + m])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of w values from each position on."""
    m, k = h, 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:]) if len(m) > k else m[:0]
        k *= 2
    n = max(0, len(h) - w + 1)
    return np.minimum(m[:n], m[w - k : w - k + n])


def stretches(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text, block, first and last start within the text."""
    cp, lens, starts = codes(texts)
    block = sliding_min(fingerprints(cp, SEED), SPAN - SEED + 1)
    windows = np.maximum(lens - SPAN + 1, 0)
    at = ranges(starts, windows)
    owner = np.repeat(np.arange(len(texts)), windows)
    b = block[at]
    new = np.ones(len(at), bool)
    new[1:] = (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    own = owner[first]
    return own, b[first].view(np.int64), at[first] - starts[own], at[last[: len(first)]] - starts[own]


def blocks(df: DataFrame) -> DataFrame:
    """The stretches of (doc_no, text) with their blocks; a map without shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("doc_no").to_numpy(zero_copy_only=False), np.int64)
            for row, texts in chunks(batch, "text"):
                own, block, lo, hi = stretches(texts)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row + own]), pa.array(block), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc_no", "block", "lo", "hi"])

    return df.mapInArrow(cut, "doc_no long, block long, lo int, hi int")


def looked_up(df: DataFrame) -> DataFrame:
    """The windows of the stretches ``at`` of (doc_no, text, at), each with its fingerprint."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("doc_no").to_numpy(zero_copy_only=False), np.int64)
            at = batch.column("at").to_pylist()
            for row, texts in chunks(batch, "text"):
                cp, _, starts = codes(texts)
                h = fingerprints(cp, SPAN).view(np.int64)
                n = np.fromiter((len(x) for x in at[row : row + len(texts)]), np.int64, len(texts))
                flat = [x for one in at[row : row + len(texts)] for x in one]
                lo = np.fromiter((x["lo"] for x in flat), np.int64, len(flat))
                hi = np.fromiter((x["hi"] for x in flat), np.int64, len(flat))
                block = np.fromiter((x["block"] for x in flat), np.int64, len(flat))
                own = np.repeat(np.arange(len(texts)), n)
                size = hi - lo + 1
                pos, own = ranges(lo, size), np.repeat(own, size)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row + own]), pa.array(np.repeat(block, size)), pa.array(h[starts[own] + pos]), pa.array(pos.astype(np.int32))], names=["doc_no", "block", "window", "pos"])

    return df.mapInArrow(windows, "doc_no long, block long, window long, pos int")


def shared_spans(docs: DataFrame) -> DataFrame:
    """The maximal stretches of (doc_no, text) covered by ``SPAN``-character windows that another doc_no has too.

    Rows may repeat a doc_no with the same text.  Per stretch a row moves, not a window; only
    stretches of blocks that at least two records have are looked up window by window.
    """
    docs = docs.where(F.col("doc_no").isNotNull() & (F.length("text") >= SPAN))
    cut = blocks(docs).checkpoint()
    common = cut.groupBy("block").agg(F.min("doc_no").alias("a"), F.max("doc_no").alias("z")).where("a < z").select("block")
    wanted = cut.join(common, "block", "left_semi").groupBy("doc_no").agg(F.collect_set(F.struct("block", "lo", "hi")).alias("at"))
    text = docs.groupBy("doc_no").agg(F.max("text").alias("text"))
    seen = looked_up(text.join(wanted, "doc_no")).checkpoint()
    # the window's fingerprint and its block's are independent: a chance match needs both
    factors = seen.groupBy("block", "window").agg(F.min("doc_no").alias("a"), F.max("doc_no").alias("z")).where("a < z").select("block", "window")
    hits = seen.join(factors, ["block", "window"], "left_semi").groupBy("doc_no").agg(F.array_sort(F.collect_list("pos")).alias("pos"))
    # a record's windows in order: a start more than SPAN past the last begins a new span
    step = F.aggregate(
        "pos",
        F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= p),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), (p + SPAN).cast("bigint").alias("e")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.cast("bigint").alias("s"), (p + SPAN).cast("bigint").alias("e"))))),
    )
    return hits.select("doc_no", F.explode(step).alias("x")).select("doc_no", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared stretches of the originals of all records."""
    shared_dir(spark)
    return shared_spans(table(spark, sf_dir, "corpus_doc").select("doc_no", F.col("original").alias("text")))


def p5_shared_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record with an original, its characters, those shared elsewhere, and the share."""
    spans = p5_found(spark, sf_dir).groupBy("doc_no").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    size = records(spark, sf_dir, "original").where("original <> ''").select("doc_no", F.length("original").cast("long").alias("chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return size.join(spans, "doc_no", "left").select("doc_no", "chars", shared.alias("shared_chars"), F.round(shared / F.col("chars"), 6).alias("shared_part"))


SQL = {
    "p5_found": r"""
WITH doc AS (SELECT doc_no, max_by(original, loaded_at) AS t FROM corpus_doc GROUP BY doc_no),
win AS (SELECT doc_no, i - 1 AS s, substr(t, i, 48) AS w FROM (SELECT doc_no, t, unnest(range(1, length(t) - 46)) AS i FROM doc WHERE length(t) >= 48)),
hit AS (SELECT doc_no, s FROM win WHERE w IN (SELECT w FROM win GROUP BY w HAVING count(DISTINCT doc_no) > 1)),
mark AS (SELECT doc_no, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_no ORDER BY s) + 48 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_no, s, sum(new) OVER (PARTITION BY doc_no ORDER BY s) AS g FROM mark)
SELECT doc_no, min(s) AS span_start, max(s) + 48 AS span_end FROM run GROUP BY doc_no, g
"""
}

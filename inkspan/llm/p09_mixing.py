"""Problem 9: mixing sources to target weights.

Method: entropy balancing.  Every text gets a rate, its expected number of copies.  Of all rates with
which each wanted source has its share of the tokens, those nearest to equal rates in relative entropy
are exponentially tilted, ``exp(slope of the source * tokens)``, cut off at the largest allowed number
of repeats.  The slopes solve a convex dual; Newton steps find them, each step one distributed
aggregate over the histogram of token counts by source.  Rates are then rounded to whole copies with
the rounding error in tokens carried from text to text.

A text that several documents hold counts once, for the source that is scarcest against its share; so
no text is used more often than allowed.  The size of the mix is a parameter; without it, it is the
largest that every source can fill.  A wanted source without documents cannot have a share; the
others' shares are taken relative to each other, and the report names it with nothing reached.

Defined cases: unwanted sources, null and '' texts take no part; no document of a wanted source, no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .tokens import TOKENIZER, counted

#: Sources a target table may name; it is held by the driver.
MOST_SOURCES = 10_000
#: Texts rounded by one task, about; Newton steps at most; relative error of a source's tokens to stop at.
BUCKET, STEPS, CLOSE = 5_000, 60, 1e-9


def wanted(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, repeats) of the target table, equal rows once."""
    rows = targets.where("source is not null and target_share > 0 and max_repeat > 0").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeat").alias("m")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the target table")
    return sorted((r["source"], float(r["s"]), int(r["m"])) for r in rows)


def mapped(values: dict[str, float]) -> object:
    """A source's value as a column."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("source")]


def distinct_texts(docs: DataFrame, targets: list[tuple[str, float, int]], tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens): each text of a wanted source once, with its least document of its scarcest source."""
    names = [s for s, _, _ in targets]
    rows = docs.where(F.col("source").isin(names) & (F.col("text") != "")).select("doc_id", "source", F.md5("text").alias("digest"), "text")
    each = counted(rows, path=tokenizer).groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")).where("tokens > 0").checkpoint()
    supply = {r["source"]: r["n"] for r in each.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    scarce = {s: i for i, (_, s) in enumerate(sorted((supply[s] * m / share, s) for s, share, m in targets if s in supply))}
    if not scarce:
        return each.select("doc_id", "source", "tokens")
    best = each.groupBy("digest").agg(F.min_by(F.struct("doc_id", "source", "tokens"), F.struct(mapped(scarce), "doc_id")).alias("v"))
    return best.select("v.doc_id", "v.source", "v.tokens")


def slopes(histogram: DataFrame, need: dict[str, float], most: dict[str, int], scale: dict[str, float]) -> dict[str, float]:
    """The slope of each source with which its expected tokens are those needed; Newton's method, kept within a bracket."""
    at = {s: 0.0 for s in need}
    low, high = {s: -700.0 for s in need}, {s: 700.0 for s in need}
    x = F.col("tokens") / mapped(scale)
    for _ in range(STEPS):
        rate = F.exp(F.least(mapped(at) * x, F.lit(60.0)))
        cap = mapped({s: float(m) for s, m in most.items()})
        tokens = F.col("n") * F.col("tokens")
        sums = histogram.groupBy("source").agg(F.sum(tokens * F.least(rate, cap)).alias("have"), F.sum(F.when(rate < cap, tokens * rate * x).otherwise(0.0)).alias("bend")).collect()
        off = 0.0
        for r in sums:
            s = r["source"]
            miss = r["have"] - need[s]
            off = max(off, abs(miss) / need[s])
            if abs(miss) <= CLOSE * need[s]:
                continue
            if miss > 0:
                high[s] = at[s]
            else:
                low[s] = at[s]
            step = at[s] - miss / r["bend"] if r["bend"] > 0 else math.inf
            at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
        if off <= CLOSE:
            break
    return at


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, copies): the texts used and how often."""
    goal = wanted(targets)
    texts = distinct_texts(docs, goal, tokenizer).checkpoint()
    histogram = texts.groupBy("source", "tokens").agg(F.count("*").alias("n")).checkpoint()
    supply = {r["source"]: (r["n"], r["t"]) for r in histogram.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).alias("t")).collect()}
    here = [(s, share, m) for s, share, m in goal if s in supply]
    whole = sum(share for _, share, _ in here)
    if not here:
        return texts.select("doc_id", "source", "tokens", F.lit(0).cast("long").alias("copies"))
    most = {s: m for s, _, m in here}
    room = min(supply[s][1] * m * whole / share for s, share, m in here)
    size = min(room, total_tokens) if total_tokens else room
    need = {s: min(size * share / whole, float(supply[s][1] * m)) for s, share, m in here}
    scale = {s: supply[s][1] / supply[s][0] for s in need}
    slope = slopes(histogram, need, most, scale)
    rate = F.least(F.exp(F.least(mapped(slope) * F.col("tokens") / mapped(scale), F.lit(60.0))), mapped({s: float(m) for s, m in most.items()}))
    number = {s: max(1, round(n / BUCKET)) for s, (n, _) in supply.items()}
    buckets = mapped(number)
    rows = texts.select("doc_id", "source", "tokens", rate.alias("rate"), F.pmod(F.xxhash64("doc_id"), buckets.cast("long")).alias("bucket"))

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], ignore_index=True)
        cap, owed, copies = most[pdf.source.iloc[0]], 0.0, []
        for rate, t in zip(pdf.rate, pdf.tokens):
            owed += rate * t
            n = min(cap, max(0, math.floor(owed / t + 0.5)))
            owed -= n * t
            copies.append(n)
        return pdf.assign(copies=copies)[["doc_id", "source", "tokens", "copies"]]

    return rows.repartition(sum(number.values()), "source", "bucket").groupBy("source", "bucket").applyInPandas(rounded, "doc_id long, source string, tokens long, copies long").where("copies > 0")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and their copies."""
    shared_dir(spark)
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every wanted source its target, the share reached, its texts, copies, tokens and repeats."""
    used = p9_mix(spark, sf_dir).groupBy("source").agg(F.count("*").alias("texts"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats")).checkpoint()
    goal = table(spark, sf_dir, "mix_target").select("source", "target_share", "max_repeat").distinct()
    n = F.coalesce("tokens", F.lit(0))
    return goal.join(used, "source", "left").select(
        "source", "target_share", "max_repeat",
        F.round(n / used.agg(F.sum("tokens")).scalar(), 6).alias("reached_share"),
        n.alias("tokens"),
        F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.col("copies") / F.col("texts"), 6).alias("mean_repeats"),
    )

"""From the words of a query to the index: segmentation, and the bridge from everyday phrasing to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import text

# The frequency above which a word is too general, the extra cost of a single character, the most concerns.
HIGH_DF, SINGLE_COST, MAX_CONCERNS = 15, 4.0, 6


def normalized(queries: DataFrame, stops: list[str] | None = None) -> DataFrame:
    """(case_no, query) with its normal form and that form without stop words, the packaged ones or those given."""
    norm = text.normalize(F.col("query"))
    return queries.select("case_no", "query", norm.alias("norm")).withColumn("masked", text.mask(F.col("norm"), stops))


def query_grams(norm: DataFrame) -> DataFrame:
    """The grams of all queries."""
    return norm.select(F.explode(text.grams(F.col("norm"))).alias("term")).distinct()


def _segment(block: Column, df: Column, n: Column) -> Column:
    """The pieces of a block of least total cost: known words of 2 to 4 characters, or single characters. Equal costs prefer the shorter piece."""
    single = -F.log(F.lit(2.0) / n) + F.lit(SINGLE_COST)

    def step(s: Column, i: Column) -> Column:
        best, length = F.element_at(s["best"], i) + single, F.lit(1)
        for k in text.GRAM_LENGTHS:
            word = F.substring(block, i - k + 1, F.lit(k))
            cost = F.element_at(s["best"], F.greatest(i - k + 1, F.lit(1))) - F.log((F.element_at(df, word) + 1) / n)
            better = (i >= k) & F.coalesce(cost < best, F.lit(False))
            best, length = F.when(better, cost).otherwise(best), F.when(better, F.lit(k)).otherwise(length)
        return F.struct(F.concat(s["best"], F.array(best)).alias("best"), F.concat(s["back"], F.array(length)).alias("back"))

    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array().cast("array<int>").alias("back"))
    back = F.aggregate(F.sequence(F.lit(1), F.length(block)), start, step, lambda s: s["back"])

    def walk(s: Column, _: Column) -> Column:
        k = F.element_at(s["back"], F.greatest(s["at"], F.lit(1)))
        piece = F.substring(block, s["at"] - k + 1, k)
        out = F.when((s["at"] > 0) & (k >= 2), F.concat(F.array(piece), s["out"])).otherwise(s["out"])
        return F.struct(F.when(s["at"] > 0, s["at"] - k).otherwise(s["at"]).alias("at"), s["back"].alias("back"), out.alias("out"))

    end = F.struct(F.length(block).alias("at"), back.alias("back"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.length(block)), end, walk, lambda s: s["out"])


def tokens(norm: DataFrame, stats: DataFrame, n_docs: Column, stop_words: list[str] | None = None) -> DataFrame:
    """(case_no, tokens): each query's blocks segmented by the index vocabulary, stop words dropped.

    Without any token the raw bigrams of the normal form stand in. At most 24 tokens, in order, each once.
    Only a query's own grams meet the vocabulary. A blank query has no tokens.
    """
    listed = norm.select("case_no", F.posexplode(F.filter(F.split("norm", " "), lambda b: F.length(b) >= 2)).alias("block_ord", "block"))
    blocks = listed.select("block").distinct()
    known = blocks.select("block", F.explode(F.array_distinct(text.grams(F.col("block")))).alias("term")).join(stats, "term")
    maps = known.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    empty = F.create_map().cast("map<string,bigint>")
    cut = blocks.join(maps, "block", "left").select("block", F.coalesce("df", empty).alias("df")).select("block", _segment(F.col("block"), F.col("df"), n_docs + 2).alias("pieces"))
    by_case = listed.join(cut, "block").groupBy("case_no").agg(F.array_sort(F.collect_list(F.struct("block_ord", "pieces"))).alias("b"))
    pieces = F.array_distinct(F.flatten(F.transform("b", lambda x: x["pieces"])))
    stops = F.array(*[F.lit(w) for w in (text.STOP_WORDS if stop_words is None else stop_words)])
    kept = F.filter(pieces, lambda t: ~F.array_contains(stops, t))
    rows = norm.join(by_case, "case_no", "left").select("case_no", "norm", F.coalesce(kept, F.array().cast("array<string>")).alias("kept"))
    return rows.select("case_no", F.slice(F.when(F.size("kept") > 0, F.col("kept")).otherwise(text.bigrams(F.col("norm"))), 1, text.MAX_TOKENS).alias("tokens"))


def trigger_stats(labels: DataFrame, stats: DataFrame) -> DataFrame:
    """Labels with the document frequency of each trigger and of its core; 0 where the index lacks them."""
    a = stats.select(F.col("term").alias("trigger"), F.col("df").alias("trigger_df"))
    b = stats.select(F.col("term").alias("core"), F.col("df").alias("core_df"))
    rows = labels.join(a, "trigger", "left").join(b, "core", "left")
    return rows.withColumn("trigger_df", F.coalesce("trigger_df", F.lit(0))).withColumn("core_df", F.coalesce("core_df", F.lit(0)))


def matches(norm: DataFrame, triggers: DataFrame) -> DataFrame:
    """(case_no, label_ord, label, trigger_ord, trigger) of the triggers that a query holds.

    One ordered ladder of guards decides how a trigger is compared. The label table is configuration of
    fixed size; it is broadcast, and every query is held against it.
    """
    t, core, n, m = F.col("trigger"), F.col("core"), F.col("norm"), F.col("masked")
    ok = (
        F.when(F.col("trigger_ord") == 0, text.hit(t, n))
        .when(F.length(t) < 3, F.col("is_short_allowed") & (F.col("trigger_df") <= HIGH_DF) & text.hit(t, m))
        .when((F.length(core) < 2) | (F.col("core_df") > HIGH_DF), text.hit(t, n))
        .when(core == F.col("label"), F.lit(False))
        .when(F.length(core) == 2, text.hit(core, m))
        .otherwise(text.matches_with_gap(core, m))
    )
    return norm.join(F.broadcast(triggers), ok).select("case_no", "label_ord", "label", "trigger_ord", "trigger")


def expanded(found: DataFrame, stats: DataFrame) -> DataFrame:
    """(case_no, label_ord, label, said): the labels bridged to that are in the index, with the phrases that led there, in order."""
    known = found.join(stats.select(F.col("term").alias("label")), "label", "left_semi")
    grouped = known.groupBy("case_no", "label_ord", "label").agg(F.array_sort(F.collect_list(F.struct("trigger_ord", "trigger"))).alias("s"))
    return grouped.select("case_no", "label_ord", "label", F.array_distinct(F.transform("s", lambda x: x["trigger"])).alias("said"))


def concerns(labels_of: DataFrame) -> DataFrame:
    """(case_no, concerns): the first six labels of a query in label order. The cap holds for re-ranking only."""
    listed = labels_of.groupBy("case_no").agg(F.array_sort(F.collect_list(F.struct("label_ord", "label"))).alias("l"))
    return listed.select("case_no", F.slice(F.transform("l", lambda x: x["label"]), 1, MAX_CONCERNS).alias("concerns"))

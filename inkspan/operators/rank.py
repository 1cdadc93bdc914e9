"""Scoring, ranking and re-ranking of passages, with the reasons for each hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions import text
from inkspan.sources.tables import freed, shared_dir, small

# Fixed values of the scoring formula and the tiers.
EXTRA_WEIGHT, LABEL_DISCOUNT, LONG_BONUS = 0.3, 0.75, 1.35
MIN_COVERAGE, POOL, FLOOR, MAX_WHY, TOP = 2, 200, 0.35, 4, 3
TIERS = ("上", "中", "下")
SYNONYM = "（同义）"
# The fields of the simplified engine, in the order in which it runs them together.
OFFLINE = ("book", "chapter", "title", "original", "translation", "decision", "outcome", "cause", "process", "significance")
OFFLINE_ARRAYS = ("figures", "themes", "cast_list")


def query_terms(tokens: DataFrame, labels_of: DataFrame) -> DataFrame:
    """(case_no, term_ord, term, is_label): a query's tokens in order, then the labels it bridges to and did not type, in label order."""
    typed = tokens.select("case_no", F.posexplode("tokens").alias("term_ord", "term")).withColumn("is_label", F.lit(False))
    added = labels_of.join(typed.select("case_no", F.col("term").alias("label")), ["case_no", "label"], "left_anti")
    return typed.unionByName(added.select("case_no", (F.col("label_ord") + 1000).alias("term_ord"), F.col("label").alias("term"), F.lit(True).alias("is_label")))


def weighted(terms: DataFrame, stats: DataFrame, n_docs: Column) -> DataFrame:
    """Query terms that the index has, with their weights: inverse document frequency, more for long terms, less for added labels."""
    idf = F.log((n_docs + 1) / (F.col("df") + 1)) + 1
    weight = idf * F.when(F.length("term") >= 3, LONG_BONUS).otherwise(1.0) * F.when(F.col("is_label"), LABEL_DISCOUNT).otherwise(1.0)
    return terms.join(stats, "term").select("case_no", "term_ord", "term", "is_label", weight.alias("w"))


def scored(terms: DataFrame, post: DataFrame, stats: DataFrame, n_docs: Column) -> DataFrame:
    """(case_no, doc_no, score, n_terms): all passages that share a term with a query.

    The score is the largest weight plus a part of the others. It is kept to nine decimals, so that it does
    not depend on the order in which a shuffle adds. Only sums move; which terms matched is looked up
    afterwards, for the few passages shown (``with_terms``).
    """
    # queries are few beside postings: while they are, no posting is shuffled and no frequent term is one task's work
    rows = post.join(small(weighted(terms, stats, n_docs).select("case_no", "term", "w")), "term")
    hits = rows.groupBy("case_no", "doc_no").agg(F.sum("w").alias("total"), F.max("w").alias("top"), F.count("*").cast("int").alias("n_terms"))
    return hits.select("case_no", "doc_no", F.round(F.col("top") + (F.col("total") - F.col("top")) * EXTRA_WEIGHT, 9).alias("score"), "n_terms")


def with_terms(shown: DataFrame, terms: DataFrame, post: DataFrame) -> DataFrame:
    """Rows of (case_no, doc_no, …) with ``terms``: the query's terms that the passage holds, in order, added labels marked."""
    label = F.when(F.col("is_label"), F.concat("term", F.lit(SYNONYM))).otherwise(F.col("term"))
    found = shown.select("case_no", "doc_no").join(terms, "case_no").join(post, ["term", "doc_no"])
    listed = found.groupBy("case_no", "doc_no").agg(F.array_sort(F.collect_list(F.struct("term_ord", label.alias("t")))).alias("m"))
    return shown.join(listed.select("case_no", "doc_no", F.transform("m", lambda x: x["t"]).alias("terms")), ["case_no", "doc_no"])


def asked_top(top: int) -> int:
    """How many passages a caller gets: the default where the number asked for is not within 1 to 10."""
    return top if 1 <= top <= 10 else TOP


def ranked(hits: DataFrame, top: int = TOP) -> DataFrame:
    """The best passages of each query: score, then matched terms, then the lower number. A limit below 1 means the default."""
    top = TOP if top <= 0 else top
    w = Window.partitionBy("case_no").orderBy(F.col("score").desc(), F.col("n_terms").desc(), "doc_no")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def situated(hits: DataFrame, concerns: DataFrame, docs: DataFrame, top: int | None = None) -> DataFrame:
    """All hits (or the first ``top``) re-ranked by how many of a query's concerns a passage covers.

    With two or more concerns a passage qualifies with two, else with one. Qualifying passages come first,
    those that cover more before the others. Queries without concerns keep the order of the score.

    Coverage is counted where a concern is a theme, and meets the hits on the key they are grouped by, so
    no hit is shuffled for it and queries without concerns cost nothing.
    """
    asked = concerns.select("case_no", F.explode(F.array_distinct("concerns")).alias("label"))
    themed = docs.select("doc_no", F.explode(F.array_distinct("themes")).alias("label")).join(small(asked.select("label").distinct()), "label", "left_semi")
    covered = asked.join(themed, "label").groupBy("case_no", "doc_no").agg(F.count("*").cast("int").alias("coverage"))
    none = F.array().cast("array<string>")
    rows = hits.join(covered, ["case_no", "doc_no"], "left").join(small(concerns), "case_no", "left")
    rows = rows.withColumn("concerns", F.coalesce("concerns", none)).withColumn("coverage", F.coalesce("coverage", F.lit(0)))
    least = F.when(F.size("concerns") >= MIN_COVERAGE, MIN_COVERAGE).otherwise(1)
    qualifies = F.col("coverage") >= least
    w = Window.partitionBy("case_no").orderBy(qualifies.desc(), F.when(qualifies, F.col("coverage")).otherwise(0).desc(), F.col("score").desc(), F.col("n_terms").desc(), "doc_no")
    rows = rows.withColumn("rank", F.row_number().over(w))
    return rows if top is None else rows.where(F.col("rank") <= top)


def tiered(pool: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """One passage for each verdict from the first 200 situated hits; queries with none get their first ``top`` situated hits.

    In each tier the first passage in pool order counts whose score reaches a share of the pool's best. The
    tiers stand in their fixed order. Without any verdict in the corpus nothing qualifies and all queries fall back.
    """
    rows = pool.where(F.col("rank") <= POOL).join(docs.select("doc_no", "verdict"), "doc_no")
    best = F.max("score").over(Window.partitionBy("case_no"))
    able = rows.withColumn("best", best).where((F.col("verdict") != "") & (F.col("score") >= F.col("best") * FLOOR))
    first = able.withColumn("k", F.row_number().over(Window.partitionBy("case_no", "verdict").orderBy("rank"))).where("k = 1").drop("k", "best")
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("verdict")).cast("int")
    slot = F.row_number().over(Window.partitionBy("case_no").orderBy(order))
    graded = first.withColumn("slot", slot).withColumn("graded", F.lit(True))
    rest = rows.where(F.col("rank") <= (top if top > 0 else TOP)).join(graded.select("case_no").distinct(), "case_no", "left_anti")
    return graded.unionByName(rest.withColumn("slot", F.col("rank")).withColumn("graded", F.lit(False)))


def why(hits: DataFrame, labels_of: DataFrame) -> DataFrame:
    """(case_no, doc_no, why): what the user said and the label it led to, for the labels a hit matches; at most four."""
    listed = hits.select("case_no", "doc_no", F.posexplode("terms").alias("p", "term")).withColumn("label", F.regexp_replace("term", SYNONYM + "$", ""))
    said = listed.join(labels_of, ["case_no", "label"]).select("case_no", "doc_no", "p", "label", F.posexplode("said").alias("q", "said")).where("said <> label")
    pairs = said.groupBy("case_no", "doc_no").agg(F.array_sort(F.collect_list(F.struct("p", "q", "said", "label"))).alias("w"))
    return pairs.select("case_no", "doc_no", F.transform(F.slice("w", 1, MAX_WHY), lambda x: F.struct(x["said"].alias("said"), x["label"].alias("label"))).alias("why"))


def as_json(hits: DataFrame, reasons: DataFrame, docs: DataFrame, cases: DataFrame, concerns: DataFrame, verdict_docs: Column, took_ms: int = 0) -> DataFrame:
    """(case_no, result): each query's answer as one JSON text; queries without hits get an empty list.

    It holds the query, the time taken as a whole, whether tiers apply, the documents with a verdict, the
    query's concerns, the concerns each hit covers, for each tier the place of its hit (-1 for none; only
    where tiers apply), and the hits.
    """
    rows = hits.join(reasons, ["case_no", "doc_no"], "left").join(docs.select("doc_no", "title"), "doc_no")
    empty = F.array().cast("array<struct<said:string,label:string>>")
    hit = F.struct(F.col("slot"), F.col("doc_no"), F.col("title"), F.col("verdict"), text.fixed3(F.col("score")).alias("score"), F.col("terms"), F.col("coverage"), F.coalesce("why", empty).alias("why"))
    grouped = rows.groupBy("case_no").agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.max("graded").alias("graded"))
    placed = F.transform(F.array(*[F.lit(t) for t in TIERS]), lambda t: F.struct(t.alias("verdict"), (F.array_position(F.transform("hits", lambda h: h["verdict"]), t).cast("int") - 1).alias("hit")))
    listed = F.coalesce("hits", F.array().cast(grouped.schema["hits"].dataType))
    none = F.array().cast("array<string>")
    out = F.struct(
        F.col("query"), F.lit(took_ms).alias("tookMs"), F.coalesce("graded", F.lit(False)).alias("graded"), verdict_docs.alias("verdictDocs"), F.coalesce("concerns", none).alias("concerns"),
        F.transform(listed, lambda h: h["coverage"]).alias("coverage"), F.when(F.col("graded"), placed).alias("tiers"), listed.alias("hits"),
    )
    return cases.select("case_no", "query").join(grouped, "case_no", "left").join(concerns, "case_no", "left").select("case_no", F.to_json(out).alias("result"))


def situation_strip(concerns: DataFrame, reasons: DataFrame, most: int = 3) -> DataFrame:
    """(case_no, place, label, said): what was recognized of a query: its concerns in order, then further labels its hits name, each with at most three phrases said.

    ``reasons`` is (case_no, slot, why); a phrase equal to its label is no evidence. Queries without either have no row.
    """
    each = reasons.select("case_no", "slot", F.posexplode("why").alias("p", "w")).select("case_no", "slot", "p", "w.said", "w.label").where("said <> label and said <> ''")
    first = each.groupBy("case_no", "label", "said").agg(F.min(F.struct("slot", "p")).alias("at"))
    quoted = first.groupBy("case_no", "label").agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("s"))
    quotes = quoted.select("case_no", "label", F.slice(F.transform("s", lambda x: x["said"]), 1, most).alias("said"), F.col("s")[0]["at"].alias("at"))
    listed = concerns.select("case_no", F.posexplode(F.array_distinct("concerns")).alias("c", "label"))
    rows = listed.join(quotes, ["case_no", "label"], "full_outer")
    w = Window.partitionBy("case_no").orderBy(F.col("c").asc_nulls_last(), "at")
    return rows.select("case_no", (F.row_number().over(w) - 1).alias("place"), "label", F.coalesce("said", F.array().cast("array<string>")).alias("said"))


def offline(cases: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """The simplified engine: raw bigrams of all fields run together, summed idf, ties by number, scores to one decimal.

    Of the first 200 that reach a share of the best, the first of each verdict is shown, in the tiers' order;
    queries with none get their first ``top``.
    """
    from inkspan.operators import best

    lists = [F.array_join(c, "") for c in OFFLINE_ARRAYS]
    grams = docs.select("doc_no", F.explode(F.array_distinct(text.windows(F.concat(*OFFLINE, *lists), 2))).alias("term"))
    asked = cases.select("case_no", F.posexplode(F.array_distinct(text.windows(F.regexp_replace("query", r"(?U)^\s+|\s+$", ""), 2))).alias("term_ord", "term"))
    post = grams.join(small(asked.select("term").distinct()), "term", "left_semi")
    shared_dir(docs.sparkSession)
    post = post.select("term", "doc_no").checkpoint()  # cutting the texts is most of the work, and it is read several times
    freed(docs.sparkSession)
    stats = post.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    weighted = asked.join(stats, "term").select("case_no", "term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("w"))
    shown = best.tiered(best.lists(weighted, post, docs.select("doc_no", "verdict"), None, n, max(top, POOL), extra=1.0, digits=6, by_terms=False), top)
    return shown.select("case_no", F.col("slot").alias("rank"), "doc_no", F.floor(F.col("score") * 10 + 0.5).cast("double").alias("score_tenths"), "verdict", "graded")


def recall(first: DataFrame, cases: DataFrame) -> DataFrame:
    """Each case with whether a wanted string is in the title of one of its first hits; a case that wants nothing passes if nothing is asked of it."""
    got = first.groupBy("case_no").agg(F.collect_list("title").alias("titles"))
    rows = cases.join(got, "case_no", "left")
    titles = F.coalesce("titles", F.array().cast("array<string>"))
    passed = F.exists("want", lambda w: F.exists(titles, lambda t: F.contains(t, w)))
    return rows.select("case_no", "confidence", F.coalesce(passed, F.lit(False)).alias("passed"), F.size(titles).alias("hits"))


def drift(curated: DataFrame, loaded: DataFrame, docs: DataFrame, book: str, top: int = TOP) -> DataFrame:
    """The first hits over the curated records against those over all: (case_no, doc_no, curated_rank, loaded_rank, kept, evicted, from_shard).

    A record of either list has a row; ``loaded_rank`` is its place among the first 200 over all records, else null.
    A record is the same in both by its number. Records without book come from no shard.
    """
    a = curated.where(F.col("rank") <= top).select("case_no", "doc_no", F.col("rank").alias("curated_rank"))
    wide = loaded.where(F.col("rank") <= POOL).select("case_no", "doc_no", F.col("rank").alias("loaded_rank"))
    both = a.join(wide, ["case_no", "doc_no"], "full_outer").where(F.col("curated_rank").isNotNull() | (F.col("loaded_rank") <= top))
    shown = F.coalesce(F.col("loaded_rank") <= top, F.lit(False))
    rows = both.withColumn("kept", F.col("curated_rank").isNotNull() & shown).withColumn("evicted", F.col("curated_rank").isNotNull() & ~shown)
    shard = (F.col("book") != "") & (F.col("book") != book)
    return rows.join(docs.select("doc_no", shard.alias("from_shard")), "doc_no").select("case_no", "doc_no", "curated_rank", "loaded_rank", "kept", "evicted", "from_shard")


def drift_shares(rows: DataFrame, docs: DataFrame, book: str, top: int = TOP) -> DataFrame:
    """One row over ``drift``: cases with hits, those with the same list, with all curated hits kept, with some evicted; hits over all records, and the shares of shards and of curated records."""
    shown = F.col("loaded_rank") <= top
    each = rows.groupBy("case_no").agg(F.count("curated_rank").alias("a"), F.count_if(shown).alias("b"), F.count_if("kept").alias("kept"), F.count_if(shown & F.col("from_shard")).alias("shard"))
    same = (F.col("a") > 0) & (F.col("kept") == F.col("a")) & (F.col("kept") == F.col("b"))
    sums = each.agg(
        F.count("*").alias("cases"),
        F.count_if(same).alias("identical"),
        F.count_if(F.col("kept") == F.col("a")).alias("kept_all"),
        F.count_if(F.col("kept") < F.col("a")).alias("lost_some"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("shard"), F.lit(0)).alias("shard_hits"),
    )
    size = docs.agg(F.count_if(F.col("book") == book).alias("curated_docs"), F.count("*").alias("docs"))
    share = lambda x, n: F.when(F.col(n) > 0, F.round(F.col(x) / F.col(n), 6)).otherwise(0.0)
    return sums.crossJoin(size).select("*", share("shard_hits", "hits").alias("shard_share"), share("curated_docs", "docs").alias("curated_share"))

"""The queries over the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import text
from inkspan.operators import bridge, index, labels, merge, rank, shaping, stats
from inkspan.plans import sql
from inkspan.plans.pipeline import Curated, pipeline
from inkspan.sources import tables

FLAGSHIP = "search_tiers"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def shown(c: str, sep: str = "|") -> object:
    return F.array_join(c, sep).alias(c)


def score() -> object:
    return F.round("score", 6).alias("score")


# text and index


@query
def normalize_queries(spark, d):
    return bridge.normalized(tables.cases(spark, d)).select("case_no", "norm")


@query
def stop_mask(spark, d):
    return bridge.normalized(tables.cases(spark, d)).select("case_no", "masked")


@query
def token_estimate(spark, d):
    docs = tables.documents(spark, d, "original", "translation")
    return docs.select("doc_no", text.estimated_tokens(F.col("original")).alias("original_tokens"), text.estimated_tokens(text.truncated(F.col("translation"))).alias("translation_tokens"))


@query
def dirty_text(spark, d):
    docs = tables.documents(spark, d, "original", "translation")
    flags = text.dirty_flags(F.concat_ws("\n", "original", "translation"))
    rows = docs.select("doc_no", *[c.cast("int").alias(k) for k, c in flags.items()])
    return rows.where(" or ".join(f"{k} = 1" for k in flags))


@query
def index_stats(spark, d):
    docs = tables.documents(spark, d, *tables.INDEXED, *tables.INDEXED_ARRAYS)
    return index.size_estimate(index.postings(docs), tables.documents(spark, d, "book"))


@query
def gram_df_top(spark, d):
    docs = tables.documents(spark, d, *tables.INDEXED, *tables.INDEXED_ARRAYS)
    return index.frequencies(index.postings(docs)).orderBy(F.col("df").desc(), "term").limit(100)


# from query to terms


@query
def tokenize_viterbi(spark, d):
    return pipeline(spark, d).tokens.select("case_no", shown("tokens"))


@query
def trigger_stats(spark, d):
    return pipeline(spark, d).triggers.select("label", "trigger", "core", "is_short_allowed", "trigger_df", "core_df")


@query
def trigger_totals(spark, d):
    rows = pipeline(spark, d).triggers.where("trigger_ord > 0")
    return rows.agg(F.count("*").alias("triggers"), F.count_if(F.col("trigger_df") > 0).alias("in_index"))


@query
def bridge_matches(spark, d):
    return pipeline(spark, d).matches.select("case_no", "label", "trigger")


@query
def bridge_expanded(spark, d):
    return pipeline(spark, d).expanded.select("case_no", "label", shown("said"))


@query
def bridge_concerns(spark, d):
    return pipeline(spark, d).concerns.select("case_no", shown("concerns"))


@query
def explain_search(spark, d):
    p = pipeline(spark, d)
    rows = p.norm.select("case_no", "norm").join(p.tokens, "case_no").join(p.concerns, "case_no", "left")
    return rows.select("case_no", "norm", shown("tokens"), F.coalesce(F.array_join("concerns", "|"), F.lit("")).alias("concerns"))


# ranking


@query
def search_scored_top3(spark, d):
    p = pipeline(spark, d)
    return p.with_terms(p.kept(p.scored(rank.TOP))).select("case_no", "rank", "doc_no", score(), "n_terms", shown("terms"))


@query
def search_situated(spark, d):
    return pipeline(spark, d).pool.where(F.col("rank") <= rank.TOP).select("case_no", "rank", "doc_no", score(), "coverage")


@query
def search_tiers(spark, d):
    return pipeline(spark, d).placed.select("case_no", "slot", "verdict", "doc_no", score(), "coverage", "graded")


@query
def search_why(spark, d):
    p = pipeline(spark, d)
    pairs = F.array_join(F.transform("why", lambda x: F.concat(x["said"], F.lit(">"), x["label"])), "|")
    return p.reasons.select("case_no", "doc_no", pairs.alias("why"))


@query
def search_json(spark, d):
    p = pipeline(spark, d)
    graded = tables.documents(spark, d, "verdict").agg(F.count_if(F.col("verdict") != "").alias("n")).scalar()
    return rank.as_json(p.tiers, rank.why(p.tiers, p.expanded), tables.documents(spark, d, "title"), p.cases, p.concerns, graded)


@query
def result_slots(spark, d):
    p = pipeline(spark, d)
    cases = p.placed.where("graded").select("case_no").distinct()
    slots = cases.select("case_no", F.explode(F.array(*[F.lit(t) for t in rank.TIERS])).alias("verdict"))
    return slots.join(p.placed.where("graded").select("case_no", "verdict", "doc_no"), ["case_no", "verdict"], "left")


@query
def theme_highlights(spark, d):
    p = pipeline(spark, d)
    rows = p.placed.select("case_no", "doc_no").join(tables.documents(spark, d, "themes"), "doc_no").join(p.cases.select("case_no", "query"), "case_no")
    found = F.filter(F.array_distinct("themes"), lambda t: (F.length(t) >= 2) & F.contains(F.col("query"), t))
    return rows.select("case_no", "doc_no", F.array_join(found, "|").alias("highlighted"))


@query
def bigram_offline_top3(spark, d):
    return rank.offline(tables.cases(spark, d), tables.documents(spark, d))


@query
def recall_cases(spark, d):
    p = pipeline(spark, d)
    first = p.placed.select("case_no", "doc_no").join(tables.documents(spark, d, "title"), "doc_no")
    return rank.recall(first, p.cases)


@query
def recall_by_confidence(spark, d):
    return recall_cases(spark, d).groupBy("confidence").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))


@query
def rank_drift(spark, d):
    """The first three of the score against those of the re-ranking: what both have, and where the score's first went."""
    p = pipeline(spark, d)
    a = p.scored(rank.TOP).groupBy("case_no").agg(F.collect_set("doc_no").alias("a"), F.min_by("doc_no", "rank").alias("first"))
    b = p.pool.select("case_no", "doc_no", "rank")
    top = b.where("rank <= 3").groupBy("case_no").agg(F.collect_set("doc_no").alias("b"))
    now = b.select("case_no", F.col("doc_no").alias("first"), F.col("rank").alias("first_now"))
    return a.join(top, "case_no").join(now, ["case_no", "first"], "left").select("case_no", F.size(F.array_intersect("a", "b")).alias("overlap"), "first", "first_now")


#: The book of curated records.
CURATED = "芦原书"


def _drift(spark, d):
    return rank.drift(Curated(spark, d, CURATED).scored(rank.TOP), pipeline(spark, d).scored(rank.POOL), tables.documents(spark, d, "book"), CURATED)


@query
def rank_drift_corpora(spark, d):
    """The first three of the score over the curated book against those over all records."""
    return _drift(spark, d)


@query
def rank_drift_shares(spark, d):
    return rank.drift_shares(_drift(spark, d), tables.documents(spark, d, "book"), CURATED)


@query
def titles_bridge(spark, d):
    return pipeline(spark, d, "titles").matches.select("case_no", "label", "trigger")


@query
def titles_concerns(spark, d):
    return pipeline(spark, d, "titles").concerns.select("case_no", shown("concerns"))


@query
def titles_tiers(spark, d):
    return pipeline(spark, d, "titles").placed.select("case_no", "slot", "verdict", "doc_no", score(), "coverage", "graded")


@query
def titles_why(spark, d):
    p = pipeline(spark, d, "titles")
    pairs = F.array_join(F.transform("why", lambda x: F.concat(x["said"], F.lit(">"), x["label"])), "|")
    return p.reasons.select("case_no", "doc_no", pairs.alias("why"))


@query
def texts_bridge(spark, d):
    """The triggers that whole translations hold."""
    return pipeline(spark, d, "texts").matches.select("case_no", "label", "trigger")


@query
def texts_expanded(spark, d):
    return pipeline(spark, d, "texts").expanded.select("case_no", "label", shown("said"))


@query
def texts_concerns(spark, d):
    return pipeline(spark, d, "texts").concerns.select("case_no", shown("concerns"))


@query
def texts_tiers(spark, d):
    return pipeline(spark, d, "texts").placed.select("case_no", "slot", "verdict", "doc_no", score(), "coverage", "graded")


@query
def texts_why(spark, d):
    p = pipeline(spark, d, "texts")
    pairs = F.array_join(F.transform("why", lambda x: F.concat(x["said"], F.lit(">"), x["label"])), "|")
    return p.reasons.select("case_no", "doc_no", pairs.alias("why"))


@query
def phrases_bridge(spark, d):
    """The triggers found in every trigger phrase of the label table, in six wordings."""
    return pipeline(spark, d, "phrases").matches.select("case_no", "label", "trigger")


@query
def phrases_expanded(spark, d):
    return pipeline(spark, d, "phrases").expanded.select("case_no", "label", shown("said"))


@query
def phrases_concerns(spark, d):
    return pipeline(spark, d, "phrases").concerns.select("case_no", shown("concerns"))


@query
def phrases_tiers(spark, d):
    return pipeline(spark, d, "phrases").placed.select("case_no", "slot", "verdict", "doc_no", score(), "coverage", "graded")


@query
def phrases_why(spark, d):
    p = pipeline(spark, d, "phrases")
    pairs = F.array_join(F.transform("why", lambda x: F.concat(x["said"], F.lit(">"), x["label"])), "|")
    return p.reasons.select("case_no", "doc_no", pairs.alias("why"))


@query
def phrases_strip(spark, d):
    """What was recognized of every phrase, with the words that say it."""
    p = pipeline(spark, d, "phrases")
    reasons = p.reasons.join(p.placed.select("case_no", "doc_no", "slot"), ["case_no", "doc_no"])
    return rank.situation_strip(p.concerns, reasons).select("case_no", "place", "label", shown("said"))


@query
def texts_strip(spark, d):
    """What was recognized of whole translations, with the phrases that say it."""
    p = pipeline(spark, d, "texts")
    reasons = p.reasons.join(p.placed.select("case_no", "doc_no", "slot"), ["case_no", "doc_no"])
    return rank.situation_strip(p.concerns, reasons).select("case_no", "place", "label", shown("said"))


# statistics


@query
def library_totals(spark, d):
    catalog = tables.read(spark, d, "shard_catalog")
    return stats.library_totals(catalog, merge.selection(_asked_shards(spark), catalog))


@query
def library_snapshot(spark, d):
    catalog = tables.read(spark, d, "shard_catalog")
    return stats.snapshot(tables.documents(spark, d, "book"), catalog, merge.selection(_asked_shards(spark), catalog), "1")


@query
def body_lengths(spark, d):
    return stats.body_lengths(tables.documents(spark, d, "title", "original", "translation"))


@query
def repeated_keys(spark, d):
    docs = tables.latest(tables.read(spark, d, "corpus_doc").select("doc_no", "book", "chapter", "item_index", "loaded_at"), "doc_no", "loaded_at")
    return stats.repeated_keys(docs.drop("loaded_at"))


@query
def book_counts(spark, d):
    return stats.book_counts(tables.documents(spark, d, "book"))


@query
def annotation_coverage(spark, d):
    return stats.annotation_coverage(tables.documents(spark, d, "cast_list", "themes", "cause", "process", "significance"))


@query
def verdict_counts(spark, d):
    return stats.verdict_counts(tables.documents(spark, d, "verdict"))


@query
def shard_report(spark, d):
    return stats.shard_report(tables.documents(spark, d, "book", "original", "translation"))


@query
def duplicate_docs(spark, d):
    return stats.duplicate_docs(tables.documents(spark, d, "title", "original"))


@query
def catalog_totals(spark, d):
    return stats.catalog_totals(tables.read(spark, d, "shard_catalog"), tables.documents(spark, d, "book", "original", "translation"))


@query
def completeness(spark, d):
    return stats.completeness(tables.documents(spark, d, "book", "original", "translation", "themes", "pros", "cons"))


@query
def cost_estimate(spark, d):
    return stats.cost_estimate(tables.documents(spark, d, "title", "original", "translation"))


# labels


def _directed(spark, d):
    p = pipeline(spark, d)
    pairs = p.labels.select("label", F.col("trigger").alias("term"))
    return labels.directedness(pairs, p.label_postings, tables.documents(spark, d, "themes"))


@query
def directedness(spark, d):
    return _directed(spark, d)


@query
def trigger_allow(spark, d):
    return labels.short_rule(_directed(spark, d))


@query
def allow_list(spark, d):
    return labels.allow_list(labels.short_rule(_directed(spark, d))).select("label", shown("short_triggers"))


@query
def sample_titles(spark, d):
    p = pipeline(spark, d)
    pairs = p.labels.select("label", F.col("trigger").alias("term"))
    return labels.sample_titles(pairs, p.label_postings, tables.documents(spark, d, "title", "themes")).select("label", "term", "positive", shown("titles"))


@query
def core_audit(spark, d):
    return labels.core_audit(pipeline(spark, d).triggers)


@query
def label_effectiveness(spark, d):
    return labels.effectiveness(pipeline(spark, d).labels, _directed(spark, d))


@query
def phrase_mine(spark, d):
    return labels.mined(tables.documents(spark, d), tables.labels(spark, d))


@query
def check_phrase(spark, d):
    asked = tables.labels(spark, d).where("trigger_ord = 0").select(F.col("label").alias("phrase"))
    return labels.phrase_labels(tables.documents(spark, d), asked)


# merging


@query
def keep_last_dedup(spark, d):
    return merge.keep_last(tables.documents(spark, d, "original")).select("doc_no")


@query
def containment_dedup(spark, d):
    docs = tables.documents(spark, d, "book", "original")
    curated = docs.where("book = '芦原书'")
    return merge.contained(docs.where("book <> '芦原书'"), curated).select("doc_no")


@query
def manifest_diff(spark, d):
    docs = tables.documents(spark, d, "book", "title", "original", "translation")
    remote = merge.manifest(docs, "2")
    older = docs.where("doc_no % 7 <> 0 or book not in ('雁录', '柘志')").where("book <> '旧记'")
    return merge.manifest_diff(merge.manifest(older, "1"), remote)


@query
def merge_by_book(spark, d):
    docs = tables.documents(spark, d, "book", "title", "original")
    local = docs.where("book <> '旧记'")
    remote = docs.where("book in ('旧记', '雁录')").withColumn("title", F.concat(F.lit("〔新〕"), "title"))
    return merge.merge_by_book(local, remote).groupBy("book").agg(F.count("*").alias("docs"), F.count_if(F.startswith("title", F.lit("〔新〕"))).alias("replaced"))


def _backfill(spark, d, additive):
    docs = tables.latest(tables.read(spark, d, "corpus_doc").drop("published_at"), "doc_no", "loaded_at").drop("loaded_at")
    done = merge.backfill(docs, tables.read(spark, d, "annotation"), additive)
    return done.select("doc_no", "cause", "outcome", "verdict", shown("themes"))


@query
def backfill_overwrite(spark, d):
    return _backfill(spark, d, False)


@query
def backfill_additive(spark, d):
    return _backfill(spark, d, True)


@query
def annotate_todo(spark, d):
    docs = tables.read(spark, d, "corpus_doc").select("doc_no", "book", "chapter", "item_index").distinct()
    return merge.not_done(docs, tables.read(spark, d, "annotation")).select("doc_no")


@query
def closed_themes(spark, d):
    return merge.closed_themes(tables.documents(spark, d, "themes"), tables.labels(spark, d)).select("doc_no", shown("themes"))


def _asked_shards(spark):
    return spark.createDataFrame([(0, "JIUJI"), (1, "nosuch"), (2, "yanlu"), (3, "jiuji"), (4, "Zhezhi")], "place int, slug string")


@query
def selection_sanitize(spark, d):
    return merge.selection(_asked_shards(spark), tables.read(spark, d, "shard_catalog"))


@query
def selection_docs(spark, d):
    catalog = tables.read(spark, d, "shard_catalog")
    chosen = merge.selection(_asked_shards(spark), catalog)
    return merge.selected(tables.documents(spark, d, "book", "title"), catalog, chosen).select("doc_no", "book")


# shaping


def _pages(spark, d):
    """Pages made of the records: heading, style, original and translated paragraphs, a navigation line."""
    docs = tables.documents(spark, d, "title", "original", "translation").where("original <> ''")
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br/>"))
    html = F.concat(
        F.lit("<html><h1>"), esc("title"), F.lit("</h1><style>p{color:red}</style><p>"), esc("original"),
        F.lit(f'</p><p style="color:{shaping.TRANSLATION_COLOUR.upper()};">'), esc("translation"), F.lit("</p><script>var a='</p>';</script><p>上一章 下一章</p></html>"),
    )
    return docs.select(F.col("doc_no").alias("page_id"), html.alias("html"))


@query
def html_clean(spark, d):
    return _pages(spark, d).select("page_id", shaping.cleaned(shaping.body(F.col("html"))).alias("body"))


@query
def html_paragraphs(spark, d):
    return shaping.paragraph_pairs(_pages(spark, d))


@query
def sentence_chunks(spark, d):
    docs = tables.documents(spark, d, "original").where("original <> ''")
    return docs.select("doc_no", F.posexplode(shaping.chunked(F.col("original"))).alias("chunk_no", "chunk"))


@query
def align_chunks(spark, d):
    docs = tables.documents(spark, d, "original", "translation").where("original <> '' and translation <> ''")
    sized = docs.select("doc_no", "translation", F.size(shaping.chunked(F.col("original"))).alias("n"))
    return sized.select("doc_no", F.posexplode(shaping.into(F.col("translation"), F.col("n"))).alias("chunk_no", "chunk"))


@query
def cap_pairs(spark, d):
    return shaping.capped(tables.documents(spark, d, "original", "translation").where("original <> ''"))


@query
def pair_plausible(spark, d):
    docs = tables.documents(spark, d, "original", "translation")
    return docs.select("doc_no", shaping.plausible(F.col("original"), F.col("translation")).cast("int").alias("plausible"))


@query
def volume_numbers(spark, d):
    return tables.documents(spark, d, "chapter").select("doc_no", shaping.volume(F.col("chapter")).alias("volume"))


@query
def pairing_modes(spark, d):
    return shaping.pairing(tables.documents(spark, d, "book", "translation"))


@query
def filtered_items(spark, d):
    return shaping.filtered_items(tables.documents(spark, d, "original", "translation")).select("doc_no", (F.col("translation") != "").alias("translated"))


@query
def head_of_books(spark, d):
    """The first ten documents of three books."""
    return shaping.head(tables.documents(spark, d, "book"), 10, ["芦原书", "雁录", "柘志"]).select("doc_no", "book")


@query
def stratified_sample(spark, d):
    return shaping.stratified(tables.documents(spark, d, "book", "chapter", "title"), 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()

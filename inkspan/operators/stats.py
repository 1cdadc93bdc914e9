"""Counts and reports over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions import text


def book_counts(docs: DataFrame) -> DataFrame:
    """Documents of each book; a missing book is ''."""
    return docs.groupBy("book").agg(F.count("*").alias("docs"))


def annotation_coverage(docs: DataFrame) -> DataFrame:
    """Annotated documents (any of cast, themes, cause, process, significance), those with a cast and those with themes."""
    any_ = (F.size("cast_list") > 0) | (F.size("themes") > 0) | (F.col("cause") != "") | (F.col("process") != "") | (F.col("significance") != "")
    return docs.agg(F.count("*").alias("docs"), F.count_if(any_).alias("annotated"), F.count_if(F.size("cast_list") > 0).alias("with_cast"), F.count_if(F.size("themes") > 0).alias("with_themes"))


def verdict_counts(docs: DataFrame) -> DataFrame:
    """Documents with a verdict, in all and for each."""
    v = F.col("verdict")
    return docs.agg(F.count_if(v != "").alias("total"), *[F.count_if(v == t).alias(n) for t, n in (("上", "upper"), ("中", "middle"), ("下", "lower"))])


def shard_report(docs: DataFrame) -> DataFrame:
    """By book: items, characters, missing translations, lengths (least, median, 90 %, most; nearest rank) and residue counts."""
    n = F.length("original")
    flags = text.dirty_flags(F.col("original"))
    # lengths are counted first, so that a book's documents never gather in one task
    lengths = docs.groupBy("book", n.alias("n")).agg(F.count("*").alias("c"), F.count_if(F.col("translation") == "").alias("t"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    sorted_ = lengths.groupBy("book").agg(
        F.sum("c").alias("items"),
        F.sum(F.col("n") * F.col("c")).alias("chars"),
        F.sum("t").alias("no_translation"),
        F.array_sort(F.collect_list(F.struct("n", "c"))).alias("h"),
        *[F.sum(k).alias(k) for k in flags],
    )

    def at(rank: object) -> object:
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("v"))
        return F.aggregate("h", start, lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + x["c"] > rank), x["n"]).otherwise(s["v"]).alias("v")), lambda s: s["v"])

    return sorted_.select(
        "book", "items", "chars", "no_translation",
        at(F.lit(0)).alias("min_len"), at(F.floor(F.col("items") / 2)).alias("p50_len"), at(F.floor(F.col("items") * 9 / 10)).alias("p90_len"), at(F.col("items") - 1).alias("max_len"),
        *flags,
    )


def duplicate_docs(docs: DataFrame) -> DataFrame:
    """Documents beyond the first of each (title, original)."""
    groups = docs.groupBy("title", "original").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("docs"), F.count("*").alias("distinct_docs"), (F.sum("n") - F.count("*")).alias("duplicates"))


def catalog_totals(catalog: DataFrame, docs: DataFrame) -> DataFrame:
    """Each shard of the catalog with its declared and its actual documents and characters; a shard without documents has 0."""
    real = docs.groupBy("book").agg(F.count("*").alias("docs_now"), F.sum(F.length("original") + F.length("translation")).alias("chars_now"))
    rows = catalog.where("slug <> '' and book <> ''").join(real, "book", "left")
    return rows.select("slug", "book", F.col("docs").cast("long").alias("docs_declared"), F.coalesce("docs_now", F.lit(0)).alias("docs_now"), F.col("chars").alias("chars_declared"), F.coalesce("chars_now", F.lit(0)).alias("chars_now"))


def library_totals(catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: the shards of the catalog and their bytes, and those of them that are selected, slugs compared without case."""
    some = chosen.select(F.lower("slug").alias("k")).distinct().withColumn("on", F.lit(True))
    rows = catalog.where("slug <> '' and book <> ''").withColumn("k", F.lower("slug")).join(some, "k", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(F.count("*").alias("books"), total("bytes").alias("installed_bytes"), F.count("on").alias("selected"), total(F.when(F.col("on"), F.col("bytes"))).alias("selected_bytes"))


def snapshot(docs: DataFrame, catalog: DataFrame, chosen: DataFrame, version: str) -> DataFrame:
    """One row, the state of the library: documents loaded, shards selected, whether a catalog is there, the version."""
    t = library_totals(catalog, chosen)
    return t.select(docs.agg(F.count("*").alias("n")).scalar().alias("docs"), F.col("selected").alias("books"), (F.col("books") > 0).alias("library_installed"), F.lit(version).alias("version"))


def body_lengths(docs: DataFrame) -> DataFrame:
    """One row: documents, and the mean, median, 90 % and largest length of title, original and translation together (nearest rank); lengths are counted first."""
    n = F.length(F.concat("title", "original", "translation"))
    counts = docs.groupBy(n.alias("n")).agg(F.count("*").alias("c"))
    h = counts.agg(F.sum("c").alias("docs"), F.sum(F.col("n") * F.col("c")).alias("chars"), F.array_sort(F.collect_list(F.struct("n", "c"))).alias("h"))

    def at(rank: object) -> object:
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("v"))
        return F.aggregate("h", start, lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + x["c"] > rank), x["n"]).otherwise(s["v"]).alias("v")), lambda s: s["v"])

    return h.select("docs", F.round(F.col("chars") / F.col("docs"), 6).alias("mean_len"), at(F.floor(F.col("docs") / 2)).alias("p50_len"), at(F.floor(F.col("docs") * 9 / 10)).alias("p90_len"), at(F.col("docs") - 1).alias("max_len"))


def repeated_keys(docs: DataFrame) -> DataFrame:
    """(book, chapter, item_index, docs): keys that several documents have; documents without book have none."""
    rows = docs.where("book <> ''").groupBy("book", "chapter", "item_index").agg(F.count("*").alias("docs"))
    return rows.where("docs > 1")


def completeness(docs: DataFrame) -> DataFrame:
    """(doc_no, violation): short originals and translations, too few themes, pros or cons outside two to three, no book."""
    rules = {
        "short_original": F.length("original") < 16,
        "short_translation": F.length("translation") < 20,
        "few_themes": F.size(F.array_distinct("themes")) < 2,
        "pros": ~F.size("pros").between(2, 3) | F.exists("pros", lambda x: F.length(x) < 10),
        "cons": ~F.size("cons").between(2, 3) | F.exists("cons", lambda x: F.length(x) < 10),
        "no_book": F.col("book") == "",
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return docs.select("doc_no", F.explode(broken).alias("violation"))


def cost_estimate(docs: DataFrame, fixed: int = 900, reply: int = 300) -> DataFrame:
    """Token totals of annotating every document: fresh input, cached input (a fixed prompt each but the first), output."""
    body = text.estimated_tokens(text.truncated(F.concat("title", "original", "translation")))
    n = F.count("*")
    return docs.agg(n.alias("items"), F.sum(body).alias("fresh_tokens"), (F.greatest(n - 1, F.lit(0)) * fixed).alias("cached_tokens"), (n * reply).alias("output_tokens"))

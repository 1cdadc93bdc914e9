"""Deduplication, merging, back-filling and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX, LEAST_CONTAINED = 120, 12
WHOLE_CORPUS = "corpus"
ANNOTATION_STRINGS = ["cause", "process", "decision", "outcome", "significance", "verdict", "verdict_why"]
ANNOTATION_ARRAYS = ["cast_list", "themes"]


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, which is what the keys of a keep-last merge ignore."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_last(docs: DataFrame, order: str = "doc_no") -> DataFrame:
    """Of documents with the same original the last by ``order``; documents without an original all stay.

    A row's text is replaced by its digest for the comparison, and the maximum is taken by partial
    aggregates, so a text that a third of all rows share gathers nowhere.
    """
    digest = F.md5(ascii_lower(F.coalesce("original", F.lit(""))))
    empty = F.coalesce("original", F.lit("")) == ""
    last = docs.where(~empty).groupBy(digest.alias("d")).agg(F.max(order).alias(order)).select(order)
    return docs.where(empty).unionByName(docs.where(~empty).join(last, order, "left_semi"))


def contained(docs: DataFrame, curated: DataFrame) -> DataFrame:
    """The documents without those that, by their first 120 characters, contain or are contained in a curated text of at least 12 characters.

    A contained text's first twelve characters occur in the text that holds it, so candidates come from an
    equality join on them and are then tested; no document meets every curated text.
    """
    def head(c: Column) -> Column:
        return F.substring(c, 1, PREFIX)

    def seeds(c: Column) -> Column:
        return F.when(F.length(c) >= LEAST_CONTAINED, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - LEAST_CONTAINED + 1), lambda i: F.substring(c, i, F.lit(LEAST_CONTAINED))))).otherwise(F.array().cast("array<string>"))

    ours = docs.select("doc_no", head(F.col("original")).alias("x")).where(F.length("x") >= LEAST_CONTAINED)
    theirs = curated.select(head(F.col("original")).alias("y")).where(F.length("y") >= LEAST_CONTAINED).distinct()
    first = lambda c: F.substring(c, 1, LEAST_CONTAINED)
    within = ours.withColumn("k", first("x")).join(theirs.select("y", F.explode(seeds(F.col("y"))).alias("k")), "k").where(F.contains("y", "x"))
    holding = ours.select("doc_no", "x", F.explode(seeds(F.col("x"))).alias("k")).join(theirs.withColumn("k", first("y")), "k").where(F.contains("x", "y"))
    return docs.join(within.select("doc_no").unionByName(holding.select("doc_no")).distinct(), "doc_no", "left_anti")


def manifest(docs: DataFrame, version: str) -> DataFrame:
    """(section, name, sha256, version) of each book: the hash of its documents' hashes in order."""
    each = F.sha2(F.concat_ws("\u0001", "doc_no", "title", "original", "translation"), 256)
    rows = docs.select("book", "doc_no", each.alias("h"))
    return rows.groupBy(F.coalesce(F.nullif(F.col("book"), F.lit("")), F.lit("史料")).alias("name")).agg(
        # order-free, so that a book's documents need not gather: sums of halves of the hashes
        F.sha2(F.concat_ws(",", F.count("*"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")), F.sum(F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(38,0)"))), 256).alias("sha256")
    ).select(F.lit("books").alias("section"), "name", "sha256", F.lit(version).alias("version"))


def manifest_diff(local: DataFrame, remote: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """(section, name, state): remote entries that are new or whose hash differs, compared without case.

    With ``real`` (name, sha256), the hashes of the files that are there, the corpus as a whole and flat
    files are compared with those, whatever the local manifest says; flat files by their bare name.
    """
    bare = F.when(F.col("section") == "files", F.regexp_extract("name", r"([^/\\]*)$", 1)).otherwise(F.col("name"))
    a = remote.select("section", bare.alias("name"), F.col("sha256").alias("r")).where("name <> ''")
    b = local.select("section", "name", F.col("sha256").alias("l"))
    rows = a.join(b, ["section", "name"], "left")
    if real is not None:
        by_file = (F.col("section") == "files") | (F.col("name") == WHOLE_CORPUS)
        rows = rows.join(real.select("name", F.col("sha256").alias("f")), "name", "left").withColumn("l", F.when(by_file, F.col("f")).otherwise(F.col("l")))
    return rows.where(~F.lower("r").eqNullSafe(F.lower("l"))).select("section", "name", F.when(F.col("l").isNull(), "new").otherwise("changed").alias("state"))


def readable(remote: DataFrame) -> DataFrame:
    """The manifest; one without any entry is broken, not up to date, and is refused."""
    if not remote.limit(1).count():
        raise ValueError("the manifest has no entry")
    return remote


def group_key(book: Column, stem: Column | None = None) -> Column:
    """A document's book, else its file's stem, else the general name."""
    return F.coalesce(F.nullif(book, F.lit("")), F.nullif(stem, F.lit("")) if stem is not None else F.lit(None).cast("string"), F.lit("史料"))


def merge_by_book(local: DataFrame, remote: DataFrame, whole: bool = False) -> DataFrame:
    """Local documents with each book that the remote side has replaced by the remote one; ``whole`` replaces everything."""
    if whole:
        return remote
    changed = remote.select(group_key(F.col("book")).alias("g")).distinct()
    kept = local.withColumn("g", group_key(F.col("book"))).join(changed, "g", "left_anti").drop("g")
    return kept.unionByName(remote)


def gates(unit: DataFrame) -> DataFrame:
    """One row: whether a unit may be merged: it has documents, none lacks both title and original, none holds a replacement character."""
    bad = F.contains(F.concat_ws("", "title", "original", "translation"), F.lit("�"))
    empty = (F.coalesce("title", F.lit("")) == "") & (F.coalesce("original", F.lit("")) == "")
    counts = unit.agg(F.count("*").alias("docs"), F.count_if(bad).alias("bad_char"), F.count_if(empty).alias("empty"))
    return counts.withColumn("passes", (F.col("docs") > 0) & (F.col("bad_char") == 0) & (F.col("empty") == 0))


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """The last annotation of each (book, chapter, item_index); rows without verdict are stale and count only where there is no other."""
    w = Window.partitionBy("book", "chapter", "item_index").orderBy(F.col("verdict").isNotNull().desc(), F.col("annotated_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ANNOTATION_STRINGS])
    return annotations.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def backfill(docs: DataFrame, annotations: DataFrame, additive: bool) -> DataFrame:
    """Documents with the annotation fields filled by (book, chapter, item_index); empty values are never written.

    ``additive`` fills only what is missing; otherwise a new value wins. Documents without partner stay as they are.
    """
    fields = ANNOTATION_STRINGS + ANNOTATION_ARRAYS
    new = latest_annotations(annotations).select("book", "chapter", "item_index", *[F.col(c).alias(f"new_{c}") for c in fields])
    rows = docs.join(new, ["book", "chapter", "item_index"], "left")

    def chosen(c: str) -> Column:
        missing = (lambda x: F.nullif(x, F.lit(""))) if c in ANNOTATION_STRINGS else (lambda x: F.when(F.size(x) > 0, x))
        a, b = missing(F.col(c)), missing(F.col(f"new_{c}"))
        empty = F.lit("") if c in ANNOTATION_STRINGS else F.array().cast("array<string>")
        return F.coalesce(*((a, b) if additive else (b, a)), empty).alias(c)

    return rows.select(*[chosen(c) if c in fields else F.col(c) for c in docs.columns])


def not_done(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Documents still to annotate: no annotation row with a verdict has their key."""
    done = annotations.where("verdict is not null").select("book", "chapter", "item_index").distinct()
    return docs.join(done, ["book", "chapter", "item_index"], "left_anti")


def closed_themes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Themes cut down to the label set, in order, each once."""
    names = labels.select("label").distinct().agg(F.collect_set("label").alias("all")).select("all").scalar()
    marked = docs.withColumn("closed", names)
    return marked.withColumn("themes", F.array_distinct(F.filter("themes", lambda t: F.array_contains("closed", t)))).drop("closed")


def selection(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(place, slug): the slugs asked for that the catalog has, compared without case, each once, in the order asked."""
    known = catalog.select("slug", F.lower("slug").alias("k")).where("slug <> ''").distinct()
    rows = asked.select("place", F.lower("slug").alias("k")).join(known, "k").groupBy("slug").agg(F.min("place").alias("at"))
    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).alias("place"), "slug")


def selected(docs: DataFrame, catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents of the books whose shards are selected; an empty selection selects none."""
    books = chosen.join(catalog.select("slug", "book"), "slug").select("book").distinct()
    return docs.join(books, "book", "left_semi")

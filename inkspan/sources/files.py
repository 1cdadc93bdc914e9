"""Files as rows: raw documents, pages, bytes; configuration with packaged defaults; selections, shards and catalogs; updates of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions import text

#: Deepest nesting of a small JSON text, least bytes of a unit that may be merged, the manifest's name for the corpus as a whole.
DEEPEST, LEAST_BYTES, WHOLE_CORPUS = 64, 32, "corpus"


def bytes_of(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name, length, sha256, content) of local files; folders are walked. A file is one row."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return rows.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), "content")


def read_pages(spark: SparkSession, folder: str, suffix: str = ".html") -> DataFrame:
    """(rel, name, html) of the pages below a folder whose name ends in ``suffix``, ``rel`` being the path within it; any depth, in order of ``rel``."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    path = F.url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B"))
    root = folder.rstrip("/").replace("file://", "")
    rel = F.substring_index(path, root + "/", -1)
    return rows.select(rel.alias("rel"), F.regexp_extract(rel, "([^/]*)$", 1).alias("name"), F.col("value").alias("html")).orderBy("rel")


def raw_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, pos, json): the JSON text of each document of corpus files, as it can be read again by itself."""
    items = T.ArrayType(T.StringType())
    root = T.StructType([T.StructField("items", items), T.StructField("books", T.ArrayType(T.StructType([T.StructField("items", items)])))])
    whole = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\\ufeff", "").alias("value"))
    parsed = F.from_json("value", root)
    nested = F.flatten(F.transform(F.filter(parsed["books"], lambda b: b["items"].isNotNull()), lambda b: b["items"]))
    listed = F.when(F.regexp_like("value", F.lit(r"^\s*\[")), F.from_json("value", items)).otherwise(F.when(F.size(nested) > 0, nested).otherwise(parsed["items"]))
    return whole.select("file", F.posexplode(listed).alias("pos", "json")).where("json is not null")


def depth(c: Column) -> Column:
    """How deep a JSON text is nested, strings left out."""
    signs = F.split(F.regexp_replace(F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        now = s["now"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(signs, start, step, lambda s: s["most"])


def small_json(c: Column, schema: str) -> Column:
    """A small JSON text by a schema; null where it is broken or nested deeper than ``DEEPEST``."""
    return F.when(F.try_parse_json(c).isNotNull() & (depth(c) <= DEEPEST), F.from_json(c, schema))


def external_or(external: Callable[[], DataFrame], default: DataFrame) -> DataFrame:
    """What a reader gives, or the default where its file is missing, cannot be read or gives no row; one row is looked for."""
    try:
        rows = external()
        return rows if rows.limit(1).count() else default
    except PySparkException:
        return default


def stop_words(spark: SparkSession, path: str | None = None) -> list[str]:
    """The stop words of a file, else the packaged ones: the longest first, then by code point. The list is configuration and is held by the driver."""
    from inkspan.sources.corpus_json import read_stop_words

    packaged = spark.createDataFrame([(w,) for w in text.STOP_WORDS], "word string")
    rows = external_or(lambda: read_stop_words(spark, path), packaged) if path else packaged
    return sorted({r["word"] for r in rows.limit(100_000).collect()}, key=lambda w: (-len(w), w))


def corpus_or_seed(spark: SparkSession, seed: DataFrame, *paths: str) -> DataFrame:
    """The documents of corpus files, or the seed where they give none."""
    from inkspan.sources.corpus_json import read_corpus

    return external_or(lambda: read_corpus(spark, *paths), seed)


def write_selection(chosen: DataFrame, path: str) -> None:
    """The slugs of (place, slug) in order as one JSON line ``{"selected": [...]}``; no row is a choice of nothing. A selection is as long as the catalog."""
    listed = F.coalesce(F.transform(F.array_sort(F.collect_list(F.struct("place", "slug"))), lambda x: x["slug"]), F.array().cast("array<string>"))
    chosen.agg(listed.alias("selected")).coalesce(1).write.mode("overwrite").json(path)


def write_shards(docs: DataFrame, catalog: DataFrame, path: str) -> DataFrame:
    """Writes the documents of each shard of the catalog under ``path``, a folder for each slug, and returns the catalog with the counts of what was written.

    ``bytes`` is what the files take; documents of no shard are not written.
    """
    names = catalog.select("slug", "book", "dynasty", "pairing").where("slug <> '' and book <> ''")
    docs.join(names.select("slug", "book"), "book").write.mode("overwrite").partitionBy("slug").json(path)
    counts = docs.groupBy("book").agg(F.count("*").cast("int").alias("docs"), F.sum(F.length("original") + F.length("translation")).alias("chars"))
    return with_bytes(names.join(counts, "book", "left").select("slug", "book", "dynasty", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("chars", F.lit(0)).alias("chars"), F.lit(0).cast("long").alias("bytes"), "pairing"), file_sizes(docs.sparkSession, path))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(slug, bytes) of a folder of shards: of folders ``slug=…`` and of files ``slug.json``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "length")
    slug = F.coalesce(F.nullif(F.regexp_extract("path", "/slug=([^/]+)/", 1), F.lit("")), F.regexp_extract("path", r"([^/]*)\.json$", 1))
    return rows.groupBy(slug.alias("slug")).agg(F.sum("length").alias("bytes"))


def with_bytes(catalog: DataFrame, sizes: DataFrame) -> DataFrame:
    """The catalog with the bytes of its files; counts are left alone, as is a shard without files."""
    new = sizes.select("slug", F.col("bytes").alias("found"))
    return catalog.join(new, "slug", "left").select(*[F.coalesce("found", "bytes").alias("bytes") if c == "bytes" else F.col(c) for c in catalog.columns])


def write_catalog(catalog: DataFrame, path: str) -> None:
    """The catalog as one JSON line, in order of slug; it has one entry a shard."""
    entry = F.struct("slug", *[c for c in catalog.columns if c != "slug"])
    catalog.agg(F.array_sort(F.collect_list(entry)).alias("books")).coalesce(1).write.mode("overwrite").json(path)


def unit_gates(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, reason): what is wrong with units to be merged, of (name, length, sha256, content); null where nothing is.

    A unit has ``LEAST_BYTES``, the hash its manifest names (if it names one, compared without case), begins with a bracket,
    holds no replacement character, parses as a whole and has at least one document. The first thing wrong is named.
    """
    wanted = manifest.select("name", F.lower("sha256").alias("wanted"))
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^\\ufeff", "")
    rows = files.join(wanted, "name", "left").withColumn("body", body)
    root = F.from_json("body", "items array<string>")["items"]
    n = F.when(F.regexp_like("body", F.lit(r"^\s*\[")), F.size(F.from_json("body", "array<string>"))).otherwise(F.size(root))
    reason = (
        F.when(F.col("length") < LEAST_BYTES, "too small")
        .when((F.coalesce("wanted", F.lit("")) != "") & (F.col("wanted") != F.lower("sha256")), "hash differs")
        .when(~F.regexp_like("body", F.lit(r"^\s*[\[{]")), "no JSON container")
        .when(F.contains("body", F.lit("�")), "replacement character")
        .when(F.try_parse_json("body").isNull(), "broken JSON")
        .when(F.coalesce(n, F.lit(0)) < 1, "no document")
    )
    return rows.select("name", reason.alias("reason"))


def flat_files(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(name, sha256, content, changed): local files with each that the remote side has otherwise replaced; files only one side has stay or are added."""
    a, b = (df.select("name", F.struct(F.lower("sha256").alias("sha256"), "content").alias(k)) for df, k in ((local, "l"), (remote, "r")))
    rows = a.join(b, "name", "full_outer")
    changed = F.col("r").isNotNull() & ~F.col("l.sha256").eqNullSafe(F.col("r.sha256"))
    best = F.when(changed, F.col("r")).otherwise(F.coalesce("l", "r"))
    return rows.select("name", best["sha256"].alias("sha256"), best["content"].alias("content"), changed.alias("changed"))


def must_reload(changed_docs: DataFrame, changed_files: DataFrame) -> bool:
    """Whether an update changed anything: documents or flat files."""
    return bool(changed_docs.limit(1).count() or changed_files.where("changed").limit(1).count())

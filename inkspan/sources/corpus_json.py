"""Reading the JSON containers: corpora, shards, configuration, annotations; and writing results, corpora and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions import text
from inkspan.sources.tables import ARRAYS, STRINGS

#: Keys under which a field may stand in a file, in order of precedence.
ALIASES = {"original": ["original", "text", "content"], "translation": ["translation", "modern", "trans"], "verdict_why": ["verdictWhy", "verdict_why"], "cast_list": ["cast", "cast_list"]}


def _keys(field: str) -> list[str]:
    return ALIASES.get(field, [field])


ITEM = T.StructType([T.StructField(k, T.StringType()) for f in STRINGS for k in _keys(f)] + [T.StructField(k, T.ArrayType(T.StringType())) for f in ARRAYS for k in _keys(f)])
ROOT = T.StructType([T.StructField("book", T.StringType()), T.StructField("items", T.ArrayType(ITEM)), T.StructField("books", T.ArrayType(T.StructType([T.StructField("book", T.StringType()), T.StructField("items", T.ArrayType(ITEM))])))])


def read_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents of files ``{"book":…, "items":[…]}``, ``{"books":[{"book":…, "items":[…]}]}`` or ``[…]``: (file, pos, fields).

    The items of ``books`` belong to their book; those of the root are read only where ``books`` has none.

    Missing and wrong-typed keys give '' or an empty array, unknown keys are ignored, a byte-order mark is
    blank. The root's book is inherited by items without one only where it stands before the items. A file
    that is no JSON gives no document. One file is one task's work; shards keep files small.
    """
    whole = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\\ufeff", "").alias("value"))
    is_list = F.regexp_like("value", F.lit(r"^\s*\["))
    mode = {"mode": "PERMISSIVE"}
    root = F.from_json("value", ROOT, mode)
    listed = F.from_json("value", T.ArrayType(ITEM), mode)
    book_first = F.regexp_like("value", F.lit(r'(?s)^\s*\{\s*(?:"(?!items")[^"]*"\s*:\s*"(?:[^"\\]|\\.)*"\s*,\s*)*?"book"\s*:'))
    rows = whole.select("file", F.when(~is_list & book_first, root["book"]).alias("root_book"), F.when(is_list, listed).otherwise(root["items"]).alias("items"), F.when(~is_list, root["books"]).alias("books"))
    owned = F.flatten(F.transform(F.filter("books", lambda b: b.isNotNull() & b["items"].isNotNull()), lambda b: F.transform(b["items"], lambda i: F.struct(b["book"].alias("owner"), i.alias("i")))))
    loose = F.transform("items", lambda i: F.struct(F.lit(None).cast("string").alias("owner"), i.alias("i")))
    each = F.when(F.coalesce(F.size(owned), F.lit(0)) > 0, owned).otherwise(loose)
    items = rows.select("file", "root_book", F.posexplode(each).alias("pos", "x")).select("file", "root_book", "pos", "x.owner", "x.i").where("i is not null")
    columns = []
    for f in STRINGS:
        value = F.coalesce(*[F.col(f"i.{k}") for k in _keys(f)], F.lit(""))
        if f == "book":
            value = F.coalesce(F.nullif(F.col("owner"), F.lit("")), F.nullif(value, F.lit("")), "root_book", F.lit(""))
        columns.append((text.verdict(value) if f == "verdict" else value).alias(f))
    for f in ARRAYS:
        columns.append(F.filter(F.coalesce(*[F.col(f"i.{k}") for k in _keys(f)], F.array().cast("array<string>")), lambda x: x.isNotNull()).alias(f))
    return items.select("file", "pos", *columns)


def numbered(docs: DataFrame, first: int = 0) -> DataFrame:
    """Documents with doc_no counted on from ``first`` in order of file and position.

    Counts by file are small and give each file its offset, so no single task sorts all documents.
    """
    counts = docs.groupBy("file").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    rows = docs.withColumn("at", at).join(counts.select("file", offset.alias("offset")), "file")
    return rows.select((F.col("offset") + F.col("at") + first).alias("doc_no"), *[c for c in docs.columns if c not in ("file", "pos")])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label, triggers, short_triggers) of a label file, in the form of the label table; no file entry, no row."""
    schema = "labels array<struct<label:string,triggers:array<string>,short_triggers:array<string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("labels")).where("label <> '' and length(label) <= 4")


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a stop-word file, the longest first."""
    rows = spark.read.schema("version string, words array<string>").json(path, multiLine=True).select(F.explode("words").alias("word")).where("word <> ''").distinct()
    return rows.orderBy(F.length("word").desc(), "word")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The shard catalog; rows without slug or book are dropped."""
    schema = "books array<struct<slug:string,book:string,dynasty:string,docs:int,chars:bigint,bytes:bigint,pairing:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("books")).where("slug <> '' and book <> ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(section, name, sha256, version) of a manifest file; a broken one gives no row."""
    raw = spark.read.schema("version string, books map<string,string>, files map<string,string>, paths map<string,string>").json(path, multiLine=True)
    return raw.select("version", F.explode(F.map_from_arrays(F.array(F.lit("books"), F.lit("files")), F.array(F.coalesce("books", F.create_map().cast("map<string,string>")), F.coalesce("files", F.create_map().cast("map<string,string>"))))).alias("section", "m")).select("section", F.explode("m").alias("name", "sha256"), "version")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation lines; lines that are no JSON are skipped."""
    schema = "book string, chapter string, `index` int, `cast` array<string>, cause string, process string, decision string, outcome string, significance string, verdict string, verdictWhy string, themes array<string>"
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return rows.withColumnsRenamed({"index": "item_index", "cast": "cast_list", "verdictWhy": "verdict_why"})


def read_selection(spark: SparkSession, path: str, default: list[str]) -> DataFrame:
    """(place, slug) of a selection file. Without a list the default holds; an empty list is a choice of nothing."""
    rows = spark.read.schema("selected array<string>").json(path, multiLine=True)
    return rows.select(F.posexplode(F.coalesce("selected", F.array(*[F.lit(s) for s in default]).cast("array<string>"))).alias("place", "slug"))


def write_corpus(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines by book, without empty annotation fields; refused before anything is written if a document is broken."""
    from inkspan.operators.merge import gates

    verdict = gates(docs).first()
    if not verdict["passes"]:
        raise ValueError(f"the documents fail the integrity gates: {verdict.asDict()}")
    optional = [c for c in docs.columns if c in ("cause", "process", "significance", "verdict", "verdict_why")]
    docs.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in optional}).write.mode("overwrite").partitionBy("book").option("ignoreNullFields", True).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest as one JSON line; it has one entry per book."""
    manifest.groupBy("version").agg(F.map_from_entries(F.collect_list(F.struct("name", "sha256"))).alias("books")).coalesce(1).write.mode("overwrite").json(path)


def append_annotations(rows: DataFrame, path: str) -> None:
    """Annotation lines added to those there."""
    rows.write.mode("append").json(path)

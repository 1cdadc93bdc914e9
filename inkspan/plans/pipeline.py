"""The search pipeline over one data directory, its parts built when asked for and shared between queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators import best, bridge, index, rank
from inkspan.sources import tables


def frames(t: Column) -> list[Column]:
    """A trigger phrase as it may be said: in a sentence, negated, with a character between, with too many between, with stop words within, and after a negation that is set apart."""
    rest = lambda n: F.substring(t, n, F.length(t))
    return [
        F.concat(F.lit("近来"), t, F.lit("，该当如何？")),
        F.concat(F.lit("并不"), t),
        F.concat(F.substring(t, 1, 1), F.lit("一"), rest(2), F.lit("！")),
        F.concat(F.substring(t, 1, 2), F.lit("三五七"), rest(3)),
        F.concat(F.lit("已经"), F.substring(t, 1, 1), F.lit("已经"), rest(2), F.lit("但是")),
        F.concat(F.lit("没有，"), t, F.lit("。再说")),
    ]


class Pipeline:
    """From cases to ranked passages. Postings are restricted to the terms that queries or labels ask for, and kept once built."""

    def __init__(self, spark: SparkSession, sf_dir: str, asked: str = "cases") -> None:
        self.spark, self.sf_dir, self.asked = spark, sf_dir, asked

    @cached_property
    def docs(self) -> DataFrame:
        return tables.documents(self.spark, self.sf_dir)

    @cached_property
    def cases(self) -> DataFrame:
        """The cases asked, the titles or translations of the records whose number is divisible by 50, or every trigger phrase in several wordings."""
        if self.asked == "cases":
            return tables.cases(self.spark, self.sf_dir)
        if self.asked == "phrases":
            framed = self.labels.select("label_ord", "trigger_ord", F.posexplode(F.array(*frames(F.col("trigger")))).alias("frame", "query"))
            return framed.select((F.col("label_ord") * 10_000 + F.col("trigger_ord") * 10 + F.col("frame")).cast("long").alias("case_no"), "query")
        column = {"titles": "title", "texts": "translation"}[self.asked]
        texts = tables.documents(self.spark, self.sf_dir, column).where("doc_no % 50 = 0")
        return texts.select(F.col("doc_no").alias("case_no"), F.col(column).alias("query"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.kept(tables.labels(self.spark, self.sf_dir))

    @cached_property
    def count(self) -> int:
        return tables.read(self.spark, self.sf_dir, "corpus_doc").select("doc_no").where("doc_no is not null").distinct().count()

    @property
    def n_docs(self) -> Column:
        return F.lit(float(self.count))

    @cached_property
    def norm(self) -> DataFrame:
        return self.kept(bridge.normalized(self.cases))

    @cached_property
    def wanted(self) -> DataFrame:
        """All terms that any query or label can ask the index for."""
        named = self.labels.select(F.explode(F.array_distinct(F.array("label", "trigger", "core"))).alias("term"))
        return bridge.query_grams(self.norm).unionByName(named).distinct()

    def records(self, *columns: str) -> DataFrame:
        return tables.documents(self.spark, self.sf_dir, *columns)

    @cached_property
    def indexed(self) -> DataFrame:
        return self.records(*tables.INDEXED, *tables.INDEXED_ARRAYS)

    @cached_property
    def stats(self) -> DataFrame:
        """Document frequencies of all that is wanted; only counts move."""
        return self.kept(index.counted(self.indexed, self.wanted))

    @cached_property
    def names(self) -> list[str]:
        """All labels; the label table is configuration of fixed size."""
        return sorted(r.label for r in self.labels.select("label").distinct().collect())

    @cached_property
    def pieces(self) -> DataFrame:
        """The postings of the terms that queries are left with, folded, with the verdicts and themes of the records."""
        return self.kept(index.folded(self.records(*tables.INDEXED, *tables.INDEXED_ARRAYS, "verdict"), self.terms, self.names))

    @cached_property
    def postings(self) -> DataFrame:
        return index.unfolded(self.pieces)

    @cached_property
    def label_postings(self) -> DataFrame:
        """The postings of the triggers of all labels."""
        return index.unfolded(self.kept(index.folded(self.indexed, self.labels.select(F.col("trigger").alias("term")))))

    @cached_property
    def triggers(self) -> DataFrame:
        return self.kept(bridge.trigger_stats(self.labels, self.stats))

    @cached_property
    def tokens(self) -> DataFrame:
        return self.kept(bridge.tokens(self.norm, self.stats, self.n_docs))

    @cached_property
    def matches(self) -> DataFrame:
        return bridge.matches(self.norm, self.triggers)

    @cached_property
    def expanded(self) -> DataFrame:
        return self.kept(bridge.expanded(self.matches, self.stats))

    @cached_property
    def concerns(self) -> DataFrame:
        return bridge.concerns(self.expanded)

    @cached_property
    def terms(self) -> DataFrame:
        return rank.query_terms(self.tokens, self.expanded)

    def lists(self, concerns: DataFrame | None = None, top: int = rank.POOL) -> DataFrame:
        """The first passages of each query, packed, re-ranked by concerns if these are given."""
        tables.shared_dir(self.spark)
        weighted = rank.weighted(self.terms, self.stats, self.n_docs).select("case_no", "term", "w")
        if self.pieces.columns == ["piece"]:
            n = self.stats.join(self.terms.select("term").distinct(), "term", "left_semi").agg(F.sum("df")).first()[0] or 0
            return best.lists(weighted, self.pieces, None, concerns, self.count, top, n_postings=n)
        return best.lists(weighted, self.postings, tables.documents(self.spark, self.sf_dir, "verdict", *["themes"][: concerns is not None]), concerns, self.count, top)

    def scored(self, top: int) -> DataFrame:
        """The first passages of each query by the score."""
        return best.unfolded(self.lists(top=top), top)

    def with_terms(self, shown: DataFrame) -> DataFrame:
        return rank.with_terms(shown, self.terms, self.postings)

    @cached_property
    def ordered(self) -> DataFrame:
        """The first passages of each query after re-ranking, packed; as many as the tiers look at."""
        return self.kept(self.lists(self.concerns))

    @cached_property
    def pool(self) -> DataFrame:
        return best.unfolded(self.ordered)

    @cached_property
    def placed(self) -> DataFrame:
        return self.kept(best.tiered(self.ordered))

    @cached_property
    def tiers(self) -> DataFrame:
        # a few rows a query, kept before their terms are looked up, which reads them twice
        return self.kept(self.with_terms(self.placed))

    @cached_property
    def reasons(self) -> DataFrame:
        """(case_no, doc_no, why) of the passages shown. Only labels are reasons, so only their postings are looked up."""
        labels = F.broadcast(self.expanded.select(F.col("label").alias("term")).distinct())
        named = rank.with_terms(self.placed, self.terms.join(labels, "term", "left_semi"), index.unfolded(self.pieces, self.names))
        return rank.why(named, self.expanded)

    def kept(self, df: DataFrame) -> DataFrame:
        """A part written to the checkpoint folder, so that what is built on it neither plans nor computes it again and an executor's loss costs nothing."""
        tables.shared_dir(self.spark)
        out = df.checkpoint()
        tables.freed(self.spark)
        return out


class Curated(Pipeline):
    """The same over the records of one book alone, with its own counts."""

    def __init__(self, spark: SparkSession, sf_dir: str, book: str) -> None:
        super().__init__(spark, sf_dir)
        self.book = book

    def records(self, *columns: str) -> DataFrame:
        return tables.documents(self.spark, self.sf_dir, "book", *columns).where(F.col("book") == self.book).drop("book")

    @cached_property
    def count(self) -> int:
        return self.records().count()


def release() -> None:
    """Forgets all pipelines, so that the next query builds its own parts."""
    _held.clear()


_held: dict[tuple[str, str, str], Pipeline] = {}


def pipeline(spark: SparkSession, sf_dir: str, asked: str = "cases") -> Pipeline:
    """The pipeline of a directory, kept while its Spark application runs."""
    key = (spark.sparkContext.applicationId, sf_dir, asked)
    if key not in _held:
        for other in [k for k in _held if k[:2] != key[:2]]:
            del _held[other]
        _held[key] = Pipeline(spark, sf_dir, asked)
    return _held[key]

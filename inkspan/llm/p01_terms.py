"""Problem 1: frequency of every distinct value or term.

Method: last-seen counters.  Tokens come ordered by record; for each term a counter keeps its
occurrences, its records and the record it was last seen in, and adds a record when the next token's
differs.  No set of records is kept for a term.  A record lies in one partition, so the counters of
different partitions add up, and only counters, not tokens, are hash-partitioned by term: a term that
occurs in a third of all records moves once per partition.

Themes are values with white space trimmed off; blanks are dropped.  A translation's terms are its
runs of letters A-Z a-z in lower case and every two adjacent characters in U+4E00-9FFF.

Defined cases: null and '' texts, null arrays and null or blank values give nothing; a value repeated
within one record adds occurrences, not records; an empty table gives no term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, codes, records, table

#: Fewer records than this are too rare; a larger share of records than this is too common.
RARE_BELOW, COMMON_ABOVE = 3, 0.2
#: Two-character terms held by a task before its counters are sent on; bounds its memory.
HELD = 2_000_000
LETTERS = re.compile("[A-Za-z]+")
HAN = 0x9FFF - 0x4E00 + 1


class LastSeen(dict):
    """Counters of terms: occurrences, records, last record."""

    def add(self, terms: list[str], record: int) -> None:
        for term in terms:
            c = self.get(term)
            if c is None:
                self[term] = [1, 1, record]
            else:
                c[0] += 1
                if c[2] != record:
                    c[1] += 1
                    c[2] = record


def merged(key: np.ndarray, occurrences: np.ndarray, recs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counters of equal keys added up."""
    o = np.argsort(key, kind="stable")
    key = key[o]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    return (key[first], np.add.reduceat(occurrences[o], first), np.add.reduceat(recs[o], first)) if len(key) else (key, occurrences, recs)


def pair_counters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent Han characters of texts, each text a record: last-seen counters over the sorted token column."""
    cp, lens, starts = codes(texts)
    c = cp.astype(np.int64) - 0x4E00
    han = (c >= 0) & (c < HAN)
    record = np.repeat(np.arange(len(texts)), lens)
    at = np.flatnonzero(han[:-1] & han[1:] & (record[:-1] == record[1:])) if len(c) else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    key = c[at] * HAN + c[at + 1]
    o = np.argsort(key, kind="stable")  # stable: a term's tokens stay ordered by record
    key, rec = key[o], record[at][o]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    unseen = new.copy()
    unseen[1:] |= rec[1:] != rec[:-1]
    first = np.flatnonzero(new)
    return key[first], np.diff(np.append(first, len(key))), np.add.reduceat(unseen.astype(np.int64), first)


def counters(df: DataFrame) -> DataFrame:
    """Of (doc_no, themes, translation): partial counters (field_name, term, occurrences, records), a map without shuffle."""

    def out(field: str, terms: list[str], occ: object, recs: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([field] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(occ, pa.int64()), pa.array(recs, pa.int64())], names=["field_name", "term", "occurrences", "records"])

    def pairs(held: list) -> pa.RecordBatch:
        key, occ, recs = merged(*map(np.concatenate, zip(*held)))
        cp = np.empty((len(key), 2), np.uint32)
        cp[:, 0], cp[:, 1] = key // HAN + 0x4E00, key % HAN + 0x4E00
        both = cp.tobytes().decode("utf-32-le")
        return out("translation", [both[i : i + 2] for i in range(0, len(both), 2)], occ, recs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        themes, words, held, n, base = LastSeen(), LastSeen(), [], 0, 0
        for batch in batches:
            for i, values in enumerate(batch.column("themes").to_pylist()):
                if values:
                    themes.add([t for v in values if v and (t := v.strip())], base + i)
            for row, texts in chunks(batch, "translation"):
                for i, t in enumerate(texts):
                    if found := LETTERS.findall(t):
                        words.add([w.lower() for w in found], base + row + i)
                held.append(pair_counters(texts))
                n += len(held[-1][0])
                if n > HELD:
                    held = [merged(*map(np.concatenate, zip(*held)))]
                    n = len(held[0][0])
                    if n > HELD:
                        yield pairs(held)
                        held, n = [], 0
            base += batch.num_rows
            for field, table in (("themes", themes), ("translation", words)):
                if len(table) > HELD:
                    yield out(field, list(table), [c[0] for c in table.values()], [c[1] for c in table.values()])
                    table.clear()
        if held:
            yield pairs(held)
        for field, table in (("themes", themes), ("translation", words)):
            yield out(field, list(table), [c[0] for c in table.values()], [c[1] for c in table.values()])

    return df.select("themes", "translation").mapInArrow(run, "field_name string, term string, occurrences long, records long")


def totals(df: DataFrame, key: str = "doc_no") -> DataFrame:
    """One row: the records with any theme and those with a translation, however often a row repeats.

    Only keys and flags move, no texts.
    """
    blank = r"(?U)^[\s\x1c-\x1f]*$"
    themed = F.exists("themes", lambda t: F.coalesce(~F.regexp_like(t, F.lit(blank)), F.lit(False)))
    flags = df.where(F.col(key).isNotNull()).select(key, F.coalesce(themed, F.lit(False)).alias("t"), F.coalesce(F.col("translation") != "", F.lit(False)).alias("x"))
    each = flags.groupBy(key).agg(F.max("t").alias("t"), F.max("x").alias("x"))
    return each.agg(F.count_if("t").alias("themes"), F.count_if("x").alias("translation"))


def term_counts(df: DataFrame, total: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """Every term of (doc_no, themes, translation), one row per doc_no, with its counts and its mark ('rare', 'common' or null).

    ``total`` is one row with the records that have any theme and a translation; it enters as scalars.
    """
    n = F.when(F.col("field_name") == "themes", total.select("themes").scalar()).otherwise(total.select("translation").scalar())
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n, "common")
    terms = counters(df).groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return terms.withColumn("mark", mark)


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every theme and every term of the translations with its occurrences, records and mark."""
    return term_counts(records(spark, sf_dir, "themes", "translation"), totals(table(spark, sf_dir, "corpus_doc")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked terms."""
    return p1_terms(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


_TERMS = r"""
WITH doc AS (SELECT doc_no, max_by(themes, loaded_at) AS themes, max_by(translation, loaded_at) AS translation
             FROM corpus_doc GROUP BY doc_no),
chars AS (SELECT doc_no, string_split(translation, '') AS c FROM doc WHERE translation <> ''),
tok AS (
  SELECT 'themes' AS field_name, doc_no, regexp_replace(regexp_replace(t, '^[\s\x{1c}-\x{1f}\p{Z}]+', ''), '[\s\x{1c}-\x{1f}\p{Z}]+$', '') AS term
  FROM (SELECT doc_no, unnest(themes) AS t FROM doc)
  UNION ALL
  SELECT 'translation', doc_no, lower(unnest(regexp_extract_all(translation, '[A-Za-z]+'))) FROM doc WHERE translation <> ''
  UNION ALL
  SELECT 'translation', doc_no, term FROM (
    SELECT doc_no, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS term FROM chars)
  WHERE regexp_full_match(term, '[\x{4E00}-\x{9FFF}]{2}')),
n AS (SELECT (SELECT count(DISTINCT doc_no) FROM tok WHERE field_name = 'themes' AND term <> '') AS themes,
             (SELECT count(*) FROM doc WHERE translation <> '') AS translation),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT doc_no) AS records FROM tok WHERE term <> '' GROUP BY ALL),
marked AS (
  SELECT field_name, term, occurrences, records,
         CASE WHEN records < 3 THEN 'rare'
              WHEN records > 0.2 * CASE field_name WHEN 'themes' THEN themes ELSE translation END THEN 'common' END AS mark
  FROM counted, n)
"""

SQL = {"p1_terms": _TERMS + "SELECT * FROM marked", "p1_found": _TERMS + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL"}

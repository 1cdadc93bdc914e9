"""Problem 3: splitting oversized items at natural boundaries.

Method: pointer doubling.  Every boundary of a text is joined to its farthest legal successor, the
overlap included; squaring the successor table finds all greedy cuts of all texts in a logarithmic
number of steps, without walking any text.

A piece ends at the farthest sentence or line end in reach; if there is none, at the farthest mark of
a clause, then at any other character that is no letter, Han character or digit; only a run of more
than ``LIMIT`` of those is cut inside (``hard``).  The next piece begins ``OVERLAP`` characters before,
or at the start of the last whole sentence, if that is nearer; where only a shorter repetition lets a
natural end be reached, it repeats less.

Defined cases: null, '' and texts within the limit give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codes, once, table
from .p07_sentences import BREAKS, sentence_spans

LIMIT, OVERLAP = 900, 60
#: Boundary classes, the strongest first.
SENTENCE, CLAUSE, MARK, HARD = 3, 2, 1, 0
CLAUSE_MARKS = ",，、､;；:：—…"

CLAUSE_CODES = np.array([ord(c) for c in CLAUSE_MARKS], np.uint32)
BREAK_CODES = np.array([ord(c) for c in BREAKS], np.uint32)

_tables: dict[str, np.ndarray] = {}


def alnum() -> np.ndarray:
    """By code point: whether it is a letter, Han character or digit."""
    if "alnum" not in _tables:
        _tables["alnum"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _tables["alnum"]


def boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where a text may be cut, 0 and its end among them, their strengths, and how much a piece after each repeats."""
    n = len(text)
    cp = codes([text])[0]
    strength = np.zeros(n + 1, np.int8)  # of the boundary before each character
    letter = alnum()[cp]
    strength[1:][~letter] = MARK
    strength[1:][np.isin(cp, CLAUSE_CODES)] = CLAUSE
    strength[1:][np.isin(cp, BREAK_CODES)] = SENTENCE
    back = np.full(n + 1, overlap, np.int64)
    for a, b in sentence_spans(text):
        strength[b] = SENTENCE
        back[b] = min(overlap, b - a)
    strength[0] = strength[n] = SENTENCE
    back[0] = 0
    cuts = np.flatnonzero(strength)
    for a in cuts[:-1][np.diff(cuts) > limit].tolist():  # the only runs that need hard cuts
        b = int(cuts[np.searchsorted(cuts, a) + 1])
        cuts = np.union1d(cuts, np.arange(a - min(a, int(back[a])) + limit, b, limit - overlap))
    return cuts, strength[cuts], np.minimum(back[cuts], cuts)


def successors(cuts: np.ndarray, kind: np.ndarray, back: np.ndarray, limit: int) -> np.ndarray:
    """For each boundary of one text the farthest legal end of the piece that follows it."""
    end = len(cuts) - 1
    reach = cuts - back + limit
    succ = np.full(len(cuts), -1, np.int64)
    for tier, upto in ((SENTENCE, reach), (CLAUSE, reach), (MARK, reach), (MARK, cuts + limit), (HARD, reach)):
        nodes = np.flatnonzero(kind >= tier)
        best = nodes[np.searchsorted(cuts[nodes], upto, "right") - 1]
        ok = (succ < 0) & (best > np.arange(len(cuts)))
        succ[ok] = best[ok]
    succ[cuts[end] <= reach] = end
    return succ


def pieces(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, ...]:
    """All pieces of the texts, each longer than ``limit``: text, start, end, whether the end is a hard cut."""
    node, kinds, backs, succ, size, base = [], [], [], [], [], 0
    for t in texts:
        cuts, kind, back = boundaries(t, limit, overlap)
        succ.append(successors(cuts, kind, back, limit) + base)
        base += len(cuts)
        node.append(cuts)
        kinds.append(kind)
        backs.append(back)
        size.append(len(cuts))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    cuts, kind, back, jump = map(np.concatenate, (node, kinds, backs, succ))
    step = jump.copy()
    first = np.cumsum(size) - np.array(size)
    own = np.repeat(np.arange(len(texts)), size)
    on = np.zeros(len(cuts), bool)
    on[first] = True
    while True:  # after k rounds ``jump`` leaps 2**k pieces and ``on`` has the first 2**k cuts of every text
        before = int(on.sum())
        on[jump[on]] = True
        jump = jump[jump]
        if int(on.sum()) == before:
            break
    at = np.flatnonzero(on & (step != np.arange(len(cuts))))
    to = step[at]
    start = np.maximum(cuts[at] - back[at], cuts[to] - limit)
    return own[at], start, cuts[to], kind[to] == HARD


def split(df: DataFrame, key: str = "doc_no", fields: tuple[str, ...] = ("original", "translation"), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text longer than ``limit``, numbered from 0, as (key, field_name, piece_no, piece_start, piece_end, cut); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for field in fields:
                texts = batch.column(field).to_pylist()
                big = [i for i, t in enumerate(texts) if t and len(t) > limit]
                own, start, end, hard = pieces([texts[i] for i in big], limit, overlap)
                number = np.arange(len(own)) - np.searchsorted(own, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[np.array(big, np.int64)[own]] if big else keys[:0]), pa.array([field] * len(own), pa.string()), pa.array(number), pa.array(start), pa.array(end), pa.array(np.where(hard, "hard", "natural").tolist(), pa.string())],
                    names=[key, "field_name", "piece_no", "piece_start", "piece_end", "cut"],
                )

    long = F.greatest(*[F.coalesce(F.length(c), F.lit(0)) for c in fields], F.lit(0)) > limit
    return df.where(long).select(key, *fields).mapInArrow(run, f"{key} long, field_name string, piece_no long, piece_start long, piece_end long, cut string")


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a text over the limit, each once: redelivered rows are dropped after the filter, so that short texts never move."""
    df = table(spark, sf_dir, "corpus_doc").select("doc_no", "loaded_at", *[F.when(F.length(c) > LIMIT, F.col(c)).alias(c) for c in ("original", "translation")])
    return once(df.where("original is not null or translation is not null"), "doc_no", "loaded_at", ["original", "translation"])


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all originals and translations longer than 900 characters."""
    return split(long_texts(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts longer than 900 and whether any of their pieces had to be cut inside a run (hard)."""
    hard = F.max(F.col("cut") == "hard")
    return p3_pieces(spark, sf_dir).groupBy("doc_no", "field_name").agg(F.when(hard, "hard").otherwise("natural").alias("cut"))


SQL = {
    "p3_found": r"""
WITH doc AS (SELECT doc_no, max_by(original, loaded_at) AS original, max_by(translation, loaded_at) AS translation FROM corpus_doc GROUP BY doc_no),
txt AS (SELECT doc_no, 'original' AS field_name, original AS t FROM doc UNION ALL SELECT doc_no, 'translation', translation FROM doc)
SELECT doc_no, field_name, CASE WHEN list_max(list_transform(regexp_extract_all(t, '[\p{L}\p{N}]+'), lambda x: length(x))) > 900 THEN 'hard' ELSE 'natural' END AS cut
FROM txt WHERE length(t) > 900
"""
}

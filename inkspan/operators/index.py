"""The inverted index: postings of grams, document frequencies, its size."""

from __future__ import annotations

import ctypes
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import text
from inkspan.operators.rank import TIERS
from inkspan.sources.tables import INDEXED, INDEXED_ARRAYS, small

#: Characters worked on at once, and terms up to which they are sent to all tasks as numbers; they are counted first.
SLICE_CHARS, SENT_TERMS = 1 << 20, 4_000_000
#: The word characters by number, from 1; they are fewer than 2 ** 15, so that a gram is one whole number.
LETTERS = np.concatenate([[0], *[np.arange(ord(a), ord(b) + 1) for a, b in re.findall("(.)-(.)", text.WORD)]]).astype(np.uint32)
NUMBER = np.zeros(1 << 16, np.int64)
NUMBER[LETTERS[1:]] = np.arange(1, len(LETTERS))
BITS = 15
GRAM = rf"\A[{text.WORD}]{{{text.GRAM_LENGTHS[0]},{text.GRAM_LENGTHS[-1]}}}\z"


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_no), each once: the 2-, 3- and 4-grams of all indexed fields. They cross neither fields nor blocks. A map without shuffle."""
    parts = [text.grams(F.col(c)) for c in INDEXED if c in docs.columns] + [text.array_grams(F.col(c)) for c in INDEXED_ARRAYS if c in docs.columns]
    return docs.select("doc_no", F.explode(F.array_distinct(F.concat(*parts))).alias("term"))


def wanted_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of some terms only; where these are few, all others are dropped before any shuffle."""
    return postings(docs).join(small(terms.select("term").distinct()), "term", "left_semi")


def frequencies(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def packed(x: object) -> bytes:
    raw = pickle.dumps(x, 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def opened(x: bytes) -> object:
    return pickle.loads(pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True))


def trimmed() -> None:
    """Gives freed memory back to the system: a task's Python worker stays for a minute, idle, while those of the next step run beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slot_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """A number below ``parts`` for each key, even."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def keys_of(terms: list[str]) -> np.ndarray:
    """Terms of two to four word characters as numbers."""
    key = np.zeros(len(terms), np.int64)
    for c in NUMBER[np.array(terms, "U4").view(np.uint32).reshape(-1, 4)].T if terms else []:
        key = np.where(c > 0, key << BITS | c, key)
    return key


def terms_of(keys: np.ndarray) -> pa.Array:
    """The terms of numbers."""
    c = LETTERS[keys[:, None] >> np.array([3, 2, 1, 0]) * BITS & (1 << BITS) - 1]
    for _ in range(2):  # shorter terms have no character at the front
        c = np.where(c[:, :1] == 0, np.roll(c, -1, axis=1), c)
    return pa.array(np.ascontiguousarray(c).view("U4").ravel().tolist(), pa.string())


class Terms:
    """A set of terms, found in texts without a string for each gram. ``keys`` lie by slot, so that a slot tells where to look."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - min(24, max(12, len(keys).bit_length() + 3)))
        slot = self.slot(keys)
        o = np.argsort(slot, kind="stable")
        self.keys, slot = keys[o], slot[o]
        #: The first key of each slot, and one key more that no gram is, at which empty slots point.
        self.first = np.full(1 << 64 - int(self.shift), len(keys), np.int32)
        here = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.first[slot[here]] = here
        self.known = np.append(self.keys, -1)
        self.crowd = int(np.diff(np.append(here, len(keys))).max(initial=0))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some grams are terms, and which terms."""
        i = self.first[self.slot(keys)]
        at = np.flatnonzero(i < len(self.keys))
        i, left = i[at], keys[at]
        same = self.known[i] == left
        rest = np.flatnonzero(~same)
        for _ in range(1, self.crowd):  # the others of the slot; past it lie those of other slots, which are never the same
            i[rest] = np.minimum(i[rest] + 1, len(self.keys))
            found = self.known[i[rest]] == left[rest]
            same[rest[found]] = True
            rest = rest[~found]
        return at[same], i[same]

    def within(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms stand in code points, and which; text by text, in pieces that overlap by what a gram is longer than one."""
        places, found = [], []
        for at in range(0, len(cp), SLICE_CHARS):
            piece = cp[at : at + SLICE_CHARS + text.GRAM_LENGTHS[-1] - 1]
            c = numbers_of(piece)
            key, ok = c, c > 0
            for n in range(1, text.GRAM_LENGTHS[-1]):
                if len(c) <= n:
                    break
                key, ok = key[:-1] << BITS | c[n:], ok[:-1] & (c[n:] > 0)
                here = np.flatnonzero(ok[:SLICE_CHARS])
                same, i = self.find(key[here])
                places.append(here[same] + at)
                found.append(i)
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *found])

    def by_row(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each stretch of (doc_no, body): the numbers of its documents, and the pairs of document and term in it, each once, by term."""
        numbers = batch.column(0).to_numpy()
        for first, starts, cp in stretches(batch.column(1)):
            n = len(starts)
            place, term = self.within(cp)
            row = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.append(starts, len(cp))))[place]
            pair = term * n + row
            del place, term, row
            pair.sort()  # a sort and a comparison take far less than np.unique
            term, row = np.divmod(pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair, n)
            yield numbers[first : first + n], row, term


def stretches(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about a slice's characters: the first's place, where each starts, and the code points of all."""
    body = texts.cast(pa.large_binary())
    first, to = 0, len(body)
    offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + to + 1] if to else []
    while first < to:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 3 * SLICE_CHARS)) - 1)
        raw = memoryview(body.buffers()[2])[offsets[first] : offsets[last]] if offsets[last] > offsets[first] else b""
        byte = np.frombuffer(raw, np.uint8)
        starts = np.append(0, np.cumsum(byte & 0xC0 != 0x80, dtype=np.int64))[offsets[first:last] - offsets[first]]
        yield first, starts, np.frombuffer(str(raw, "utf-8", "replace").encode("utf-32-le"), np.uint32)
        first = last


def numbers_of(cp: np.ndarray) -> np.ndarray:
    """Code points as numbers of word characters, 0 for any other."""
    return NUMBER[np.where(cp < len(NUMBER), cp, 0)]


def gram_keys(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of all grams of n characters."""
    if len(c) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, ok = np.zeros(len(c) - n + 1, np.int64), np.ones(len(c) - n + 1, bool)
    for i in range(n):
        x = c[i : len(c) - n + 1 + i]
        key, ok = key << BITS | x, ok & (x > 0)
    at = np.flatnonzero(ok)
    return at, key[at]


def document_counts(c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all grams of some documents, rising, and how many of the documents hold each."""
    each = []
    for n in text.GRAM_LENGTHS:
        at, key = gram_keys(c, n)
        row = np.searchsorted(starts, at, "right") - 1
        o = np.lexsort((row, key))
        key, row = key[o], row[o]
        new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
        each.append(np.unique(key[new], return_counts=True))
    return np.concatenate([k for k, _ in each]), np.concatenate([n for _, n in each])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of counts by key."""
    keys, which = np.unique(np.concatenate([np.zeros(0, np.int64), *[k for k, _ in parts]]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, which, np.concatenate([np.zeros(0, np.int64), *[x for _, x in parts]]))
    return keys, n


def body_of(docs: DataFrame) -> Column:
    """The indexed fields of a document, each on lines of its own."""
    parts = [F.col(c) for c in INDEXED if c in docs.columns] + [F.array_join(c, "\n") for c in INDEXED_ARRAYS if c in docs.columns]
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def bodies(docs: DataFrame) -> DataFrame:
    return docs.select("doc_no", body_of(docs).alias("body"))


def sent(terms: DataFrame) -> np.ndarray | None:
    """The terms that the index can have, as numbers; none if they are too many to be sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch.column(0).to_pylist()))], names=["key"])

    rows = terms.where(F.regexp_like("term", F.lit(GRAM))).select("term").distinct().mapInArrow(run, "key long").limit(SENT_TERMS + 1).toArrow()
    return rows.column(0).to_numpy() if rows.num_rows <= SENT_TERMS else None


def counted(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of some terms; those in no document have no row. Each task sends one count a term."""
    if (keys := sent(terms)) is None:
        return frequencies(wanted_postings(docs, terms))
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(held.value)
        df = np.zeros(len(known.keys), np.int64)
        for batch in batches:
            for _, _, term in known.by_row(batch):
                df += np.bincount(term, minlength=len(df))
        at = np.flatnonzero(df)
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([terms_of(known.keys[some]), pa.array(df[some])], names=["term", "n"])
        del known, df, at
        trimmed()

    return bodies(docs).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def folded(docs: DataFrame, terms: DataFrame, themes: list[str] | None = None) -> DataFrame:
    """(data): the postings of some terms, compressed, for a checkpoint; ``unfolded`` opens them.

    If themes are given, it is (piece): the verdicts of the documents and those of their themes are beside the
    postings, for ``best.blocks``; but for terms too many to be sent.
    """
    keys = sent(terms)
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def pack(numbers: np.ndarray, row: np.ndarray, key: np.ndarray, n: np.ndarray, *more: object) -> pa.Array:
        short = np.uint16 if len(numbers) <= 1 << 16 else np.int32
        return pa.array([packed((numbers, row.astype(short), key, n, *more))], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(held.value)
        for batch in batches:
            to = 0
            for numbers, row, term in known.by_row(batch):
                at, to = to, to + len(numbers)
                if len(row):
                    start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                    distinct, n = term[start], np.diff(np.append(start, len(term)))
                    more = []
                    if themes is not None:
                        t = batch.column("themes").slice(at, to - at)
                        d = t.flatten().dictionary_encode()
                        of = np.repeat(np.arange(to - at), pc.list_value_length(t).to_numpy(zero_copy_only=False))
                        more = [batch.column("grade").slice(at, to - at).to_numpy().astype(np.int8), of.astype(np.int32), d.indices.to_numpy(), d.dictionary.to_pylist()]
                    yield pa.RecordBatch.from_arrays([pack(numbers, row, known.keys[distinct], n, *more)], names=[name])
            numbers = row = term = start = distinct = n = None
        del known
        trimmed()

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = keys_of(batch.column("term").to_pylist())
                o = np.argsort(key, kind="stable")
                yield pa.RecordBatch.from_arrays([pack(batch.column("doc_no").to_numpy(), o, *np.unique(key, return_counts=True))], names=["data"])

    if keys is None:
        return wanted_postings(docs, terms).mapInArrow(plain, "data binary")
    name, rows = "data", bodies(docs)
    if themes is not None:
        grade = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("verdict")).cast("int")
        held_themes = F.filter(F.array_distinct("themes"), lambda t: t.isin(themes))
        name, rows = "piece", docs.select("doc_no", body_of(docs).alias("body"), grade.alias("grade"), held_themes.alias("themes"))
    return rows.mapInArrow(run, f"{name} binary")


def unfolded(data: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(term, doc_no) of ``folded`` postings, of all terms or of a few only."""
    few = None if only is None else keys_of([t for t in only if re.search(GRAM.replace(r"\z", r"\Z"), t)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                numbers, row, key, n, *_ = opened(x)
                if few is not None:
                    here = np.isin(key, few)
                    key, n, row = key[here], n[here], row[np.repeat(here, n)]
                key = np.repeat(key, n)
                for at in range(0, len(key), 100_000):
                    distinct, which = np.unique(key[at : at + 100_000], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([terms_of(distinct).take(pa.array(which)), pa.array(numbers[row[at : at + 100_000]])], names=["term", "doc_no"])

    return data.mapInArrow(run, "term string, doc_no long")


def size_estimate(post: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: terms, postings, the largest document frequency, documents and estimated bytes of the index."""
    stats = frequencies(post)
    n = docs.agg(F.count("*").alias("n")).scalar()
    return stats.agg(
        F.count("*").alias("terms"),
        F.sum("df").alias("postings"),
        F.max("df").alias("max_df"),
        n.alias("docs"),
        (F.sum(F.length("term") * 2 + 24 + F.col("df") * 4 + 32) + n * 80).alias("bytes"),
    )

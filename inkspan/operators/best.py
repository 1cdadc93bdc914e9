"""The first passages of every query, found without a row for each pair of a query and a passage.

Passages are cut into blocks, by hash or as they lie in the folded index, queries into groups; each task holds
one group against one block after the other and keeps the first passages of each query.  Postings and queries
lie in the checkpoint folder and are read from there; a folded index is made into blocks without a shuffle.  A query's terms are taken by falling weight: what
a passage with only the terms that are left can reach is bounded, and once enough passages are above that
bound, the rest of the terms are only looked up for the passages found.  No passage of the first is lost.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from inkspan.operators.index import keys_of, trimmed
from inkspan.operators.rank import EXTRA_WEIGHT, FLOOR, MIN_COVERAGE, POOL, TIERS, TOP
from inkspan.sources.tables import small

#: Passages of a block and queries of a group, about; groups at least, so that all cores are busy.
BLOCK_DOCS, GROUP_CASES, LEAST_GROUPS = 250_000, 10_000, 12
#: Postings of a block of a folded index, about; at twice as many a block is closed.
BLOCK_POSTINGS = 5_000_000
#: Bytes of a packed block that travel in one row; the JVM makes several copies of a row.
CHUNK = 1 << 18
#: An entry of a list.
ENTRY = np.dtype([("doc_no", "<i8"), ("score", "<f8"), ("n_terms", "<i4"), ("coverage", "<i4"), ("verdict", "<i1")])
#: Sums of other orders differ by less.
SLACK = 1e-6


def packed(x: object) -> bytes:
    raw = pickle.dumps(x, 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def opened(x: bytes) -> object:
    return pickle.loads(pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True))


CHUNKS = "data binary, last boolean"


def chunks(x: object, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Something packed, in rows (data, last) of ``CHUNK`` bytes, or in one."""
    data = packed(x)
    size = len(data) if whole else CHUNK
    for at in range(0, len(data), size):
        yield pa.RecordBatch.from_pydict({"data": pa.array([data[at : at + size]], pa.binary()), "last": pa.array([at + size >= len(data)])})


def cut(df: DataFrame, parts: int, key: str, made: object) -> DataFrame:
    """``made`` of the columns of each part, as arrays, strings as numbers into ``terms``; packed, in a partition of its own, in ``chunks``; queries in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held: list[dict] = []
        for batch in batches:
            if batch.num_rows:
                d = batch.column("term").dictionary_encode()
                number = np.array([codes.setdefault(t, len(codes)) for t in d.dictionary.to_pylist()], np.int32)
                rest = {c: batch.column(c).to_numpy() for c in batch.schema.names if c not in (key, "term")}
                held.append({"term": number[d.indices.to_numpy()]} | rest)
        if held:
            x = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held.clear()
            yield from chunks(made(x, list(codes)), made is grouped)

    return df.repartitionById(parts, key).mapInArrow(run, CHUNKS)


def indexed(x: dict, terms: list[str]) -> tuple:
    """Passages by rising doc_no, names of the posting lists, where they start, and the places of their passages."""
    docs, local = np.unique(x["doc_no"], return_inverse=True)
    key = x["kind"].astype(np.int64) * len(terms) + x["term"]
    o = np.lexsort((local, key))
    key = key[o]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    names = [(k // len(terms), terms[k % len(terms)]) for k in key[first].tolist()]
    return docs, names, first, local[o].astype(np.int32)


def grouped(x: dict, terms: list[str]) -> dict[tuple, list[int]]:
    """Queries by what they ask, equal ones together: weighted terms and labels."""
    o = np.lexsort((x["term"], x["kind"], x["case_no"]))
    no, asked = x["case_no"][o], list(zip(x["kind"][o].tolist(), x["w"][o].tolist(), [terms[t] for t in x["term"][o].tolist()]))
    first = np.flatnonzero(np.append(True, no[1:] != no[:-1])).tolist()
    out: dict[tuple, list[int]] = {}
    for at, to in zip(first, [*first[1:], len(no)]):
        out.setdefault(tuple(sorted(asked[at:to])), []).append(int(no[at]))
    return out


def joined(pieces: list[tuple]) -> dict:
    """A block of pieces of a folded index: its passages by rising doc_no, with verdicts, where the postings of each key start, and the passages of each theme."""
    docs = np.concatenate([p[0] for p in pieces])
    base = np.cumsum([0, *[len(p[0]) for p in pieces]])
    o = np.argsort(docs)
    place = np.empty(len(docs), np.int64)
    place[o] = np.arange(len(docs))
    keys, which = np.unique(np.concatenate([p[2] for p in pieces]), return_inverse=True)
    # piece by piece, since a block has millions of postings
    code = np.empty(sum(len(p[1]) for p in pieces), np.int64)
    at = k = 0
    for p, b in zip(pieces, base.tolist()):
        here = code[at : at + len(p[1])]
        np.add(np.repeat(which[k : k + len(p[2])] * len(docs), p[3]), place[p[1].astype(np.int64) + b], out=here)
        at, k = at + len(p[1]), k + len(p[2])
    code.sort()
    first = np.searchsorted(code, np.arange(len(keys) + 1) * len(docs))
    themes: dict[str, list] = {}
    for (*_, of, theme, names), b in zip(pieces, base.tolist()):
        for i, t in enumerate(names):
            themes.setdefault(t, []).append(place[of[theme == i] + b])
    grade = np.concatenate([p[4] for p in pieces])[o]
    code %= len(docs)
    return {"docs": docs[o], "keys": keys, "first": first, "local": code.astype(np.int32), "verdict": grade, "themes": {t: np.concatenate(x) for t, x in themes.items()}}


def blocks(pieces: DataFrame, parts: int) -> DataFrame:
    """A folded index as blocks, packed, in ``chunks``; ``parts`` blocks or more. Pieces that lie together stay together, so none is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs = n = 0
        for batch in batches:
            for x in batch.column(0):
                held.append(opened(x.as_py()))
                docs, n = docs + len(held[-1][0]), n + len(held[-1][1])
                if n >= 2 * BLOCK_POSTINGS or docs >= 2 * BLOCK_DOCS:
                    yield from chunks(joined(held))
                    held, docs, n = [], 0, 0
        if held:
            yield from chunks(joined(held))
        held.clear()
        trimmed()

    return pieces.coalesce(parts).mapInArrow(run, CHUNKS)


class Block:
    """Passages with their verdicts and the postings of each term and theme; numbered by rising doc_no."""

    def __init__(self, docs: np.ndarray, names: list, first: np.ndarray, local: np.ndarray, verdict: np.ndarray | None = None) -> None:
        self.docs = docs
        self.post = dict(zip(names, np.split(local, first[1:])))
        self.verdict = np.zeros(len(docs), np.int8) if verdict is None else verdict
        for i, v in enumerate(TIERS, 1):
            self.verdict[self.post.get((2, v), [])] = i
        self.bits: dict[str, np.ndarray] = {}
        self.score, self.n = np.zeros(len(self.docs)), np.zeros(len(self.docs), np.int32)

    @classmethod
    def of(cls, x: dict, terms: list[str], keys: np.ndarray) -> Block:
        """A block of ``joined`` pieces, with the terms that are asked for."""
        block = cls(x["docs"], [], np.zeros(1, np.int64), x["local"], x["verdict"])
        i = np.minimum(np.searchsorted(x["keys"], keys), len(x["keys"]) - 1)
        first = x["first"]
        for k in np.flatnonzero(x["keys"][i] == keys).tolist():
            block.post[0, terms[k]] = x["local"][first[i[k]] : first[i[k] + 1]]
        block.post |= {(1, t): at for t, at in x["themes"].items()}
        return block

    def has(self, term: str, ids: np.ndarray) -> np.ndarray:
        """Which of the passages, by rising number, hold a term. Bits are kept only where they take less than the list."""
        at = self.post[0, term]
        if 32 * len(at) < len(self.docs):
            found = np.zeros(len(ids), bool)
            i = np.searchsorted(ids, at.astype(ids.dtype))
            at, i = at[i < len(ids)], i[i < len(ids)]
            found[i[ids[i] == at]] = True
            return found
        if term not in self.bits:
            b = np.zeros(len(self.docs), bool)
            b[at] = True
            self.bits[term] = np.packbits(b, bitorder="little")
        return (self.bits[term][ids >> 3] >> (ids & 7).astype(np.uint8) & 1).astype(bool)

    def first(self, terms: list[tuple[float, str]], labels: list[str], top: int, extra: float = EXTRA_WEIGHT, digits: int = 9, by_terms: bool = True, least: float = -np.inf) -> np.ndarray:
        """The first passages for weighted terms, re-ranked by the labels covered. ``extra`` is the part that terms beside the best count with.

        Without labels, passages of a score below ``least`` may be left out.
        """
        terms = sorted(((w, t) for w, t in terms if (0, t) in self.post), key=lambda x: -x[0])
        score, n, ids = self.score, self.n, np.zeros(0, np.int32)
        for i, (w, t) in enumerate(terms):
            at = self.post[0, t]
            # the first term found is the one of the largest weight
            score[at] += np.where(n[at] == 0, w, w * extra)
            n[at] += 1
            rest = [x for x, _ in terms[i + 1 :]]
            if not labels and rest:
                ids = np.flatnonzero(n)
                bound = rest[0] + extra * sum(rest[1:]) + SLACK
                if least > bound or len(ids) >= top and np.partition(score[ids], len(ids) - top)[len(ids) - top] > bound:
                    for v, u in terms[i + 1 :]:
                        more = ids[self.has(u, ids)]
                        score[more] += v * extra
                        n[more] += 1
                    break
        else:
            ids = np.flatnonzero(n)
        s, k = np.round(score[ids], digits), n[ids].copy()
        score[ids], n[ids] = 0, 0
        covered = np.zeros(len(ids), np.int32)
        if labels:
            cover = np.zeros(len(self.docs), np.int32)
            for label in labels:
                cover[self.post.get((1, label), [])] += 1
            covered = cover[ids]
        o = leading((graded(covered, len(labels)), s, k if by_terms else np.zeros(len(k))), top)
        out = np.empty(len(o), ENTRY)
        out["doc_no"], out["score"], out["n_terms"], out["coverage"], out["verdict"] = self.docs[ids[o]], s[o], k[o], covered[o], self.verdict[ids[o]]
        return out


def leading(keys: tuple[np.ndarray, ...], top: int) -> np.ndarray:
    """Places of the first ``top`` by the keys, each the larger the better, then by place; in order."""
    sure, open_, need = [], np.arange(len(keys[0])), top
    for key in keys:
        if len(open_) <= need:
            break
        x = key[open_]
        least = np.partition(x, len(x) - need)[len(x) - need]
        sure.append(open_[x > least])
        need -= len(sure[-1])
        open_ = open_[x == least]
    o = np.concatenate([*sure, open_[:need]])
    return o[np.lexsort((o, *[-k[o] for k in reversed(keys)]))]


def lists(terms: DataFrame, post: DataFrame, docs: DataFrame, concerns: DataFrame | None, n_docs: int, top: int = POOL, extra: float = EXTRA_WEIGHT, digits: int = 9, by_terms: bool = True, n_postings: int = 0) -> DataFrame:
    """(case_no, data): the first ``top`` passages of each query that has any, as ``ENTRY`` in the order of ``rank.situated`` (of ``rank.ranked`` without concerns).

    ``terms`` is (case_no, term, w), ``post`` has the postings of these terms, ``docs`` has verdict and themes.
    ``post`` may also be a folded index with verdicts and themes, of ``n_postings``.
    """
    asked = terms.select(F.lit(0).alias("kind"), "case_no", "term", "w")
    packed_index = post.columns == ["piece"]
    if not packed_index:
        found = post.select("doc_no", F.lit(0).alias("kind"), "term")
        found = found.unionByName(docs.where(F.col("verdict").isin(*TIERS)).select("doc_no", F.lit(2).alias("kind"), F.col("verdict").alias("term")))
    if concerns is not None:
        wanted = concerns.select("case_no", F.explode(F.array_distinct("concerns")).alias("term"))
        asked = asked.unionByName(wanted.select(F.lit(1).alias("kind"), "case_no", "term", F.lit(0.0).alias("w")))
        if not packed_index:
            themed = docs.select("doc_no", F.explode(F.array_distinct("themes")).alias("term"))
            found = found.unionByName(themed.join(small(wanted.select("term").distinct()), "term", "left_semi").select("doc_no", F.lit(1).alias("kind"), "term"))
    parts = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias("part")
    n_blocks = -(-max(1, n_docs) // BLOCK_DOCS)
    if packed_index:
        left = blocks(post, max(n_blocks, -(-n_postings // BLOCK_POSTINGS))).checkpoint()
    else:
        left = cut(found.select("*", parts("doc_no", n_blocks)), n_blocks, "part", indexed).checkpoint()
    groups = max(LEAST_GROUPS, -(-terms.select("case_no").distinct().count() // GROUP_CASES))
    right = cut(asked.select("*", parts("case_no", groups)), groups, "part", grouped).select(F.col("data").alias("asked")).checkpoint()

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, bytes]]:
        asked, held, block_parts = None, {}, []
        for data, last, cases in rows:
            block_parts.append(data)
            if not last:
                continue
            data = b"".join(block_parts)
            block_parts.clear()
            if asked is None:
                asked = opened(cases)
                names = sorted({t for key in asked for kind, _, t in key if not kind})
                keys = keys_of(names)
            x = opened(data)
            block = Block.of(x, names, keys) if isinstance(x, dict) else Block(*x)
            for key in asked:
                labels = [t for kind, _, t in key if kind]
                # what scores less than the last of a full list can't come into it
                least = held[key]["score"][-1] if not labels and key in held and len(held[key]) == top else -np.inf
                got = block.first([(w, t) for kind, w, t in key if not kind], labels, top, extra, digits, by_terms, least)
                if len(got):
                    held[key] = merged([held[key], got], len(labels), top, by_terms) if key in held else got
            del x, block, data
            trimmed()
        for key, x in held.items():
            for no in asked[key]:
                yield no, x.tobytes()

    # a task takes all blocks one after the other against its group, which alone is held; the parts of a block come in their order; rows, since Arrow would put all blocks into one batch
    pairs = left.coalesce(1).hint("shuffle_replicate_nl").crossJoin(right).select("data", "last", F.when(F.col("last"), F.col("asked")).alias("asked"))
    return terms.sparkSession.createDataFrame(pairs.rdd.mapPartitions(run), "case_no long, data binary", verifySchema=False)


def graded(covered: np.ndarray, labels: int) -> np.ndarray:
    """Labels covered where they are enough to come first, else 0."""
    return np.where(covered >= min(max(labels, 1), MIN_COVERAGE), covered, 0)


def merged(parts: list[np.ndarray], labels: int, top: int, by_terms: bool = True) -> np.ndarray:
    """The first of the lists of several blocks."""
    x = np.concatenate(parts)
    x = x[np.argsort(x["doc_no"], kind="stable")]
    return x[leading((graded(x["coverage"], labels), x["score"], x["n_terms"] if by_terms else np.zeros(len(x))), top)]


def shown(case_no: list[int], chosen: list[np.ndarray], **more: list) -> pa.RecordBatch:
    x = np.concatenate(chosen) if chosen else np.empty(0, ENTRY)
    size = [len(c) for c in chosen]
    columns = {"case_no": pa.array(np.repeat(np.array(case_no, np.int64), size)), "doc_no": pa.array(x["doc_no"]), "score": pa.array(x["score"]), "n_terms": pa.array(x["n_terms"]), "coverage": pa.array(x["coverage"])}
    return pa.RecordBatch.from_pydict(columns | more)


def unfolded(found: DataFrame, top: int = POOL) -> DataFrame:
    """(case_no, doc_no, score, n_terms, coverage, rank) of lists, the first ``top`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                each = [np.frombuffer(d, ENTRY)[:top] for d in some.column("data").to_pylist()]
                rank = np.concatenate([np.arange(1, len(e) + 1, dtype=np.int32) for e in each])
                yield shown(some.column("case_no").to_pylist(), each, rank=pa.array(rank))

    return found.mapInArrow(run, "case_no long, doc_no long, score double, n_terms int, coverage int, rank int")


def tiered(found: DataFrame, top: int = TOP) -> DataFrame:
    """``rank.tiered`` of lists: (case_no, doc_no, score, n_terms, coverage, rank, verdict, slot, graded)."""
    top = top if top > 0 else TOP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, rank, verdict, slot, graded = [], [], [], [], []
            for d in batch.column("data").to_pylist():
                x = np.frombuffer(d, ENTRY)[:POOL]
                able = x["score"] >= x["score"].max() * FLOOR
                hit = [np.flatnonzero(able & (x["verdict"] == v))[:1] for v in range(1, len(TIERS) + 1)]
                at = np.concatenate(hit)
                graded += [len(at) > 0] * (len(at) or min(top, len(x)))
                at = at if len(at) else np.arange(min(top, len(x)))
                each.append(x[at])
                rank += (at + 1).tolist()
                verdict += [("", *TIERS)[v] for v in x["verdict"][at]]
                slot += range(1, len(at) + 1)
            more = {"rank": pa.array(rank, pa.int32()), "verdict": pa.array(verdict, pa.string()), "slot": pa.array(slot, pa.int32()), "graded": pa.array(graded, pa.bool_())}
            yield shown(batch.column("case_no").to_pylist(), each, **more)

    return found.mapInArrow(run, "case_no long, doc_no long, score double, n_terms int, coverage int, rank int, verdict string, slot int, graded boolean")

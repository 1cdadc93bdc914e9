"""How well labels and trigger phrases point to what they stand for."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions import text
from inkspan.operators import index
from inkspan.operators.bridge import HIGH_DF, SINGLE_COST
from inkspan.sources.tables import freed, shared_dir, small

# Fixed values of the audit.
LEAST_P, MIN_DF, PHRASE_DF, PER_LABEL = 0.60, 2, 3, 20
MINED = ("title", "translation", "significance", "cause", "process", "decision", "outcome", "original")

HAN = re.compile("[一-鿿㐀-䶿]+")
STOPS = frozenset(text.STOP_WORDS)
#: Numbers up to this are Han characters; documents of a part.
HAN_LETTERS, PART_DOCS = int(index.NUMBER[[ord("鿿"), ord("䶿")]].max()), 10_000


def themed(docs: DataFrame) -> DataFrame:
    """(doc_no, label): the distinct themes of each document."""
    return docs.select("doc_no", F.explode(F.array_distinct("themes")).alias("label"))


def directedness(pairs: DataFrame, post: DataFrame, docs: DataFrame) -> DataFrame:
    """For (label, term): the documents with the term, those of them with the label as a theme, and the share; 0 without documents."""
    found = pairs.select("label", "term").distinct().join(post, "term")
    marked = found.join(themed(docs).withColumn("has", F.lit(1)), ["doc_no", "label"], "left")
    counts = marked.groupBy("label", "term").agg(F.count("*").alias("df"), F.count("has").alias("df_label"))
    rows = pairs.select("label", "term").distinct().join(counts, ["label", "term"], "left")
    df, dl = F.coalesce("df", F.lit(0)), F.coalesce("df_label", F.lit(0))
    return rows.select("label", "term", df.alias("df"), dl.alias("df_label"), F.when(df > 0, F.round(dl / df, 6)).otherwise(0.0).alias("p"))


def short_rule(directed: DataFrame) -> DataFrame:
    """Short triggers with whether they are allowed, and whether they are close calls."""
    df, p = F.col("df"), F.col("p")
    allowed = df.between(MIN_DF, HIGH_DF) & (p >= LEAST_P)
    edge = (df == 1) | ((df > 0) & (df < 3)) | ((df > HIGH_DF) & (df <= 20)) | ((df > 0) & (F.round(F.abs(p - LEAST_P), 9) <= 0.10))
    return directed.where(F.length("term") < 3).select("label", "term", "df", "df_label", "p", allowed.alias("allowed"), edge.alias("edge"))


def allow_list(ruled: DataFrame) -> DataFrame:
    """(label, short_triggers) of labels with an allowed short trigger, the triggers in order; of ``short_rule``. A label's triggers are few."""
    return ruled.where("allowed").groupBy("label").agg(F.array_sort(F.collect_set("term")).alias("short_triggers"))


def patched(table: DataFrame, allowed: DataFrame) -> DataFrame:
    """The label table with ``short_triggers`` as the allow-list has them, and none where it has nothing; other columns stay."""
    new = allowed.select("label", F.col("short_triggers").alias("new"))
    return table.join(new, "label", "left").select(*[F.col("new").alias(c) if c == "short_triggers" else F.col(c) for c in table.columns])


def sample_titles(pairs: DataFrame, post: DataFrame, docs: DataFrame, most: int = 3) -> DataFrame:
    """(label, term, positive, titles): titles of the first documents that hold a term, with and without the label as a theme, at most three of each.

    Only the least numbers move; they are kept while partial results are combined.
    """
    found = pairs.select("label", "term").distinct().join(post, "term")
    marked = found.join(themed(docs).withColumn("has", F.lit(True)), ["doc_no", "label"], "left").withColumn("positive", F.col("has").isNotNull())
    keys = ["label", "term", "positive"]
    # two steps, so that a term that a third of all documents hold is cut down in many tasks first
    part = Window.partitionBy(*keys, F.pmod(F.xxhash64("doc_no"), F.lit(64))).orderBy("doc_no")
    few = marked.withColumn("k", F.row_number().over(part)).where(F.col("k") <= most)
    first = few.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_no"))).where(F.col("k") <= most)
    listed = first.join(docs.select("doc_no", "title"), "doc_no").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("doc_no", "title"))).alias("t"))
    return listed.select(*keys, F.transform("t", lambda x: x["title"]).alias("titles"))


def core_audit(triggers: DataFrame) -> DataFrame:
    """Triggers of three characters or more whose core is short or general, and what the bridge does with them."""
    core = F.length("core")
    rows = triggers.where((F.col("trigger_ord") > 0) & (F.length("trigger") >= 3) & ((core < 3) | (F.col("core_df") > HIGH_DF)))
    verdict = F.when(core < 2, "literal: core too short").when(F.col("core_df") > HIGH_DF, "literal: core too general").when(F.col("core") == F.col("label"), "skipped: core is the label").otherwise("literal core of two")
    return rows.select("label", "trigger", "core", "core_df", verdict.alias("verdict"))


def effectiveness(labels: DataFrame, directed: DataFrame) -> DataFrame:
    """Each label's own name: documents, those with it as a theme, the share, and whether it is dead or a poor name."""
    names = labels.select("label").distinct()
    own = directed.where(F.col("label") == F.col("term")).drop("term")
    rows = names.join(own, "label", "left")
    df, p = F.coalesce("df", F.lit(0)), F.coalesce("p", F.lit(0.0))
    return rows.select("label", df.alias("df"), F.coalesce("df_label", F.lit(0)).alias("df_label"), p.alias("p"), (df == 0).alias("dead"), ((df > 0) & (p < 0.75)).alias("poor"))


def mining_text(docs: DataFrame) -> DataFrame:
    """(doc_no, body): the text fields and lists run together, in normal form, without stop words."""
    return docs.select("doc_no", mining_body().alias("body"))


def mining_body() -> Column:
    return text.mask(text.normalize(F.concat_ws(" ", *MINED, F.array_join("themes", " "), F.array_join("pros", " "), F.array_join("cons", " "))))


def segmented(body: str, known: dict[str, float], single: float) -> list[str]:
    """The words of a body as ``bridge.tokens`` cuts them, all of them and in order; known words by their cost."""
    out: list[str] = []
    for block in body.split(" "):
        if len(block) < 2:
            continue
        best, back = [0.0], []
        for i in range(1, len(block) + 1):
            least, length = best[i - 1] + single, 1
            for k in text.GRAM_LENGTHS:
                if k > i:
                    break
                cost = known.get(block[i - k : i])
                if cost is not None and best[i - k] + cost < least:
                    least, length = best[i - k] + cost, k
            best.append(least)
            back.append(length)
        at, pieces = len(block), []
        while at:
            k = back[at - 1]
            if k >= 2:
                pieces.append(block[at - k : at])
            at -= k
        out += [x for x in reversed(pieces) if x not in STOPS]
    return out or [body[i : i + 2] for i in range(len(body) - 1)]


def joined(words: list[str], longest: int) -> list[str]:
    """One to three neighbouring words of Han characters, of two to ``longest`` characters together, each once."""
    out = {}
    for i in range(len(words)):
        phrase = ""
        for w in words[i : i + 3]:
            phrase += w
            if not HAN.fullmatch(w) or len(phrase) > longest:
                break
            if len(phrase) >= 2:
                out[phrase] = None
    return list(out)


def cut(c: np.ndarray, starts: np.ndarray, keys: np.ndarray, cost: np.ndarray, single: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of bodies, as ``segmented`` cuts them, stop words left out; all blocks are cut at once, character by character."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], c > 0, [0]])))
    first, length = edge[::2], edge[1::2] - edge[::2]
    o = np.argsort(-length, kind="stable")
    first, length = first[o][length[o] >= 2], length[o][length[o] >= 2]
    at_k = {}
    for k in text.GRAM_LENGTHS:
        at_k[k] = np.full(len(c) + 1, np.inf)
        at, key = index.gram_keys(c, k)
        distinct, which = np.unique(key, return_inverse=True)
        i = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        at_k[k][at] = np.where(keys[i] == distinct, cost[i], np.inf)[which] if len(keys) else np.inf
    best, back = np.zeros(len(c) + 1), np.zeros(len(c) + 1, np.int64)
    for i in range(1, int(length.max(initial=0)) + 1):
        e = first[: np.searchsorted(-length, -i, "right")] + i
        least, size = best[e - 1] + single, np.ones(len(e), np.int64)
        for k in [k for k in text.GRAM_LENGTHS if k <= i]:
            x = best[e - k] + at_k[k][e - k]
            better = x < least
            least, size = np.where(better, x, least), np.where(better, k, size)
        best[e], back[e] = least, size
    places, sizes, e = [], [], first + length
    while len(e):
        k = back[e]
        e = e - k
        places.append(e[k >= 2])
        sizes.append(k[k >= 2])
        going = e > first
        e, first = e[going], first[going]
    place, size = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *sizes])
    o = np.argsort(place)
    place, size = place[o], size[o]
    key = np.zeros(len(place), np.int64)
    for i in range(text.GRAM_LENGTHS[-1]):
        x = c[np.minimum(place + i, len(c) - 1)] if len(place) else key
        key = np.where(i < size, key << index.BITS | x, key)
    kept = ~np.isin(key, index.keys_of(sorted(STOPS)))
    return place[kept], size[kept]


def said(c: np.ndarray, starts: np.ndarray, place: np.ndarray, size: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``joined`` words and their characters, as many columns as the longest has; each phrase of a row once."""
    row = np.searchsorted(starts, place, "right") - 1
    plain = np.append(0, np.cumsum((c == 0) | (c > HAN_LETTERS)))
    han = plain[place + size] == plain[place]
    rows, letters = [np.zeros(0, np.int64)], [np.zeros((0, longest), np.int64)]
    for count in (1, 2, 3):
        m = len(place) - count + 1
        if m <= 0:
            break
        ok = np.ones(m, bool)
        total = np.zeros(m, np.int64)
        for i in range(count):
            ok &= han[i : m + i] & (row[i : m + i] == row[:m])
            total += size[i : m + i]
        j = np.flatnonzero(ok & (total <= longest))
        out, filled = np.zeros((len(j), longest), np.int64), np.zeros(len(j), np.int64)
        for i in range(count):
            for x in range(text.GRAM_LENGTHS[-1]):
                here = np.flatnonzero(size[j + i] > x)
                out[here, filled[here] + x] = c[place[j[here] + i] + x]
            filled += size[j + i]
        rows.append(row[j])
        letters.append(out)
    row, out = np.concatenate(rows), np.concatenate(letters)
    return distinct_rows(row, out)


def distinct_rows(row: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of a row and a phrase once, by phrase."""
    o = np.lexsort((row, *[packed_letters(letters[:, i : i + 4]) for i in range(0, letters.shape[1], 4)]))
    row, letters = row[o], letters[o]
    new = np.append(True, (row[1:] != row[:-1]) | (letters[1:] != letters[:-1]).any(axis=1)) if len(row) else np.zeros(0, bool)
    return row[new], letters[new]


def packed_letters(x: np.ndarray) -> np.ndarray:
    key = np.zeros(len(x), np.int64)
    for c in x.T:
        key = key << index.BITS | c
    return key


def strings(letters: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(index.LETTERS[letters]).view(f"U{letters.shape[1]}").ravel().tolist(), pa.string())


def worded(docs: DataFrame, made: Callable, schema: str, longest: int) -> DataFrame:
    """``made`` of (doc_no, themes, row, letters) for each part of the documents: the phrases of its bodies as letters.

    The vocabulary of the index is nowhere as a whole: each part of the documents sends the number of its documents
    that hold each gram, the numbers are added up by gram, and each part gets those of the grams of its own bodies.
    """
    shared_dir(docs.sparkSession)
    n_docs = docs.count()
    n, parts = F.lit(float(n_docs + 2)), max(12, -(-n_docs // PART_DOCS))
    # costs are Spark's, as ``bridge.tokens`` has them: another logarithm's last bit may cut ties otherwise
    single = docs.sparkSession.range(1).select((-F.log(F.lit(2.0) / n) + F.lit(SINGLE_COST)).alias("x")).first().x
    part = F.pmod(F.xxhash64("doc_no"), F.lit(parts)).cast("int")
    whole = docs.select(part.alias("part"), "doc_no", index.body_of(docs).alias("body"), mining_body().alias("mined"), F.array_distinct("themes").alias("themes"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, at = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("part")[0].as_py()
            for _, starts, cp in index.stretches(batch.column("body")):
                held.append(index.document_counts(index.numbers_of(cp), starts))
            for _, _, cp in index.stretches(batch.column("mined")):
                seen += [np.unique(index.gram_keys(index.numbers_of(cp), k)[1]) for k in text.GRAM_LENGTHS]
            held, seen = [index.added(held)], [np.unique(np.concatenate(seen))]
            yield row_of(at, -1, [], (batch.column("doc_no").to_numpy(), batch.column("themes").to_pylist(), batch.column("mined").to_pylist()))
        if held:
            keys = np.union1d(held[0][0], seen[0])
            count = np.zeros(len(keys), np.int64)
            count[np.searchsorted(keys, held[0][0])] = held[0][1]
            asked = np.isin(keys, seen[0])
            slot = index.slot_of(keys, parts)
            for i in range(parts):
                k = slot == i
                yield row_of(at, i, [], (np.diff(keys[k], prepend=0), least_bytes(count[k]), np.packbits(asked[k])))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = []
        for batch in batches:
            for at, x in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                gaps, count, asked = index.opened(x)
                keys = np.cumsum(gaps)
                each.append((at, keys, count, np.unpackbits(asked, count=len(keys)).astype(bool)))
        df = index.added([(k, n) for _, k, n, _ in each])
        for at, keys, _, asked in each:
            n = df[1][np.searchsorted(df[0], keys[asked])]
            k, (values, which) = keys[asked][n > 0], np.unique(n[n > 0], return_inverse=True)
            yield row_of(at, 0, values.tolist(), (np.diff(k, prepend=0), least_bytes(which)))

    columns = "part int, slot int, dfs array<long>, data binary"
    sent = whole.repartitionById(parts, "part").mapInArrow(send, columns).checkpoint()
    freed(docs.sparkSession)
    known = sent.where("slot >= 0").repartitionById(parts, "slot").mapInArrow(answer, columns)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, costs, held = [np.zeros(0, np.int64)], [np.zeros(0)], []
        for batch in batches:
            for at, values, x in zip(batch.column("slot").to_pylist(), batch.column("costs"), batch.column("data").to_pylist()):
                if at < 0:
                    held.append(x)
                    continue
                gaps, which = index.opened(x)
                keys.append(np.cumsum(gaps))
                costs.append(values.values.to_numpy()[which])
        key, cost = np.concatenate(keys), np.concatenate(costs)
        o = np.argsort(key)
        key, cost = key[o], cost[o]
        for x in held:
            no, themes, texts = index.opened(x)
            for first, starts, cp in index.stretches(pa.array([t + "\n" for t in texts], pa.string())):
                c = index.numbers_of(cp)
                place, size = cut(c, starts, key, cost, single)
                row, letters = said(c, starts, place, size, longest)
                bare = np.setdiff1d(np.arange(len(starts)), np.searchsorted(starts, place, "right") - 1).tolist()
                more = [(r, p) for r in bare for p in joined([texts[first + r][i : i + 2] for i in range(len(texts[first + r]) - 1)], longest)]
                if more:
                    wide = np.array([p for _, p in more], f"U{longest}").view(np.uint32).reshape(-1, longest)
                    row, letters = distinct_rows(np.append(row, [r for r, _ in more]), np.concatenate([letters, index.numbers_of(wide)]))
                yield from made(no[first : first + len(starts)], themes[first : first + len(starts)], row, letters)

    placed = known.unionByName(sent.where("slot < 0")).repartitionById(parts, "part")
    return placed.select("slot", F.transform("dfs", lambda x: -F.log((x + 1) / n)).alias("costs"), "data").mapInArrow(mine, schema)


def row_of(part: int, slot: int, dfs: list[int], data: object) -> pa.RecordBatch:
    columns = {"part": pa.array([part], pa.int32()), "slot": pa.array([slot], pa.int32()), "dfs": pa.array([dfs], pa.list_(pa.int64())), "data": pa.array([index.packed(data)], pa.binary())}
    return pa.RecordBatch.from_pydict(columns)


def least_bytes(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the smallest type that has room for them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def phrases(docs: DataFrame, longest: int = 6) -> DataFrame:
    """(phrase, doc_no): one to three neighbouring words of each document, of two to six characters together, each once; the whole body is cut by the vocabulary of the index."""

    def rows(no: np.ndarray, _: list, row: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(no[row], pa.int64()), strings(letters)], names=["doc_no", "phrase"])

    return worded(docs, rows, "doc_no long, phrase string", longest)


def phrase_counts(docs: DataFrame, closed: list[str], longest: int = 6) -> DataFrame:
    """(phrase, label, n): the documents with a phrase (label null), and those of them with each of the labels as a theme."""
    number = {label: i for i, label in enumerate(closed, 1)}

    def counts(_: np.ndarray, themes: list, row: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
        marks = [[0, *[number[t] for t in x or [] if t in number]] for x in themes]
        size = np.array([len(m) for m in marks], np.int64)
        flat, start = np.array([i for m in marks for i in m], np.int64), np.cumsum(size) - size
        new = np.append(True, (letters[1:] != letters[:-1]).any(axis=1)) if len(row) else np.zeros(0, bool)
        which, distinct = np.cumsum(new) - 1, letters[new]
        reps = size[row]
        place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start[row], reps)
        pair, n = np.unique(np.repeat(which, reps) * (len(closed) + 1) + flat[place], return_counts=True)
        label = pa.array([None, *closed], pa.string()).take(pa.array(pair % (len(closed) + 1)))
        yield pa.RecordBatch.from_arrays([strings(distinct).take(pa.array(pair // (len(closed) + 1))), label, pa.array(n, pa.int64())], names=["phrase", "label", "n"])

    return worded(docs, counts, "phrase string, label string, n long", longest).groupBy("phrase", "label").agg(F.sum("n").alias("n"))


def mined(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, phrase, df, df_label, p, place): phrases that point to a label and are not yet among its triggers, the best twenty of each, none within another.

    A phrase goes to the label with the largest share, then the most documents, then the first.
    """
    closed = labels.where("trigger_ord = 0").select("label", "label_ord")
    # a phrase has a count for each label at most, and labels are a closed set
    counts = phrase_counts(docs, sorted(r.label for r in closed.select("label").distinct().collect()))
    each = counts.groupBy("phrase").agg(F.max(F.when(F.col("label").isNull(), F.col("n"))).alias("df"), F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", F.col("n").alias("df_label")))).alias("l"))
    with_label = each.where(F.col("df") >= PHRASE_DF).select("phrase", "df", F.inline("l")).join(F.broadcast(closed), "label")
    p = F.round(F.col("df_label") / F.col("df"), 9)
    w = Window.partitionBy("phrase").orderBy(F.col("p").desc(), F.col("df_label").desc(), "label_ord")
    best = with_label.withColumn("p", p).where(F.col("p") >= LEAST_P).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    known = labels.groupBy("label").agg(F.collect_list("trigger").alias("triggers"))
    near = F.exists("triggers", lambda t: (F.length(t) >= 2) & (F.contains(t, F.col("phrase")) | F.contains(F.col("phrase"), t)))
    fresh = best.join(F.broadcast(known), "label").where(~near & (F.col("phrase") != F.col("label"))).drop("triggers")
    # labels are a closed set, phrases of one are bounded by the vocabulary; the fold keeps twenty
    ordered = fresh.groupBy("label").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("a"), (-F.col("df_label")).alias("b"), "phrase", "df", "df_label", "p"))).alias("c"))
    kept = F.aggregate(
        "c",
        F.slice("c", 1, 0),
        lambda s, x: F.when((F.size(s) < PER_LABEL) & ~F.exists(s, lambda y: F.contains(y["phrase"], x["phrase"]) | F.contains(x["phrase"], y["phrase"])), F.concat(s, F.array(x))).otherwise(s),
    )
    return ordered.select("label", F.posexplode(kept).alias("place", "x")).select("label", "place", "x.phrase", "x.df", "x.df_label", F.round("x.p", 6).alias("p"))


def phrase_labels(docs: DataFrame, phrases_asked: DataFrame) -> DataFrame:
    """For each phrase asked: the documents whose body holds it, and how many of them have each label."""
    grams = mining_text(docs)
    asked = small(phrases_asked.select("phrase").distinct(), 1000)
    found = grams.join(asked, F.contains(F.col("body"), F.col("phrase"))).select("phrase", "doc_no")
    per = found.join(themed(docs), "doc_no").groupBy("phrase", "label").agg(F.count("*").alias("n"))
    total = found.groupBy("phrase").agg(F.count("*").alias("docs"))
    return total.join(per, "phrase").select("phrase", "docs", "label", "n", F.round(F.col("n") * 100 / F.col("docs"), 6).alias("percent"))

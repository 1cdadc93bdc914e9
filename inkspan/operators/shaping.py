"""From pages to passages: HTML extraction, sentence chunks, proportional alignment, numerals, samples.

Built-in expressions throughout, but for the proportional alignment.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks that end a sentence and softer breaks, sizes of chunks and pairs, the colour that marks translations.
ENDS, SOFT = "。！？；!?", "，、；：,;"
TARGET, MIN_TAIL, MAX_PAIR = 300, 120, 900
TRANSLATION_COLOUR = "#967d63"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&hellip;": "…"}
DIGITS = "零一二三四五六七八九"


def strings() -> Column:
    return F.array().cast("array<string>")


def cut_sentences(c: Column) -> Column:
    """Sentences with their marks; '' and null give none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"(?<=[{ENDS}])"), lambda s: s != "")


def chunked(c: Column, target: int = TARGET) -> Column:
    """Sentences put together until ``target`` characters; a short rest joins the last chunk; chunks beyond twice the target are split."""
    start = F.struct(strings().alias("out"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        cur = F.concat(s["cur"], x)
        full = F.length(cur) >= target
        return F.struct(F.when(full, F.concat(s["out"], F.array(cur))).otherwise(s["out"]).alias("out"), F.when(full, "").otherwise(cur).alias("cur"))

    def finish(s: Column) -> Column:
        n = F.size(s["out"])
        joined = F.concat(F.slice(s["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(s["out"], F.greatest(n, F.lit(1))), s["cur"])))
        return F.when(F.length(s["cur"]) == 0, s["out"]).when((n > 0) & (F.length(s["cur"]) < MIN_TAIL), joined).otherwise(F.concat(s["out"], F.array(s["cur"])))

    return F.flatten(F.transform(F.aggregate(cut_sentences(c), start, step, finish), lambda x: overlong(x, 2 * target)))


def overlong(c: Column, most: int) -> Column:
    """A text in pieces of at most ``most`` characters and one more, cut after the last soft break of the second half of each, else hard."""
    half = most // 2
    start = F.struct(F.lit(0).alias("pos"), strings().alias("out"))

    def step(s: Column, _: Column) -> Column:
        more = F.length(c) - s["pos"] > most
        found = F.length(F.regexp_extract(F.substring(c, s["pos"] + half + 2, F.lit(half)), f"(?s)^.*[{SOFT}]", 0))
        cut = F.when(found > 0, s["pos"] + half + 1 + found).otherwise(s["pos"] + most)
        piece = F.substring(c, s["pos"] + 1, cut - s["pos"])
        return F.struct(F.when(more, cut).otherwise(s["pos"]).alias("pos"), F.when(more, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    def finish(s: Column) -> Column:
        rest = F.substring(c, s["pos"] + 1, F.length(c))
        return F.when(rest != "", F.concat(s["out"], F.array(rest))).otherwise(s["out"])

    rounds = F.sequence(F.lit(1), F.floor(F.length(c) / half).cast("int") + 1)
    return F.when(F.length(c) <= most, F.array(c)).otherwise(F.aggregate(rounds, start, step, finish))


def shares(text: str | None, n: int | None) -> list[str]:
    """A text in exactly n chunks, cut at the sentence ends nearest to equal shares; too few sentences leave '' at the end."""
    sents = [s for s in re.split(f"(?<=[{ENDS}])", text or "") if s]
    if not n or n <= 0 or not sents:
        return []
    if n == 1 or len(sents) <= n:
        return ["".join(sents)] if n == 1 else sents + [""] * (n - len(sents))
    ends = list(accumulate(map(len, sents)))  # ends[j - 1]: characters of the first j sentences
    out, at = [], 0
    for k in range(1, n):
        target = round(ends[-1] * k / n)  # halves to even
        cut = min(range(at + 1, len(sents)), key=lambda j: abs(ends[j - 1] - target), default=min(at + 1, len(sents)))
        out.append("".join(sents[at:cut]))
        at = cut
    return [*out, "".join(sents[at:])]


def into(text: Column, n: Column) -> Column:
    """``shares`` over Arrow batches: each cut depends on the one before, which nested column functions would recompute for every step."""

    def cut(text: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([shares(t, k) for t, k in zip(text, n)], dtype=object)

    return F.pandas_udf(cut, "array<string>")(text, n)


def plausible(original: Column, translation: Column) -> Column:
    """Whether the lengths of a pair fit each other."""
    o, t = F.length(original), F.length(translation)
    return (o > 0) & (t > 0) & (t <= o * 5 + 400) & (t >= o * 0.15 - 400)


def capped(docs: DataFrame, most: int = MAX_PAIR) -> DataFrame:
    """(doc_no, part, original, translation): pairs longer than ``most`` in as many parts as that asks for, if both sides have sentences enough; others as part 0."""
    total = F.length("original") + F.length("translation")
    room = F.size(cut_sentences(F.col("original"))) - 1
    room = F.when(F.col("translation") != "", F.least(room, F.size(cut_sentences(F.col("translation"))) - 1)).otherwise(room)
    parts = F.when(total > most, F.least(F.ceil(total / most).cast("int"), room)).otherwise(1)
    rows = docs.select("doc_no", "original", "translation", F.when(parts < 2, 1).otherwise(parts).alias("n"))
    whole = rows.where("n = 1").select("doc_no", F.lit(0).alias("part"), "original", "translation")
    some = rows.where("n > 1")
    zipped = F.arrays_zip(into(F.col("original"), F.col("n")).alias("o"), F.when(F.col("translation") != "", into(F.col("translation"), F.col("n"))).otherwise(F.array_repeat(F.lit(""), F.col("n"))).alias("t"))
    split = some.select("doc_no", F.posexplode(zipped).alias("p", "x")).select("doc_no", (F.col("p") + 1).alias("part"), F.col("x.o").alias("original"), F.col("x.t").alias("translation"))
    return whole.unionByName(split)


def body(html: Column) -> Column:
    """What follows the first closing heading, else all."""
    return F.regexp_replace(html, r"(?is)^.*?</h1>", "")


def entities(c: Column) -> Column:
    """Numeric and named entities decoded once; those of the ampersand last."""
    parts = F.split(c, "(?=&#)")

    def numeric(p: Column) -> Column:
        hex_, dec = F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]{1,6});", 1), F.regexp_extract(p, r"^&#(\d{1,7});", 1)
        code = F.when(hex_ != "", F.conv(hex_, 16, 10)).when(dec != "", dec).cast("bigint")
        rest = F.regexp_replace(p, r"^&#(?:[xX][0-9A-Fa-f]{1,6}|\d{1,7});", "")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.concat(char, rest)).otherwise(p)

    out = F.array_join(F.transform(parts, numeric), "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def cleaned(html: Column) -> Column:
    """Text of a piece of HTML: styles and scripts dropped, line breaks kept, tags stripped, entities decoded, readings in brackets and navigation lines dropped, blanks collapsed."""
    s = F.regexp_replace(F.regexp_replace(html, r"(?is)<style.*?</style>", ""), r"(?is)<script.*?</script>", "")
    s = F.regexp_replace(s, r"(?i)<br[^>]*>|</?p[^>]*>", "\n")
    s = F.replace(F.regexp_replace(s, r"(?s)<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))
    s = F.regexp_replace(entities(s), r"[（(][a-zA-Zāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü·\s,，]{1,40}[）)]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t\r\f　 ]+", " "), r" ?\n[ \n]*", "\n")
    lines = F.filter(F.split(s, "\n"), lambda x: ~F.regexp_like(x, F.lit("[上下]一[节章]")))
    return F.trim(F.array_join(F.transform(lines, F.trim), "\n"))


def paragraph_pairs(pages: DataFrame, least: int = 8) -> DataFrame:
    """(page_id, pair_no, original, translation): each translated paragraph with the last paragraph before it, if that has at least ``least`` characters."""
    found = F.regexp_extract_all(body(F.col("html")), F.lit(r"(?is)<p[^>]*>.*?</p>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("at", "p"))
    tag = F.regexp_extract("p", r"(?is)^<p[^>]*>", 0)
    inner = cleaned(F.regexp_replace(F.regexp_replace("p", r"(?is)^<p[^>]*>", ""), r"(?is)</p>$", ""))
    rows = rows.select("page_id", "at", F.contains(F.lower(tag), F.lit(TRANSLATION_COLOUR)).alias("is_translation"), inner.alias("text")).where("text <> ''")
    w = Window.partitionBy("page_id").orderBy("at")
    pairs = rows.withColumn("before", F.lag("text").over(w)).withColumn("before_kind", F.lag("is_translation").over(w))
    pairs = pairs.where(F.col("is_translation") & ~F.col("before_kind") & (F.length("before") >= least))
    return pairs.select("page_id", F.row_number().over(w).alias("pair_no"), F.col("before").alias("original"), F.col("text").alias("translation"))


def volume(c: Column) -> Column:
    """The number after the first 卷, in Arabic or Chinese digits; -1 without one."""
    digits = F.regexp_extract(c, r"^[^卷]*卷(\d+)", 1)
    word = F.regexp_extract(c, f"^[^卷]*卷([{DIGITS}十百千]+)", 1)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("num"))

    def step(s: Column, ch: Column) -> Column:
        unit = F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000)
        value = F.call_function("locate", ch, F.lit(DIGITS)) - 1
        return F.struct(F.when(unit.isNotNull(), s["sum"] + F.when(s["num"] == 0, 1).otherwise(s["num"]) * unit).otherwise(s["sum"]).alias("sum"), F.when(unit.isNotNull(), 0).otherwise(value).alias("num"))

    spelled = F.aggregate(F.filter(F.split(word, ""), lambda x: x != ""), start, step, lambda s: s["sum"] + s["num"])
    n = F.when(digits != "", F.try_to_number(digits, F.lit("999999999")).cast("int")).when(word != "", spelled)
    return F.coalesce(F.when(n > 0, n), F.lit(-1))


def stem(name: Column) -> Column:
    """A file name without its ending."""
    return F.regexp_replace(name, r"(-原文|-白话|-译文|-段译)?\.html$", "")


def title_of(name: Column) -> Column:
    """A page's title from its file name: without ending and without a leading chapter number."""
    return F.trim(F.regexp_replace(F.regexp_replace(stem(name), "^第[^-]*章-", ""), "^-", ""))


def scope(rel: Column) -> Column:
    """The first folder of a path and a colon, or ''; volumes are counted anew in each."""
    return F.when(F.contains(rel, F.lit("/")), F.concat(F.substring_index(rel, "/", 1), F.lit(":"))).otherwise("")


def keyed(pages: DataFrame) -> DataFrame:
    """(page, level, key) of pages (page, rel): path without ending, stem, title, volume within its folder, volume; in order of trust. Short keys do not count."""
    name = F.regexp_extract("rel", "([^/]*)$", 1)
    folder = F.regexp_extract("rel", "^(.*/)?[^/]*$", 1)
    vol = volume(stem(name))
    keys = F.array(
        F.concat(F.lit("R:"), folder, stem(name)),
        F.concat(F.lit("S:"), stem(name)),
        F.when(title_of(name) != "", F.concat(F.lit("~"), title_of(name))),
        F.when(vol > 0, F.concat(F.lit("V:"), scope(F.col("rel")), vol)),
        F.when(vol > 0, F.concat(F.lit("V:"), vol)),
    )
    return pages.select("page", F.posexplode(keys).alias("level", "key")).where("key is not null and (length(key) > 2 or level > 2)")


def translations_of(originals: DataFrame, translations: DataFrame) -> DataFrame:
    """(page, other, level): for each page (page, rel) the translated page found by the first of its keys that leads to one.

    Of several pages with one key the first by path counts, but a volume only if it is unique. Pages shorter than 20
    characters and introductions are left out by the caller (``translated_pages``).
    """
    theirs = keyed(translations).groupBy("level", "key").agg(F.count("*").alias("n"), F.min("page").alias("other")).where("level < 3 or n = 1").drop("n")
    found = keyed(originals).join(theirs, ["level", "key"])
    best = found.groupBy("page").agg(F.min(F.struct("level", "other")).alias("b"))
    return best.select("page", F.col("b.other").alias("other"), F.col("b.level").alias("level"))


def translated_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """Pages (rel, html) that can be a translation: no introduction, a body of at least 20 characters; numbered ``page`` in order of path by their path."""
    ok = ~F.contains("rel", F.lit("简介")) & (F.length(cleaned(body(F.col("html")))) >= least)
    return pages.where(ok).withColumn("page", F.col("rel"))


def filtered_items(docs: DataFrame, original: int = 16, translation: int = 20) -> DataFrame:
    """Documents long enough to keep: the original has 16 characters; a translation of fewer than 20 is none."""
    rows = docs.where(F.length("original") >= original)
    return rows.withColumn("translation", F.when(F.length("translation") >= translation, F.col("translation")).otherwise(""))


def head(docs: DataFrame, limit: int, only: list[str] | None = None, by: str = "book", order: str = "doc_no") -> DataFrame:
    """The first ``limit`` documents of each book or file (all for 0), of the books named only.

    A book's numbers are cut down in many tasks first, so a third of all rows in one book gathers nowhere.
    """
    rows = docs if only is None else docs.where(F.col("book").isin(only))
    if limit <= 0:
        return rows
    part = Window.partitionBy(by, F.pmod(F.xxhash64(order), F.lit(64))).orderBy(order)
    few = rows.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= limit)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= limit).drop("_k")


def pairing(docs: DataFrame, by_chapter: Column | None = None) -> DataFrame:
    """(book, docs, translated, pairing): how much of each book has a translation; ``by_chapter`` says which documents were aligned by whole chapters."""
    n, t = F.count("*"), F.count_if(F.col("translation") != "")
    whole = F.lit(0) if by_chapter is None else F.count_if(by_chapter & (F.col("translation") != ""))
    mode = F.when(t == 0, "仅原文").when(t != n, "部分对齐").when(whole > 0, "整章对齐").otherwise("段译配对")
    return docs.groupBy("book").agg(n.alias("docs"), t.alias("translated"), mode.alias("pairing"))


def stratified(docs: DataFrame, per_stratum: int) -> DataFrame:
    """(doc_no, book, stratum): in each book and title (else the chapter before its first separator) an evenly spaced choice of ``per_stratum`` rows, or all of a smaller stratum.

    Ranks come from a window over (book, stratum); strata are bounded by what one title holds.
    """
    stratum = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.substring_index("chapter", " · ", 1))
    rows = docs.select("doc_no", "book", stratum.alias("stratum"))
    w = Window.partitionBy("book", "stratum")
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("doc_no")) - 1)
    # row rn is kept if rn = ((2k+1)n) div (2m) for some k < m
    k = F.floor((F.col("rn") * 2 * per_stratum + F.col("n")) / (F.col("n") * 2)).cast("int")
    kept = F.exists(F.array(k - 1, k, k + 1), lambda x: (x >= 0) & (x < per_stratum) & (F.floor((x * 2 + 1) * F.col("n") / (2 * per_stratum)) == F.col("rn")))
    return rows.where((F.col("n") <= per_stratum) | kept).select("doc_no", "book", "stratum")

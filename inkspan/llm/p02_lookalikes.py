"""Problem 2: visually identical text with different characters.

Method: transitive look-alike classes by union-find over code points and strings, a representative
for each class by its frequency in the collection, and greedy rewriting by a multi-pattern automaton.

Classes come from public Unicode data (compatibility and canonical decompositions, categories) and
from the fixed values below (letters of other alphabets, radicals without a decomposition).  A class
may hold the empty string (invisible characters) and strings (a letter and its accents).  Of the code
points of a class the most frequent stands for all.  A class that holds an accented letter and its
decomposed spelling takes the spelling that is more frequent.  Compatibility characters made of
several (an ellipsis, a Roman numeral) are always written out, because parts of them can stand
beside a whole one: otherwise ". ..." in two spellings would come out in two forms.

The driver holds one counter per distinct code point, at most the 1.1 million of Unicode.

Defined cases: null stays null and '' stays ''; a text of invisible characters only becomes ''.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, codes, table

# Letters of other alphabets and the Latin letters they are drawn like.
DRAWN_ALIKE = {
    "АВЕЅІЈКМНОРСТУХҮԌԚԜӀ": "ABESIJKMHOPCTYXYGQWI",
    "аеѕіјорсухһԁԛԝ": "aesijopcyxhdqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ": "ABEZHIKMNOPTYXCM",
    "οϲϳνα": "ocjva",
    "ՕՏՍօհոս": "OSUohnu",
    "ικρυɑɡıɩӏһѵᴄᴏᴠᴡᴢѡգցզոռօհլ": "ikpuagiilhvcovwzwqgqnnohl",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ": "ABCDEHJKLMPSTVWZ",
}
# Radicals of the supplement block without a decomposition, and the ideographs of the same shape.
RADICALS = {
    "⺅⺉⺋⺓⺕⺖⺗⺘⺙⺛⺝⺞⺡⺣⺥⺨⺫⺭⺯⺰⺲": "亻刂㔾幺彐忄㣺扌攵旡月歺氵灬爫犭罒礻糹纟罒",
    "⺿⻂⻃⻄⻅⻈⻉⻋⻌⻐⻓⻔⻘⻙⻚⻛⻜⻝⻠⻢⻥⻦⻧⻨⻩⻬⻭⻮⻯⻰⻱⻲": "艹衤覀西见讠贝车辶钅长门青韦页风飞食饣马鱼鸟卤麦黄齐歯齿竜龙龜亀",
}
# Format characters that are drawn, and fillers that are not.
DRAWN_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"


def invisible(c: str) -> bool:
    return (unicodedata.category(c) == "Cf" and c not in DRAWN_FORMATS) or c in FILLERS or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or "᠋" <= c <= "᠏"


class Classes:
    """Union-find over strings; a code point is a string of one, invisible characters join ''."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while (p := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = p
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))


def rewriting(frequency: dict[str, int]) -> tuple[dict[int, str], dict[str, str]]:
    """Of a collection's code points and their frequency: what each becomes, and which spellings of a letter with accents become which."""
    classes = Classes()
    for table_ in (DRAWN_ALIKE, RADICALS):
        for a, b in table_.items():
            for x, y in zip(a, b):
                classes.union(x, y)
    parts: dict[str, str] = {}
    seen = set(frequency) | {d for c in frequency for d in unicodedata.normalize("NFKD", c)} | {y for t in (DRAWN_ALIKE, RADICALS) for a, b in t.items() for y in a + b}
    for c in sorted(seen):
        whole = unicodedata.normalize("NFKD", c)
        if invisible(c):
            classes.union(c, "")
        elif unicodedata.category(c) == "Zs":
            classes.union(c, " ")
        elif whole != c:
            if len(whole) == 1:
                classes.union(c, whole)
            else:
                parts[c] = whole
    best: dict[str, str] = {}
    for c in sorted(seen):
        if c in parts:
            continue
        root = classes.find(c)
        if root != "" and (root not in best or (frequency.get(c, 0), -ord(c)) > (frequency.get(best[root], 0), -ord(best[root]))):
            best[root] = c
    one = {c: "" if classes.find(c) == "" else best[classes.find(c)] for c in seen if c not in parts}

    def spelled(c: str) -> str:
        return "".join(one.get(d, d) for d in parts[c])

    # an accented letter and all ways to spell it out are one class; it is found by what its parts become
    letters: dict[str, list[str]] = {}
    for c in sorted(parts):
        if unicodedata.normalize("NFD", c) != c and any(unicodedata.combining(d) for d in parts[c]):
            letters.setdefault(unicodedata.normalize("NFD", spelled(c)), []).append(c)
    strings = {}
    for spelling, members in letters.items():
        top = max(members, key=lambda c: (frequency.get(c, 0), -ord(c)))
        if frequency.get(top, 0) >= frequency.get(spelling[-1], 0):
            strings[spelling] = top
    out = {ord(c): x for c, x in one.items() if x != c} | {ord(c): spelled(c) for c in parts}
    return out, strings


def rewriter(out: dict[int, str], strings: dict[str, str]) -> Callable[[str], str]:
    """A function that brings a text to its one form: code points first, then the longest spellings, left to right."""
    singles = {k: v for k, v in out.items()}
    stays = {c for c in map(chr, singles) if strings.get(unicodedata.normalize("NFD", singles[ord(c)])) == c}
    marks = [chr(i) for i in range(0x300, 0x3100) if unicodedata.combining(chr(i))]
    odd = re.compile("[" + "".join(re.escape(c) for c in [*(c for c in map(chr, singles) if c not in stays), *marks]) + "]")
    accent = re.compile("[" + "".join(map(re.escape, marks)) + "]")
    points, spellings = ahocorasick.Automaton(), ahocorasick.Automaton()
    for c, x in singles.items():
        points.add_word(chr(c), (1, x))
    for s, x in strings.items():
        spellings.add_word(s, (len(s), x))

    def replaced(automaton: ahocorasick.Automaton, text: str) -> str:
        done, at = [], 0
        for last, (n, x) in automaton.iter_long(text):
            done.append(text[at : last + 1 - n])
            done.append(x)
            at = last + 1
        return "".join(done) + text[at:]

    if len(points):
        points.make_automaton()
    if len(spellings):
        spellings.make_automaton()

    def canonical(text: str) -> str:
        if not odd.search(text):
            return text
        text = replaced(points, text)
        if accent.search(text):
            text = unicodedata.normalize("NFD", text)
            if len(spellings):
                text = replaced(spellings, text)
        return text

    return canonical


def code_points(df: DataFrame, *columns: str) -> dict[str, int]:
    """Each code point of the columns with its frequency; counted in the tasks, at most all of Unicode reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for c in columns:
                for _, texts in chunks(batch, c):
                    n = np.bincount(codes(texts)[0])
                    total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])

    counted = df.select(*columns).mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {chr(r["c"]): r["n"] for r in counted.collect()}


def tables(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, str, list[str]]]:
    """The tables with texts to bring to one form: data, key, order, columns."""
    return [(table(spark, sf_dir, "corpus_doc"), "doc_no", "loaded_at", ["original", "translation"]), (table(spark, sf_dir, "cases"), "case_no", "asked_at", ["query"])]


def learned(spark: SparkSession, sf_dir: str) -> tuple[dict[int, str], dict[str, str]]:
    """The rewriting for the originals, translations and queries; every delivery of a text counts for the frequencies."""
    frequency: dict[str, int] = {}
    for df, _, _, columns in tables(spark, sf_dir):
        for c, n in code_points(df, *columns).items():
            frequency[c] = frequency.get(c, 0) + n
    return rewriting(frequency)


def formed(df: DataFrame, key: str, order: str, columns: list[str], rules: tuple[dict[int, str], dict[str, str]], texts_too: bool) -> DataFrame:
    """Each text of the columns: (field_name, key, raw, form[, text]), ``raw`` and ``form`` being digests; null and '' texts are left out."""

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = rewriter(*rules)
        for batch in batches:
            keys, orders = batch.column(0).to_pylist(), batch.column(1)
            for c in columns:
                rows, raw, form, texts = [], [], [], []
                for i, t in enumerate(batch.column(c).to_pylist()):
                    if t and keys[i] is not None:
                        x = canonical(t)
                        a = digest(t)
                        rows.append(i)
                        raw.append(a)
                        form.append(a if x is t else digest(x))
                        texts.append(x)
                arrays = [pa.array([c] * len(rows), pa.string()), pa.array([keys[i] for i in rows], pa.int64()), orders.take(pa.array(rows, pa.int64())), pa.array(raw, pa.binary()), pa.array(form, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * texts_too, names=["field_name", "key", "at", "raw", "form"] + ["text"] * texts_too)

    made = df.select(key, F.coalesce(F.col(order), F.lit("1900-01-01").cast("timestamp")).alias("at"), *columns).mapInArrow(run, "field_name string, key long, at timestamp, raw binary, form binary" + ", text string" * texts_too)
    values = ["raw", "form", "text"] if texts_too else ["raw", "form"]
    best = made.groupBy("field_name", "key").agg(F.max_by(F.struct(*values), "at").alias("v"))
    return best.select("field_name", "key", *[F.col(f"v.{v}").alias(v) for v in values])


def all_formed(spark: SparkSession, sf_dir: str, texts_too: bool) -> DataFrame:
    rules = learned(spark, sf_dir)
    a, b = (formed(*x, rules, texts_too) for x in tables(spark, sf_dir))
    return a.unionByName(b)


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original, translation and query in its one form."""
    return all_formed(spark, sf_dir, True).select("field_name", "key", "text")


def alike(each: DataFrame) -> DataFrame:
    """Pairs of (field_name, key, raw, form) with equal form and unequal raw.

    Texts are grouped by digest; copies are joined only to the copies of a different text with the same form, so
    a large group of equal texts yields nothing by itself.
    """
    forms = each.groupBy("field_name", "form").agg(F.min("raw").alias("a"), F.max("raw").alias("z")).where("a < z").select("field_name", "form")
    some = each.join(forms, ["field_name", "form"], "left_semi")
    kinds = some.select("field_name", "form", "raw").distinct()
    other = kinds.withColumnRenamed("raw", "other")
    pairs = kinds.join(other, ["field_name", "form"]).where("raw < other").drop("form")
    left = some.select("field_name", "raw", F.col("key").alias("x"))
    right = some.select("field_name", F.col("raw").alias("other"), F.col("key").alias("y"))
    both = pairs.join(left, ["field_name", "raw"]).join(right, ["field_name", "other"])
    return both.select("field_name", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts of one field that look the same and differ in some character."""
    return alike(all_formed(spark, sf_dir, False))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text: field_name, key, its class (the least key of those that look the same), the texts of the class, the spellings among them, and the class's texts spelled otherwise."""
    each = all_formed(spark, sf_dir, False)
    # counted by spelling first, so that a large group of copies is combined on the map side
    spelled = each.groupBy("field_name", "form", "raw").agg(F.count("*").alias("same"), F.min("key").alias("least"))
    whole = spelled.groupBy("field_name", "form").agg(F.sum("same").alias("texts"), F.count("*").alias("spellings"), F.min("least").alias("class_id"))
    both = each.join(spelled.drop("least"), ["field_name", "form", "raw"]).join(whole, ["field_name", "form"])
    return both.select("field_name", "key", "class_id", "texts", "spellings", (F.col("texts") - F.col("same")).alias("links"))

"""Problem 7: sentence boundaries across languages and scripts.

Method: the standard character-property sentence-break rules, driven by the property classes
(terminators of all scripts, dots, closing and opening marks, continuation marks, format
characters), with abbreviation suppression and handling of quotations.  A text is read by its
events (marks, quotes, line breaks) only; the characters between them are never visited.

Defined cases: null and '' texts and texts of blanks give no sentence; a text without any mark is
one sentence per line and ideographic space; an opening sign that is never closed on its line, or a
closing sign never opened, encloses nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import records

# The Unicode sentence terminators (STerm) and dots (ATerm), written as ranges.
STERM = (
    "!?։؝-؟۔܀-܂߹࠷࠹࠽࠾।॥၊။።፧፨"
    "᙮᜵᜶។៕᠃᠉᥄᥅᪨-᪫᭚᭛᭞᭟᰻᰼᱾᱿"
    "‼‽⁇-⁉⸮⸼。꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉"
    "꩝-꩟꫰꫱꯫︒︕︖﹖﹗！？｡\U00011047\U00011048\U000110be-\U000110c1"
)
ATERM = ".․﹒．"
# Brackets and quotes that come in pairs, and the line breaks.
PAIRS = "()[]{}（）［］｛｝〔〕【】〈〉《》「」『』｢｣“”‘’«»‹›〖〗〘〙〚〛﹁﹂﹃﹄"
BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
# Marks with which a sentence goes on after a closing sign (the comma in its forms).
COMMAS = ",、，､﹐﹑،՝"
# Marks with which a sentence goes on after a dot.
CONTINUE = COMMAS + ";:；：-\u2013\u2014"
# English abbreviations that stand before their name or number, and those that may end a sentence.
ABBREVIATIONS = frozenset(
    "mr mrs ms messrs dr prof gen col maj capt cpt lt sgt adm cmdr gov sen rep pres rev hon st mt ft sec ed eds tr trans "
    "vol vols fol fols ff p pp ch chap art fig figs cf ca c approx nos bk pt par ser viz vs v esp ibid op loc mss ms".split()
)
BEFORE_NUMBER = frozenset(["no"])
MAY_END = frozenset("etc al jr sr co inc ltd bc ad am pm".split())
# Greek and Cyrillic letters drawn like Latin ones, for reading abbreviations.
LATIN = str.maketrans("АВЕЅІЈКМНОРСТХаеѕіјорсхуΑΒΕΖΗΙΚΜΝΟΡΤΧο", "ABESIJKMHOPCTXaesijopcxyABEZHIKMNOPTXo")

OPEN = {a: b for a, b in zip(PAIRS[::2], PAIRS[1::2])}
CLOSE = {b: a for a, b in OPEN.items()}
TERMINATORS = frozenset(chr(c) for part in re.findall(r".-.|.", STERM, re.S) for c in range(ord(part[0]), ord(part[-1]) + 1)) | frozenset(ATERM)
DOTS = frozenset(ATERM)
_class = lambda chars: "".join(map(re.escape, sorted(chars)))
EVENT = re.compile(f"[{_class(TERMINATORS)}{_class(PAIRS)}]")
LINE = re.compile(f"[^{_class(BREAKS)}]+")
#: Format characters, variation selectors and combining marks belong to the character before them.
FORMAT = re.compile("[\u00ad\u0300-\u036f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\U000e0100-\U000e01ef]*")
RUN = re.compile(f"(?:[{_class(TERMINATORS)}]{FORMAT.pattern})+")
TAIL = re.compile(f"(?:[{_class(TERMINATORS)}{_class(CLOSE)}]{FORMAT.pattern})*")
BLANK = re.compile(f"(?:\\s|{FORMAT.pattern[:-1]})*")
WORD = re.compile(r"[^\W\d_]+")


def word_before(text: str, at: int, start: int) -> str:
    """The letters right before ``at``, in one form."""
    i = at
    while i > start and at - i < 24 and (text[i - 1].isalpha() or FORMAT.fullmatch(text[i - 1])):
        i -= 1
    word = text[i:at]
    if not word.isascii():
        word = unicodedata.normalize("NFKC", "".join(c for c in word if not FORMAT.fullmatch(c))).translate(LATIN)
    return word


def dot_ends(text: str, first: int, end: int, start: int, stop: int) -> bool:
    """Whether the dots text[first:end] end a sentence of the line text[start:stop]."""
    if end >= stop:
        return True
    after = BLANK.match(text, end, stop).end()
    if after >= stop:
        return True
    nxt, gap = text[after], after > end and any(c.isspace() for c in text[end:after])
    if nxt.islower() or nxt in CONTINUE:
        return False
    if not gap:
        if nxt.isdigit() and nxt < "\u3000":
            return not text[first - 1 : first].isdigit() and not (first > start and text[first - 1].isascii())
        # a name may follow a sentence without a blank; within an abbreviation only single letters do
        if nxt.isupper() and len(word_before(text, first, start)) < 2:
            return False
    word = word_before(text, first, start)
    if not word:
        return True
    low = word.lower()
    if len(word) == 1 and word.isascii() and (word.isupper() or low in "pcv"):
        return False
    if low in BEFORE_NUMBER:
        return not nxt.isdigit()
    if len(word) == 1 and word.isascii() and text[first - 2 : first - 1] in DOTS:
        return False
    return low not in ABBREVIATIONS


def is_real(text: str, at: int, start: int, stop: int) -> bool:
    """Whether the mark at ``at`` is one of a sentence (no dot of a number or abbreviation)."""
    if text[at] not in DOTS:
        return True
    word = word_before(text, at, start).lower()
    return not (word in ABBREVIATIONS or word in MAY_END or (len(word) == 1 and word.isascii()) or text[at + 1 : at + 2].isdigit())


def line_spans(text: str, start: int, stop: int, out: list[tuple[int, int]]) -> bool:
    """Appends the sentences of one line, untrimmed; whether it has any sentence mark."""
    events = [(m.start(), m.group()) for m in EVENT.finditer(text, start, stop)]
    if not events:
        out.append((start, stop))
        return False
    paired: set[int] = set()
    stack: list[tuple[str, int]] = []
    for at, ch in events:
        if ch in OPEN:
            stack.append((ch, at))
        elif ch in CLOSE:
            want = CLOSE[ch]
            if ch == "’" and text[at - 1 : at].isalpha() and text[at + 1 : at + 2].isalpha() and not any(o == want for o, _ in stack):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == want:
                    paired.add(stack[k][1])
                    paired.add(at)
                    del stack[k:]
                    break
    begin, depth, done, marked = start, 0, start, False
    for at, ch in events:
        if at < done:
            continue
        if ch in OPEN:
            depth += at in paired
        elif ch in CLOSE:
            if at not in paired:
                continue
            depth -= 1
            if depth:
                continue
            back = at
            while back > begin and (text[back - 1] in CLOSE or FORMAT.fullmatch(text[back - 1])):
                back -= 1
            if back <= begin or text[back - 1] not in TERMINATORS:
                continue
            end = TAIL.match(text, at, stop).end()
            marked = True
            after = BLANK.match(text, end, stop).end()
            if after < stop and (text[after] in COMMAS or text[after].islower()):
                continue
            out.append((begin, end))
            begin = done = end
        else:
            if depth:
                marked = marked or is_real(text, at, start, stop)
                continue
            end = RUN.match(text, at, stop).end()
            run = text[at:end]
            if all(c in DOTS or c not in TERMINATORS for c in run):
                if not dot_ends(text, at, end, start, stop):
                    done = end
                    continue
                if end >= stop and not is_real(text, at, start, stop) and len(run) == 1:
                    done = end
                    continue
            marked = True
            while end < stop and text[end] in CLOSE and end not in paired:
                end = TAIL.match(text, end, stop).end()
            out.append((begin, end))
            begin = done = end
    if begin < stop:
        out.append((begin, stop))
    return marked


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence of a text, in order, outer white space excluded."""
    if not text:
        return []
    rough: list[tuple[int, int]] = []
    marked = False
    for m in LINE.finditer(text):
        marked = line_spans(text, m.start(), m.end(), rough) or marked
    if not marked and "\u3000" in text:
        finer = []
        for a, b in rough:
            while (k := text.find("\u3000", a, b)) >= 0:
                finer.append((a, k))
                a = k + 1
            finer.append((a, b))
        rough = finer
    out = []
    for a, b in rough:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


SENTENCES = "doc_no long, field_name string, sent_start long, sent_end long"


def sentences(df: DataFrame, key: str = "doc_no", fields: tuple[str, ...] = ("original", "translation")) -> DataFrame:
    """Each sentence of the named text fields as (key, field_name, sent_start, sent_end); a map without shuffle."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for j, field in enumerate(fields):
                k, a, b = [], [], []
                for no, text in zip(keys, batch.column(1 + j).to_pylist()):
                    spans = sentence_spans(text)
                    k += [no] * len(spans)
                    a += [s for s, _ in spans]
                    b += [e for _, e in spans]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([field] * len(k), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[key, "field_name", "sent_start", "sent_end"])

    return df.select(key, *fields).mapInArrow(split, f"{key} long, field_name string, sent_start long, sent_end long")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the originals and translations of all records."""
    return sentences(records(spark, sf_dir, "original", "translation"))


def p7_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field: sentences, their characters and the longest one."""
    n = F.col("sent_end") - F.col("sent_start")
    return p7_found(spark, sf_dir).groupBy("field_name").agg(F.count("*").alias("sentences"), F.sum(n).alias("chars"), F.max(n).alias("longest"))

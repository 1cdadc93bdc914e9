"""Text functions as Spark columns: normal form, blocks, grams, masking, matching, estimates.

Everything here is a built-in expression; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word characters, the full-width forms with their half-width ones, the negations, and the query stop words.
WORD = "一-鿿㐀-䶿0-9A-Za-z"
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
NEGATIONS = "不没无别勿莫"
STOP_WORDS = (
    "不断 互相 已经 有人 一直 可能 应该 需要 很多 时候 地方 事情 问题 情况 方面 这样 那样 这些 那些 一样 什么 怎么 如何 多少 几个 因为 所以 因此 因而 从而 "
    "但是 而且 如果 虽然 然后 还是 或者 还有 就是 只是 不过 甚至 尤其 反而 现在 当时 如今 之前 之后 以后 以前 目前 起来 还在 一起 一再 越来越 最重 我们 他们 "
    "你们 自己 对方 别人 大家 上面 下面 里面 外面 一个 一次 每次"
).split()
#: Stop words in the order in which they are masked: the longest first, then by code point.
MASK_ORDER = sorted(STOP_WORDS, key=lambda w: (-len(w), w))
#: Lengths of the grams that make up the index.
GRAM_LENGTHS = (2, 3, 4)
MAX_TOKENS = 24


def normalize(c: Column) -> Column:
    """Query normal form: full-width forms and the ideographic space folded, runs of other characters to one blank. null gives ''."""
    folded = F.translate(F.coalesce(c, F.lit("")), FULL + "　", HALF + " ")
    return F.trim(F.regexp_replace(folded, f"[^{WORD}]+", " "))


def blocks(c: Column) -> Column:
    """Maximal runs of word characters of at least two; null gives an empty array. Nothing is folded."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[^{WORD}]+"), lambda b: F.length(b) >= 2)


def windows(b: Column, n: int) -> Column:
    """All substrings of n characters of b; none if it is shorter."""
    return F.when(F.length(b) >= n, F.transform(F.sequence(F.lit(1), F.length(b) - n + 1), lambda i: F.substring(b, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def grams(c: Column) -> Column:
    """The grams of a text's blocks, repeats included; they cross no block edge."""
    return F.flatten(F.transform(blocks(c), lambda b: F.concat(*[windows(b, n) for n in GRAM_LENGTHS])))


def array_grams(c: Column) -> Column:
    """The grams of the texts of an array; a null array or element gives none."""
    return F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), grams))


def bigrams(c: Column) -> Column:
    """Distinct raw bigrams of the blocks of a normal form."""
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(c, " "), lambda b: F.length(b) >= 2), lambda b: windows(b, 2))))


def mask(c: Column, words: list[str] | None = None) -> Column:
    """Text without its stop words (or those given), removed one after the other, the longest first."""
    for w in MASK_ORDER if words is None else sorted(words, key=lambda w: (-len(w), w)):
        c = F.replace(c, F.lit(w), F.lit(""))
    return c


def hit(needle: Column, hay: Column) -> Column:
    """Whether some occurrence of needle has no negation right before or after it."""
    return F.regexp_like(hay, F.concat(F.lit(rf"(?<![{NEGATIONS}])\Q"), needle, F.lit(rf"\E(?![{NEGATIONS}])")))


def matches_with_gap(core: Column, hay: Column, gap: int = 2) -> Column:
    """Whether the characters of core follow one another in hay, each at its first place after the one before, with at most ``gap`` others between."""
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("skipped"), F.lit(True).alias("ok"), F.lit(True).alias("first"))

    def step(s: Column, ch: Column) -> Column:
        j = F.call_function("locate", ch, hay, s["at"])
        return F.struct((j + 1).alias("at"), F.when(s["first"], 0).otherwise(s["skipped"] + j - s["at"]).alias("skipped"), (s["ok"] & (j > 0)).alias("ok"), F.lit(False).alias("first"))

    chars = F.filter(F.split(core, ""), lambda x: x != "")
    return F.aggregate(chars, start, step, lambda s: s["ok"] & (s["skipped"] <= gap) & (F.length(core) > 0) & (F.length(hay) > 0))


def verdict(c: Column) -> Column:
    """The verdict in its closed set; anything else gives ''."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(v.isin("上", "上策"), "上").when(v.isin("中", "中策"), "中").when(v.isin("下", "下策"), "下").otherwise("")


def estimated_tokens(c: Column) -> Column:
    """0.3 for each ASCII character and 0.6 for any other, rounded up; null gives 0."""
    text = F.coalesce(c, F.lit(""))
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil((ascii_chars * 3 + (F.length(text) - ascii_chars) * 6) / F.lit(10)).cast("long")


def truncated(c: Column, n: int = 4000, marker: str = "…") -> Column:
    """At most n characters, then the marker."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def version_key(c: Column, parts: int = 4) -> Column:
    """A version's parts as numbers, missing and other parts 0; keys compare like versions."""
    cleaned = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^[vV]", "")
    numbers = F.transform(F.split(cleaned, r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), parts)), 1, parts)


def without_fence(c: Column) -> Column:
    """The inside of a fenced block, if the text is one."""
    inside = F.regexp_extract(F.trim(c), r"(?s)^```[^\n]*\n(.*?)\n?```$", 1)
    return F.when(inside != "", inside).otherwise(F.trim(c))


def dirty_flags(c: Column) -> dict[str, Column]:
    """Residue of pages and broken characters in a text."""
    return {
        "has_nav": F.regexp_like(c, F.lit("[上下]一[节章]")),
        "has_html": F.regexp_like(c, F.lit(r"</?[A-Za-z][^>]*>|&[a-z]+;|&#\d+;")),
        "has_bad_char": F.contains(c, F.lit("�")),
        "has_rare_char": F.regexp_like(c, F.lit("[\\x{10000}-\\x{10FFFF}]")),
    }


def fixed3(c: Column) -> Column:
    """Three decimals, as text."""
    return F.format_string("%.3f", c)

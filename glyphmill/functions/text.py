"""Column functions on texts, words and segmentations.

A segmentation travels as an array of parts, or, while symbols are merged, as a
padded string in which each symbol stands between its own two spaces, so that
merging a pair is one ``replace``: greedy, left to right, non-overlapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: all Unicode white space, as a class that Java and RE2 both read.
WHITESPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LINE_BREAK = "\r\n|\r|\n"
EOL = "</w>"


def words(text: Column) -> Column:
    """The white-space separated tokens of a text."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def lower_line(text: Column) -> Column:
    """Tokens in lower case, joined by one space."""
    return F.array_join(F.transform(words(text), F.lower), " ")


def pad_symbols(word: Column, use_eol: bool = False) -> Column:
    """A word as padded characters, with an end-of-word symbol if asked for."""
    padded = F.concat(F.lit(" "), F.array_join(F.split(word, ""), "  "), F.lit(" "))
    return F.concat(padded, F.lit(f" {EOL} ")) if use_eol else padded


def pad_parts(parts: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(parts, "  "), F.lit(" "))


def symbols(padded: Column) -> Column:
    """The symbols of a padded segmentation."""
    return F.split(F.trim(padded), "  ")


def merge_pair(padded: Column, left: str | Column, right: str | Column) -> Column:
    left, right = (F.lit(x) if isinstance(x, str) else x for x in (left, right))
    return F.replace(padded, F.concat(F.lit(" "), left, F.lit("  "), right, F.lit(" ")), F.concat(F.lit(" "), left, right, F.lit(" ")))


def adjacent_pairs(parts: Column) -> Column:
    """Overlapping neighbours as array<struct<l, r>>."""
    n = F.size(parts)
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    return F.when(n > 1, pairs)


def boundaries(parts: Column) -> Column:
    """Inner boundary offsets of a segmentation: running lengths without the last."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        at = acc["at"] + F.length(part)
        return F.struct(at.alias("at"), F.array_append(acc["found"], at).alias("found"))

    return F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda acc: acc["found"])


def strip_eol(parts: Column) -> Column:
    """Without an end-of-word symbol: a last part of its own goes, one at the end of the last part is cut off."""
    last, n = F.element_at(parts, -1), F.size(parts)
    head = F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.when(last == EOL, head).when(last.endswith(EOL), F.concat(head, F.array(F.replace(last, F.lit(EOL), F.lit(""))))).otherwise(parts)


def strip_label(parts: Column) -> Column:
    """Each part up to its first colon, without empty-morph marks (~)."""
    return F.filter(F.transform(parts, lambda p: F.substring_index(p, ":", 1)), lambda p: p != "~")


def capitalised(word: Column) -> Column:
    """Whether the first character is upper case."""
    return F.substring(word, 1, 1).rlike(r"^\p{Lu}")


def capitalise(part: Column) -> Column:
    return F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 1 << 30))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Code points in which two strings agree from the start."""
    upto = F.least(F.length(a), F.length(b))
    return F.when(upto > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i)))).otherwise(0)


def drop_strings(long: Column, short: Column, kind: Column) -> tuple[Column, Column]:
    """(from, to) of an affix rule without what both share: a prefix for suffix rules (kind s), else a suffix."""
    at_start = common_prefix_length(long, short)
    at_end = common_prefix_length(F.reverse(long), F.reverse(short))

    def cut(x: Column) -> Column:
        return F.when(kind == "s", F.substring(x, at_start + 1, F.length(x))).otherwise(F.left(x, F.length(x) - at_end))

    return cut(long), cut(short)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where a norm is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)

"""Word vectors: parsing, means, and filling in words without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def parse_vectors(lines: DataFrame, dim: int, line: str = "line", order: str | None = None) -> DataFrame:
    """word, vec from lines of fields: the last ``dim`` are numbers (``.`` is 0), those before make the word.

    Of a word's lines the last by ``order`` counts, if given.
    """
    fields = lines.select(words(F.col(line)).alias("f"), *([F.col(order).alias("_o")] if order else [])).where(F.size("f") > dim)
    numbers = F.transform(F.slice("f", F.size("f") - dim + 1, F.lit(dim)), lambda x: F.when(x == ".", 0.0).otherwise(x.cast("double")))
    parsed = fields.select(F.array_join(F.slice("f", F.lit(1), F.size("f") - dim), "").alias("word"), numbers.alias("vec"), *(["_o"] if order else []))
    return parsed.groupBy("word").agg(F.max_by("vec", "_o").alias("vec")) if order else parsed


def mean_vector(vectors: DataFrame) -> DataFrame:
    """One row, vec: the element-wise mean."""
    each = vectors.select(F.posexplode("vec").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("vec"))  # one row for each dimension


def _deletions(word: str) -> str:
    """SQL: the word, and it without any one or two characters."""
    one = f"transform(sequence(1, length({word})), i -> concat(left({word}, i - 1), substring({word}, i + 1)))"
    two = f"flatten(transform(sequence(1, length({word})), i -> transform(sequence(1, greatest(length({word}) - 1, 1)), j -> concat(left(concat(left({word}, i - 1), substring({word}, i + 1)), j - 1), substring(concat(left({word}, i - 1), substring({word}, i + 1)), j + 1)))))"
    return f"array_distinct(concat(array({word}), CASE WHEN length({word}) > 0 THEN {one} ELSE array() END, CASE WHEN length({word}) > 1 THEN {two} ELSE array() END))"


def impute_vectors(needed: DataFrame, vectors: DataFrame, vocab: DataFrame, distance: int = 2) -> DataFrame:
    """word, source, vec for every needed word.

    A word without a vector takes that of the most frequent word within edit distance ``distance`` (at most 2) that
    has one, nearer words first, ties by word; without such a word the mean.  ``source``: the word whose vector it is, or null
    for the mean.  Near words meet through shared deletions, an equi-join.
    """
    wanted = needed.select("word").distinct()
    have = wanted.join(vectors, "word").select("word", F.col("word").alias("source"), "vec")
    missing = wanted.join(vectors.select("word"), "word", "left_anti")
    rated = vectors.select("word").join(vocab, "word", "left").select(F.col("word").alias("near"), F.coalesce("freq", F.lit(0)).alias("freq"))
    left = missing.select("word", F.explode(F.expr(_deletions("word"))).alias("key"))
    right = rated.select("near", "freq", F.explode(F.expr(_deletions("near"))).alias("key"))
    pairs = left.join(right, "key").select("word", "near", "freq").distinct().withColumn("d", F.levenshtein("word", "near")).where(F.col("d") <= distance)
    best = pairs.groupBy("word").agg(F.min_by("near", F.struct("d", (-F.col("freq")).alias("f"), "near")).alias("source"))
    found = missing.join(best, "word", "left").join(vectors.select(F.col("word").alias("source"), "vec"), "source", "left")
    filled = found.crossJoin(mean_vector(vectors).withColumnRenamed("vec", "_mean"))  # a single row
    return have.unionByName(filled.select("word", "source", F.coalesce("vec", "_mean").alias("vec")))


def count_imputed(filled: DataFrame) -> DataFrame:
    return filled.agg(F.count_if(F.col("source").isNull()).alias("mean_imputed"))

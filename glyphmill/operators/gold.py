"""Preparing gold standards, corpora and word lists for evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, strip_label, words
from .vocab import vocabulary


def parse_alternatives(analyses: Column) -> Column:
    """``a b, c d`` as array<array<string>>."""
    return F.transform(F.split(analyses, ", "), lambda a: F.split(F.trim(a), " "))


def strip_labels(gold: DataFrame) -> DataFrame:
    """Every part without its label, empty morphs dropped."""
    return gold.withColumn("alts", F.transform("alts", strip_label))


def serialise(gold: DataFrame) -> DataFrame:
    """word, line: ``word<TAB>a b, c d``."""
    told = F.array_join(F.transform("alts", lambda a: F.array_join(a, " ")), ", ")
    return gold.select("word", F.concat_ws("\t", "word", told).alias("line"))


def in_vocabulary(gold: DataFrame, vocab: DataFrame) -> DataFrame:
    return gold.join(vocab.select("word").distinct(), "word", "left_semi")


def union_gold(first: DataFrame, second: DataFrame, vocab: DataFrame) -> DataFrame:
    """First-style entries of the vocabulary as they are, and second-style ones of other words with labels stripped."""
    kept = in_vocabulary(first, vocab)
    rest = in_vocabulary(second, vocab).join(kept.select("word"), "word", "left_anti")
    return kept.select("word", "alts").unionByName(strip_labels(rest).select("word", "alts"))


def evaluation_data(table: DataFrame, gold: DataFrame, vectors: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frequency lines, gold, word list) restricted to words of the table that have a vector; gold without labels."""
    fields = table.select(F.col(line), words(F.col(line)).alias("f")).where(F.size("f") == 2).select(line, F.col("f")[1].alias("word"))
    known = fields.select("word").distinct().join(vectors.select("word"), "word", "left_semi")
    return fields.join(known, "word", "left_semi").select(line), strip_labels(in_vocabulary(gold, known)), known


def evaluation_corpus(table: DataFrame, gold: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(corpus, gold) from a tab-separated corpus: its second field, and the gold entries of its words without labels."""
    corpus = table.select(F.get(F.split(F.col(line), "\t"), F.lit(1)).alias("text")).where("text IS NOT NULL")
    return corpus, strip_labels(in_vocabulary(gold, vocabulary(corpus)))


def prune_parallel(sides: DataFrame, max_length: int, columns: tuple[str, ...] = ("base_src", "base_tgt", "morpho_src", "morpho_tgt")) -> DataFrame:
    """Line-aligned texts all of whose token counts are below ``max_length``; a missing side is an empty line."""
    filled = sides.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})
    short = None
    for c in columns:
        ok = F.size(F.filter(F.split(F.col(c), WHITESPACE), lambda w: w != "")) < max_length
        short = ok if short is None else short & ok
    return filled.where(short)

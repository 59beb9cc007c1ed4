"""Morpheme-boundary scores of segmentations against gold standards with alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import boundaries
from .bpe import apply_merges, remove_eols


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under == 0, F.lit(1.0)).otherwise(over.cast("double") / under)


def word_scores(gold: DataFrame, segs: DataFrame, check_letters: bool = True) -> DataFrame:
    """word, hits, insertions, deletions of each suggested word that is in the gold standard, against its best alternative.

    The best alternative has the highest F; among equals the higher precision, then the later one.  An alternative
    that doesn't spell its word is an error.
    """
    both = segs.select("word", F.col("parts").alias("_sug")).join(gold.select("word", "alts"), "word")
    each = both.select("word", "_sug", F.posexplode(F.transform("alts", lambda a: F.filter(a, lambda p: p != ""))).alias("_no", "_alt"))
    if check_letters:
        wrong = F.raise_error(F.concat(F.lit("letters differ: "), F.col("word")))
        each = each.withColumn("_alt", F.when(F.array_join("_alt", "") == F.array_join("_sug", ""), F.col("_alt")).otherwise(wrong))
    sug, want = boundaries(F.col("_sug")), boundaries(F.col("_alt"))
    h, i, d = F.size(F.array_intersect(sug, want)), F.size(F.array_except(sug, want)), F.size(F.array_except(want, sug))
    each = each.select("word", "_no", h.alias("h"), i.alias("i"), d.alias("d"))
    f, p = _ratio(2 * F.col("h"), 2 * F.col("h") + F.col("i") + F.col("d")), _ratio(F.col("h"), F.col("h") + F.col("i"))
    best = each.groupBy("word").agg(F.max_by(F.struct("h", "i", "d"), F.struct(f, p, "_no")).alias("b"))
    return best.select("word", F.col("b.h").cast("bigint").alias("hits"), F.col("b.i").cast("bigint").alias("insertions"), F.col("b.d").cast("bigint").alias("deletions"))


def totals(scores: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged precision, recall and F (1 where nothing is to be found)."""
    sums = scores.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "insertions", "deletions")), F.count("*").alias("evaluated"))
    h, i, d = F.col("hits"), F.col("insertions"), F.col("deletions")
    return sums.select(*by, "evaluated", "hits", "insertions", "deletions", _ratio(h, h + i).alias("precision"), _ratio(h, h + d).alias("recall"), _ratio(2 * h, 2 * h + i + d).alias("fmeasure"))


def report(gold: DataFrame, segs: DataFrame, gold_lines: int | None = None) -> DataFrame:
    """One row: the numbers of gold and suggested words, of words evaluated and their percentages, and the scores."""
    scored = totals(word_scores(gold, segs))
    counts = gold.agg(F.count("*").alias("gold_words")).crossJoin(segs.agg(F.count("*").alias("suggested_words")))  # two single rows
    if gold_lines is not None:
        counts = counts.withColumn("gold_words", F.lit(gold_lines).cast("bigint"))
    share = lambda c: F.round(F.try_divide(100 * F.col("evaluated"), F.col(c)), 2)
    return counts.crossJoin(scored).withColumns({"gold_percent": share("gold_words"), "suggested_percent": share("suggested_words")})


def format_report(report_row: DataFrame) -> DataFrame:
    """The report's three score lines."""
    line = lambda name, c: F.format_string(f"{name}: %.2f%%%%", F.col(c) * 100)
    return report_row.select(F.explode(F.array(line("F-measure", "fmeasure"), line("Precision", "precision"), line("Recall", "recall"))).alias("value"))


def parse_report(lines: DataFrame, line: str = "value") -> DataFrame:
    """The F-measure of a score report, in percent."""
    return lines.where(F.col(line).startswith("F-measure:")).select(F.regexp_extract(line, r"([0-9.]+)%", 1).cast("double").alias("fmeasure"))


def merge_sweep(gold: DataFrame, merges: list[tuple[str, str]], cuts: list[int], use_eol: bool = False, presegs: DataFrame | None = None) -> DataFrame:
    """num_merges and scores of the gold words segmented with the first ``num_merges`` merges, for every cut."""
    from .preseg import apply_presegs, recover_presegs

    words = gold.select("word").distinct()
    out = None
    for cut in cuts:
        vocab = words
        if presegs is not None:
            vocab = apply_presegs(words.withColumn("freq", F.lit(1)), presegs).select("word")
        segs = apply_merges(vocab, merges, cut, use_eol)
        segs = remove_eols(segs) if use_eol else segs
        if presegs is not None:
            segs = recover_presegs(words, presegs, segs)
        one = word_scores(gold, segs).withColumn("num_merges", F.lit(cut))
        out = one if out is None else out.unionByName(one)
    return totals(out, "num_merges")


def score_table(base: DataFrame, morpho: DataFrame) -> DataFrame:
    """num_merges, bpe_f, morph_f in percent (two decimals)."""
    told = lambda df, name: df.select("num_merges", F.round(F.col("fmeasure") * 100, 2).alias(name))
    return told(base, "bpe_f").join(told(morpho, "morph_f"), "num_merges")


def score_peaks(table: DataFrame) -> DataFrame:
    return table.agg(F.max("bpe_f").alias("bpe_peak"), F.max("morph_f").alias("morph_peak"))

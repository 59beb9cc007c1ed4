"""Writers of the text formats.  Ordered outputs are range-sorted: their part files, in name order, are in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EOL


def segmentation_lines(segs: DataFrame) -> DataFrame:
    """``word: p1 p2`` lines sorted by word."""
    return segs.orderBy("word").select(F.concat(F.col("word"), F.lit(": "), F.array_join("parts", " ")).alias("value"))


def write_segmentations(segs: DataFrame, path: str) -> None:
    segmentation_lines(segs).write.text(path)


def write_merges(merges: DataFrame, path: str) -> None:
    merges.orderBy("rank").select(F.concat_ws(" ", "l", "r").alias("value")).write.text(path)


def write_suggestions(segs: DataFrame, path: str, order: str = "word") -> None:
    """Parts separated by one space, without end-of-word symbols."""
    line = F.replace(F.replace(F.array_join("parts", " "), F.lit(f" {EOL}"), F.lit("")), F.lit(EOL), F.lit(""))
    segs.orderBy(order).select(line.alias("value")).write.text(path)


def write_corpus(corpus: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id", "line_no"), text: str = "text") -> None:
    """One line per row, in the order of the keys."""
    corpus.orderBy(*keys).select(F.col(text).alias("value")).write.text(path)


def write_lines(lines: DataFrame, path: str, line: str = "line") -> None:
    lines.select(F.col(line).alias("value")).write.text(path)


def write_score_table(table: DataFrame, path: str) -> None:
    """CSV: header, blank, rows by number of merges, blank, peaks.  A table has one row for each cut of a sweep."""
    row = F.concat_ws(",", *(F.col(c).cast("string") for c in ("num_merges", "bpe_f", "morph_f")))
    rows = table.select(F.lit(2).alias("k"), F.col("num_merges").alias("n"), row.alias("value"))
    peaks = table.agg(F.concat_ws(",", F.lit("Peak"), F.max("bpe_f").cast("string"), F.max("morph_f").cast("string")).alias("value")).select(F.lit(4).alias("k"), F.lit(0).alias("n"), "value")
    fixed = table.sparkSession.createDataFrame([(0, 0, "Num Iterations,BPE Scores,Morpho Scores"), (1, 0, ""), (3, 0, "")], "k int, n int, value string")
    fixed.unionByName(rows).unionByName(peaks).coalesce(1).sortWithinPartitions("k", "n").select("value").write.text(path)


def write_parallel(sides: DataFrame, paths: dict[str, str]) -> None:
    """Each column of aligned lines to its own place, in line order."""
    for column, path in paths.items():
        sides.orderBy("line_no").select(F.col(column).alias("value")).write.text(path)


def write_table(table: DataFrame, path: str) -> None:
    table.write.parquet(path)

"""Readers of the text formats, and of the tables that replace pickles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..operators.gold import parse_alternatives
from ..operators.preseg import RULES_SCHEMA
from ..operators.vectors import parse_vectors


def read_lines(spark: SparkSession, path: str, ignore_errors: bool = False) -> DataFrame:
    """line_no, value.  Line numbers rise in file order; they have gaps between the splits of a large file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    return lines.withColumn("value", F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))) if ignore_errors else lines


def number_lines(lines: DataFrame) -> DataFrame:
    """Consecutive line numbers, from the sizes of the splits: no global sort."""
    split = lines.withColumn("_split", F.shiftright("line_no", 33))
    sizes = {r["_split"]: r["n"] for r in split.groupBy("_split").agg(F.count("*").alias("n")).collect()}  # one row for each split
    first, total = {}, 0
    for k in sorted(sizes):
        first[k], total = total, total + sizes[k]
    if not first:
        return lines
    start = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))
    return split.select((start[F.col("_split")] + F.col("line_no").bitwiseAND((1 << 33) - 1)).alias("line_no"), "value")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """word, alts of a gold standard; of repeated words the last line counts.  A line must be ``word<TAB>analyses``."""
    lines = read_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    bad = F.raise_error(F.concat(F.lit("not a gold line: "), F.col("value")))
    checked = lines.withColumn("value", F.when(F.col("value").rlike(r"^[^\t]+\t[^\t]+$"), F.col("value")).otherwise(bad))
    fields = checked.select("line_no", F.split("value", "\t").alias("f"))
    return fields.groupBy(F.col("f")[0].alias("word")).agg(F.max_by(F.col("f")[1], "line_no").alias("a")).select("word", parse_alternatives(F.col("a")).alias("alts"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """rank, l, r of a merge list."""
    fields = number_lines(read_lines(spark, path)).select(F.col("line_no").cast("int").alias("rank"), F.split(F.trim("value"), " ").alias("f"))
    return fields.select("rank", F.col("f")[0].alias("l"), F.col("f")[1].alias("r"))


def read_segmentations(spark: SparkSession, path: str) -> DataFrame:
    """word, parts of ``word: p1 p2`` lines."""
    last = F.substring_index("value", ": ", -1)
    return read_lines(spark, path).select(F.left(F.col("value"), F.length("value") - F.length(last) - 2).alias("word"), F.split(last, " ").alias("parts"))


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """word, parts of suggested segmentations, one word per line, parts separated by one space."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), " ")
    return read_lines(spark, path).select(F.array_join(parts, "").alias("word"), parts.alias("parts"))


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return parse_vectors(read_lines(spark, path), dim, "value", "line_no")


def read_transformations(spark: SparkSession, path: str) -> DataFrame:
    """ord, rule, transformations of a JSON list of affix rules."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", RULES_SCHEMA).alias("rules"))
    return whole.select(F.posexplode("rules").alias("ord", "r")).select("ord", "r.rule", "r.transformations")


def read_word_list(spark: SparkSession, path: str, field: int | None = None) -> DataFrame:
    """word of each line, or of a field of each line."""
    lines = read_lines(spark, path)
    return lines.select((F.col("value") if field is None else F.get(F.split(F.trim("value"), WHITESPACE), F.lit(field))).alias("word"))


def read_parallel(spark: SparkSession, base_src: str, base_tgt: str, morpho_src: str, morpho_tgt: str) -> DataFrame:
    """line_no and four aligned texts, as many lines as the first has; shorter files give empty lines."""
    one = lambda path, name: number_lines(read_lines(spark, path)).withColumnRenamed("value", name)
    out = one(base_src, "base_src")
    for path, name in ((base_tgt, "base_tgt"), (morpho_src, "morpho_src"), (morpho_tgt, "morpho_tgt")):
        out = out.join(one(path, name), "line_no", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Vectors (word, vec) or pre-segmentations (word, parts) kept as Parquet."""
    return spark.read.parquet(path)

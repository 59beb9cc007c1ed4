"""Inputs that the registered queries derive from the driver's tables, each as a frame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..operators.vocab import kept, vocabulary
from ..session import ship

#: Suffixes that stand for morphology, longest first, and their rules (suffix to replacement).
SUFFIXES = ("ment", "ing", "ed", "en", "s")
RULES = (("ing", ""), ("s", ""), ("ed", ""), ("en", ""), ("ing", "ed"), ("ed", "en"), ("ment", ""))
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs if lang is None else docs.where(F.col("lang") == lang)


def vocab(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    return vocabulary(documents(spark, sf_dir, lang))


def kept_vocab(spark: SparkSession, sf_dir: str, lang: str | None = None, lower: bool = False) -> DataFrame:
    """The vocabulary for those who read it more than once."""
    return kept(vocabulary(documents(spark, sf_dir, lang), ignore_case=lower))


def vocab_sql(lang: str | None = None, lower: bool = False) -> str:
    where = f" WHERE lang = '{lang}'" if lang else ""
    word = "lower(w)" if lower else "w"
    return f"SELECT {word} AS word, count(*)::BIGINT AS freq FROM (SELECT unnest(string_split_regex(text, '{WHITESPACE}')) AS w FROM documents{where}) WHERE w <> '' GROUP BY 1"


def _suffix_sql() -> str:
    return "CASE " + " ".join(f"WHEN word LIKE '%{s}' AND length(word) >= {len(s) + 3} THEN '{s}'" for s in SUFFIXES) + " END"


def stems(words: DataFrame) -> DataFrame:
    """word, freq, stem, suf of the words that end in a listed suffix after at least three characters."""
    cut = words.withColumn("suf", F.expr(_suffix_sql())).where("suf IS NOT NULL")
    return cut.withColumn("stem", F.expr("left(word, length(word) - length(suf))"))


def stems_sql(words: str) -> str:
    return f"SELECT word, freq, suf, left(word, length(word) - length(suf)) AS stem FROM (SELECT word, freq, {_suffix_sql()} AS suf FROM ({words})) WHERE suf IS NOT NULL"


def presegs(words: DataFrame) -> DataFrame:
    return stems(words).select("word", F.array("stem", "suf").alias("parts"))


def gold_lines(words: DataFrame, labelled: bool = False) -> DataFrame:
    """word, line of a gold standard: the stem and suffix, and for words of even length the whole word as well."""
    alt = F.concat(F.col("stem"), F.lit(":x_N ~ "), F.col("suf"), F.lit(":+Y")) if labelled else F.concat_ws(" ", "stem", "suf")
    more = F.when(F.length("word") % 2 == 0, F.concat(F.lit(", "), F.col("word"))).otherwise("")
    return stems(words).select("word", F.concat(F.col("word"), F.lit("\t"), alt, more).alias("line"))


def gold(words: DataFrame, labelled: bool = False) -> DataFrame:
    from ..operators.gold import parse_alternatives

    return gold_lines(words, labelled).select("word", parse_alternatives(F.split("line", "\t")[1]).alias("alts"))


def gold_alts_sql(words: str) -> str:
    """word, idx, alt (parts): one row for each alternative of the plain gold standard."""
    return f"SELECT word, 0 AS idx, [stem, suf] AS alt FROM ({stems_sql(words)}) UNION ALL SELECT word, 1, [word] FROM ({stems_sql(words)}) WHERE length(word) % 2 = 0"


def word_vectors(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """word, vec: each word has the embedding whose number among all is the word's length and frequency modulo their count."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = vectors.count()
    return words.withColumn("vec_id", F.pmod(F.col("freq") * 31 + F.length("word") * 7 + F.ascii("word"), F.lit(max(n, 1)))).join(vectors, "vec_id").select("word", "vec")


def word_vectors_sql(words: str) -> str:
    return f"SELECT word, embedding::DOUBLE[] AS vec FROM ({words}) w JOIN embeddings e ON e.vec_id = (w.freq * 31 + length(w.word) * 7 + ascii(w.word)) % (SELECT count(*) FROM embeddings)"


def rules(spark: SparkSession, words: DataFrame) -> DataFrame:
    """ord, rule, transformations: for each rule, examples among the vocabulary: its three most frequent pairs."""
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(RULES)], "ord int, a string, b string")
    pairs = words.select("word", "freq", F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(RULES)))).alias("r")).select("word", "freq", "r.*")
    pairs = pairs.where(F.expr("endswith(word, a) AND length(word) >= length(a) + 3")).withColumn("other", F.expr("concat(left(word, length(word) - length(a)), b)"))
    known = pairs.join(words.select(F.col("word").alias("other"), F.col("freq").alias("f2")), "other")
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("freq"), "word", "other"))).where("_n <= 3")
    best = first.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "word", "other"))).alias("top"))
    shown = F.transform("top", lambda x: F.struct((1.0 / (2 + F.log10(-x["f"].cast("double")))).cast("string").alias("cosine"), F.struct(x["word"].alias("input"), x["other"].alias("output")).alias("rule")))
    return frame.join(best, "ord", "left").select("ord", F.struct(F.col("a").alias("from"), F.col("b").alias("to"), F.lit("s").alias("kind")).alias("rule"), F.when(F.col("top").isNotNull(), shown).alias("transformations"))

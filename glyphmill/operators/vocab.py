"""Vocabularies: (word, freq) from corpora and frequency tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, lower_line, words
from ..session import scratch, ship, spread

#: Distinct words that a task holds before it sends their counts on.
HELD_WORDS = 500_000


def vocabulary(corpus: DataFrame, text: str = "text", ignore_case: bool = False) -> DataFrame:
    """Token counts; with ``ignore_case`` of lower-cased tokens.  Null texts hold no tokens.

    Tasks count the words of the texts that they read (``str.split`` cuts at the same white space as WHITESPACE), so that
    words are shuffled with their counts, not token by token.
    """
    ship(corpus.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            yield from (found.slice(k, 50_000) for k in range(0, found.num_rows, 50_000))

        for batch in batches:
            for value in batch.column(0):
                held.update((value.as_py() or "").split())
                if len(held) > HELD_WORDS:
                    yield from told()
        yield from told()

    seen = corpus.select(F.col(text).cast("string")).mapInArrow(count, "word string, n bigint")
    if ignore_case:
        seen = seen.select(F.lower("word").alias("word"), "n")
    return seen.groupBy("word").agg(F.sum("n").alias("freq"))


def kept(vocab: DataFrame) -> DataFrame:
    """The vocabulary as a table of its own, for those who read it more than once: texts are counted once, and every core gets a share of the words."""
    return scratch(vocab.repartition(spread(vocab.sparkSession), "word"), "vocabulary")


def frequency_table(table: DataFrame, line: str = "line") -> DataFrame:
    """A vocabulary from lines of ``freq word``; other lines are skipped, repeated words added up."""
    fields = table.select(words(F.col(line)).alias("f")).where(F.size("f") == 2)
    return fields.groupBy(F.col("f")[1].alias("word")).agg(F.sum(F.col("f")[0].cast("bigint")).alias("freq"))


def corpus_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, text of every line of every text."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "text"))


def lowercase_corpus(corpus: DataFrame, text: str = "text") -> DataFrame:
    return corpus.withColumn(text, lower_line(F.col(text)))


def without_most_frequent(vocab: DataFrame, k: int) -> DataFrame:
    """The vocabulary without its k most frequent words (ties by word).  Only k rows meet in one place."""
    if k <= 0:
        return vocab
    top = vocab.orderBy(F.desc("freq"), "word").limit(k).select("word")
    return vocab.join(top, "word", "left_anti")


def drop_zero(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("freq") != 0)

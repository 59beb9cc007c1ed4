"""Merges chosen by an n-gram model: context tables, log-likelihood changes, training.

Contexts are n symbols joined by one space; the pad before and after a word is
the empty symbol, which no word holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting
from ..functions.counting import PAD
from ..functions.text import adjacent_pairs, merge_pair, symbols, words
from ..session import drop_scratch, scratch, ship
from .bpe import Merge, initial_segmentation, pair_statistics, split_padded, top_pairs

#: Distinct windows, or changed ones, that a task holds before it sends them on, and texts that it turns into arrays at a time.
HELD, TEXTS = 1_000_000, 500


def padded(parts: Column, n: int) -> Column:
    pads = F.array_repeat(F.lit(PAD), n)
    return F.concat(pads, parts, pads)


def ngram_counts(segs: DataFrame, n: int, first_word_freq: int | None = None) -> DataFrame:
    """ctx, sym, n: how often a symbol follows a context within words, weighted by freq.

    ``first_word_freq``: also count the all-pad windows between words, n for each word but the first,
    whose frequency this is.
    """
    seen = _counted(segs.select(F.col("freq").cast("bigint"), "parts").where("parts IS NOT NULL"), n)
    if first_word_freq is not None:
        between = segs.agg((F.lit(n) * (F.sum("freq") - F.lit(first_word_freq))).alias("n"))
        seen = seen.unionByName(between.select(F.array_join(F.array_repeat(F.lit(PAD), n), " ").alias("ctx"), F.lit(PAD).alias("sym"), "n"))
    return seen.groupBy("ctx", "sym").agg(F.sum("n").alias("n"))


def _rows(batch: pa.RecordBatch, n: int, names: counting.Names) -> Iterator[counting.Rows]:
    """The batch's rows of symbols: texts, lists, lists of words, or, with a first column of weights, lists or padded strings."""
    cells = batch.column(batch.num_columns - 1)
    if batch.num_columns > 1:
        yield counting.of_parts(split_padded(cells), n, names, counting.whole_numbers(batch.column(0)))
        return
    for k in range(0, batch.num_rows, TEXTS):
        part = cells.slice(k, TEXTS)
        yield counting.of_parts(part, n, names) if pa.types.is_nested(part.type) else counting.of_texts(part.to_pylist(), n, names)


def _counted(rows: DataFrame, n: int) -> DataFrame:
    """ctx, sym, n: the windows of rows as in ``_rows``, added up by tasks, several times where more than one has them."""
    ship(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = counting.Names()

        def told(columns: list, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*counting.told_windows(columns, names), pa.array(counts)], names=["ctx", "sym", "n"])

        held = counting.Held(names, n + 1, HELD, told)
        for batch in batches:
            for found in _rows(batch, n, names):
                yield from held.add(*counting.windows(found, n, names))
        yield from held.rest()

    return rows.mapInArrow(count, "ctx string, sym string, n bigint")


def _changes(rows: DataFrame, n: int, wanted: list[tuple[str, str]] | None) -> DataFrame:
    """l, r, ctx, sym, c: what merging each (wanted) pair changes in the window counts of rows as in ``_rows``, added up by tasks."""
    ship(rows.sparkSession)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = counting.Names()

        def told(columns: list, counts) -> pa.RecordBatch:
            pair = counting.told_symbols(columns[:2], names)
            return pa.RecordBatch.from_arrays([*pair, *counting.told_windows(columns[2:], names, pair), pa.array(counts)], names=["l", "r", "ctx", "sym", "c"])

        held = counting.Held(names, n + 3, HELD, told)
        for batch in batches:
            for found in _rows(batch, n, names):
                yield from held.add(*counting.changes(found, n, names, wanted))
        yield from held.rest()

    return rows.mapInArrow(change, "l string, r string, ctx string, sym string, c bigint")


def context_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ctx").agg(F.sum("n").alias("base"))


def running_parts(docs: DataFrame, segs: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """parts: the segmented words of every text that has any, in order.

    Without ``segs`` the symbols of a word are its characters and texts are cut where they are read, without a shuffle.
    With ``segs`` each row needs a key of its own; words that have no segmentation are passed over.
    """
    if segs is None:
        return docs.select(F.transform(words(F.col(text)), lambda w: F.split(w, "")).alias("parts")).where(F.size("parts") > 0)
    tokens = docs.select(F.col(doc).alias("_doc"), F.posexplode(words(F.col(text))).alias("_at", "word"))
    each = tokens.join(segs.select("word", "parts"), "word").groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("_at", "parts"))).alias("_words"))
    return each.select(F.transform("_words", lambda w: w["parts"]).alias("parts"))


def _running(docs: DataFrame, segs: DataFrame | None, doc: str, text: str) -> DataFrame:
    """One column: the texts themselves, whose symbols are their characters, or the lists of their words' parts."""
    return docs.select(F.col(text).cast("string")) if segs is None else running_parts(docs, segs, doc, text)


def corpus_ngram_counts(docs: DataFrame, n: int, segs: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """ctx, sym, n over running text: windows cross words, each document is padded by n at both ends.

    Symbols as in ``running_parts``.  Documents are independent, so that no global order is needed; windows are made
    within a task, as arrays of symbol numbers, and only their counts are shuffled.
    """
    return _counted(_running(docs, segs, doc, text), n).groupBy("ctx", "sym").agg(F.sum("n").alias("n"))


def log_likelihood(counts: DataFrame) -> DataFrame:
    """One row, loglik: the sum of n * ln(n / base)."""
    return counts.join(context_counts(counts), "ctx").agg(F.sum(F.col("n") * F.ln(F.col("n") / F.col("base"))).alias("loglik"))


def _told(candidates: DataFrame | None) -> list[tuple[str, str]] | None:
    """The candidates, which are a bounded parameter."""
    return None if candidates is None else [(r["l"], r["r"]) for r in candidates.select("l", "r").collect()]


def merge_deltas(segs: DataFrame, n: int, candidates: DataFrame | None, compat: bool = False) -> DataFrame:
    """l, r, delta: the exact change of the log-likelihood that each candidate merge, or every merge, would bring.

    ``segs``: word, freq, seg (padded string).  Windows that hold an occurrence change from those of the old to those of the
    merged segmentation.  With ``compat`` the changes are added up for each occurrence alone, also where two of them
    share a window.
    """
    rows = segs.select(F.col("freq").cast("bigint"), "seg").where("seg IS NOT NULL")
    counts = scratch(_counted(rows, n).groupBy("ctx", "sym").agg(F.sum("n").alias("n")), "ngrams")
    if compat:
        cut = segs.select("freq", "seg", symbols(F.col("seg")).alias("parts"))
        pairs = cut.select("freq", "seg", F.explode(F.array_distinct(adjacent_pairs(F.col("parts")))).alias("p"))
        hit = pairs.select("freq", "seg", "p.l", "p.r")
        hit = hit if candidates is None else hit.join(candidates.select("l", "r"), ["l", "r"])
        changes = _occurrence_changes(hit, n).select("l", "r", "w.ctx", "w.sym", "c")
    else:
        changes = _changes(rows, n, _told(candidates))
    return _deltas(changes, counts)


def _deltas(changes: DataFrame, counts: DataFrame) -> DataFrame:
    """l, r, delta from signed window counts (l, r, ctx, sym, c) and the counts before.

    Continuations that don't change drop out of a context's sum, and of the rest only the context's total is needed.
    """
    change = changes.groupBy("l", "r", "ctx", "sym").agg(F.sum("c").alias("c")).where("c <> 0")
    xlnx = lambda c: F.when(c > 0, c * F.ln(c)).otherwise(0.0)
    was = F.coalesce("n", F.lit(0).cast("bigint"))
    cells = change.join(counts, ["ctx", "sym"], "left").select("l", "r", "ctx", "c", (xlnx(was + F.col("c")) - xlnx(was)).alias("d"))
    base = F.coalesce("base", F.lit(0).cast("bigint"))
    by_ctx = cells.groupBy("l", "r", "ctx").agg(F.sum("d").alias("d"), F.sum("c").alias("c")).join(context_counts(counts), "ctx", "left")
    return by_ctx.groupBy("l", "r").agg(F.sum(F.col("d") - (xlnx(base + F.col("c")) - xlnx(base))).alias("delta"))


def corpus_merge_deltas(docs: DataFrame, n: int, candidates: DataFrame | None = None, doc: str = "doc_id", text: str = "text", segs: DataFrame | None = None) -> DataFrame:
    """l, r, delta: the change of the running-text log-likelihood for each candidate pair, or for every pair.

    Symbols as in ``running_parts``.  Tasks add up the changes of the texts they read before they send them on, in
    portions of bounded size.
    """
    rows = _running(docs, segs, doc, text)
    counts = scratch(corpus_ngram_counts(docs, n, segs, doc, text), "text-ngrams")
    return _deltas(_changes(rows, n, _told(candidates)), counts)


def _occurrence_changes(hit: DataFrame, n: int) -> DataFrame:
    """The windows around each single occurrence: n + 1 before the merge, n + 1 after."""
    rows = hit.select("l", "r", "freq", symbols(F.col("seg")).alias("s")).select("l", "r", "freq", "s", F.posexplode("s").alias("i", "x"))
    rows = rows.where((F.col("x") == F.col("l")) & (F.get("s", F.col("i") + 1) == F.col("r")))
    cut = lambda at, k, start: F.struct(F.array_join(F.slice(at, start, F.lit(k)), " ").alias("ctx"), F.element_at(at, start + k).alias("sym"))
    after = F.concat(F.slice("s", F.lit(1), F.col("i")), F.array(F.concat("l", "r")), F.slice("s", F.col("i") + 3, F.size("s")))
    first = F.col("i") + 1
    old = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: cut(padded(F.col("s"), n), n, first + k))
    new = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: cut(padded(after, n), n, first + k))
    return rows.select("l", "r", (-F.col("freq")).alias("c"), F.explode(old).alias("w")).unionByName(rows.select("l", "r", F.col("freq").alias("c"), F.explode(new).alias("w")))


def all_deltas(segs: DataFrame, n: int) -> DataFrame:
    """The change of every pair."""
    return merge_deltas(segs, n, None)


def learn_lm(vocab: DataFrame, n_merges: int, n: int, candidate_limit: int = 40) -> tuple[list[Merge], list[float], DataFrame]:
    """Merges of the best log-likelihood change among the most frequent pairs, their changes, and word, freq, parts."""
    table = scratch(initial_segmentation(vocab), "lm-segmentation")
    merges, gains = [], []
    for rank in range(n_merges):
        parts = table.select("freq", symbols(F.col("seg")).alias("parts"))
        top = scratch(top_pairs(pair_statistics(parts), candidate_limit), "candidates")
        best = merge_deltas(table, n, top).join(top, ["l", "r"]).orderBy(F.desc(F.round("delta", 6)), F.desc("freq"), "l", "r").first()
        if best is None:
            break
        merges.append(Merge(rank, best["l"], best["r"], best["freq"]))
        gains.append(best["delta"])
        old, table = table, scratch(table.withColumn("seg", merge_pair(F.col("seg"), best["l"], best["r"])), "lm-segmentation")
        drop_scratch(old)
    return merges, gains, table.select("word", "freq", symbols(F.col("seg")).alias("parts"))

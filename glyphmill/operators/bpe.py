"""Byte-pair encoding: learning merges, applying them, rewriting corpora.

The loop works on types, not tokens.  Each round counts all pairs exactly, takes
the best pair by (freq desc, left, right), and as many of the next pairs as are
sure to be the next merges anyway; only those few rows reach the driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import counting
from ..functions.text import EOL, capitalise, capitalised, merge_pair, pad_symbols, strip_eol, symbols
from ..session import drop_scratch, scratch, ship, spread


#: Characters of text that are rewritten at a time.
BLOCK = 8_000_000
#: Words whose segmentation a task keeps.
HELD_WORDS = 500_000
#: Distinct pairs that a task holds before it sends their counts on.
HELD_PAIRS = 1_000_000


class Merge(NamedTuple):
    rank: int
    l: str  # noqa: E741
    r: str
    freq: int


def pair_statistics(segs: DataFrame, parts: str = "parts") -> DataFrame:
    """l, r, freq: neighbouring symbols, overlapping ones included, weighted by the words' freq."""
    return _pair_counts(segs.select(F.col("freq").cast("bigint"), F.col(parts).alias("parts")).where("parts IS NOT NULL"))


def _pair_counts(rows: DataFrame, merges: list[tuple[str, str]] | None = None) -> DataFrame:
    """l, r, freq of rows (freq, parts as a list or as a padded string) after the merges; tasks add up what they read."""
    ship(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = counting.Names()

        def told(columns: list, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*counting.told_symbols(columns, names), pa.array(counts)], names=["l", "r", "n"])

        held = counting.Held(names, 2, HELD_PAIRS, told)
        for batch in batches:
            parts = split_padded(batch.column(1))
            found = counting.of_parts(parts, 0, names, counting.whole_numbers(batch.column(0)))
            yield from held.add(*counting.pairs(counting.merged(found, merges or [], names), names))
        yield from held.rest()

    return rows.mapInArrow(count, "l string, r string, n bigint").groupBy("l", "r").agg(F.sum("n").alias("freq"))


def split_padded(parts: pa.Array) -> pa.Array:
    """The lists of symbols of padded strings; lists stay as they are."""
    return parts if pa.types.is_nested(parts.type) else pc.split_pattern(pc.utf8_trim(parts, characters=" "), "  ")


def top_pairs(stats: DataFrame, n: int) -> DataFrame:
    return stats.where("freq > 0").orderBy(F.desc("freq"), "l", "r").limit(n)


def initial_segmentation(vocab: DataFrame, use_eol: bool = False) -> DataFrame:
    """word, freq, seg (padded characters)."""
    return vocab.select("word", "freq", pad_symbols(F.col("word"), use_eol).alias("seg"))


def _sure_merges(ranked: list[tuple[str, str, int]], made: set[str], room: int) -> list[tuple[str, str, int]]:
    """The first pairs that one-at-a-time merging would take in this order.

    The first pair always is.  A following pair is while it has no symbol in common with the earlier ones, is no
    pair of equals, makes a symbol that is new, and counts strictly more than the pair after it: then no
    pair that the merges create can come before it.
    """
    taken = ranked[:1]
    if not taken or taken[0][0] == taken[0][1] or taken[0][0] + taken[0][1] in made:
        return taken
    used, new = {*taken[0][:2]}, {taken[0][0] + taken[0][1]}
    for k in range(1, len(ranked) - 1):
        left, right, freq = ranked[k]
        if len(taken) >= room or left == right or left in used or right in used or left + right in made or left + right in new or freq <= ranked[k + 1][2]:
            break
        taken.append(ranked[k])
        used |= {left, right}
        new.add(left + right)
    return taken


def learn_bpe(
    vocab: DataFrame, n_merges: int, use_eol: bool = False, checkpoint_every: int | None = None, on_checkpoint: Callable[[DataFrame, int], None] | None = None, look_ahead: int = 64, replaces_per_table: int = 24,
) -> tuple[list[Merge], DataFrame]:
    """Up to ``n_merges`` merges and the final word, freq, parts.  Ends early when no pair has a positive count.

    ``on_checkpoint(segmentations, merges so far)`` is called at 0, every ``checkpoint_every`` merges, and at the end.
    """
    table = scratch(initial_segmentation(vocab, use_eol), "segmentation")
    merges, pending, made = [], [], set()

    def seg() -> Column:
        out = F.col("seg")
        for left, right in pending:
            out = merge_pair(out, left, right)
        return out

    def now() -> DataFrame:
        return table.select("word", "freq", symbols(seg()).alias("parts"))

    while True:
        due = checkpoint_every or n_merges
        if on_checkpoint and len(merges) < n_merges and len(merges) % due == 0:
            on_checkpoint(now(), len(merges))
        if len(merges) >= n_merges:
            break
        room = min(n_merges - len(merges), due - len(merges) % due if on_checkpoint else n_merges)
        ranked = [(r["l"], r["r"], r["freq"]) for r in top_pairs(_pair_counts(table.select("freq", "seg"), list(pending)), look_ahead).collect()]
        taken = _sure_merges(ranked, made, room)
        if not taken:
            break
        for left, right, freq in taken:
            merges.append(Merge(len(merges), left, right, freq))
            made.add(left + right)
            pending.append((left, right))
        if len(pending) >= replaces_per_table:
            old = table
            table = scratch(table.select("word", "freq", seg().alias("seg")), "segmentation")
            drop_scratch(old)
            pending = []
    if on_checkpoint:
        on_checkpoint(now(), len(merges))
    return merges, now()


def merges_frame(spark, merges: list[Merge]) -> DataFrame:
    return spark.createDataFrame([tuple(m) for m in merges], "rank int, l string, r string, freq bigint")


def apply_merges(vocab: DataFrame, merges: list[tuple[str, str]], first: int | None = None, use_eol: bool = False, in_sql: int = 48) -> DataFrame:
    """word, parts: the merge list applied in its order, each pair once, everywhere.

    Short lists are nested ``replace`` calls; long ones one walk per word that takes the smallest list place after
    the last, which equals going through the list.
    """
    merges = list(merges)[:first]
    segs = initial_segmentation(vocab.select("word", F.lit(1).alias("freq")), use_eol)
    if len(merges) <= in_sql:
        seg: Column = F.col("seg")
        for left, right in merges:
            seg = merge_pair(seg, left, right)
        return segs.select("word", symbols(seg).alias("parts"))
    ship(vocab.sparkSession)
    places: dict[tuple[str, str], list[int]] = {}
    for k, pair in enumerate(merges):
        places.setdefault(tuple(pair), []).append(k)
    shared = vocab.sparkSession.sparkContext.broadcast(places)  # the merge list is a bounded parameter

    @F.pandas_udf("array<string>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda s: segment_word(s.strip(" ").split("  "), shared.value))

    return segs.select("word", walk("seg").alias("parts"))


def segment_word(parts: list[str], places: dict[tuple[str, str], list[int]]) -> list[str]:
    """One word through a merge list, given each pair's (rising) places in it."""
    last = -1
    while len(parts) > 1:
        ahead = [next((k for k in places[p] if k > last), None) for p in zip(parts, parts[1:], strict=False) if p in places]
        ahead = [k for k in ahead if k is not None]
        if not ahead:
            break
        last = min(ahead)
        pair = next(p for p in zip(parts, parts[1:], strict=False) if last in places.get(p, ()))
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                out.append(parts[k] + parts[k + 1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out
    return parts


def remove_eols(segs: DataFrame, parts: str = "parts") -> DataFrame:
    return segs.withColumn(parts, strip_eol(F.col(parts)))


def delimit_corpus(corpus: DataFrame, segs: DataFrame, keys: tuple[str, ...] = ("doc_id", "line_no"), text: str = "text", separator: str = "@@", restore_case: bool = False, missing: str = "error") -> DataFrame:
    """Every line with each token replaced by its parts, ``separator`` after all but the last; blank lines stay.

    ``restore_case``: tokens are looked up in lower case and a capital first letter comes back.  ``missing``: what a
    token without segmentation does: error, or keep (it stays whole).  Lines go in blocks of bounded size: each block
    asks once for every different word that it holds, and is rewritten in one task with the answers; so neither tokens nor
    the segmentations travel whole.
    """
    if missing not in ("error", "keep"):
        raise ValueError(missing)
    ship(corpus.sparkSession)
    blocks = scratch(_in_blocks(corpus.select(*keys, F.col(text).cast("string").alias(text))), "blocks")
    asked = blocks.select("_block", F.col(text).alias("_text")).mapInArrow(_words_of_blocks, "_block bigint, _token string")
    asked = asked.withColumn("_look", F.lower("_token") if restore_case else F.col("_token"))
    found = asked.join(segs.select(F.col("word").alias("_look"), F.col("parts").alias("_parts")), "_look", "left")
    absent = F.array("_token") if missing == "keep" else F.raise_error(F.concat(F.lit("no segmentation for "), F.col("_token")))
    parts = F.coalesce("_parts", absent)
    if restore_case:
        parts = F.when(capitalised(F.col("_token")), F.concat(F.array(capitalise(parts[0])), F.slice(parts, F.lit(2), F.size(parts)))).otherwise(parts)
    pieces = found.select("_block", "_token", F.array_join(parts, f"{separator} ").alias("_piece"))

    def rewrite(lines: pa.Table, answers: pa.Table) -> pa.Table:
        piece = dict(zip(answers.column("_token").to_pylist(), answers.column("_piece").to_pylist(), strict=True))
        told = [" ".join([piece[w] for w in (line or "").split()]) for line in lines.column(text).to_pylist()]
        return pa.table([*(lines.column(k) for k in keys), pa.array(told, pa.string())], names=[*keys, text])

    n = spread(corpus.sparkSession)
    return blocks.repartition(n, "_block").groupBy("_block").cogroup(pieces.repartition(n, "_block").groupBy("_block")).applyInArrow(rewrite, blocks.drop("_block").schema)


def delimit_with_merges(corpus: DataFrame, merges: list[tuple[str, str]], keys: tuple[str, ...] = ("doc_id", "line_no"), text: str = "text", separator: str = "@@", restore_case: bool = False) -> DataFrame:
    """``delimit_corpus`` where the segmentations are those that a merge list gives: tasks walk each word once, and nothing is shuffled."""
    ship(corpus.sparkSession)
    places: dict[tuple[str, str], list[int]] = {}
    for k, pair in enumerate(merges):
        places.setdefault(tuple(pair), []).append(k)
    shared = corpus.sparkSession.sparkContext.broadcast(places)  # the merge list is a bounded parameter
    line = F.col(text).cast("string")
    rows = corpus.select(*keys, line.alias(text), (F.lower(line) if restore_case else F.lit(None).cast("string")).alias("_look"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, known = shared.value, {}

        def piece(token: str, look: str) -> str:
            parts = segment_word(list(look), places)
            if restore_case and unicodedata.category(token[0]) == "Lu":
                parts[0] = parts[0][:1].upper() + parts[0][1:]
            if len(known) >= HELD_WORDS:
                known.clear()
            known[token] = found = f"{separator} ".join(parts)
            return found

        for batch in batches:
            told = []
            for line, low in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                tokens = (line or "").split()
                looks = low.split() if restore_case and low else tokens
                told.append(" ".join([known.get(w) or piece(w, x) for w, x in zip(tokens, looks, strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(told, pa.string())], names=[*keys, text])

    return rows.mapInArrow(rewrite, rows.drop("_look").schema)


def _in_blocks(lines: DataFrame) -> DataFrame:
    """The lines (their text last) with the number of their block, _block: neighbours in a partition, up to about BLOCK characters."""
    schema = StructType([*lines.schema.fields, StructField("_block", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            sizes, numbers = pc.fill_null(pc.utf8_length(batch.column(batch.num_columns - 1)), 0).to_pylist(), []
            for size in sizes:
                if held > BLOCK:
                    block, held = block + 1, 0
                numbers.append(block)
                held += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "_block"])

    return lines.mapInArrow(number, schema)


def _words_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_block, _token: the different words of each block, as far as its lines follow one another."""
    now, held = None, set()

    def told() -> Iterator[pa.RecordBatch]:
        words = pa.array(list(held), pa.string())
        found = pa.RecordBatch.from_arrays([pa.array(np.full(len(words), now or 0, np.int64)), words], names=["_block", "_token"])
        held.clear()
        yield from (found.slice(k, 50_000) for k in range(0, found.num_rows, 50_000))

    for batch in batches:
        for block, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if block != now:
                yield from told()
                now = block
            held.update((line.as_py() or "").split())
    yield from told()


def segmentation_diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """Words that two segmentation tables cut differently."""
    told = lambda df, name: df.select("word", F.array_join("parts", " ").alias(name))
    return told(base, "base").join(told(other, "other"), "word").where("base <> other")


__all__ = ["EOL", "Merge", "apply_merges", "delimit_corpus", "delimit_with_merges", "initial_segmentation", "learn_bpe", "merges_frame", "pair_statistics", "remove_eols", "segment_word", "segmentation_diff", "top_pairs"]

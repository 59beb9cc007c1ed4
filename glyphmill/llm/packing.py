"""Best-fit packing by linear grouping.

The tokenised pieces meet the plan only as counts by length, of which there
are at most ``capacity``: pieces of one length are interchangeable.  Lengths
above ``capacity / large_parts`` are cut into ``groups`` groups of equal
cardinality and rounded up to their group's longest; a linear programme over
configurations of those few sizes (column generation, the knapsack priced by
dynamic programming) is solved and rounded down; actual lengths take the
places of the rounded ones; what is left, and all small lengths, go best-fit
in falling order.  The plan is a list of runs: `so many pieces of this length
go, so many a sequence, into these sequences at this offset`.  Its size is
bounded by the capacity, not by the number of pieces.  Each piece then finds its
place by its length and its number among the pieces of that length, counted in
salted groups.

Null and empty texts give one piece of the end id alone.  Each input row gives
its own pieces, repeated rows included; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import as_bytes, read, scratch
from ._text import binary_rows

CAPACITY, END_ID = 4096, 1
#: (groups, large_parts) that are tried on the counts; the plan with the fewest sequences is taken.
SETTINGS = ((64, 6), (96, 4), (64, 3), (64, 2))
#: Texts' words whose ids a Python worker keeps from task to task; beyond it the memory starts anew.
CACHED_WORDS = 900_000
#: Rows in one salted group of equal lengths, about.
GROUP_ROWS = 256
#: Salted groups of one length whose counts are added up in one place.
BLOCK_SALTS = 1024


#: Latin letters that are lower-cased and composed, and end marks.
_LETTERS = re.compile("([a-z\u00df-\u00f6\u00f8-\u024f]+)([.,;:!?]*)").fullmatch


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    The tokenizer's pre-tokenizer never joins what white space parts, so a text's ids are its
    white-space-free chunks' ids in turn; chunks are remembered.  Chunks of Latin letters, which are one
    pre-token each, are encoded many at once and told apart by the end-of-word mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn_letters(self, cores: dict[bytes, str]) -> None:
        keys = list(cores)
        for at in range(0, len(keys), 2000):
            part = keys[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([cores[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self._learn_any(part)
                continue
            raw, start = ids.tobytes(), 0
            for key, end in zip(part, (ends * 4).tolist(), strict=True):
                self.known[key] = raw[start:end]
                start = end

    def _learn_any(self, chunks: list[bytes]) -> None:
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False), strict=True):
            self.known[chunk] = self._pack(e.ids)

    def _learn(self, chunks: set[bytes]) -> None:
        known, cores, other, split = self.known, {}, set(), []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            lowered = text.lower()
            m = _LETTERS(lowered)
            if m is None:
                other.add(chunk)
            elif lowered == text and not m[2]:
                cores[chunk] = text
            else:
                core, tail = m[1].encode(), m[2].encode()
                split.append((chunk, core, tail))
                if core not in known:
                    cores[core] = m[1]
                if tail and tail not in known:
                    other.add(tail)
        self._learn_letters(cores)
        self._learn_any(list(other))
        for chunk, core, tail in split:
            known[chunk] = known[core] + known[tail] if tail else known[core]

    def encode(self, texts: list[bytes], cached_words: int = CACHED_WORDS) -> list[bytes]:
        if len(self.known) > cached_words:
            self.known.clear()
        # the vocabulary has no case, but the special tokens' names have
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = set()
        for c in chunks:
            new.update(c)
        new.difference_update(self.known.keys() & new)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, cached_words: int = CACHED_WORDS) -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece of at most ``capacity`` ids."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), struct.pack("<I", END_ID)
        for batch, texts in binary_rows(batches, "_text"):
            row, out = [], []
            for k, ids in enumerate(enc.encode(texts, cached_words)):
                raw = memoryview(ids + end)
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row.append(k)
                    out.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out, strict=True) if out else ([] for _ in fields)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True))], names=[key, *(n for n, _ in fields)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), as_bytes(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class Run(NamedTuple):
    """``count`` pieces of ``length`` go, ``each`` a sequence, into sequences from ``sequence`` on, at ``offset``."""

    length: int
    count: int
    each: int
    sequence: int
    offset: int


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Basic configurations (columns) and how often each is used in the linear programme's optimum."""
    g = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    most = int(capacity // sizes.min())
    for _ in range(40 * g + 100):
        dual = np.linalg.solve(basis.T, np.ones(g))
        best, pick = np.zeros(capacity + 1), np.full((most, capacity + 1), -1)
        layers = [best]
        for j in range(most):
            new = layers[-1].copy()
            for i in np.flatnonzero(dual > 1e-12):
                cand = layers[-1][: capacity + 1 - sizes[i]] + dual[i]
                better = cand > new[sizes[i] :] + 1e-12
                new[sizes[i] :][better] = cand[better]
                pick[j, sizes[i] :][better] = i
            layers.append(new)
        if layers[-1][capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(g), capacity
        for j in range(most - 1, -1, -1):
            if (i := pick[j, room]) >= 0:
                column[i] += 1
                room -= sizes[i]
        step = np.linalg.solve(basis, column)
        ratio = np.full(g, np.inf)
        np.divide(used, step, out=ratio, where=step > 1e-9)
        leave = int(np.argmin(ratio))
        theta = max(ratio[leave], 0.0)
        used = np.maximum(used - theta * step, 0)
        basis[:, leave], used[leave] = column, theta
    return basis.round().astype(int), used


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 64, large_parts: int = 6) -> tuple[list[Run], int]:
    """Runs that place all pieces, given how many there are of each length, and the number of sequences."""
    left = {length: n for length, n in counts.items() if n > 0}
    runs: list[Run] = []
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    used = 0

    def add(room: int, sequence: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                bisect.insort(order, room)
            rooms.setdefault(room, []).append((sequence, n))

    large = sorted(x for x in left if x * large_parts > capacity and x < capacity)
    if large:
        # linear grouping: neighbours in length share a group of about equal cardinality
        total, grouped, seen = sum(left[x] for x in large), [[]], 0
        for x in large:
            if grouped[-1] and seen * groups >= total * len(grouped):
                grouped.append([])
            grouped[-1].append(x)
            seen += left[x]
        sizes = np.array([g[-1] for g in grouped])
        demand = np.array([sum(left[x] for x in g) for g in grouped], float)
        columns, often = _configurations(sizes, demand, capacity)
        queues = [[[x, left[x]] for x in g] for g in grouped]
        for c in np.argsort(-often, kind="stable"):
            slots = [i for i in range(len(sizes)) for _ in range(columns[i, c])]
            need = columns[:, c]
            held = [sum(n for _, n in q) for q in queues]
            bins = min([int(often[c] + 1e-6), *(held[i] // need[i] for i in np.flatnonzero(need))]) if slots else 0
            takes = []
            for i in slots:  # the actual lengths of each slot, as (length, sequences in a row)
                rest, mine = bins, []
                while rest:
                    n = min(rest, queues[i][-1][1])
                    mine.append((queues[i][-1][0], n))
                    queues[i][-1][1] -= n
                    if not queues[i][-1][1]:
                        queues[i].pop()
                    rest -= n
                takes.append(mine)
            cuts = sorted({sum(n for _, n in mine[:k]) for mine in takes for k in range(len(mine) + 1)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                at = 0
                for mine in takes:
                    upto = 0
                    for length, n in mine:
                        upto += n
                        if upto > a:
                            break
                    runs.append(Run(length, b - a, 1, used + a, at))
                    at += length
                add(capacity - at, used + a, b - a)
            used += bins
        rest = {x: n for q in queues for x, n in q}
        left = {x: rest.get(x, 0) if x in set(large) else n for x, n in left.items()}
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                full, tail = divmod(n, each)
                if full:
                    runs.append(Run(length, full * each, each, used, 0))
                    add(capacity - each * length, used, full)
                    used += full
                if tail:
                    runs.append(Run(length, tail, tail, used, 0))
                    add(capacity - tail * length, used, 1)
                    used += 1
                break
            room = order[k]
            sequence, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(k)
            each = room // length
            full = min(many, n // each)
            if not full:
                full, each = 1, n
            runs.append(Run(length, full * each, each, sequence, capacity - room))
            add(room - each * length, sequence, full)
            add(room, sequence + full, many - full)
            n -= full * each
    return runs, used


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, settings: tuple[tuple[int, int], ...] = SETTINGS) -> tuple[list[Run], int]:
    """The first plan with the fewest sequences among the settings; one that meets the volume's lower bound ends the search."""
    least, best = -(-sum(x * n for x, n in counts.items()) // capacity), None
    for groups, large_parts in settings:
        found = plan(counts, capacity, groups, large_parts)
        best = found if best is None or found[1] < best[1] else best
        if best[1] <= least:
            break
    return best


def pack(pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY, settings: tuple[tuple[int, int], ...] = SETTINGS) -> DataFrame:
    """The pieces (a scratch table with ``length``) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = best_plan(counts, capacity, settings)
    runs.sort(key=lambda r: (r.length, r.sequence, r.offset))
    array = np.array(runs, np.int64).reshape(-1, 5)
    first = np.cumsum(array[:, 1]) - array[:, 1]
    starts = np.searchsorted(array[:, 0], array[:, 0])
    first -= first[starts] if len(array) else 0
    salts = max(1, -(-max(counts.values(), default=1) // GROUP_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys, *[c for c in pieces.columns if c not in keys]), F.lit(salts)))
    # running counts in two levels: over the salts of a block, and over the blocks of a length
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_salt") / BLOCK_SALTS))
    before = lambda order, *by: F.coalesce(F.sum("_n").over(Window.partitionBy("length", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("length", "_block").agg(F.sum("_n").alias("_n")).withColumn("_upto", before("_block")).drop("_n")
    offsets = sums.withColumn("_before", before("_salt", "_block")).join(blocks, ["length", "_block"]).select("length", "_salt", (F.col("_before") + F.col("_upto")).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(*keys, *[c for c in pieces.columns if c not in keys])
    numbered = salted.withColumn("_no", F.row_number().over(within) - 1).join(offsets, ["length", "_salt"])
    numbered = numbered.select(*pieces.columns, (F.col("_no") + F.col("_before")).cast("long").alias("_no"))
    shared = pieces.sparkSession.sparkContext.broadcast((array, first))  # bounded by the capacity

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, no: pd.Series) -> pd.DataFrame:
        array, first = shared.value
        big = np.int64(1) << 40
        k = np.searchsorted(array[:, 0] * big + first, length.to_numpy() * big + no.to_numpy(), side="right") - 1
        at = no.to_numpy() - first[k]
        return pd.DataFrame({"sequence_id": array[k, 3] + at // array[k, 2], "offset": array[k, 4] + at % array[k, 2] * array[k, 0]})

    placed = numbered.withColumn("_place", place("length", "_no"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, settings: tuple[tuple[int, int], ...] = SETTINGS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """The documents' pieces with their places.  ``cached_words`` trades a worker's memory for time, nothing else."""
    pieces = scratch(token_pieces(docs, key, text, capacity, vocabulary, cached_words), "pieces")
    return pack(pieces, (key, "piece"), capacity, settings)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))

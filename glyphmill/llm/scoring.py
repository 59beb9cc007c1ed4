"""Language-model scores by online logistic context mixing over hashed-context bit predictors.

A text is its lower-cased (A-Z) words and one end.  Every token is a path in a
Huffman tree over the ``CODED`` most frequent words, the end, and an escape, so
that a text is a sequence of binary decisions.

*Predictors*: for each decision, counts of both outcomes under contexts of the
running text: none, the word before, and the two words before, over all training
texts.  The counts are exact at any size: contexts are dealt by hash over buckets
whose number follows the corpus, and each bucket sorts its contexts, so that no two
share a count.  Some texts at a time (a *source*) ask the buckets for what they need.
*Mixer*: the log-odds are added with weights that a gate chooses by how often the two
contexts were seen and that are learned online along each text.  *Refinement*: a
map from the mixed probability to the observed frequency, adapted along the text, is
averaged in.  Both start anew with each text, so that a score does not depend on how
texts are dealt to tasks.

A word behind an escape is spelled in bytes, closed by a space: bit predictors
under the last 1, 2, 3 and 5 bytes of the word and the whole word so far, mixed by
gated weights that are learned online in ``SHARDS`` shards of the words (dealt by
hash, in order, whatever the partitions) and averaged, with a refinement map of
their own.  The spelling is mixed with the word's share of the escaped training
tokens.  It depends on the word alone and is computed once for each distinct
word.  Documents look up the most frequent words in a table of bounded size
(``TOP_WORDS``) and all others by a join.

In training texts every token's own count is left out.  Held out is each row
whose crc32 of the key as text is 1 modulo 5 (null: the empty text).  Null texts
are empty: one end token.  Each row counts, repeated ones too.  Without training
rows every count is 0; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, drop_scratch, read, scratch
from ._text import U64, _byte_codes, _powers, binary_rows, splitmix
from ._tree import SCHEMA, piece_rows, sum_arrays

TOP_WORDS, TOP_LENGTH, FLUSH_WORDS = 300_000, 64, 400_000
ORDERS = (1, 2, 3, 5)
BITS = (16, 19, 19, 19, 19)
PRIOR, CLIP, SETS, BINS = 0.4, 8.0, 16, 33
END = b"\n"
#: Words with a code of their own; slots for the contexts of running text, as powers of two: at least, of a table in memory, of a bucket.
CODED, LEAST_BITS, MOST_BITS, BUCKET_BITS = 4096, 12, 21, 24
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tokens of the texts that ask for their counts together, and of those that are mixed together.
SOURCE_TOKENS, MIXED_TOKENS = 1 << 20, 1 << 15
#: Shards of the words for learning, and words in one portion of a shard.
SHARDS, PORTION = 32, 4096
#: Decisions of a text between two steps of its mixer, and the mixer's rate.
STRIDE, RATE = 512, 0.01


def held_out(key: object) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 5 == 1


# --- counts -------------------------------------------------------------------


def _count_words(docs: DataFrame) -> DataFrame:
    """word, c: counts in training texts of every word of any text; the null word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, new, ends = Counter(), set(), 0

        def out() -> pa.RecordBatch:
            for w in new:
                seen.setdefault(w, 0)
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch, texts in binary_rows(batches, "_text"):
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = text.lower().split()
                if held_out(key):
                    new.update(words)
                else:
                    seen.update(words)
                    ends += 1
            if len(seen) + len(new) > FLUSH_WORDS:
                yield out()
                seen, new = Counter(), set()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).sortWithinPartitions("word")


def _tokens(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    return [END if w is None else w + b" " for w in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


# --- bits ---------------------------------------------------------------------


@dataclass
class Code:
    """A Huffman tree: the nodes and bits of each byte's path."""

    node: np.ndarray
    bit: np.ndarray
    start: np.ndarray
    length: np.ndarray
    odds: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """Every symbol has a path: its count is at least 1.  Also the log-odds of each node's second branch."""
    n = len(counts)
    heap = [(int(c) + 1, b, None) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    for k in range(n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n + k, (a, b)))
    paths: dict[int, list[tuple[int, int]]] = {}
    odds = np.zeros(max(n - 1, 1), np.float32)
    stack = [(heap[0], [])]
    while stack:
        (_, name, kids), path = stack.pop()
        if kids is None:
            paths[name] = path
        else:
            odds[name - n] = np.log(kids[1][0] / kids[0][0])
            stack += [(kids[x], [*path, (name - n, x)]) for x in (0, 1)]
    length = np.array([len(paths[b]) for b in range(n)])
    flat = [x for b in range(n) for x in paths[b]]
    return Code(np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64), np.cumsum(length) - length, length, odds)


@dataclass
class Decisions:
    """The binary decisions of some tokens: outcome and the slot under each context.

    What a token shares from its start with the token before it is decided once: ``token`` is the token of every byte,
    ``at`` the place of that byte among those that are decided, ``byte`` the place of each decision's byte.
    """

    token: np.ndarray
    at: np.ndarray
    byte: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each decided byte, the sum over the tokens that hold it."""
        return np.bincount(self.at, weights[self.token], int(self.at.max(initial=-1)) + 1)


def _decided(raw: np.ndarray, token: np.ndarray, pos: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes no earlier token has decided, and each byte's place among those: sorted tokens share the most."""
    before = np.concatenate([[0], lengths[:-1]])[token]  # the length of the token before, which lies that far back
    back = np.arange(len(raw)) - before
    new = (pos >= before) | (raw[back] != raw)  # at the first token, before is 0
    told = np.cumsum(new)
    begin = (np.cumsum(lengths) - lengths)[token]
    new = told > told[begin] - new[begin]
    order = np.argsort(pos.astype(np.uint16) if lengths.max() <= 1 << 16 else pos, kind="stable")  # by place within tokens
    fresh = new[order]
    last = np.maximum.accumulate(np.where(fresh, np.arange(len(raw)), 0))
    at = np.empty(len(raw), np.int64)
    at[order] = (np.cumsum(new) - 1)[order[last]]
    return new, at


def decisions(tokens: list[bytes], code: Code) -> Decisions:
    raw = np.frombuffer(b"".join(tokens), np.uint8)
    n = len(raw)
    lengths = np.array([len(t) for t in tokens])
    begin = np.cumsum(lengths) - lengths
    token = np.repeat(np.arange(len(tokens)), lengths)
    first = begin[token]
    pos = np.arange(n) - first
    new, place = _decided(raw, token, pos, lengths)
    contexts, past = [], np.zeros(n, U64)
    for back in range(1, max(ORDERS) + 1):
        byte = np.zeros(n, U64)
        byte[back:] = raw[:-back] if back < n else 0
        byte[pos < back] = 0
        past = past | (byte << U64(8 * (back - 1)))
        if back in ORDERS:
            contexts.append(splitmix(past[new] + U64(back * 0x9E3779B97F4A7C15 % (1 << 64))))
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(_byte_codes()[raw] * up[:n], out=total[1:])
    contexts.append(splitmix((total[:-1] - total[first]) * down[first] + pos.astype(U64))[new])
    raw = raw[new]
    reps = code.length[raw]
    at = np.repeat(np.arange(len(raw)), reps)
    path = np.arange(len(at)) + np.repeat(code.start[raw] - np.cumsum(reps) + reps, reps)
    step = splitmix(code.node.astype(U64) + U64(1))[path]
    slots = []
    for context, bits in zip(contexts, BITS, strict=True):
        slot = np.repeat(context, reps)
        slot += step
        slot *= U64(0xD6E8FEB86659FD93)
        slot >>= U64(64 - bits)
        slots.append(slot.view(np.int64))
    return Decisions(token, place, at, code.bit[path], slots)


# --- learning -----------------------------------------------------------------


def _summed(stripes: DataFrame, name: str, sizes: list[int]) -> list[np.ndarray]:
    held = scratch(stripes, name)
    sums = sum_arrays(held, sizes)
    drop_scratch(held)
    return sums


def _byte_counts(types: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            tokens, c = _tokens(batch)
            raw = np.frombuffer(b"".join(tokens), np.uint8)
            total += np.bincount(raw, np.repeat(c, [len(t) for t in tokens]), 256).astype(np.int64)
        yield piece_rows([total])

    return _summed(types.mapInArrow(run, SCHEMA), "byte-counts", [256])[0]


def _context_counts(types: DataFrame, code: Code) -> list[np.ndarray]:
    """For each context, the counts of both outcomes by slot: (2, slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 << b, np.float64) for b in BITS]
        for batch in batches:
            tokens, c = _tokens(batch)
            if tokens:
                d = decisions(tokens, code)
                weight = d.sums(c)[d.byte]
                for total, slot, bits in zip(totals, d.slots, BITS, strict=True):
                    total += np.bincount(slot + (d.bit << bits), weight, 2 << bits)
        yield piece_rows(totals)

    found = _summed(types.mapInArrow(run, SCHEMA), "context-counts", [2 << b for b in BITS])
    return [t.astype(np.float32).reshape(2, -1) for t in found]


def _level(n: np.ndarray) -> np.ndarray:
    return (n > 0.5).astype(np.int64) + (n > 2.5) + (n > 15.5)


def _inputs(d: Decisions, counts: list[np.ndarray], leave: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds under each context (and a constant), and the gate; ``leave``: without one token of each."""
    rows, seen = [], []
    one, prior = d.bit.astype(np.float32), np.float32(PRIOR)
    for slot, table in zip(d.slots, counts, strict=True):
        n0, n1 = table[0][slot], table[1][slot]
        if leave:
            n0, n1 = np.maximum(n0 - (1 - one), 0), np.maximum(n1 - one, 0)
        rows.append(np.clip(np.log((n1 + prior) / (n0 + prior)), -CLIP, CLIP).astype(np.float32))
        seen.append(n0 + n1)
    rows.append(np.full(len(d.bit), 0.3, np.float32))
    return np.array(rows), 4 * _level(seen[-1]) + _level(seen[2])


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _bin(logit: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((logit + 12) * (BINS - 1) / 24), 0, BINS - 1).astype(np.int64)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """shard, tokens, counts: each shard's words in order, PORTION at a time, however the batches were cut."""
    shard, tokens, counts = None, [], []
    for batch in batches:
        more, c = _tokens(batch)
        shards = batch.column(2).to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if a == b:
                continue
            if tokens and shards[a] != shard:
                yield shard, tokens, np.array(counts, np.int64)
                tokens, counts = [], []
            shard = int(shards[a])
            tokens += more[a:b]
            counts += c[a:b].tolist()
            while len(tokens) >= PORTION:
                yield shard, tokens[:PORTION], np.array(counts[:PORTION], np.int64)
                tokens, counts = tokens[PORTION:], counts[PORTION:]
    if tokens:
        yield shard, tokens, np.array(counts, np.int64)


def _learn_mixer(types: DataFrame, code: Code, counts: list[np.ndarray], step: int = 32_768, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """The mixer's weights (sets, inputs) and the refinement map (sets, bins), from one online pass over each shard of the training words."""
    shared = types.sparkSession.sparkContext.broadcast((code, counts))
    inputs = len(BITS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, counts = shared.value
        now, state = None, np.zeros(SETS * (inputs + 1) + 2 * SETS * BINS)

        def closed() -> np.ndarray:
            return state + np.rint(64 * np.concatenate([(w * mass[:, None]).ravel(), mass, hits.ravel()]))

        for shard, tokens, c in _portions(batches):
            if shard != now:
                if now is not None:
                    state = closed()
                w, squares, mass = np.full((SETS, inputs), 0.3), np.full((SETS, inputs), 1e-6), np.zeros(SETS)
                hits, now = np.zeros((2, SETS * BINS)), shard
            d = decisions(tokens, code)
            x, gate = _inputs(d, counts, leave=True)
            count, root = d.sums(c)[d.byte], d.sums(np.sqrt(c))[d.byte]
            several = np.cumsum(d.sums(np.ones(len(tokens)))[d.byte])  # a step holds as many decisions as if nothing were shared
            cuts = np.unique(np.searchsorted(several, np.arange(step, several[-1], step), side="right"))
            for a, b in zip([0, *cuts], [*cuts, len(gate)], strict=True):
                s = slice(a, b)
                g, y, xs, weight = gate[s], d.bit[s], x[:, s], root[s]
                logit = sum(k[g] * row for k, row in zip(np.ascontiguousarray(w.T), xs, strict=True))
                p = _squash(logit)
                cell = g * BINS + _bin(logit)
                hits[0] += np.bincount(cell, count[s], SETS * BINS)
                hits[1] += np.bincount(cell, count[s] * y, SETS * BINS)
                error, here = (y - p) * weight, np.bincount(g, weight, SETS)
                slope = np.array([np.bincount(g, error * row, SETS) for row in xs]).T / np.maximum(here, 1e-9)[:, None]
                squares += slope**2
                w += rate * slope / np.sqrt(squares)
                mass += here
        yield piece_rows([closed() if now is not None else state])

    dealt = types.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(SHARDS)).cast("int")).repartition(SHARDS, "shard").sortWithinPartitions("shard", "word")
    state = _summed(dealt.select("word", "c", "shard").mapInArrow(run, SCHEMA), "mixer", [SETS * (inputs + 1) + 2 * SETS * BINS])[0] / 64
    mass = state[SETS * inputs : SETS * (inputs + 1)]
    weights = np.where(mass[:, None] > 0, state[: SETS * inputs].reshape(SETS, inputs) / np.maximum(mass, 1e-9)[:, None], 0.3)
    total, ones = state[SETS * (inputs + 1) :].reshape(2, SETS, BINS)
    centre = _squash(np.linspace(-12, 12, BINS))[None]
    return weights, (ones + 8 * centre) / (total + 8)


@dataclass
class Model:
    code: Code
    logit: list[np.ndarray]
    level: list[np.ndarray]
    weights: np.ndarray
    refine: np.ndarray

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """The log10 probability of each token (a word with its space, or the end)."""
        if not tokens:
            return np.empty(0)
        d = decisions(tokens, self.code)
        gate = 4 * self.level[1][d.slots[-1]].astype(np.int64) + self.level[0][d.slots[2]]
        weights = np.ascontiguousarray(self.weights.T)
        mixed = (weights[-1] * 0.3)[gate]
        for weight, slot, table in zip(weights, d.slots, self.logit):  # noqa: B905  the last weight is the constant's
            mixed += weight[gate] * table[slot]
        p = (_squash(mixed) + self.refine.ravel()[gate * BINS + _bin(mixed)]) / 2
        p = np.clip(np.where(d.bit == 1, p, 1 - p), 1 / 65536, 1 - 1 / 65536)
        each = np.bincount(d.byte, np.log10(p))
        return np.bincount(d.token, each[d.at], len(tokens))


def train(types: DataFrame) -> Model:
    """A model from ``word``, ``c`` (all training words; see the module's text)."""
    seen = types.where("c > 0")
    code = huffman(_byte_counts(seen))
    counts = _context_counts(seen, code)
    weights, refine = _learn_mixer(seen, code, counts)
    logit = [np.clip(np.log((t[1] + PRIOR) / (t[0] + PRIOR)), -CLIP, CLIP).astype(np.float32) for t in counts]
    level = [_level(counts[k].sum(0)).astype(np.uint8) for k in (2, -1)]
    return Model(code, logit, level, weights.round(9), refine.round(9))


GRID = tuple(round(x, 3) for x in (0.0, *np.linspace(0.05, 0.95, 19), 0.98, 0.99))


def _with_shares(spelled: DataFrame, n: int, coded: int) -> DataFrame:
    """The words' scores as a mixture of spelling and share (c / n), weighted as suits escaped training tokens that are left out.

    ``score`` is that of a held-out text, ``score_in`` that of a training text, one token of the word left out.
    """
    spelling, least = F.pow(F.lit(10.0), F.col("score")), F.lit(1e-300)
    mix = lambda share, w: F.log10(F.greatest(w * share + (1 - w) * spelling, least))
    left_out = (F.col("c") - 1) / F.lit(max(n - 1, 1))
    fit = spelled.where(f"c > 0 AND word IS NOT NULL AND place >= {coded}").agg(*(F.sum(F.col("c") * mix(left_out, F.lit(w))).alias(str(k)) for k, w in enumerate(GRID))).first()
    best = max(range(len(GRID)), key=lambda k: (round(fit[k], 3), -k)) if n and fit[0] is not None else 0
    w = F.lit(GRID[best])
    unseen = F.log10(1 - w) + F.col("score")
    told = lambda share, seen: F.when(seen, F.greatest(mix(share, w), unseen)).otherwise(unseen)
    return spelled.withColumns({"score": told(F.col("c") / F.lit(max(n, 1)), F.col("c") > 0), "score_in": told(left_out, F.col("c") > 1)})


# --- running text -------------------------------------------------------------


def _states(counts: np.ndarray) -> np.ndarray:
    """Both outcomes' counts (2, slots) as one number each: halved until both are below 256."""
    out = (counts[0] << 8 | counts[1]).astype(np.uint16)
    large = np.flatnonzero((counts[0] | counts[1]) > 255)
    some = counts[:, large]
    down = np.ceil(np.log2((some.max(0) + 1) / 256)).astype(np.int64)
    out[large] = (some[0] >> down) << 8 | some[1] >> down
    return out


_ZEROS, _ONES = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
#: A state as it is, without an own zero, without an own one; then log-odds and levels.
_LESS = np.concatenate([np.stack([np.maximum(_ZEROS - a, 0), np.maximum(_ONES - b, 0)], 1) for a, b in ((0, 0), (1, 0), (0, 1))])
_STATE_LOGIT = np.clip(np.log((_LESS[:, 1] + PRIOR) / (_LESS[:, 0] + PRIOR)), -CLIP, CLIP).astype(np.float32)
_STATE_GATES = [(k * _level(_LESS.sum(1))).astype(np.uint8) for k in (4, 1)]
_MIX1, _MIX2, _MIX3, _MIX4 = (U64(int(x) | 1) for x in splitmix(np.arange(301, 305, dtype=U64)))


@dataclass
class Texts:
    """Tokens of some texts in a row: the symbol, and the two words before (0: none, 1: a rare word, else its place + 2)."""

    text: np.ndarray
    symbol: np.ndarray
    before: np.ndarray
    before2: np.ndarray


def tokens_of(places: list[np.ndarray], coded: int) -> Texts:
    """From each text's words as places in the table of frequent words (-1: not in it)."""
    lengths = np.array([len(x) + 1 for x in places])
    last = np.cumsum(lengths) - 1
    at = np.zeros(int(lengths.sum()), np.int64)
    inner = np.ones(len(at), bool)
    inner[last] = False
    at[inner] = np.concatenate(places) if len(places) else 0
    symbol = np.where((at < 0) | (at >= coded), coded, at)
    symbol[last] = coded + 1
    name = at + 2
    text = np.repeat(np.arange(len(places)), lengths)
    back = np.arange(len(at)) - np.repeat(last - lengths + 1, lengths)
    before, before2 = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    before[1:], before2[2:] = name[:-1], name[:-2]
    before[back < 1], before2[back < 2] = 0, 0
    return Texts(text, symbol, before, before2)


def text_decisions(t: Texts, code: Code, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, node, outcome and the slots under both contexts of every decision."""
    reps = code.length[t.symbol]
    path = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps - code.start[t.symbol], reps)
    node = code.node[path]
    step = (node + 1).astype(U64) * _MIX3
    one = (t.before.astype(U64) + U64(1)) * _MIX1
    two = (one ^ (one >> U64(29))) * _MIX4 + (t.before2.astype(U64) + U64(1)) * _MIX2

    def slots(context: np.ndarray) -> np.ndarray:
        x = np.repeat(context, reps) + step
        x ^= x >> U64(32)
        return ((x * _MIX4) >> U64(64 - bits)).astype(np.int64)

    return np.repeat(t.text, reps), node, code.bit[path], slots(one), slots(two)


def table_bits(n_tokens: int) -> int:
    """Slots that the contexts of so many tokens need, as a power of two."""
    return max(n_tokens.bit_length() + 2, LEAST_BITS)


def start_weights(states: Sequence[np.ndarray] = ()) -> np.ndarray:
    """(sets, 3): none, one word, two words.  A context counts by how often it was seen and, in hashed tables, how empty its table is."""
    trust = np.array([0.0, 0.3, 0.6, 0.9])
    clear = [1.0 - np.count_nonzero(s) / len(s) for s in states] or [1.0, 1.0]
    one, two = np.meshgrid(trust * clear[0], trust * clear[1], indexing="ij")
    one = one * (1 - two)
    return np.stack([1 - one - two, one, two], -1).reshape(SETS, 3).astype(np.float32)


def mix_texts(t: Texts, n: int, training: np.ndarray, code: Code, states: list[np.ndarray], weights: np.ndarray, starts: list[np.ndarray] | None = None) -> np.ndarray:
    """log10 of each text's probability, all but what is behind escapes.  The texts go in step, each with its own mixer.

    ``states`` are the counts' states, each token's from its place in ``starts`` on, or else in hashed tables.
    """
    if not n:
        return np.zeros(0)
    reps = code.length[t.symbol]
    before = np.cumsum(reps) - reps
    if starts is None:
        slots = text_decisions(t, code, len(states[0]).bit_length() - 1)[3:]
        states, starts = [table[slot] for slot, table in zip(slots, states, strict=True)], [before, before]
    # texts of many strides come first, so that those that go on are always the first ones
    sizes = np.bincount(t.text, reps, n).astype(np.int64)
    first = before - (np.cumsum(sizes) - sizes)[t.text]
    by_size = np.argsort(sizes // -STRIDE, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_size] = np.arange(n)
    sizes = sizes[by_size]
    going = [*np.cumsum(np.bincount((sizes + STRIDE - 1) // STRIDE)[::-1])[::-1][1:].tolist(), 0]
    # the pieces into which strides cut the tokens' paths, by step and text
    step = first // STRIDE
    parts = (first + reps - 1) // STRIDE - step + 1
    token = np.repeat(np.arange(len(reps)), parts)
    step = step[token] + np.arange(len(token)) - np.repeat(np.cumsum(parts) - parts, parts)
    skip = np.maximum(step * STRIDE - first[token], 0)
    long = np.minimum(first[token] + reps[token], (step + 1) * STRIDE) - first[token] - skip
    order = _with_places(step * n + rank[t.text[token]], (len(going) * n).bit_length())[1]
    token, skip, long = token[order], skip[order], long[order]
    bounds, ends = np.cumsum(np.bincount(step)).tolist(), np.cumsum(long)
    skip += long - ends
    n_paths = len(code.node)
    shifts = [k[token] + skip for k in (code.start[t.symbol] + n_paths * training[t.text], *starts)]
    # by path, those of training texts last
    odds, bit, own = np.tile(code.odds[code.node], 2), np.tile(code.bit, 2), np.concatenate([np.zeros(n_paths, np.int64), code.bit + 1 << 16])
    w = [np.tile(k, n).astype(np.float32) for k in weights.T]
    hits, total = np.tile(8 * _squash(np.linspace(-12, 12, BINS)), n).astype(np.float32), np.full(n * BINS, 8, np.float32)
    low, high, scale, half, least, rate = (np.float32(k) for k in (-12, 12, (BINS - 1) / 24, 0.5, 1 / 65536, RATE))
    scores, a, piece = np.zeros(n), 0, 0
    for j, (here, stay) in enumerate(zip(going[:-1], going[1:], strict=True)):
        s, b = slice(piece, bounds[j]), int(ends[bounds[j] - 1])
        along, (path, *slots) = np.arange(a, b), (np.repeat(k[s], long[s]) for k in shifts)
        path += along
        y, mine, z = bit.take(path), own.take(path), [odds.take(path)]
        runs = np.minimum(sizes[:here] - j * STRIDE, STRIDE)
        r = np.repeat(np.arange(here) * SETS, runs)
        for slot, table, scaled in zip(slots, states, _STATE_GATES, strict=True):
            slot += along
            state = table.take(slot) | mine
            z.append(_STATE_LOGIT.take(state))
            r += scaled.take(state)
        logit = w[0].take(r) * z[0]
        logit += w[1].take(r) * z[1]
        logit += w[2].take(r) * z[2]
        np.clip(logit, low, high, out=logit)
        p = 1 / (1 + np.exp(-logit))
        cell = np.rint((logit + high) * scale).astype(np.int64)
        cell += np.repeat(np.arange(here) * BINS, runs)
        one = y.astype(np.float32)
        final = hits.take(cell)
        final /= total.take(cell)
        final += p
        final *= half
        final += one
        final -= 1
        final = np.log(np.maximum(np.abs(final), least))
        scores[:here] += np.add.reduceat(final.astype(np.float64), np.cumsum(runs) - runs)
        a, piece, u = b, bounds[j], stay * STRIDE
        if stay:
            r, cell, error = r[:u], cell[:u], (one[:u] - p[:u]) * rate
            for k, v in zip(w, z, strict=True):
                k[: stay * SETS] += np.bincount(r, error * v[:u], stay * SETS)
            zeros, ones = np.bincount(cell + y[:u] * (stay * BINS), minlength=2 * stay * BINS).reshape(2, -1)
            hits[: stay * BINS] += ones
            total[: stay * BINS] += zeros + ones
    return scores[rank] / np.log(10)


def _with_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers (below 2^bits) sorted, and where each stood; plain numbers sort faster than places do."""
    low = len(keys).bit_length()
    if bits + low > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = keys << low | np.arange(len(keys))
    both.sort()
    return both >> low, both & ((1 << low) - 1)


def _distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers (below 2^bits), sorted, and each one's place among them."""
    keys, order = _with_places(keys, bits)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[new], place


class Places:
    """The places of frequent words in their table, one for each worker process."""

    def __init__(self) -> None:
        self.held: dict[str, dict[bytes, int]] = {}

    def of(self, shared) -> dict[bytes, int]:
        if "place" not in self.held:
            self.held["place"] = {w: k for k, w in enumerate(shared.value)}
        return self.held["place"]


@dataclass
class Contexts:
    """How a context and a symbol make one number: both words before, then the symbol's place among the tree's leaves.

    Words are numbers below ``names``, so the numbers of different contexts differ; those below a node of the tree are neighbours.
    The number of buckets is a power of two.
    """

    code: Code
    names: int
    buckets: int

    def __post_init__(self) -> None:
        c = self.code
        paths = [tuple(c.bit[a : a + k].tolist()) for a, k in zip(c.start.tolist(), c.length.tolist(), strict=True)]
        self.symbol = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        self.leaf = np.empty_like(self.symbol)
        self.leaf[self.symbol] = np.arange(len(paths))
        self.up = np.where(c.bit > 0, 0, 8).astype(np.uint16)
        self.low, self.wide = (len(paths) - 1).bit_length(), (self.names - 1).bit_length()
        if self.low + 2 * self.wide > 63:
            raise ValueError("too many words for contexts of two words")

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        return self.code.length[self.symbol[keys & ((1 << self.low) - 1)]]

    def asked(self, t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For one and two words: the distinct numbers, bucket by bucket; the bounds of the buckets; each token's place among the numbers."""
        one, at = _distinct(t.before << self.low | self.leaf[t.symbol], self.low + self.wide)
        bits = len(one).bit_length()
        pairs, at_pairs = _distinct(t.before2 << bits | at, self.wide + bits)  # in order of before2 and the number above
        two = (pairs >> bits) << (self.low + self.wide) | one[pairs & ((1 << bits) - 1)]
        for keys, at in ((one, at), (two, at_pairs)):
            bucket = (splitmix((keys >> self.low).astype(U64)) & U64(self.buckets - 1)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            yield keys[order], np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=self.buckets))]), place[at]

    def others(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From all numbers of some contexts, sorted, and their counts: at each node of a number's path the count of the branch not taken, and where each path begins."""
        c = self.code
        symbol, context = self.symbol[keys & ((1 << self.low) - 1)], keys >> self.low
        length, first = c.length[symbol], c.start[symbol]
        begin = np.cumsum(length) - length
        out, alive = np.zeros(int(length.sum()), np.int32 if counts.sum() < 1 << 31 else np.int64), np.arange(len(keys))
        for depth in range(int(length.max(initial=0))):
            alive = alive[length[alive] > depth]
            at = first[alive] + depth
            node, here = c.node[at], context[alive]
            new = np.ones(len(alive) + 1, bool)
            new[1:-1] = (node[1:] != node[:-1]) | (here[1:] != here[:-1])
            shared = ~(new[:-1] & new[1:])  # a number alone below a node has nothing beside it from there on
            alive, new, bit = alive[shared], new[:-1][shared], c.bit[at[shared]]
            if not len(alive):
                break
            edge, count = np.flatnonzero(new), counts[alive]
            ones = np.add.reduceat(count * bit, edge)
            both = np.stack([ones, np.add.reduceat(count, edge) - ones], 1).ravel()
            out[begin[alive] + depth] = both[2 * np.cumsum(new) - 2 + bit]
        return out, begin

    def states(self, keys: np.ndarray, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The states along each number's path, from its count and those of the branches not taken."""
        symbol = self.symbol[keys & ((1 << self.low) - 1)]
        reps = self.code.length[symbol]
        ends, along = np.cumsum(reps), np.cumsum(others)
        taken = np.repeat(counts + along[ends - 1], reps) - along
        path = np.arange(len(others)) + np.repeat(self.code.start[symbol] - ends + reps, reps)
        up = self.up[path]  # where the taken branch's count goes
        out = (taken.astype(np.uint16) << up) | (others.astype(np.uint16) << (np.uint16(8) - up))
        large = np.flatnonzero((taken | others) > 255)
        one, a, b = self.code.bit[path[large]] > 0, taken[large], others[large]
        out[large] = _states(np.stack([np.where(one, b, a), np.where(one, a, b)]))
        return out


def _packed(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))


def _planes(x: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bytes of numbers, all first bytes before all second ones."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, : len(planes)] = planes.T
    return whole.reshape(-1).view("<i8")


def _small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and those that are 255 and above in full."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255]


def _from_small(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def _request(keys: np.ndarray, counts: np.ndarray, contexts: Contexts) -> bytes:
    """Sorted numbers and counts: neighbours differ in few bytes."""
    step = np.diff(keys >> contexts.low, prepend=-1)
    return _packed(np.packbits(step > 0), _planes(step[step > 0], 2 * contexts.wide + 1), _planes(keys & ((1 << contexts.low) - 1), contexts.low), *_small(counts))


def _requested(raw: bytes, contexts: Contexts) -> tuple[np.ndarray, np.ndarray]:
    moved, steps, leaf, small, large = _unpacked(raw)
    step = np.zeros(len(small), np.int64)
    step[np.unpackbits(moved, count=len(small)) > 0] = _from_planes(steps)
    return (np.cumsum(step) - 1) << contexts.low | _from_planes(leaf), _from_small(small, large)


def _sources(docs: DataFrame, top, contexts: Contexts, coded: int) -> DataFrame:
    """The texts as places of their words (kind 0), and the numbers they ask for with their training counts (kind 1 and 2), by bucket."""
    kind = docs.schema["_key"].dataType.simpleString()
    places = Places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = places.of(top).get
        source = TaskContext.get().partitionId() << 20
        keys, held, found, sizes, rare, n = [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            t = tokens_of(found, coded)
            counted = ~np.array(held, bool)[t.text]
            lengths = np.array([len(x) for x in found], np.int64)
            names = _planes(np.concatenate(found) + 1, contexts.wide)
            rows = [(source, 0, source, _packed(lengths, names, np.array(held, bool), np.array(sizes, np.int64), np.frombuffer(b" ".join(rare), np.uint8)))]
            for k, (asked, bounds, at) in enumerate(contexts.asked(t), 1):
                counts = np.bincount(at[counted], minlength=len(asked))
                for j in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b = bounds[j : j + 2]
                    rows.append((source, k, j, _request(asked[a:b], counts[a:b], contexts)))
            whole = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(whole)] * len(rows), pa.int32()), whole)
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([lists, *columns], names=["_keys", "source", "kind", "bucket", "data"])

        for batch, texts in binary_rows(batches, "_text"):
            own = batch.column(0)
            a = 0
            for b, (key, text) in enumerate(zip(own.to_pylist(), texts, strict=True), 1):
                tokens = text.lower().split()
                at = np.fromiter(map(place, tokens, repeat(-1)), np.int64, len(tokens))
                rare.extend(tokens[k] for k in np.flatnonzero(at < 0).tolist())
                found.append(at)
                held.append(held_out(key))
                sizes.append(len(text))
                n += len(at) + 1
                if n >= SOURCE_TOKENS:
                    keys.append(own.slice(a, b - a))
                    yield out()
                    keys, held, found, sizes, rare, n, a = [], [], [], [], [], 0, b
                    source += 1
            if a < len(texts):
                keys.append(own.slice(a))
        if found:
            yield out()

    return docs.mapInArrow(run, f"_keys array<{kind}>, source long, kind int, bucket long, data binary")


def _answers(sources: DataFrame, shared, tasks: int) -> DataFrame:
    """Each request with the counts over all training texts in its place: of its numbers, and of the branches not taken; the texts as they are."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() == 0:
            return table
        contexts = shared.value
        requests = [_requested(x, contexts) for x in table["data"].to_pylist()]
        ends = np.cumsum([len(k) for k, _ in requests])
        keys, at = np.unique(np.concatenate([k for k, _ in requests]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        for (k, c), b in zip(requests, ends.tolist(), strict=True):
            counts[at[b - len(k) : b]] += c  # numbers are distinct within a request
        del requests
        others, begin = contexts.others(keys, counts)
        length, answers = contexts.lengths(keys), []
        for part in np.split(at, ends[:-1]):
            reps = length[part]
            path = others[np.arange(int(reps.sum())) + np.repeat(begin[part] - np.cumsum(reps) + reps, reps)]
            answers.append(_packed(*_small(counts[part]), *_small(path)))
        return table.set_column(table.schema.get_field_index("data"), "data", pa.array(answers, pa.binary()))

    return sources.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(run, sources.schema)


# --- scores -------------------------------------------------------------------


def _word_scores(types: DataFrame, model: Model) -> DataFrame:
    shared = types.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.log10(_tokens(batch)[0]))], names=["word", "c", "score"])

    return types.mapInArrow(run, "word binary, c long, score double")


def _look_up(answers: DataFrame, told: pa.Table, end: int, coded: int, shared_contexts, tasks: int) -> DataFrame:
    """A row per document with the sums over its frequent words, and a row for each other word in it (word, tf)."""
    key_type = answers.schema["_keys"].dataType.elementType.simpleString()
    spelled = [told[c].to_numpy().copy() for c in ("score", "score_in")]
    for x in spelled:
        x[:coded] = 0.0  # their code says all
    shared = answers.sparkSession.sparkContext.broadcast((told["c"].to_numpy(), spelled))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (c, spelled), contexts = shared.value, shared_contexts.value
        logs, known, weights = np.log10(c + 0.5), c > 0, start_weights()
        given = sorted(zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True))
        lengths, names, held, sizes, raw = _unpacked(given[0][2])
        keys = pa.concat_arrays([x.values for x in table["_keys"].filter(pc.equal(table["kind"], 0)).chunks])
        ends = np.cumsum(lengths)
        names = _from_planes(names) - 1
        found = [names[b - k : b] for k, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
        others = iter(raw.tobytes().split(b" "))
        by_size = np.argsort(lengths, kind="stable")  # texts of like lengths are mixed together
        t = tokens_of([found[k] for k in by_size.tolist()], coded)
        states, starts = [], []
        for kind, (asked, bounds, at) in enumerate(contexts.asked(t), 1):
            reps = contexts.lengths(asked)
            starts.append((np.cumsum(reps) - reps)[at])
            parts = []
            for _, j, x in (x for x in given if x[0] == kind):
                count, large, other, others_large = _unpacked(x)
                parts.append(contexts.states(asked[bounds[j] : bounds[j + 1]], _from_small(count, large), _from_small(other, others_large)))
            states.append(np.concatenate(parts))
        del given
        scores = np.zeros(len(found))
        portion = np.flatnonzero(np.diff(np.cumsum(lengths[by_size] + 1) // MIXED_TOKENS)) + 1
        for a, b in zip([0, *portion.tolist()], [*portion.tolist(), len(found)], strict=True):
            x, y = np.searchsorted(t.text, [a, b])
            part = Texts(t.text[x:y] - a, t.symbol[x:y], t.before[x:y], t.before2[x:y])
            scores[by_size[a:b]] = mix_texts(part, b - a, ~held[by_size[a:b]], contexts.code, states, weights, [s[x:y] for s in starts])
        first = key[0].as_py() << 21
        out, rare = [], ([], [], [], [])
        for k, (at, out_of) in enumerate(zip(found, held.tolist(), strict=True)):
            hit = at[at >= 0]
            out.append((first + k, out_of, len(at) + 1, int(known[hit].sum()) + (end > 0), float(logs[hit].sum() + np.log10(end + 0.5)), float(spelled[0 if out_of else 1][hit].sum() + scores[k]), int(sizes[k])))
            if len(hit) < len(at):
                other = Counter(islice(others, len(at) - len(hit)))
                rare[0].extend([first + k] * len(other))
                rare[1].extend(other)
                rare[2].extend(other.values())
                rare[3].extend([out_of] * len(other))
        m, columns = len(rare[0]), list(zip(*out, strict=True))
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        arrays = [pa.array(list(x), t) for x, t in zip(columns, types, strict=True)]
        lower = {0: pa.array(rare[0], pa.int64()), 1: pa.array(rare[3], pa.bool_())}
        whole = [pa.concat_arrays([a, lower.get(k, pa.nulls(m, a.type))]) for k, a in enumerate(arrays)]
        n = len(out)
        return pa.Table.from_arrays([pa.concat_arrays([keys, pa.nulls(m, keys.type)]), *whole, pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(rare[1], pa.binary())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rare[2], pa.int64())])], names=["_key", "row", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "word", "tf"])

    schema = f"_key {key_type}, row long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long, word binary, tf long"
    return answers.repartition(tasks, "source").groupBy("source").applyInArrow(run, schema)


@contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the step that made them ends, not with the driver's garbage.  Not for the frame that is returned: it may run twice."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", top_words: int = TOP_WORDS, coded: int = CODED) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    with _without_old_shuffles(docs.sparkSession):
        return _score_documents(docs, key, text, top_words, coded)


def _score_documents(docs: DataFrame, key: str, text: str, top_words: int, coded: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    held = docs.select(F.col(key).alias("_key"), as_bytes(text).alias("_text"))
    types = scratch(_count_words(held), "words")
    n, v = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    end = (types.where("word IS NULL").select("c").first() or (0,))[0]
    short = types.where(f"word IS NOT NULL AND length(word) <= {TOP_LENGTH}")
    top = short.orderBy(F.desc("c"), "word").limit(top_words).toArrow()  # of bounded size, as are its words
    coded = min(coded, top.num_rows)
    counts = top["c"].to_numpy()
    code = huffman(np.concatenate([counts[:coded], [max(n - end - int(counts[:coded].sum()), 0), end]]))
    words = context.broadcast(top["word"].to_pylist())

    # words that are spelled; the coded ones stay in the spelling model's counts
    least = (int(counts[coded - 1]), bytes(top["word"][coded - 1].as_py())) if coded else None
    has_code = f"length(word) <= {TOP_LENGTH} AND (c > {least[0]} OR (c = {least[0]} AND word <= X'{least[1].hex()}'))" if least else "false"
    spelled = scratch(_word_scores(types, train(types)), "word-spellings")
    placed = spelled.withColumn("place", F.when(F.col("word").isNotNull() & F.expr(has_code), 0).otherwise(coded))
    scored = _with_shares(placed, n - end - int(counts[:coded].sum()), coded).drop("place")  # computed anew where it is read: a table of it takes more disk
    listed = scored.where(f"word IS NOT NULL AND length(word) <= {TOP_LENGTH}").orderBy(F.desc("c"), "word").limit(top_words).select("c", "score", "score_in").toArrow()
    contexts = Contexts(code, top.num_rows + 2, 1 << max(table_bits(n) - BUCKET_BITS, 0))
    shared, tasks = context.broadcast(contexts), max(-(-n // SOURCE_TOKENS), 8)
    drop_scratch(types)
    found = scratch(_look_up(_answers(_sources(held, words, contexts, coded), shared, tasks), listed, end, coded, shared, tasks), "look-ups")
    rows, rare = found.where("word IS NULL").drop("word", "tf"), found.where("word IS NOT NULL").select("row", "word", "tf", "held_out")
    rest = scored.where("word IS NOT NULL")
    if top.num_rows:  # the table above holds the others
        c, w = int(counts[-1]), bytes(top["word"][-1].as_py())
        rest = rest.where(f"NOT (length(word) <= {TOP_LENGTH}) OR c < {c} OR (c = {c} AND word > X'{w.hex()}')")
    each = rare.join(rest, "word").select("row", "tf", (F.col("c") > 0).alias("known"), F.log10(F.col("c") + 0.5).alias("log"), F.when(F.col("held_out"), F.col("score")).otherwise(F.col("score_in")).alias("s"))
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("known"), F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * F.col("log")).alias("l"), F.sum(F.col("tf") * F.col("s")).alias("s"))
    joined = rows.join(sums, "row", "left")
    none = lambda c, zero: F.coalesce(c, F.lit(zero))
    total = F.col("score") + none(F.col("s"), 0.0)
    return joined.select(
        F.col("_key").alias(key), "held_out", "n_tokens", (F.col("n_known") + none(F.col("k"), 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + none(F.col("l"), 0.0) - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"),
        total.alias("score"), F.when(F.col("n_bytes") > 0, -total / F.col("n_bytes") * float(np.log2(10))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))

"""Counting symbols by arrays, within a task: pairs, windows of n + 1 symbols, and what merges change in them.

Rows of symbols stand one after another in one array of numbers, with n pads (number 0) before, between and after
them, so that every n + 1 neighbours are a window of one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = ""
#: The numbers of the pad and of the symbol that a merge makes; further symbols are numbered from FIRST.
MERGED, FIRST = 1, 2


class Names:
    """Numbers for symbols that hold for a whole task."""

    def __init__(self) -> None:
        self.all: list[str | None] = [PAD, None]
        self.number: dict[str, int] = {}

    def of(self, symbol: str) -> int:
        if (k := self.number.get(symbol)) is None:
            k = self.number[symbol] = len(self.all)
            self.all.append(symbol)
        return k

    @property
    def bits(self) -> int:
        return (len(self.all) - 1).bit_length()


class Rows(NamedTuple):
    """ids: the padded symbols; joined: whether a symbol and the next are of one word; weight: of the row whose window starts here."""

    ids: np.ndarray
    joined: np.ndarray
    weight: np.ndarray | None


def _laid_out(ids: np.ndarray, joined: np.ndarray, sizes: np.ndarray, n: int, weights: np.ndarray | None) -> Rows:
    at = np.arange(len(ids)) + n * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    whole = np.zeros(len(ids) + n * (len(sizes) + 1), np.int64)
    within = np.zeros(len(whole), bool)
    whole[at], within[at] = ids, joined
    return Rows(whole, within, None if weights is None else np.repeat(weights, sizes + n))


def of_parts(parts: pa.Array, n: int, names: Names, weights: np.ndarray | None = None) -> Rows:
    """Rows from lists of symbols (each list a word), or from lists of such lists (a text's words); none may be null."""
    if pa.types.is_nested(parts.type.value_type):
        words = parts.flatten()
        of_word = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(of_word)])
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
        sizes = np.diff(ends[upto])
    else:
        words = parts
        sizes = of_word = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(of_word)])
    told = words.flatten().dictionary_encode()
    numbers = np.array([names.of(s) for s in told.dictionary.to_pylist()], np.int64)
    ids = numbers[told.indices.to_numpy()] if len(told) else np.zeros(0, np.int64)
    joined = np.ones(len(ids), bool)
    joined[ends[1:][of_word > 0] - 1] = False
    return _laid_out(ids, joined, sizes, n, weights)


def of_texts(texts: list[str | None], n: int, names: Names) -> Rows:
    """Rows from texts that hold a word, their symbols being characters; ``str.split`` cuts at the same white space as WHITESPACE."""
    rows = [x for t in texts if t and (x := " ".join(t.split()))]
    points = np.frombuffer("\n".join(rows).encode("utf-32-le"), np.uint32) if rows else np.zeros(0, np.uint32)
    blank = (points == 32) | (points == 10)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    seen[[10, 32]] = False
    table = np.zeros(0x110000, np.int64)
    for point in np.flatnonzero(seen).tolist():
        table[point] = names.of(chr(point))
    keep = ~blank
    follows = np.append(keep[1:], False) if len(points) else keep
    ends = np.concatenate([np.flatnonzero(points == 10), [len(points)]]) if rows else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(keep)])[ends]
    return _laid_out(table[points[keep]], follows[keep], np.diff(np.concatenate([[0], upto])), n, None)


def whole_numbers(column: pa.Array) -> np.ndarray:
    """A column of counts; null counts nothing."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of the counts of each."""
    if counts is None:
        order, found = None, np.sort(keys)
    else:
        order = np.argsort(keys)
        found = keys[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[first], np.diff(np.append(first, len(found))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _packed(columns: list[np.ndarray], bits: int) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.int64) if bits * len(columns) > 31 else np.zeros(len(columns[0]), np.int32)
    for c in columns:
        key = (key << bits) | c.astype(key.dtype)
    return key


def grouped(columns: list[np.ndarray], bits: int, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns (numbers of so many bits) and the sum of the counts of each."""
    if bits * len(columns) <= 63:
        keys, sums = summed(_packed(columns, bits), counts)
        mask = (1 << bits) - 1
        return [((keys >> (bits * (len(columns) - 1 - k))) & mask).astype(np.int64) for k in range(len(columns))], sums
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0)
    first = np.flatnonzero(new)
    sums = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return [c[first] for c in rows], sums


def windows(rows: Rows, n: int, names: Names) -> tuple[list[np.ndarray], np.ndarray]:
    """n + 1 columns of symbols and how often they stand together."""
    each = max(0, len(rows.ids) - n)
    return grouped([rows.ids[k : k + each] for k in range(n + 1)], names.bits, rows.weight)


def pairs(rows: Rows, names: Names) -> tuple[list[np.ndarray], np.ndarray]:
    """Two columns of symbols and the number of times they are neighbours within a word, overlapping ones included."""
    at = np.flatnonzero(rows.joined)
    return grouped([rows.ids[at], rows.ids[at + 1]], names.bits, None if rows.weight is None else rows.weight[at])


def _taken(rows: Rows, wanted: np.ndarray | None, bits: int) -> np.ndarray:
    """Whether merging the pair that begins here, left to right, would take it: every second one in a run of equals."""
    ids, joined = rows.ids, rows.joined
    if not len(ids):
        return np.zeros(0, bool)
    after = np.append(ids[1:], 0)
    twin = joined & (ids == after)
    starts = twin & ~np.concatenate([[False], twin[:-1]])
    place = np.arange(len(ids))
    begun = np.maximum.accumulate(np.where(starts, place, 0))
    taken = joined & ~(twin & ((place - begun) % 2 == 1))
    if wanted is not None:
        taken &= np.isin((ids << bits) | after, wanted)
    return taken


def merged(rows: Rows, merges: list[tuple[str, str]], names: Names) -> Rows:
    """Rows without pads after the merges, each once, everywhere, in their order."""
    for left, right in merges:
        if left not in names.number or right not in names.number:
            continue
        ids = rows.ids
        met = rows.joined & (ids == names.number[left])
        met[:-1] &= ids[1:] == names.number[right]
        at = np.flatnonzero(met)
        if left == right and len(at):
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
        if not len(at):
            continue
        ids, joined = ids.copy(), rows.joined.copy()
        ids[at], joined[at] = names.of(left + right), joined[at + 1]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        rows = Rows(ids[keep], joined[keep], None if rows.weight is None else rows.weight[keep])
    return rows


def changes(rows: Rows, n: int, names: Names, wanted: list[tuple[str, str]] | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns l, r and n + 1 symbols (MERGED among them), and the signed change of that window's count by merging each pair.

    Most occurrences are alone: the windows around them depend on their n + 2 neighbours, which are counted first.
    Occurrences of a pair that are so near that windows hold two of them are walked through one by one.
    """
    ids, bits, size = rows.ids, names.bits, len(rows.ids)
    keys = None if wanted is None else np.array([(names.number[a] << bits) | names.number[b] for a, b in wanted if a in names.number and b in names.number], np.int64)
    taken = _taken(rows, keys, bits)
    after = np.append(ids[1:], 0) if size else ids
    near = np.zeros(size, bool)
    for d in range(2, n + 2):
        both = taken[:-d] & taken[d:] & (ids[:-d] == ids[d:]) & (after[:-d] == after[d:])
        near[:-d] |= both
        near[d:] |= both
    out = [*_alone(rows, n, bits, taken & ~near), *_crowded(rows, n, taken, np.flatnonzero(taken & near))]
    columns = [np.concatenate([o[0][k] for o in out]) for k in range(n + 3)]
    found, counts = grouped(columns, bits, np.concatenate([o[1] for o in out]))
    real = counts != 0
    return [c[real] for c in found], counts[real]


def _alone(rows: Rows, n: int, bits: int, taken: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    each = max(0, len(rows.ids) - n - 1)
    place = sum((taken[j : j + each].astype(np.int64) << j for j in range(n + 1)), np.zeros(each, np.int64))  # bit j: a pair begins at j
    at = np.flatnonzero(place)
    wide = max(bits, n + 1)  # the places are one more column
    found, counts = grouped([*(rows.ids[at + k] for k in range(n + 2)), place[at]], wide, None if rows.weight is None else rows.weight[at])
    counts = counts.astype(np.int64)
    for j in range(n + 1):
        here = (found[-1] >> j) & 1 == 1
        gram, c = [f[here] for f in found[:-1]], counts[here]
        pair = [gram[j], gram[j + 1]]
        yield [*pair, *gram[: n + 1]], -c
        yield [*pair, *gram[:j], np.full(len(c), MERGED), *gram[j + 2 :]], c
        if j == 0:
            yield [*pair, *gram[1:]], -c


def _crowded(rows: Rows, n: int, taken: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    ids = rows.ids
    after = np.append(ids[1:], 0) if len(ids) else ids
    left, right = ids[at], after[at]
    order = np.lexsort((at, right, left))  # by pair, then by place
    at, left, right = at[order], left[order], right[order]
    # the window's row: the one of the occurrence
    weight = np.ones(len(at), np.int64) if rows.weight is None else rows.weight[at]
    same = np.zeros(len(at), bool)
    same[1:] = (left[1:] == left[:-1]) & (right[1:] == right[:-1])
    last = np.where(same, np.concatenate([[-(1 << 40)], at[:-1]]) if len(at) else at, -(1 << 40))  # the occurrence before

    def merges_at(p: np.ndarray, k: np.ndarray) -> np.ndarray:
        return taken[p] & (ids[p] == left[k]) & (after[p] == right[k])

    for back in range(-1, n + 1):  # windows of the old text that begin at most n before and one after
        k = np.flatnonzero(at - back > last + 1)
        yield [left[k], right[k], *(ids[at[k] - back + i] for i in range(n + 1))], -weight[k]
    every, start, lead = np.arange(len(at)), at.copy(), np.zeros(len(at), np.int64)
    for back in range(n + 1):  # windows of the new text that begin so many symbols before
        if back:
            two = merges_at(np.maximum(start - 2, 0), every) & (start >= 2)
            start = start - 1 - two
            lead = np.where(two, 1, lead)  # one with the occurrence before was counted there
        k = every[lead == 0]
        p, columns = start[k], []
        for _ in range(n + 1):
            hit = merges_at(p, k)
            columns.append(np.where(hit, MERGED, ids[p]))
            p = p + 1 + hit
        yield [left[k], right[k], *columns], weight[k]


class Held:
    """Sums by rows of columns, kept within a task and told in portions of about ``most`` rows."""

    def __init__(self, names: Names, n_columns: int, most: int, told: Callable[[list[np.ndarray], np.ndarray], pa.RecordBatch]) -> None:
        self.names, self.most, self.told = names, most, told
        self.columns, self.counts, self.fresh = [np.zeros(0, np.int64)] * n_columns, np.zeros(0, np.int64), []

    def _gather(self) -> None:
        parts = [(self.columns, self.counts), *self.fresh]
        self.fresh = []
        self.columns, self.counts = grouped([np.concatenate([p[0][k] for p in parts]) for k in range(len(self.columns))], self.names.bits, np.concatenate([p[1] for p in parts]))

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.fresh.append((columns, counts.astype(np.int64)))
        if sum(len(c) for _, c in self.fresh) > max(self.most, len(self.counts)):
            self._gather()
            if len(self.counts) > self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._gather()
        for k in range(0, len(self.counts), 100_000):
            yield self.told([c[k : k + 100_000] for c in self.columns], self.counts[k : k + 100_000])
        self.columns, self.counts = [c[:0] for c in self.columns], self.counts[:0]


def told_symbols(columns: list[np.ndarray], names: Names) -> list[pa.Array]:
    """The symbols of the columns, without MERGED."""
    known = pa.array(names.all, pa.string())
    return [known.take(pa.array(c)) for c in columns]


def told_windows(columns: list[np.ndarray], names: Names, pair: list[pa.Array] | None = None) -> list[pa.Array]:
    """ctx and sym of windows; MERGED is the pair's two symbols in one."""
    cells = told_symbols(columns, names)
    if pair is not None:
        both = pc.binary_join_element_wise(*pair, "")
        cells = [pc.coalesce(c, both) for c in cells]
    ctx = pc.binary_join_element_wise(*cells[:-1], " ") if len(cells) > 1 else pa.array([PAD] * len(cells[0]), pa.string())
    return [ctx, cells[-1]]

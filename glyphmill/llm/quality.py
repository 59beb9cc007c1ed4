"""Quality rules as a short-circuit cascade.

Rules are predicates over lazily computed features of one text.  The cost of
each rule and the share of documents it rejects are estimated on a random
sample of about ``sample_rows`` of all documents, inside the tasks that scan them;
the cascade then runs the rules in the order of
rejections per second, and a document stops at the first rule that rejects it.
The order changes only the work done: a document is kept when no rule rejects
it, so verdicts don't depend on the sample.

Null and empty texts have no words and fail ``few_words``.  Every input row
gives one row, repeated rows included; extra columns are passed through by
``apply_quality_rules``.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, read
from ._text import binary_rows, table, window_hashes

SYMBOLS = b"#*$%&|<>"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_SPACES, _TAIL = b"\x20\x09\x0a\x0b\x0c\x0d", bytes(range(0x80, 0xC0))


class Features:
    """Features of one text (UTF-8 bytes), each computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @functools.cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @functools.cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _SPACES + _TAIL))

    def share_of(self, kind: bytes) -> int:
        return len(self.text) - len(self.text.translate(None, kind))

    @functools.cached_property
    def n_symbols(self) -> int:
        return self.share_of(SYMBOLS)

    @functools.cached_property
    def n_bars(self) -> int:
        """Words that are one bar: the borders of a table's cells."""
        return self.words.count(b"|")

    @functools.cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @functools.cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @functools.cached_property
    def word_ids(self) -> np.ndarray:
        return np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)

    @functools.cached_property
    def n_repeat_words(self) -> int:
        """Words inside 8-word windows that occur at least twice."""
        if self.n_words < 9:
            return 0
        windows = window_hashes(self.word_ids, 8)
        order = np.sort(windows)
        again = order[1:][order[1:] == order[:-1]]
        if not len(again):
            return 0
        hit = np.flatnonzero(np.isin(windows, again))
        cover = np.zeros(self.n_words + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 8, -1)
        return int(np.count_nonzero(np.cumsum(cover[:-1])))

    @functools.cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return int(np.count_nonzero(self.word_ids[1:] == self.word_ids[:-1]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]
    base: bool = False


#: Thresholds are integer comparisons, so that no verdict hangs on rounding.
RULES = (
    Rule("few_words", lambda f: f.n_words < 20, base=True),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 30 * f.n_words, base=True),
    Rule("symbols", lambda f: 100 * (f.n_symbols - f.n_bars) > 20 * f.n_words),  # a table is not noise
    Rule("duplicate_lines", lambda f: f.n_dup_lines > 1 and 100 * f.n_dup_lines > 30 * len(f.lines)),
    Rule("stutter", lambda f: 100 * f.n_stutters > 25 * f.n_words),
    Rule("capitals", lambda f: 100 * f.share_of(_UPPER) > 60 * f.share_of(_LETTERS)),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
)

SAMPLE_ROWS, SEED = 2000, 11


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def estimate_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Estimate]:
    """Cost (seconds a document) and selectivity (share rejected) of each rule on about ``sample_rows`` random documents.

    Each task measures its own share of the sample; only its sums leave it, and the driver gets one row per rule.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    schema = pa.schema([("rule", pa.int32()), ("n", pa.int64()), ("seconds", pa.float64()), ("rejected", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, spent, lost = 0, [0.0] * len(rules), [0] * len(rules)
        for _, texts in binary_rows(batches, "_text"):
            n += len(texts)
            for t in texts:
                for k, rule in enumerate(rules):
                    features, began = Features(t), time.perf_counter()
                    lost[k] += bool(rule.rejects(features))
                    spent[k] += time.perf_counter() - began
        if n:
            yield table({"rule": range(len(rules)), "n": [n] * len(rules), "seconds": spent, "rejected": lost}, schema)

    found = (
        docs.where(F.rand(SEED) < share).select(as_bytes(text).alias("_text"))
        .mapInArrow(measure, "rule int, n long, seconds double, rejected long")
        .groupBy("rule").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
        .collect()
    )
    by = {r["rule"]: r for r in found}
    return [Estimate(rule.name, by[k]["seconds"] / by[k]["n"] if k in by else 1.0, by[k]["rejected"] / by[k]["n"] if k in by else 0.0) for k, rule in enumerate(rules)]


def cascade_order(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    """Rules by rejections per second, highest first; ties keep the given order."""
    gain = {e.name: e.rejected / max(e.seconds, 1e-9) for e in estimates}
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


def first_rejection(features: Features, ordered: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in ordered if r.rejects(features)), None)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the base counts, ``base_failed``, and ``kept`` from the cascade over the other rules."""
    ordered = cascade_order(tuple(r for r in rules if not r.base), [e for e, r in zip(estimate_rules(docs, rules, sample_rows, text), rules, strict=True) if not r.base])
    base = tuple(r for r in rules if r.base)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in binary_rows(batches, "_text"):
            keys, seen = batch.column(0), [Features(t) for t in texts]
            failed = [any(r.rejects(f) for r in base) for f in seen]
            kept = [not bad and first_rejection(f, ordered) is None for bad, f in zip(failed, seen, strict=True)]
            columns = [keys, *(pa.array([getattr(f, c) for f in seen], pa.int64()) for c in counts), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *counts, "base_failed", "kept"])

    out = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(key), as_bytes(text).alias("_text")).mapInArrow(run, out)


def apply_quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns.  Each document stops at its first rejection."""
    ordered = cascade_order(rules, estimate_rules(docs, rules, sample_rows, text))

    @F.pandas_udf("boolean")
    def keeps(texts):
        return texts.map(lambda t: first_rejection(Features(t or b""), ordered) is None).astype(bool)

    return docs.where(keeps(as_bytes(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) u(i)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
cover AS (SELECT rid, count(DISTINCT j) AS n FROM again, unnest(range(i, i + 8)) u(j) GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters, len(list_filter(ws, lambda x: x = '|')) AS n_bars,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters FROM w LEFT JOIN cover USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * (n_symbols - n_bars) > 20 * n_words OR (n_dup_lines > 1 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_stutters > 25 * n_words OR 100 * capitals > 60 * letters OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""

"""What queries leave to shuffles and how often they read the texts; arrays of symbols against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import counting
from glyphmill.operators import bpe, lm, vocab
from glyphmill.plans import queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def merged(word, l, r):
    out, k = [], 0
    while k < len(word):
        step = 2 if word[k : k + 2] == [l, r] else 1
        out.append("".join(word[k : k + step]))
        k += step
    return out


def plain_windows(rows, n):
    out = Counter()
    for parts, weight in rows:
        at = [""] * n + parts + [""] * n
        for k in range(len(at) - n):
            out[tuple(at[k : k + n + 1])] += weight
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_changes_of_windows(n):
    """Every pair's change, with runs and chains of pairs, parts of several letters, weights, and keys too wide for a number (n = 12)."""
    rng = random.Random(n)
    rows = [([rng.choice(["a", "b", "ab", "c" * rng.randint(1, 2)]) for _ in range(rng.randint(0, 14))], rng.randint(0, 5)) for _ in range(60)]
    names = counting.Names()
    found = counting.of_parts(lm.pa.array([p for p, _ in rows], lm.pa.list_(lm.pa.string())), n, names, np.array([w for _, w in rows]))
    columns, counts = counting.windows(found, n, names)
    got = {tuple(names.all[c[k]] for c in columns): v for k, v in enumerate(counts.tolist())}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in plain_windows(rows, n).items() if v}
    columns, counts = counting.changes(found, n, names, None)
    got = {}
    for k, v in enumerate(counts.tolist()):
        l, r = names.all[columns[0][k]], names.all[columns[1][k]]
        window = tuple(names.all[c[k]] if c[k] != counting.MERGED else l + r for c in columns[2:])
        got.setdefault((l, r), Counter())[window] += v
    for l, r in {(p[k], p[k + 1]) for p, w in rows if w for k in range(len(p) - 1)}:
        want = plain_windows([(merged(p, l, r), w) for p, w in rows], n)
        want.subtract(plain_windows(rows, n))
        assert {k: v for k, v in got[l, r].items() if v} == {k: v for k, v in want.items() if v}


def test_merging_in_arrays():
    rng = random.Random(3)
    words = [[rng.choice("aab") for _ in range(rng.randint(1, 9))] for _ in range(80)]
    merges = [("a", "a"), ("aa", "b"), ("b", "b"), ("aa", "aa"), ("x", "a")]
    names = counting.Names()
    rows = counting.merged(counting.of_parts(lm.pa.array(words), 0, names, np.arange(80)), merges, names)
    columns, counts = counting.pairs(rows, names)
    want = Counter()
    for weight, word in enumerate(words):
        for l, r in merges:
            word = merged(word, l, r)
        for pair in zip(word, word[1:]):
            want[pair] += weight
    assert {tuple(names.all[c[k]] for c in columns): v for k, v in enumerate(counts.tolist())} == want


@pytest.mark.parametrize("name", ["merge_deltas", "lm_train"])
def test_model_queries_add_up_windows_within_tasks(spark, monkeypatch, name):
    """no row for each window of each word and candidate."""
    seen, deltas = [], lm._deltas

    def watched(changes, counts):  # scratch tables go after each merge
        assert "Generate" not in plan(changes) and "documents" not in str(changes.inputFiles())
        seen.append(changes.count())
        assert 0 < seen[-1] <= changes.rdd.getNumPartitions() * changes.select("l", "r", "ctx", "sym").distinct().count()
        return deltas(changes, counts)

    monkeypatch.setattr(lm, "_deltas", watched)
    queries.QUERIES[name](spark, DATA).count()
    assert seen


def test_running_text_changes_follow_distinct_windows(spark, monkeypatch):
    """ten times the text has as many changed windows, and contexts don't meet all their continuations."""
    seen = []
    deltas = lm._deltas
    monkeypatch.setattr(lm, "_deltas", lambda changes, counts: seen.append(changes) or deltas(changes, counts))
    for times in (40, 400):
        docs = spark.createDataFrame([(1, "abab cab b\tbaa " * times)], "doc_id bigint, text string").coalesce(1)
        found = lm.corpus_merge_deltas(docs, 2)
        assert "flatten" not in plan(found)
    assert seen[0].count() == seen[1].count()


def test_wide_text_in_arrays(spark):
    """Every white space of the class, characters beyond the first plane, empty and null texts."""
    texts = ["a\x1cb\x85c　d e\x0bf", "𐐀𐐁 𐐀𐐁", "", None, " \n\t ", "ß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["ctx"], r["sym"]): r["n"] for r in lm.corpus_ngram_counts(docs, 1).collect()}
    rows = [[c for w in t.split() for c in w] for t in texts if t and t.split()]
    assert got == {("".join(k[:1]), k[1]): v for k, v in plain_windows([(r, 1) for r in rows], 1).items()}
    by_class = docs.select(F.explode(vocab.words("text")).alias("word")).groupBy("word").count()
    assert {tuple(r) for r in vocab.vocabulary(docs).collect()} == {tuple(r) for r in by_class.collect()}


def test_vocabulary_counts_within_tasks(spark, monkeypatch):
    monkeypatch.setattr(vocab, "HELD_WORDS", 3)
    docs = spark.createDataFrame([("a b A a c d e a b",), (None,), ("d d d É é",)], "text string")
    assert "Generate" not in plan(vocab.vocabulary(docs))
    assert {r["word"]: r["freq"] for r in vocab.vocabulary(docs, ignore_case=True).collect()} == {"a": 4, "b": 2, "c": 1, "d": 4, "e": 1, "é": 2}
    assert vocab.vocabulary(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["preseg_recover", "preseg_propagated", "preseg_vocab", "merge_deltas", "preseg_common", "segmentation_diff", "boundary_fmeasure", "preseg_best", "preseg_words", "merge_sweep"])
def test_texts_are_counted_once(spark, name):
    """what follows the vocabulary reads it as a table, not by counting the texts again."""
    assert "documents" not in str(queries.QUERIES[name](spark, DATA).inputFiles())


@pytest.mark.parametrize("name", ["delimit_corpus", "delimit_restore_case"])
def test_delimiting_shuffles_no_tokens(spark, name):
    """F4, F5."""
    assert "Exchange" not in plan(queries.QUERIES[name](spark, DATA))


def test_ngrams_of_running_text_are_made_within_tasks(spark):
    """F8: no row for each window."""
    assert "Generate" not in plan(queries.QUERIES["ngram_counts_corpus"](spark, DATA))


@pytest.mark.parametrize("restore_case", [False, True])
def test_both_ways_of_delimiting_agree(spark, monkeypatch, restore_case):
    monkeypatch.setattr(bpe, "BLOCK", 20)
    monkeypatch.setattr(bpe, "HELD_WORDS", 2)
    texts = ["Hallo hallo  HALLO", "", None, " \t", "ΣΑΣ σας Éa ßß Ǆx", "lala lalala aaaa Aaaa", "x" * 50] * 3
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id bigint, line_no int, text string").repartition(3)
    merges = [("l", "a"), ("la", "la"), ("a", "a"), ("h", "a")]
    segs = bpe.apply_merges(vocab.vocabulary(lines, ignore_case=restore_case), merges)
    one = {tuple(r) for r in bpe.delimit_corpus(lines, segs, restore_case=restore_case).collect()}
    two = {tuple(r) for r in bpe.delimit_with_merges(lines, merges, restore_case=restore_case).collect()}
    assert one == two and len(one) == len(texts)
    assert {r[2] for r in one if r[1] == 5} == {"lala lala@@ la aa@@ aa " + ("Aa@@ aa" if restore_case else "A@@ aa@@ a")}

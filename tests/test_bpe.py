"""Byte-pair encoding against hand-worked cases and a plain one-at-a-time model."""

import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions.text import adjacent_pairs, boundaries, merge_pair, pad_symbols, strip_eol, symbols
from glyphmill.operators import bpe
from glyphmill.operators.vocab import corpus_lines, frequency_table, lowercase_corpus, vocabulary, without_most_frequent


def plain_merge(parts, pair):
    out, k = [], 0
    while k < len(parts):
        if tuple(parts[k : k + 2]) == pair:
            out.append(parts[k] + parts[k + 1])
            k += 2
        else:
            out.append(parts[k])
            k += 1
    return out


def plain_bpe(vocab, n, eol=False):
    segs = {w: list(w) + ["</w>"] * eol for w in vocab}
    merges = []
    for _ in range(n):
        stats = Counter()
        for w, s in segs.items():
            for p in zip(s, s[1:]):
                stats[p] += vocab[w]
        live = [(-c, p) for p, c in stats.items() if c > 0]
        if not live:
            break
        c, pair = min(live)
        merges.append((*pair, -c))
        segs = {w: plain_merge(s, pair) for w, s in segs.items()}
    return merges, segs


def frame(spark, vocab):
    return spark.createDataFrame(list(vocab.items()), "word string, freq bigint")


@pytest.mark.parametrize("eol", [False, True])
def test_learning_equals_the_plain_model(spark, eol):
    rng = random.Random(7)
    for _ in range(3):
        vocab = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): rng.randint(0, 9) for _ in range(30)}
        merges, segs = bpe.learn_bpe(frame(spark, vocab), 12, use_eol=eol)
        want, want_segs = plain_bpe(vocab, 12, eol)
        assert [(m.l, m.r, m.freq) for m in merges] == want
        assert {r["word"]: r["parts"] for r in segs.collect()} == want_segs


def test_learning_ends_without_pairs(spark):
    merges, segs = bpe.learn_bpe(frame(spark, {"a": 3, "bc": 0}), 5)
    assert merges == [] and segs.count() == 2
    merges, _ = bpe.learn_bpe(frame(spark, {}), 5)
    assert merges == []


def test_checkpoints(spark):
    seen = []
    bpe.learn_bpe(frame(spark, {"abab": 4, "abcd": 3, "cdcd": 2}), 5, checkpoint_every=2, on_checkpoint=lambda df, k: seen.append(k))
    assert seen[0] == 0 and seen == sorted(seen) and len(seen) >= 2


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_column_functions(spark):
    lit = F.lit
    assert [tuple(p) for p in one(spark, adjacent_pairs(F.array(*map(lit, "aaa"))))] == [("a", "a"), ("a", "a")]
    assert one(spark, symbols(merge_pair(pad_symbols(lit("aaa")), "a", "a"))) == ["aa", "a"]
    assert one(spark, symbols(merge_pair(pad_symbols(lit("aaaa")), "a", "a"))) == ["aa", "aa"]
    assert one(spark, strip_eol(F.array(lit("th"), lit("e</w>")))) == ["th", "e"]
    assert one(spark, strip_eol(F.array(lit("the"), lit("</w>")))) == ["the"]
    assert one(spark, boundaries(F.array(lit("open"), lit("mind"), lit("ed")))) == [4, 8]
    assert one(spark, boundaries(F.array(lit("open")))) == []


@pytest.mark.parametrize("in_sql", [0, 48])
def test_applying_goes_through_the_list(spark, in_sql):
    words = spark.createDataFrame([("abc",), ("ab",), ("c",), ("ababab",)], "word string")
    got = {r["word"]: r["parts"] for r in bpe.apply_merges(words, [("ab", "c"), ("a", "b")], in_sql=in_sql).collect()}
    assert got == {"abc": ["ab", "c"], "ab": ["ab"], "c": ["c"], "ababab": ["ab", "ab", "ab"]}


@given(st.text("abc", min_size=1, max_size=9), st.lists(st.tuples(st.sampled_from(["a", "b", "c", "ab", "bc", "abc"]), st.sampled_from(["a", "b", "c", "ab", "bc"])), max_size=8))
def test_walk_equals_list(word, merges):
    places = {}
    for k, p in enumerate(merges):
        places.setdefault(p, []).append(k)
    want = list(word)
    for p in merges:
        want = plain_merge(want, p)
    assert bpe.segment_word(list(word), places) == want


def test_delimiting(spark):
    corpus = spark.createDataFrame([(1, 0, "Cats  sat"), (1, 1, ""), (1, 2, None), (2, 0, "NASA sat")], "doc_id int, line_no int, text string")
    segs = spark.createDataFrame([("cats", ["cat", "s"]), ("sat", ["sat"]), ("nasa", ["na", "sa"])], "word string, parts array<string>")
    got = {(r["doc_id"], r["line_no"]): r["text"] for r in bpe.delimit_corpus(corpus, segs, restore_case=True).collect()}
    assert got == {(1, 0): "Cat@@ s sat", (1, 1): "", (1, 2): "", (2, 0): "Na@@ sa sat"}
    with pytest.raises(Exception, match="no segmentation for Cats"):
        bpe.delimit_corpus(corpus, segs).collect()
    assert bpe.delimit_corpus(corpus, segs, missing="keep").where("doc_id = 1 AND line_no = 0").first()["text"] == "Cats sat"


def test_vocabularies(spark):
    docs = spark.createDataFrame([(1, "The the\ncat"), (2, None), (3, "cat cat\x1ccat")], "doc_id int, text string")
    assert {tuple(r) for r in vocabulary(docs).collect()} == {("The", 1), ("the", 1), ("cat", 4)}
    assert {tuple(r) for r in vocabulary(docs, ignore_case=True).collect()} == {("the", 2), ("cat", 4)}
    lines = spark.createDataFrame([("3 cat",), ("cat",), ("1 cat x",), (" 2\tcat ",), ("1 dog",)], "line string")
    assert {tuple(r) for r in frequency_table(lines).collect()} == {("cat", 5), ("dog", 1)}
    assert [r["text"] for r in lowercase_corpus(corpus_lines(docs.where("doc_id = 1"))).orderBy("line_no").collect()] == ["the the", "cat"]
    assert {r["word"] for r in without_most_frequent(vocabulary(docs), 1).collect()} == {"The", "the"}


def test_diff(spark):
    a = spark.createDataFrame([("ab", ["a", "b"]), ("cd", ["cd"])], "word string, parts array<string>")
    b = spark.createDataFrame([("ab", ["ab"]), ("cd", ["cd"])], "word string, parts array<string>")
    assert [tuple(r) for r in bpe.segmentation_diff(a, b).collect()] == [("ab", "a b", "ab")]

"""Affix rules, their application, mass transfer, recovery and propagation."""

import json

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.text import drop_strings
from glyphmill.operators import preseg
from glyphmill.sources.readers import read_transformations

PARTS = "word string, parts array<string>"


def test_drop_strings(spark):
    rows = spark.createDataFrame([("ies", "y", "s"), ("able", "ab", "s"), ("unre", "re", "p"), ("aab", "ab", "p")], "a string, b string, k string")
    cut = drop_strings(F.col("a"), F.col("b"), F.col("k"))
    assert [tuple(r) for r in rows.select(*cut).collect()] == [("ies", "y"), ("le", ""), ("un", ""), ("a", "")]


def test_mass_flows_down(spark):
    vocab = spark.createDataFrame([("cats", 3), ("cat", 1), ("recats", 2)], "word string, freq bigint")
    cut = spark.createDataFrame([("cats", ["cat", "s"]), ("recats", ["re", "cats"]), ("dog", ["dog"])], PARTS)
    got = dict(map(tuple, preseg.apply_presegs(vocab, cut).collect()))
    assert got == {"cats": 0, "cat": 6, "s": 5, "recats": 0, "re": 2}
    assert dict(map(tuple, preseg.apply_presegs(vocab, cut, drop_zero=True).collect())) == {"cat": 6, "s": 5, "re": 2}


def test_recovery(spark):
    vocab = spark.createDataFrame([("cats", 3), ("sat", 1)], "word string, freq bigint")
    cut = spark.createDataFrame([("cats", ["cat", "s"])], PARTS)
    segs = spark.createDataFrame([("cat", ["c", "at"]), ("s", ["s"]), ("sat", ["sat"])], PARTS)
    assert {r["word"]: r["parts"] for r in preseg.recover_presegs(vocab, cut, segs).collect()} == {"cats": ["c", "at", "s"], "sat": ["sat"]}
    with pytest.raises(Exception, match="no segmentation for s"):
        preseg.recover_presegs(vocab, cut, segs.where("word <> 's'")).collect()
    kept = preseg.recover_presegs(vocab, cut, segs.where("word <> 's'"), missing="keep")
    assert {r["word"]: r["parts"] for r in kept.collect()}["cats"] == ["c", "at", "s"]
    assert [r["offsets"] for r in preseg.extract_boundaries(vocab, cut).collect()] == [[3]]


@pytest.fixture
def world(spark, tmp_path):
    words = ["walk", "walks", "talk", "talks", "redo", "do", "zero", "zeros", "undo"]
    vocab = spark.createDataFrame([(w, 9 - k) for k, w in enumerate(words)], "word string, freq bigint")
    at = {"walk": [1, 0], "walks": [1, 1], "talk": [2, 0], "talks": [2, 1], "do": [0, 3], "redo": [4, 3], "undo": [0, 9], "zero": [5, 5], "zeros": [5, 5]}
    vectors = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in at.items()], "word string, vec array<double>")
    rules = [
        {"rule": {"from": "", "to": "s", "kind": "s"}, "transformations": [{"cosine": "0.9", "rule": {"input": "walk", "output": "walks"}}, {"cosine": "0.95", "rule": {"input": "walk", "output": "nope"}}]},
        {"rule": {"from": "re", "to": "", "kind": "p"}, "transformations": [{"cosine": "0.7", "rule": {"input": "redo", "output": "do"}}]},
        {"rule": {"from": "x", "to": "y", "kind": "s"}, "transformations": [{"cosine": "0.7", "rule": {"input": "a", "output": "b"}}]},
        {"rule": {"from": "q", "to": "", "kind": "s"}},
    ]
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    return vocab, vectors, read_transformations(spark, str(path))


def test_rules_and_words(spark, world):
    vocab, vectors, rules = world
    found = preseg.transform_directions(rules, vocab, vectors)
    assert [(r["ord"], r["kind"], r["from_str"], r["to_str"], r["dirs"]) for r in found.orderBy("ord").collect()] == [(0, "s", "s", "", [[0.0, -1.0]]), (1, "p", "re", "", [[-4.0, 0.0]])]
    got = {r["word"]: r["parts"] for r in preseg.compute_presegs(vocab, found, vocab, vectors).collect()}
    # zeros - zero is the zero vector: no match; undo has no rule
    assert got == {"walk": ["walk"], "walks": ["walk", "s"], "talk": ["talk"], "talks": ["talk", "s"], "redo": ["re", "do"], "do": ["do"], "zero": ["zero"], "zeros": ["zeros"], "undo": ["undo"]}
    assert preseg.transform_directions(rules, vocab, vectors, num_examples=0).count() == 0


def test_common(spark):
    vocab = spark.createDataFrame([("cats", 3)], "word string, freq bigint")
    cut = spark.createDataFrame([("cats", ["cat", "s"]), ("dogs", ["dog", "s"])], PARTS)
    rows = preseg.common_presegs(vocab, cut, cut, cut, 5).collect()
    assert [(r["word"], r["freq"]) for r in rows] == [("cats", 3), ("dogs", 0)]


NODES = "word string, parent string, kind string, from_str string, parts array<string>"


def test_propagation(spark):
    """Trees worked by hand."""
    rows = [
        # suffixes on suffixes, then a prefix in front of all: each inner split shows in the longer words
        ("giving", "give", "s", "ing", "giv ing", "giv ing"), ("givings", "giving", "s", "s", "giving s", "giv ing s"), ("regivings", "givings", "p", "re", "re givings", "re giv ing s"), ("give", None, None, None, "give", "give"),
        # a suffix inside a prefixed word, and again one level down
        ("unlocked", "locked", "p", "un", "un locked", "un lock ed"), ("locked", "lock", "s", "ed", "lock ed", "lock ed"), ("unlockedness", "unlocked", "s", "ness", "unlocked ness", "un lock ed ness"),
        # the stem doesn't end like its parent: the parent's split stops there, and so does all below
        ("baking", "baked", "s", "ing", "bak ing", "bak ing"), ("baked", "bake", "s", "ed", "bak ed", "bak ed"), ("bakings", "baking", "s", "s", "baking s", "bak ing s"),
        # a split that the word didn't take leaves later parts without a counterpart
        ("abcd", "abc", "s", "d", "abc d", "a b c d"), ("abc", "ab", "s", "c", "ab c", "a b c"), ("ab", "a", "s", "b", "a b", "a b"), ("a", None, None, None, "a", "a"),
        # nothing is left of a part that is the affix itself
        ("sss", "ss", "s", "s", "ss s", "s s s"), ("ss", "s", "s", "s", "s s", "s s"), ("lone", None, None, None, "lone", "lone"),
    ]
    df = spark.createDataFrame([(*r[:4], r[4].split()) for r in rows], NODES)
    assert {r["word"]: " ".join(r["parts"]) for r in preseg.propagated(df).collect()} == {r[0]: r[5] for r in rows}
    assert preseg.propagated(df.limit(0)).count() == 0


def test_propagation_down_a_deep_tree(spark):
    df = spark.createDataFrame([("a" * k, "a" * (k - 1), "s", "a", ["a" * (k - 1), "a"]) for k in range(2, 14)], NODES)
    assert {r["word"]: r["parts"] for r in preseg.propagated(df).collect()} == {"a" * k: ["a"] * k for k in range(2, 14)}


def test_cycles_are_refused(spark):
    vocab = spark.createDataFrame([("ab", 1), ("cd", 1), ("e", 2)], "word string, freq bigint")
    cut = spark.createDataFrame([("ab", ["cd", "s"]), ("cd", ["ab", "t"]), ("e", ["ab", "x"])], PARTS)
    with pytest.raises(ValueError, match="back to their own word"):
        preseg.apply_presegs(vocab, cut)
    longer = spark.createDataFrame([("ab", ["abc", "s"]), ("abc", ["x", "y"])], PARTS)  # a longer part, but no cycle
    assert dict(map(tuple, preseg.apply_presegs(vocab, longer).collect())) == {"ab": 0, "cd": 1, "e": 2, "abc": 0, "s": 1, "x": 1, "y": 1}

"""N-gram deltas, scores, gold preparation, vectors, and reading and writing."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import bpe, gold, lm, score, vectors
from glyphmill.sources import readers, writers
from glyphmill.streaming.vocab import stream_vocabulary

PARTS = "word string, parts array<string>"
GOLD = "word string, alts array<array<string>>"


def plain_counts(segs, n):
    out = Counter()
    for parts, freq in segs:
        p = [""] * n + parts + [""] * n
        for i in range(len(parts) + n):
            out[tuple(p[i : i + n]), p[i + n]] += freq
    return out


def plain_loglik(counts):
    base = Counter()
    for (ctx, _), c in counts.items():
        base[ctx] += c
    return sum(c * math.log(c / base[ctx]) for (ctx, _), c in counts.items() if c)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_deltas_are_exact(spark, n):
    rng = random.Random(n)
    vocab = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))): rng.randint(1, 9) for _ in range(12)}
    segs = bpe.initial_segmentation(spark.createDataFrame(list(vocab.items()), "word string, freq bigint"))
    before = plain_loglik(plain_counts([(list(w), f) for w, f in vocab.items()], n))
    for r in lm.all_deltas(segs, n).collect():
        def merged(w, pair=(r["l"], r["r"])):
            out, k = [], 0
            while k < len(w):
                step = 2 if tuple(w[k : k + 2]) == pair else 1
                out.append(w[k : k + step])
                k += step
            return out

        after = plain_loglik(plain_counts([(merged(w), f) for w, f in vocab.items()], n))
        assert r["delta"] == pytest.approx(after - before, abs=1e-6)


def test_counts_and_training(spark):
    words = [("ab", 2), ("b", 1)]
    segs = spark.createDataFrame([(w, f, list(w)) for w, f in words], "word string, freq bigint, parts array<string>")
    got = {(r["ctx"], r["sym"]): r["n"] for r in lm.ngram_counts(segs, 2).collect()}
    assert got == {(" ".join(c), s): n for (c, s), n in plain_counts([(list(w), f) for w, f in words], 2).items()}
    assert {(r["ctx"], r["sym"]): r["n"] for r in lm.ngram_counts(segs, 2, first_word_freq=2).collect()}[" ", ""] == 2
    merges, gains, parts = lm.learn_lm(segs.select("word", "freq"), 3, 2)
    assert [(m.l, m.r) for m in merges] == [("a", "b")] and len(gains) == 1 and parts.count() == 2


def joined(word, l, r):
    out, k = [], 0
    while k < len(word):
        step = 2 if word[k : k + 2] == [l, r] else 1
        out.append("".join(word[k : k + step]))
        k += step
    return out


@pytest.mark.parametrize("whole_words", [False, True])
def test_running_text_against_counting_anew(spark, monkeypatch, whole_words):
    """Every pair's change, over empty and null texts, repeated texts, near and overlapping occurrences, and several portions."""
    monkeypatch.setattr(lm, "HELD", 20)
    texts = ["aaa aab\n baab", "", None, " \t", "ab", "abab ababa aaaa", "abab ababa aaaa", "caab ß ab " * 30, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    cut = (lambda w: [w[:2], *w[2:]]) if whole_words else list
    each = [[cut(w) for w in (t or "").split()] for t in texts]
    each = [words for words in each if words]
    segs = spark.createDataFrame(sorted({(w, tuple(cut(w))) for t in texts for w in (t or "").split()}), "word string, parts array<string>") if whole_words else None

    def counts(documents):
        return plain_counts([([s for w in words for s in w], 1) for words in documents], 2)

    got = {(r["ctx"], r["sym"]): r["n"] for r in lm.corpus_ngram_counts(docs, 2, segs).collect()}
    assert got == {(" ".join(c), s): n for (c, s), n in counts(each).items()}
    before = plain_loglik(counts(each))
    found = {(r["l"], r["r"]): r["delta"] for r in lm.corpus_merge_deltas(docs, 2, segs=segs).collect()}
    assert set(found) == {(w[k], w[k + 1]) for words in each for w in words for k in range(len(w) - 1)}
    for (l, r), delta in found.items():
        assert delta == pytest.approx(plain_loglik(counts([[joined(w, l, r) for w in words] for words in each])) - before, abs=1e-6)
    some = spark.createDataFrame(sorted(found)[:2], "l string, r string")
    assert {(r["l"], r["r"]): r["delta"] for r in lm.corpus_merge_deltas(docs, 2, some, segs=segs).collect()} == pytest.approx({k: found[k] for k in sorted(found)[:2]})
    assert lm.corpus_merge_deltas(docs.where("doc_id < 0"), 2).count() == 0


def test_compat_deltas_agree_on_single_occurrences(spark):
    segs = bpe.initial_segmentation(spark.createDataFrame([("xab", 3), ("cd", 2)], "word string, freq bigint"))
    pairs = bpe.pair_statistics(spark.createDataFrame([("xab", 3, list("xab")), ("cd", 2, list("cd"))], "word string, freq bigint, parts array<string>"))
    exact = {(r["l"], r["r"]): r["delta"] for r in lm.merge_deltas(segs, 2, pairs).collect()}
    each = {(r["l"], r["r"]): r["delta"] for r in lm.merge_deltas(segs, 2, pairs, compat=True).collect()}
    assert exact.keys() == each.keys()
    for k in exact:
        assert each[k] == pytest.approx(exact[k], abs=1e-9)


def test_scores(spark):
    want = spark.createDataFrame([("openminded", [["open", "mind", "ed"]]), ("cats", [["cats"], ["cat", "s"]]), ("dog", [["dog"]])], GOLD)
    segs = spark.createDataFrame([("openminded", ["open", "minded"]), ("cats", ["cat", "s"]), ("zzz", ["zzz"])], PARTS)
    got = {r["word"]: tuple(r)[1:] for r in score.word_scores(want, segs).collect()}
    assert got == {"openminded": (1, 0, 1), "cats": (1, 0, 0)}
    row = score.report(want, segs).first()
    assert (row["evaluated"], row["gold_words"], row["suggested_words"]) == (2, 3, 3)
    assert (row["precision"], row["recall"], row["fmeasure"]) == (1.0, pytest.approx(2 / 3), pytest.approx(0.8))
    assert score.parse_report(score.format_report(score.report(want, segs))).first()["fmeasure"] == 80.0
    none = score.totals(score.word_scores(want, segs.where("word = 'zzz'"))).first()
    assert (none["precision"], none["recall"], none["fmeasure"]) == (1.0, 1.0, 1.0)
    with pytest.raises(Exception, match="letters differ"):
        score.word_scores(want, spark.createDataFrame([("dog", ["d", "og", "x"])], PARTS)).collect()


def test_sweep(spark):
    want = spark.createDataFrame([("cats", [["cat", "s"]]), ("cat", [["cat"]])], GOLD)
    rows = {r["num_merges"]: r for r in score.merge_sweep(want, [("c", "a"), ("ca", "t")], [0, 1, 2]).collect()}
    assert rows[2]["fmeasure"] == 1.0 and rows[0]["precision"] < rows[1]["precision"]
    table = score.score_table(score.merge_sweep(want, [("c", "a")], [0, 1]), score.merge_sweep(want, [("c", "a")], [0, 1]))
    assert score.score_peaks(table).first()["bpe_peak"] == table.agg(F.max("bpe_f")).first()[0]


def test_gold(spark):
    first = spark.createDataFrame([("cats", [["cat", "s"]]), ("no", [["no"]])], GOLD)
    second = spark.createDataFrame([("cats", [["x"]]), ("dogs", [["dog:dog_N", "~", "s:+PL"]])], GOLD)
    vocab = spark.createDataFrame([("cats",), ("dogs",)], "word string")
    got = {r["word"]: r["alts"] for r in gold.union_gold(first, second, vocab).collect()}
    assert got == {"cats": [["cat", "s"]], "dogs": [["dog", "s"]]}
    assert [r["line"] for r in gold.serialise(first).orderBy("word").collect()] == ["cats\tcat s", "no\tno"]
    lines = spark.createDataFrame([("2 cats",), ("1 dogs",), ("x",)], "line string")
    table, kept, known = gold.evaluation_data(lines, second, spark.createDataFrame([("dogs", [1.0])], "word string, vec array<double>"))
    assert [r["line"] for r in table.collect()] == ["1 dogs"] and [r["alts"] for r in kept.collect()] == [[["dog", "s"]]] and known.count() == 1
    sides = spark.createDataFrame([(0, "a b", "a", "a", "a"), (1, "a", None, "a", "a b c")], "line_no int, base_src string, base_tgt string, morpho_src string, morpho_tgt string")
    assert [r["line_no"] for r in gold.prune_parallel(sides, 3).collect()] == [0]


def test_vectors(spark):
    lines = spark.createDataFrame([("new york 1 .", 0), ("cat 2 3", 1), ("cat 4 5", 2)], "line string, n int")
    got = {r["word"]: r["vec"] for r in vectors.parse_vectors(lines, 2, order="n").collect()}
    assert got == {"newyork": [1.0, 0.0], "cat": [4.0, 5.0]}
    held = spark.createDataFrame([("cat", [1.0]), ("cart", [3.0]), ("zebra", [5.0])], "word string, vec array<double>")
    assert vectors.mean_vector(held).first()["vec"] == [3.0]
    needed = spark.createDataFrame([("cat",), ("cst",), ("qqqqqq",), ("",)], "word string")
    freq = spark.createDataFrame([("cat", 1), ("cart", 9)], "word string, freq bigint")
    filled = vectors.impute_vectors(needed, held, freq)
    assert {r["word"]: (r["source"], r["vec"]) for r in filled.collect()} == {"cat": ("cat", [1.0]), "cst": ("cat", [1.0]), "qqqqqq": (None, [3.0]), "": (None, [3.0])}
    assert vectors.count_imputed(filled).first()[0] == 2


def test_imputation_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    held = {word(): rng.randint(1, 5) for _ in range(25)}
    needed = {word() for _ in range(25)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + row[1:], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    vecs = spark.createDataFrame([(w, [1.0]) for w in held], "word string, vec array<double>")
    got = {r["word"]: r["source"] for r in vectors.impute_vectors(spark.createDataFrame([(w,) for w in needed], "word string"), vecs, spark.createDataFrame(list(held.items()), "word string, freq bigint")).collect()}
    for w in needed:
        near = sorted((distance(w, h), -f, h) for h, f in held.items() if distance(w, h) <= 2)
        assert got[w] == (w if w in held else near[0][2] if near else None)


def test_reading_and_writing(spark, tmp_path):
    segs = spark.createDataFrame([("the", ["th", "e"]), ("cats", ["cat", "s"])], PARTS)
    writers.write_segmentations(segs, str(tmp_path / "segs"))
    assert {r["word"]: r["parts"] for r in readers.read_segmentations(spark, str(tmp_path / "segs")).collect()} == {"the": ["th", "e"], "cats": ["cat", "s"]}
    writers.write_merges(spark.createDataFrame([(1, "th", "e"), (0, "t", "h")], "rank int, l string, r string"), str(tmp_path / "ops"))
    assert [tuple(r) for r in readers.read_merges(spark, str(tmp_path / "ops")).orderBy("rank").collect()] == [(0, "t", "h"), (1, "th", "e")]
    (tmp_path / "gold.txt").write_text("cats\tcat s, cats\r\ncats\tc ats\n")
    assert [r["alts"] for r in readers.read_gold(spark, str(tmp_path / "gold.txt")).collect()] == [[["c", "ats"]]]
    (tmp_path / "bad.txt").write_text("cats\n")
    with pytest.raises(Exception, match="not a gold line"):
        readers.read_gold(spark, str(tmp_path / "bad.txt")).collect()
    for k, name in enumerate("abcd"):
        (tmp_path / name).write_text("x\n" * (3 - k))
    assert [tuple(r) for r in readers.read_parallel(spark, *(str(tmp_path / n) for n in "abcd")).orderBy("line_no").collect()] == [(0, "x", "x", "x", ""), (1, "x", "x", "", ""), (2, "x", "", "", "")]
    (tmp_path / "sug.txt").write_text("cat s\n")
    assert [tuple(r) for r in readers.read_suggestions(spark, str(tmp_path / "sug.txt")).collect()] == [("cats", ["cat", "s"])]
    (tmp_path / "vec.txt").write_text("cat . 2.5\n")
    assert [tuple(r) for r in readers.read_vectors(spark, str(tmp_path / "vec.txt"), 2).collect()] == [("cat", [0.0, 2.5])]
    writers.write_score_table(spark.createDataFrame([(500, 41.2, 44.0), (0, 40.0, 45.0)], "num_merges int, bpe_f double, morph_f double"), str(tmp_path / "csv"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["Num Iterations,BPE Scores,Morpho Scores", "", "0,40.0,45.0", "500,41.2,44.0", "", "Peak,41.2,45.0"]
    writers.write_suggestions(spark.createDataFrame([("ab", ["a", "b</w>"]), ("c", ["c", "</w>"])], PARTS), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a b", "c"]
    (tmp_path / "words.txt").write_text("3 cat\n")
    assert readers.read_word_list(spark, str(tmp_path / "words.txt"), 1).first()["word"] == "cat"


def test_streaming_vocabulary(spark, tmp_path):
    spark.createDataFrame([(1, "a b a")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    stream_vocabulary(stream, "running", str(tmp_path / "state")).awaitTermination(60)
    assert {tuple(r) for r in spark.sql("SELECT * FROM running").collect()} == {("a", 2), ("b", 1)}

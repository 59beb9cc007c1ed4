"""The registered queries over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, drop_strings, symbols
from ..operators import bpe, gold, lm, preseg, score, vectors, vocab
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MERGES, FIRST = 8, 6


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _text(parts: str = "parts") -> F.Column:
    return F.array_join(parts, " ")


# --- vocabularies ---------------------------------------------------------------

_V = fx.vocab_sql()


@_query("token_frequency", _V)
def token_frequency(spark, d):
    return fx.vocab(spark, d)


@_query("token_frequency_ci", fx.vocab_sql(lower=True))
def token_frequency_ci(spark, d):
    return vocab.vocabulary(fx.documents(spark, d), ignore_case=True)


@_query("freq_table_vocab", f"SELECT word, sum(freq)::BIGINT AS freq FROM (SELECT word, freq FROM ({_V}) UNION ALL SELECT word, 1 FROM ({_V}) WHERE length(word) = 3) GROUP BY word")
def freq_table_vocab(spark, d):
    words = fx.vocab(spark, d)
    lines = words.select(F.concat_ws(" ", "freq", "word").alias("line")).unionByName(words.where("length(word) = 3").select(F.concat(F.lit(" 1\t"), F.col("word")).alias("line")))
    bad = words.where("length(word) = 4").select(F.explode(F.array("word", F.concat(F.lit("1 "), F.col("word"), F.lit(" x")))).alias("line"))
    return vocab.frequency_table(lines.unionByName(bad))


_LINES = "SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM documents)"
_TOKENS = f"list_filter(string_split_regex(text, '{WHITESPACE}'), lambda w: w <> '')"


@_query("lowercase_corpus", f"SELECT doc_id, line_no, array_to_string(list_transform({_TOKENS}, lambda w: lower(w)), ' ') AS text FROM ({_LINES})")
def lowercase_corpus(spark, d):
    return vocab.lowercase_corpus(vocab.corpus_lines(fx.documents(spark, d)))


_TAB_LINES = f"SELECT doc_id, line_no, replace(text, chr(9), ' ') AS text FROM ({_LINES})"


def _tab_lines(spark, d):
    """Every line of every text as the second of three tab-separated fields."""
    rows = vocab.corpus_lines(fx.documents(spark, d))
    return rows.select(F.concat_ws("\t", "doc_id", F.regexp_replace("text", "\t", " "), "line_no").alias("line"))


@_query("tab_corpus", f"SELECT w AS word, count(*)::BIGINT AS freq FROM (SELECT unnest({_TOKENS}) AS w FROM ({_TAB_LINES})) GROUP BY 1")
def tab_corpus(spark, d):
    corpus, _ = gold.evaluation_corpus(_tab_lines(spark, d), spark.createDataFrame([], "word string, alts array<array<string>>"))
    return vocab.vocabulary(corpus)


@_query("frequent_excluded", f"SELECT word, freq FROM (SELECT *, row_number() OVER (ORDER BY freq DESC, word) AS n FROM ({_V})) WHERE n > 100")
def frequent_excluded(spark, d):
    return vocab.without_most_frequent(fx.vocab(spark, d), 100)


# --- byte-pair encoding ---------------------------------------------------------

_PAIRS = "SELECT p[1] AS l, p[2] AS r, sum(freq)::BIGINT AS freq FROM (SELECT freq, unnest(list_transform(range(1, len(p)), lambda i: [p[i], p[i + 1]])) AS p FROM (SELECT freq, string_split({seg}, '{by}') AS p FROM ({rows}))) GROUP BY 1, 2"
_CHAR_PAIRS = _PAIRS.format(seg="word", by="", rows=_V)


@_query("pair_statistics", _CHAR_PAIRS)
def pair_statistics(spark, d):
    return bpe.pair_statistics(fx.vocab(spark, d).select("freq", F.split("word", "").alias("parts")))


@_query("top_pairs", f"SELECT * FROM ({_CHAR_PAIRS}) ORDER BY freq DESC, l, r LIMIT 40")
def top_pairs(spark, d):
    return bpe.top_pairs(bpe.pair_statistics(fx.vocab(spark, d).select("freq", F.split("word", "").alias("parts"))), 40)


def bpe_sql(words: str, n: int, eol: bool = False, prefix: str = "") -> str:
    """CTEs: ``s_k`` the segmentations after k merges, ``b_k`` the k-th merge."""
    end = " || ' </w> '" if eol else ""
    ctes = [f"{prefix}s0 AS MATERIALIZED (SELECT word, freq, ' ' || array_to_string(string_split(word, ''), '  ') || ' '{end} AS seg FROM ({words}))"]
    for k in range(n):
        pairs = _PAIRS.format(seg="trim(seg)", by="  ", rows=f"{prefix}s{k}")
        ctes.append(f"{prefix}b{k} AS MATERIALIZED (SELECT {k} AS rank, l, r, freq FROM ({pairs}) WHERE freq > 0 ORDER BY freq DESC, l, r LIMIT 1)")
        ctes.append(f"{prefix}s{k + 1} AS MATERIALIZED (SELECT word, s.freq, replace(seg, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' ') AS seg FROM {prefix}s{k} s, {prefix}b{k})")
    return "WITH " + ", ".join(ctes)


def merges_sql(n: int, prefix: str = "") -> str:
    return " UNION ALL ".join(f"SELECT rank::INTEGER AS rank, l, r, freq FROM {prefix}b{k}" for k in range(n))


@_query("bpe_train", f"{bpe_sql(_V, MERGES)} {merges_sql(MERGES)}")
def bpe_train(spark, d):
    merges, _ = bpe.learn_bpe(fx.vocab(spark, d), MERGES)
    return bpe.merges_frame(spark, merges)


@_query("bpe_segmentations", f"{bpe_sql(_V, MERGES)} SELECT word, freq, replace(trim(seg), '  ', ' ') AS seg FROM s{MERGES}")
def bpe_segmentations(spark, d):
    _, segs = bpe.learn_bpe(fx.vocab(spark, d), MERGES)
    return segs.select("word", "freq", _text().alias("seg"))


@_query("bpe_train_eol", f"{bpe_sql(_V, MERGES, eol=True)} {merges_sql(MERGES)}")
def bpe_train_eol(spark, d):
    merges, _ = bpe.learn_bpe(fx.vocab(spark, d), MERGES, use_eol=True)
    return bpe.merges_frame(spark, merges)


@_query("remove_eols", f"{bpe_sql(_V, MERGES, eol=True)} SELECT word, replace(replace(replace(trim(seg), '  ', ' '), ' </w>', ''), '</w>', '') AS seg FROM s{MERGES} WHERE word NOT LIKE '%</w>%'")
def remove_eols(spark, d):
    _, segs = bpe.learn_bpe(fx.vocab(spark, d), MERGES, use_eol=True)
    return bpe.remove_eols(segs).where("word NOT LIKE '%</w>%'").select("word", _text().alias("seg"))


_EN, _FR = fx.vocab_sql("en"), fx.vocab_sql("fr")


def apply_sql(rows: str, n: int) -> str:
    """seg after the first n merges b0.. on the padded ``seg`` of ``rows``."""
    for k in range(n):
        rows = f"SELECT x.* EXCLUDE (seg), replace(seg, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' ') AS seg FROM ({rows}) x, b{k}"
    return rows


_PADDED = "SELECT word, ' ' || array_to_string(string_split(word, ''), '  ') || ' ' AS seg FROM ({0})"


@_query("bpe_apply_merges", f"{bpe_sql(_EN, MERGES)} SELECT word, replace(trim(seg), '  ', ' ') AS seg FROM ({apply_sql(_PADDED.format(_FR), FIRST)})")
def bpe_apply_merges(spark, d):
    merges, _ = bpe.learn_bpe(fx.vocab(spark, d, "en"), MERGES)
    segs = bpe.apply_merges(fx.vocab(spark, d, "fr"), [(m.l, m.r) for m in merges], FIRST)
    return segs.select("word", _text().alias("seg"))


@_query("bpe_apply_long_list", ORACLES["bpe_apply_merges"])
def bpe_apply_long_list(spark, d):
    merges, _ = bpe.learn_bpe(fx.vocab(spark, d, "en"), MERGES)
    segs = bpe.apply_merges(fx.vocab(spark, d, "fr"), [(m.l, m.r) for m in merges], FIRST, in_sql=0)
    return segs.select("word", _text().alias("seg"))


def _delimit_sql(lower: bool) -> str:
    words = fx.vocab_sql(lower=lower)
    look = "lower(w)" if lower else "w"
    part = "replace(trim(seg), '  ', '@@ ')"
    piece = f"CASE WHEN regexp_matches(w, '^\\p{{Lu}}') THEN upper(left({part}, 1)) || substring({part}, 2) ELSE {part} END" if lower else part
    return f"""{bpe_sql(words, MERGES)}, t AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) AS at0, unnest(ws) AS w FROM (SELECT doc_id, line_no, {_TOKENS} AS ws FROM ({_LINES}))),
    j AS (SELECT doc_id, line_no, string_agg({piece}, ' ' ORDER BY at0) AS text FROM t JOIN s{MERGES} s ON s.word = {look} GROUP BY 1, 2)
    SELECT l.doc_id, l.line_no, coalesce(j.text, '') AS text FROM ({_LINES}) l LEFT JOIN j ON j.doc_id = l.doc_id AND j.line_no = l.line_no"""


@_query("delimit_corpus", _delimit_sql(False))
def delimit_corpus(spark, d):
    merges, _ = bpe.learn_bpe(fx.vocab(spark, d), MERGES)
    return bpe.delimit_with_merges(vocab.corpus_lines(fx.documents(spark, d)), [(m.l, m.r) for m in merges])


@_query("delimit_restore_case", _delimit_sql(True))
def delimit_restore_case(spark, d):
    docs = fx.documents(spark, d)
    merges, _ = bpe.learn_bpe(vocab.vocabulary(docs, ignore_case=True), MERGES)
    return bpe.delimit_with_merges(vocab.corpus_lines(docs), [(m.l, m.r) for m in merges], restore_case=True)


# --- gold standards --------------------------------------------------------------

_STEMS = fx.stems_sql(_V)
_EVEN = "length(word) % 2 = 0"


@_query("gold_parse", f"SELECT word, stem || ' ' || suf || CASE WHEN {_EVEN} THEN ', ' || word ELSE '' END AS line, CASE WHEN {_EVEN} THEN 2 ELSE 1 END::INTEGER AS n_alts FROM ({_STEMS})")
def gold_parse(spark, d):
    parsed = fx.gold(fx.vocab(spark, d))
    return parsed.select("word", F.array_join(F.transform("alts", lambda a: F.array_join(a, " ")), ", ").alias("line"), F.size("alts").alias("n_alts"))


@_query("gold_strip_labels", f"SELECT word, word || chr(9) || array_to_string(list_filter([CASE WHEN split_part(stem, ':', 1) = '~' THEN NULL ELSE split_part(stem, ':', 1) END, suf], lambda x: x IS NOT NULL), ' ') || CASE WHEN {_EVEN} THEN ', ' || split_part(word, ':', 1) ELSE '' END AS line FROM ({_STEMS}) WHERE word NOT LIKE '%~%' AND word NOT LIKE '%,%'")
def gold_strip_labels(spark, d):
    words = fx.vocab(spark, d).where("word NOT LIKE '%~%' AND word NOT LIKE '%,%'")
    return gold.serialise(gold.strip_labels(fx.gold(words, labelled=True)))


@_query("gold_union", f"WITH v AS ({_EN}), a AS (SELECT word, stem || ' ' || suf AS line FROM ({fx.stems_sql('SELECT * FROM v')}) WHERE suf <> 's'), b AS (SELECT word, stem || ' ' || suf AS line FROM ({_STEMS}) WHERE word NOT LIKE '%~%' AND word NOT LIKE '%:%') SELECT * FROM a UNION ALL SELECT * FROM b WHERE word IN (SELECT word FROM v) AND word NOT IN (SELECT word FROM a)")
def gold_union(spark, d):
    en = fx.vocab(spark, d, "en")
    first = fx.stems(en).where("suf <> 's'").select("word", F.array(F.array("stem", "suf")).alias("alts"))
    second = fx.stems(fx.vocab(spark, d)).where("word NOT LIKE '%~%' AND word NOT LIKE '%:%'").select("word", F.array(F.array(F.concat("stem", F.lit(":x")), F.lit("~"), F.concat("suf", F.lit(":+PL")))).alias("alts"))
    both = gold.union_gold(first, second, en)
    return both.select("word", F.array_join(F.col("alts")[0], " ").alias("line"))


@_query("gold_in_corpus", f"SELECT word, stem || ' ' || suf AS line FROM ({_STEMS}) WHERE word IN (SELECT word FROM ({_EN}))")
def gold_in_corpus(spark, d):
    kept = gold.in_vocabulary(fx.stems(fx.vocab(spark, d)), fx.vocab(spark, d, "en"))
    return kept.select("word", F.concat_ws(" ", "stem", "suf").alias("line"))


@_query("tab_corpus_gold", f"WITH v AS (SELECT DISTINCT unnest({_TOKENS.replace('text', 'lower(text)')}) AS word FROM ({_TAB_LINES})) SELECT word, stem || ' ' || suf AS line FROM ({_STEMS}) WHERE word NOT LIKE '%:%' AND word NOT LIKE '%~%' AND word IN (SELECT word FROM v)")
def tab_corpus_gold(spark, d):
    entries = fx.stems(fx.vocab(spark, d)).where("word NOT LIKE '%:%' AND word NOT LIKE '%~%'")
    entries = entries.select("word", F.array(F.array(F.concat("stem", F.lit(":N")), F.lit("~"), F.concat("suf", F.lit(":+PL")))).alias("alts"))
    _, kept = gold.evaluation_corpus(_tab_lines(spark, d).select(F.lower("line").alias("line")), entries)
    return kept.select("word", F.array_join(F.col("alts")[0], " ").alias("line"))


_KNOWN = f"SELECT word FROM ({fx.word_vectors_sql(_FR)})"


def _evaluation_data(spark, d):
    words = fx.vocab(spark, d)
    table = words.select(F.concat_ws(" ", "freq", "word").alias("line"))
    entries = fx.stems(words).where("word NOT LIKE '%:%' AND word NOT LIKE '%~%'").select("word", F.array(F.array(F.concat("stem", F.lit(":a")), F.concat("suf", F.lit(":b")))).alias("alts"))
    return gold.evaluation_data(table, entries, fx.word_vectors(spark, d, fx.vocab(spark, d, "fr")))


@_query("seg_eval_data", f"SELECT word, stem || ' ' || suf AS line FROM ({_STEMS}) WHERE word IN ({_KNOWN}) AND word NOT LIKE '%:%' AND word NOT LIKE '%~%'")
def seg_eval_data(spark, d):
    return _evaluation_data(spark, d)[1].select("word", F.array_join(F.col("alts")[0], " ").alias("line"))


@_query("seg_eval_lines", f"SELECT freq || ' ' || word AS line FROM ({_V}) WHERE word IN ({_KNOWN})")
def seg_eval_lines(spark, d):
    return _evaluation_data(spark, d)[0]


@_query("seg_eval_words", f"SELECT word FROM ({_V}) WHERE word IN ({_KNOWN})")
def seg_eval_words(spark, d):
    return _evaluation_data(spark, d)[2]


# --- boundaries --------------------------------------------------------------------


@_query("boundary_extract", f"SELECT word, length(stem)::VARCHAR AS offsets FROM ({_STEMS})")
def boundary_extract(spark, d):
    words = fx.vocab(spark, d)
    found = preseg.extract_boundaries(words, fx.presegs(words))
    return found.select("word", F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("offsets"))


def _bounds_sql(parts: str) -> str:
    return f"list_transform(range(1, len({parts})), lambda i: list_sum(list_transform({parts}[1:i], lambda x: length(x)))::BIGINT)"


def scores_sql(ctes: str, segs: str) -> str:
    """Best-alternative hits, insertions and deletions; ``segs``: word, parts."""
    return f"""{ctes}, g AS (SELECT word, idx, {_bounds_sql('alt')} AS want FROM ({fx.gold_alts_sql(_V)})),
    u AS (SELECT word, {_bounds_sql('parts')} AS sug FROM ({segs})),
    c AS (SELECT word, idx, len(list_intersect(sug, want)) AS h, len(sug) - len(list_intersect(sug, want)) AS i, len(want) - len(list_intersect(sug, want)) AS d FROM g JOIN u USING (word)),
    f AS (SELECT *, CASE WHEN 2 * h + i + d = 0 THEN 1 ELSE 2 * h / (2 * h + i + d) END AS f, CASE WHEN h + i = 0 THEN 1 ELSE h / (h + i) END AS p FROM c),
    best AS (SELECT word, h::BIGINT AS hits, i::BIGINT AS insertions, d::BIGINT AS deletions FROM f QUALIFY row_number() OVER (PARTITION BY word ORDER BY f DESC, p DESC, idx DESC) = 1)"""


_SCORES = scores_sql(bpe_sql(_V, MERGES), f"SELECT word, string_split(trim(seg), '  ') AS parts FROM s{MERGES}")
_RATES = "round(sum(hits) / (sum(hits) + sum(insertions)), 9) AS precision, round(sum(hits) / (sum(hits) + sum(deletions)), 9) AS recall, round(2 * sum(hits) / (2 * sum(hits) + sum(insertions) + sum(deletions)), 9) AS fmeasure"


def _scored(spark, d):
    words = fx.kept_vocab(spark, d)
    _, segs = bpe.learn_bpe(words, MERGES)
    return fx.gold(words), segs


@_query("boundary_scores", f"{_SCORES} SELECT * FROM best")
def boundary_scores(spark, d):
    return score.word_scores(*_scored(spark, d))


@_query("boundary_fmeasure", f"{_SCORES} SELECT count(*)::BIGINT AS evaluated, (SELECT count(*) FROM ({_STEMS}))::BIGINT AS gold_words, (SELECT count(*) FROM ({_V}))::BIGINT AS suggested_words, sum(hits)::BIGINT AS hits, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, {_RATES} FROM best")
def boundary_fmeasure(spark, d):
    told = score.report(*_scored(spark, d))
    return told.select("evaluated", "gold_words", "suggested_words", "hits", "insertions", "deletions", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "fmeasure")))


_CUTS = (0, 2, 4, 6)
_SWEEP = " UNION ALL ".join(f"SELECT {c} AS num_merges, word, string_split(trim(seg), '  ') AS parts FROM ({apply_sql(_PADDED.format('SELECT word FROM st'), c)})" for c in _CUTS)


@_query("merge_sweep", f"""{bpe_sql(_V, MERGES)}, st AS MATERIALIZED ({_STEMS}), g AS (SELECT word, idx, {_bounds_sql('alt')} AS want FROM (SELECT word, 0 AS idx, [stem, suf] AS alt FROM st UNION ALL SELECT word, 1, [word] FROM st WHERE {_EVEN})),
    u AS (SELECT num_merges, word, {_bounds_sql('parts')} AS sug FROM ({_SWEEP})),
    c AS (SELECT num_merges, word, idx, len(list_intersect(sug, want)) AS h, len(sug) - len(list_intersect(sug, want)) AS i, len(want) - len(list_intersect(sug, want)) AS d FROM g JOIN u USING (word)),
    f AS (SELECT *, CASE WHEN 2 * h + i + d = 0 THEN 1 ELSE 2 * h / (2 * h + i + d) END AS f, CASE WHEN h + i = 0 THEN 1 ELSE h / (h + i) END AS p FROM c),
    best AS (SELECT num_merges, word, h AS hits, i AS insertions, d AS deletions FROM f QUALIFY row_number() OVER (PARTITION BY num_merges, word ORDER BY f DESC, p DESC, idx DESC) = 1)
    SELECT num_merges, count(*)::BIGINT AS evaluated, {_RATES} FROM best GROUP BY num_merges""")
def merge_sweep(spark, d):
    words = fx.kept_vocab(spark, d)
    merges, _ = bpe.learn_bpe(words, MERGES)
    swept = score.merge_sweep(fx.gold(words), [(m.l, m.r) for m in merges], list(_CUTS))
    return swept.select("num_merges", "evaluated", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "fmeasure")))


# --- pre-segmentation -----------------------------------------------------------------


def _cascade_sql(words: str, rounds: int = 8) -> str:
    """CTEs w0..: the vocabulary after each round of giving frequencies to parts."""
    ctes = [f"v AS MATERIALIZED ({words})", f"cut AS MATERIALIZED ({fx.stems_sql('SELECT * FROM v')})", "w0 AS MATERIALIZED (SELECT word, freq FROM v)"]
    for k in range(rounds):
        ctes.append(f"m{k} AS MATERIALIZED (SELECT w.word, w.freq, stem, suf FROM w{k} w JOIN cut USING (word) WHERE w.freq <> 0)")
        ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT word, sum(freq)::BIGINT AS freq FROM (SELECT * FROM w{k} UNION ALL SELECT word, -freq FROM m{k} UNION ALL SELECT stem, freq FROM m{k} UNION ALL SELECT suf, freq FROM m{k}) GROUP BY word)")
    return "WITH " + ", ".join(ctes), f"w{rounds}"


_CASCADE, _LAST = _cascade_sql(_V)


@_query("preseg_vocab", f"{_CASCADE} SELECT * FROM {_LAST}")
def preseg_vocab(spark, d):
    words = fx.kept_vocab(spark, d)
    return preseg.apply_presegs(words, fx.presegs(words))


@_query("preseg_recover", f"""{_CASCADE}, {bpe_sql(f'SELECT * FROM {_LAST}', MERGES)[5:]}
    SELECT v.word, CASE WHEN cut.word IS NULL THEN replace(trim(own.seg), '  ', ' ') ELSE replace(trim(a.seg), '  ', ' ') || ' ' || replace(trim(b.seg), '  ', ' ') END AS seg
    FROM v LEFT JOIN cut USING (word) LEFT JOIN s{MERGES} own ON own.word = v.word LEFT JOIN s{MERGES} a ON a.word = cut.stem LEFT JOIN s{MERGES} b ON b.word = cut.suf""")
def preseg_recover(spark, d):
    words = fx.kept_vocab(spark, d)
    cut = fx.presegs(words)
    _, segs = bpe.learn_bpe(preseg.apply_presegs(words, cut), MERGES)
    return preseg.recover_presegs(words, cut, segs).select("word", _text().alias("seg"))


@_query("preseg_common", f"{bpe_sql(_V, MERGES)} SELECT c.word, stem || ' ' || suf AS preseg, replace(trim(seg), '  ', ' ') AS bpe_seg, c.freq FROM ({_STEMS}) c JOIN s{MERGES} USING (word) ORDER BY c.freq DESC, word LIMIT 200")
def preseg_common(spark, d):
    words = fx.kept_vocab(spark, d)
    _, segs = bpe.learn_bpe(words, MERGES)
    return preseg.common_presegs(words, fx.presegs(words), segs, segs, 200).select("word", "preseg", "bpe_seg", "freq")


@_query("drop_strings", "SELECT 's' AS kind, a.name AS long, b.name AS short, substring(a.name, k + 1) AS from_str, substring(b.name, k + 1) AS to_str FROM (SELECT p_name AS name FROM (SELECT DISTINCT n_name AS p_name FROM nation)) a, (SELECT DISTINCT n_name AS name FROM nation) b, LATERAL (SELECT coalesce(max(i), 0) AS k FROM range(1, 100) t(i) WHERE i <= length(b.name) AND left(a.name, i) = left(b.name, i)) WHERE length(a.name) > length(b.name)")
def affix_drop_strings(spark, d):
    names = fx.table(spark, d, "nation").select("n_name").distinct()  # a fixed table of 25 names: pairs of them are few
    pairs = names.select(F.col("n_name").alias("long")).join(names.select(F.col("n_name").alias("short")), F.expr("length(long) > length(short)"))
    cut = drop_strings(F.col("long"), F.col("short"), F.lit("s"))
    return pairs.select(F.lit("s").alias("kind"), "long", "short", cut[0].alias("from_str"), cut[1].alias("to_str"))


_RULE_ROWS = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(fx.RULES))
_EXAMPLES = f"""v AS MATERIALIZED ({_V}), vec AS MATERIALIZED ({fx.word_vectors_sql('SELECT * FROM v')}), r(ord, a, b) AS (VALUES {_RULE_ROWS}),
    ex AS (SELECT ord, a, b, v.word, o.word AS other, v.freq FROM r JOIN v ON ends_with(v.word, a) AND length(v.word) >= length(a) + 3 JOIN v o ON o.word = left(v.word, length(v.word) - length(a)) || b),
    top AS MATERIALIZED (SELECT * FROM ex WHERE length(a) <> length(b) QUALIFY row_number() OVER (PARTITION BY ord ORDER BY freq DESC, word, other) <= 3),
    shown AS (SELECT ord, CASE WHEN length(a) > length(b) THEN a ELSE b END AS lng, CASE WHEN length(a) > length(b) THEN b ELSE a END AS sht, CASE WHEN length(a) > length(b) THEN word ELSE other END AS lw, CASE WHEN length(a) > length(b) THEN other ELSE word END AS sw, freq FROM top),
    cutr AS (SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, 9) t(i) WHERE i <= length(sht) AND left(lng, i) = left(sht, i)) AS k FROM shown),
    dirs AS MATERIALIZED (SELECT substring(lng, k + 1) AS from_str, substring(sht, k + 1) AS to_str, ord, lw, sw, list_transform(range(1, 65), lambda i: s.vec[i] - l.vec[i]) AS dir FROM cutr JOIN vec l ON l.word = lw JOIN vec s ON s.word = sw),
    tr AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY length(to_str), seen) - 1)::INTEGER AS ord, from_str, to_str, n FROM (SELECT from_str, to_str, min(ord) AS seen, count(*) AS n FROM dirs GROUP BY 1, 2))"""


def _transforms(spark, d):
    words = fx.kept_vocab(spark, d)
    vecs = fx.word_vectors(spark, d, words)
    return words, vecs, preseg.transform_directions(fx.rules(spark, words), words, vecs)


@_query("transform_directions", f"WITH {_EXAMPLES} SELECT tr.ord, 's' AS kind, tr.from_str, tr.to_str, n::INTEGER AS n_dirs, round((SELECT sum(list_sum(dir)) FROM dirs WHERE dirs.from_str = tr.from_str AND dirs.to_str = tr.to_str), 6) AS total FROM tr")
def transform_directions(spark, d):
    _, _, found = _transforms(spark, d)
    total = F.aggregate(F.flatten("dirs"), F.lit(0.0), lambda a, x: a + x)
    return found.select("ord", "kind", "from_str", "to_str", F.size("dirs").alias("n_dirs"), F.round(total, 6).alias("total"))


_CANDIDATES = f"""WITH {_EXAMPLES}, cand AS MATERIALIZED (SELECT v.word, tr.ord, from_str, to_str, left(v.word, length(v.word) - length(from_str)) || to_str AS parent FROM v JOIN tr ON ends_with(v.word, from_str) AND length(v.word) > length(from_str) WHERE parent IN (SELECT word FROM v))"""


@_query("preseg_candidates", f"{_CANDIDATES} SELECT word, ord, 's' AS kind, from_str, parent FROM cand")
def preseg_candidates(spark, d):
    words, _, found = _transforms(spark, d)
    return preseg.candidates(words, found, words)


_BEST = f"""{_CANDIDATES}, cv AS (SELECT c.*, list_transform(range(1, 65), lambda i: p.vec[i] - w.vec[i]) AS x FROM cand c JOIN vec w ON w.word = c.word JOIN vec p ON p.word = c.parent),
    cs AS (SELECT cv.word, cv.ord, cv.from_str, cv.parent, max(CASE WHEN list_sum(list_transform(x, lambda q: q * q)) = 0 OR list_sum(list_transform(dir, lambda q: q * q)) = 0 THEN -2 ELSE list_cosine_similarity(x, dir) END) AS sim FROM cv JOIN dirs ON dirs.from_str = cv.from_str AND dirs.to_str = cv.to_str GROUP BY 1, 2, 3, 4),
    best AS (SELECT word, from_str, parent FROM cs WHERE sim > {{0}} QUALIFY row_number() OVER (PARTITION BY word ORDER BY ord) = 1)"""
THRESHOLD = 0.1


@_query("preseg_best", f"{_BEST.replace("{0}", str(THRESHOLD))} SELECT word, 's' AS kind, from_str, parent FROM best")
def preseg_best(spark, d):
    words, vecs, found = _transforms(spark, d)
    return preseg.best_transforms(words, found, words, vecs, THRESHOLD)


@_query("preseg_words", f"{_BEST.replace("{0}", str(THRESHOLD))} SELECT v.word, CASE WHEN from_str IS NULL THEN v.word ELSE left(v.word, length(v.word) - length(from_str)) || ' ' || from_str END AS parts FROM v LEFT JOIN best USING (word)")
def preseg_words(spark, d):
    words, vecs, found = _transforms(spark, d)
    return preseg.compute_presegs(words, found, words, vecs, THRESHOLD).select("word", _text().alias("parts"))


def _propagated_sql(generations: int = 6) -> str:
    """CTEs g0..: words by generation of their derivation, with the splits they hand on; one step for each split met."""
    own = "[{'place': 0, 'affix': b.from_str}]"
    parts = "[left(b.word, length(b.word) - length(b.from_str)), b.from_str]"
    ctes = [f"g0 AS MATERIALIZED (SELECT b.word, {parts} AS parts, {own} AS sent FROM best b WHERE parent NOT IN (SELECT word FROM best))"]
    for k in range(1, generations):
        rows = f"SELECT b.word, {parts} AS parts, p.sent AS met, {own} AS sent FROM best b JOIN g{k - 1} p ON p.word = b.parent"
        for e in range(1, k + 1):
            part, affix, at = "parts[c.place + 1]", "c.affix", "c.place"
            fits = f"coalesce(c.place < len(sent) AND length({part}) > length({affix}) AND ends_with({part}, {affix}), false)"
            cut = f"list_concat(list_concat(parts[1:{at}], [left({part}, length({part}) - length({affix})), {affix}]), parts[{at} + 2:])"
            rows = f"SELECT word, CASE WHEN {fits} THEN {cut} ELSE parts END AS parts, met, CASE WHEN {fits} THEN list_append(sent, {{'place': {at}, 'affix': {affix}}}) ELSE sent END AS sent FROM (SELECT *, met[{e}] AS c FROM ({rows}))"
        ctes.append(f"g{k} AS MATERIALIZED (SELECT word, parts, sent FROM ({rows}))")
    every = " UNION ALL ".join(f"SELECT word, array_to_string(parts, ' ') AS parts FROM g{k}" for k in range(generations))
    return f"{_BEST.replace('{0}', str(THRESHOLD))}, {', '.join(ctes)} SELECT word, word AS parts FROM v WHERE word NOT IN (SELECT word FROM best) UNION ALL {every}"


@_query("preseg_propagated", _propagated_sql())
def preseg_propagated(spark, d):
    words, vecs, found = _transforms(spark, d)
    return preseg.compute_presegs(words, found, words, vecs, THRESHOLD, propagate=True).select("word", _text().alias("parts"))


# --- n-gram models -----------------------------------------------------------------------

N = 2


def _windows_sql(rows: str, key: str = "freq") -> str:
    """ctx, sym, n of rows (p: parts, freq)."""
    return f"SELECT w[1] AS ctx, w[2] AS sym, {key} FROM (SELECT *, unnest(list_transform(range(1, len(p) + {N + 1}), lambda i: [array_to_string(q[i:i + {N - 1}], ' '), q[i + {N}]])) AS w FROM (SELECT *, list_concat(list_concat(['', ''], p), ['', '']) AS q FROM ({rows})))"


def counts_sql(rows: str) -> str:
    return f"SELECT ctx, sym, sum(freq)::BIGINT AS n FROM ({_windows_sql(rows)}) GROUP BY 1, 2"


_SEG0 = f"SELECT word, freq, string_split(word, '') AS p FROM ({_V})"


def _chars(spark, d):
    return fx.vocab(spark, d).select("word", "freq", F.split("word", "").alias("parts"))


@_query("ngram_counts", counts_sql(_SEG0))
def ngram_counts(spark, d):
    return lm.ngram_counts(_chars(spark, d), N)


_RUNNING = f"""SELECT ctx, sym, count(*)::BIGINT AS n FROM (SELECT coalesce(lag(c, 2) OVER w, '') || ' ' || coalesce(lag(c, 1) OVER w, '') AS ctx, c AS sym FROM (
    SELECT doc_id, at0, k, c FROM (SELECT doc_id, at0, generate_subscripts(cs, 1) AS k, unnest(cs) AS c FROM (SELECT doc_id, at0, string_split(w, '') AS cs FROM (SELECT doc_id, generate_subscripts(ws, 1) AS at0, unnest(ws) AS w FROM (SELECT doc_id, {_TOKENS} AS ws FROM documents))))
    UNION ALL SELECT doc_id, 1000000000, k, '' FROM documents, range(1, 3) t(k) WHERE len({_TOKENS}) > 0) WINDOW w AS (PARTITION BY doc_id ORDER BY at0, k)) GROUP BY 1, 2"""


@_query("ngram_counts_corpus", _RUNNING)
def ngram_counts_corpus(spark, d):
    return lm.corpus_ngram_counts(fx.documents(spark, d), N)


@_query("corpus_loglik", f"WITH c AS ({counts_sql(_SEG0)}), b AS (SELECT ctx, sum(n) AS base FROM c GROUP BY ctx) SELECT round(sum(n * ln(n / base)), 2) AS loglik FROM c JOIN b USING (ctx)")
def corpus_loglik(spark, d):
    return lm.log_likelihood(lm.ngram_counts(_chars(spark, d), N)).select(F.round("loglik", 2).alias("loglik"))


def _loglik_sql(rows: str) -> str:
    return f"SELECT sum(n * ln(n / base)) AS ll FROM (SELECT n, sum(n) OVER (PARTITION BY ctx) AS base FROM ({counts_sql(rows)}))"


CANDIDATES = 40
LM_MERGES = 3


def lm_sql(words: str, n: int) -> str:
    """CTEs: ``t_k`` the candidates before the k-th merge and ``d_k`` their changes, from counting all words anew for each; ``b_k`` the merge; ``s_k`` as in ``bpe_sql``."""
    ctes = [f"s0 AS MATERIALIZED (SELECT word, freq, ' ' || array_to_string(string_split(word, ''), '  ') || ' ' AS seg FROM ({words}))"]
    for k in range(n):
        pairs = _PAIRS.format(seg="trim(seg)", by="  ", rows=f"s{k}")
        merged = f"SELECT l, r, s.freq, string_split(trim(replace(seg, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' ')), '  ') AS p FROM s{k} s, t{k}"
        counts = f"SELECT l, r, ctx, sum(freq)::BIGINT AS n FROM ({_windows_sql(merged, 'l, r, freq')}) GROUP BY l, r, ctx, sym"
        ctes.append(f"t{k} AS MATERIALIZED (SELECT * FROM ({pairs}) ORDER BY freq DESC, l, r LIMIT {CANDIDATES})")
        now = f"SELECT freq, string_split(trim(seg), '  ') AS p FROM s{k}"
        ctes.append(f"o{k} AS MATERIALIZED ({_loglik_sql(now)})")
        ctes.append(f"d{k} AS MATERIALIZED (SELECT l, r, a.ll - o{k}.ll AS delta FROM (SELECT l, r, sum(n * ln(n / base)) AS ll FROM (SELECT l, r, n, sum(n) OVER (PARTITION BY l, r, ctx) AS base FROM ({counts})) GROUP BY l, r) a, o{k})")
        ctes.append(f"b{k} AS MATERIALIZED (SELECT {k} AS rank, l, r, freq FROM d{k} JOIN t{k} USING (l, r) ORDER BY round(delta, 6) DESC, freq DESC, l, r LIMIT 1)")
        ctes.append(f"s{k + 1} AS MATERIALIZED (SELECT word, s.freq, replace(seg, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' ') AS seg FROM s{k} s, b{k})")
    return "WITH " + ", ".join(ctes)


@_query("merge_deltas", f"{lm_sql(_V, 1)} SELECT l, r, round(delta, 2) AS delta FROM d0")
def merge_deltas(spark, d):
    segs = bpe.initial_segmentation(fx.kept_vocab(spark, d))
    top = bpe.top_pairs(bpe.pair_statistics(segs.select("freq", symbols(F.col("seg")).alias("parts"))), CANDIDATES)
    return lm.merge_deltas(segs, N, top).select("l", "r", F.round("delta", 2).alias("delta"))


@_query("lm_train", f"{lm_sql(_V, LM_MERGES)} {merges_sql(LM_MERGES)}")
def lm_train(spark, d):
    merges, _, _ = lm.learn_lm(fx.vocab(spark, d), LM_MERGES, N, CANDIDATES)
    return bpe.merges_frame(spark, merges)


@_query("corpus_merge_deltas")  # every pair of the running text: too much for SQL, tests compare with counting anew
def corpus_merge_deltas(spark, d):
    return lm.corpus_merge_deltas(fx.documents(spark, d), N).select("l", "r", F.round("delta", 2).alias("delta"))


_TRAINED = f"""{bpe_sql(_EN, MERGES)}, t AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) AS at0, unnest(ws) AS w FROM (SELECT doc_id, line_no, {_TOKENS} AS ws FROM ({_LINES.replace('FROM documents', "FROM documents WHERE lang = 'fr'")}))),
    a AS MATERIALIZED ({apply_sql(_PADDED.format(_FR), MERGES)}), j AS (SELECT doc_id, line_no, string_agg(replace(trim(seg), '  ', '@@ '), ' ' ORDER BY at0) AS text FROM t JOIN a ON a.word = w GROUP BY 1, 2)
    SELECT l.doc_id, l.line_no, coalesce(j.text, '') AS text FROM ({_LINES.replace('FROM documents', "FROM documents WHERE lang = 'fr'")}) l LEFT JOIN j ON j.doc_id = l.doc_id AND j.line_no = l.line_no"""


@_query("train_and_apply", _TRAINED)
def train_and_apply(spark, d):
    from .pipelines import train_and_apply as run

    french = vocab.corpus_lines(fx.documents(spark, d, "fr"))
    return run(fx.documents(spark, d, "en"), french, MERGES)[2]


@_query("segmentation_diff", f"""{_CASCADE}, {bpe_sql('SELECT * FROM v', MERGES)[5:]}, {bpe_sql(f'SELECT * FROM {_LAST}', MERGES, prefix='m')[5:]},
    o AS (SELECT v.word, CASE WHEN cut.word IS NULL THEN replace(trim(own.seg), '  ', ' ') ELSE replace(trim(a.seg), '  ', ' ') || ' ' || replace(trim(b.seg), '  ', ' ') END AS other
    FROM v LEFT JOIN cut USING (word) LEFT JOIN ms{MERGES} own ON own.word = v.word LEFT JOIN ms{MERGES} a ON a.word = cut.stem LEFT JOIN ms{MERGES} b ON b.word = cut.suf)
    SELECT word, replace(trim(seg), '  ', ' ') AS base, other FROM o JOIN s{MERGES} USING (word) WHERE replace(trim(seg), '  ', ' ') <> other""")
def segmentation_diff(spark, d):
    from .pipelines import base_and_morpho

    words = fx.kept_vocab(spark, d)
    return base_and_morpho(words, fx.presegs(words), MERGES)[2]


# --- vectors -----------------------------------------------------------------------------


@_query("vector_parse", "SELECT 'v' || vec_id || label AS word, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN abs(x) < 0.05 THEN 0 ELSE x END)), 6) AS total FROM embeddings")
def vector_parse(spark, d):
    told = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < 0.05, ".").otherwise(x.cast("string")))
    lines = fx.table(spark, d, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("v"), F.col("vec_id")), "label", F.array_join(told, " ")).alias("line"))
    parsed = vectors.parse_vectors(lines, fx.DIM)
    return parsed.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@_query("vector_mean", "SELECT (i - 1)::INTEGER AS at, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i")
def vector_mean(spark, d):
    mean = vectors.mean_vector(fx.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec")))
    return mean.select(F.posexplode("vec").alias("at", "mean")).select("at", F.round("mean", 6).alias("mean"))


@_query("oov_impute")
def oov_impute(spark, d):
    needed = vocab.vocabulary(fx.table(spark, d, "benchmark"))
    known = fx.vocab(spark, d, "fr")
    vecs = known.select("word", F.array(F.col("freq").cast("double"), F.length("word").cast("double")).alias("vec"))
    return vectors.impute_vectors(needed, vecs, known).select("word", "source")


# --- parallel texts ------------------------------------------------------------------------

def _count_sql(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '{WHITESPACE}'), lambda w: w <> ''))"


@_query("parallel_prune", f"SELECT conv_id, turn, base_src, base_tgt FROM (SELECT conv_id, turn, text AS base_src, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS base_tgt FROM conversations) WHERE {_count_sql('base_src')} < 60 AND {_count_sql('base_tgt')} < 60 AND {_count_sql('lower(base_src)')} < 60")
def parallel_prune(spark, d):
    talk = fx.table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("base_tgt"))
    sides = talk.withColumnRenamed("text", "base_src").join(after, ["conv_id", "turn"], "left")
    sides = sides.withColumns({"morpho_src": F.lower("base_src"), "morpho_tgt": F.col("base_tgt")})
    return gold.prune_parallel(sides, 60).select("conv_id", "turn", "base_src", "base_tgt")

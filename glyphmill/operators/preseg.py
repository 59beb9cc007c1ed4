"""Pre-segmentation: affix rules from examples and vectors, their application, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import boundaries, cosine, drop_strings, subtract
from ..session import scratch

RULES_SCHEMA = "array<struct<rule:struct<`from`:string,`to`:string,kind:string>,transformations:array<struct<cosine:string,rule:struct<input:string,output:string>>>>>"


# --- pre-segmentations on vocabularies ----------------------------------------


def extract_boundaries(vocab: DataFrame, presegs: DataFrame) -> DataFrame:
    """word, offsets of the inner boundaries of pre-segmented words of the vocabulary."""
    cut = presegs.where(F.size("parts") > 1).join(vocab.select("word"), "word", "left_semi")
    return cut.select("word", boundaries(F.col("parts")).alias("offsets"))


def _refuse_cycles(cut: DataFrame) -> None:
    """Raise where a word's parts lead back to it: such frequencies would go round for ever."""
    steps = cut.select("word", F.explode("parts").alias("part"))
    if steps.where("length(part) >= length(word)").isEmpty():
        return  # parts shorter than their words can't lead back
    steps = scratch(steps.join(cut.select(F.col("word").alias("part")), "part", "left_semi").distinct(), "steps")
    before = -1
    while (left := steps.count()) not in (0, before):
        steps, before = scratch(steps.join(steps.select(F.col("word").alias("part")), "part", "left_semi"), "steps"), left
    if left:
        raise ValueError(f"pre-segmentations lead back to their own word, one of them {steps.agg(F.min('word')).first()[0]!r}")


def apply_presegs(vocab: DataFrame, presegs: DataFrame, drop_zero: bool = False) -> DataFrame:
    """The vocabulary after pre-segmented words have given their frequency to their parts.

    Parts that are pre-segmented words pass it on, until none holds any; a cycle among them is an error.  Pre-segmented
    words that held a frequency stay with 0 unless ``drop_zero``.  Only the moving words take part in a round; the
    vocabulary is regrouped once.
    """
    cut = presegs.where(F.size("parts") > 1).select("word", "parts")
    _refuse_cycles(cut)
    moving = scratch(vocab.where("freq <> 0").join(cut, "word").select("word", "freq", "parts"), "moving")
    changes = None
    while not moving.isEmpty():
        into = scratch(moving.select(F.explode("parts").alias("word"), "freq").groupBy("word").agg(F.sum("freq").alias("freq")), "into")
        round_ = moving.select("word", (-F.col("freq")).alias("freq")).unionByName(into)
        changes = round_ if changes is None else changes.unionByName(round_)
        moving = scratch(into.where("freq <> 0").join(cut, "word").select("word", "freq", "parts"), "moving")
    held = vocab.select("word", "freq")
    now = held if changes is None else held.unionByName(changes).groupBy("word").agg(F.sum("freq").alias("freq"))
    return now.where("freq <> 0") if drop_zero else now


def recover_presegs(vocab: DataFrame, presegs: DataFrame, segs: DataFrame, missing: str = "error") -> DataFrame:
    """word, parts of the original vocabulary: a pre-segmented word's parts' segmentations one after another, else its own.

    ``missing``: error, or keep (a part without a segmentation stays whole).
    """
    parts = vocab.select("word").join(presegs.select("word", F.col("parts").alias("_pre")), "word", "left")
    rows = parts.select("word", F.posexplode(F.coalesce("_pre", F.array("word"))).alias("_at", "_part"))
    found = rows.join(segs.select(F.col("word").alias("_part"), F.col("parts").alias("_seg")), "_part", "left")
    absent = F.array("_part") if missing == "keep" else F.raise_error(F.concat(F.lit("no segmentation for "), F.col("_part")))
    each = found.select("word", F.struct("_at", F.coalesce("_seg", absent).alias("_seg")).alias("s"))
    return each.groupBy("word").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["_seg"])).alias("parts"))


def common_presegs(vocab: DataFrame, presegs: DataFrame, base: DataFrame, morpho: DataFrame, k: int) -> DataFrame:
    """The k most frequent pre-segmented words (ties by word) with both segmentations; words out of the vocabulary count 0."""
    cut = presegs.where(F.size("parts") > 1).select("word", F.array_join("parts", " ").alias("preseg"))
    freq = cut.join(vocab, "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    top = freq.orderBy(F.desc("freq"), "word").limit(k)
    told = lambda df, name: df.select("word", F.array_join("parts", " ").alias(name))
    return top.join(told(base, "bpe_seg"), "word", "left").join(told(morpho, "morpho_seg"), "word", "left").select("word", "preseg", "bpe_seg", "morpho_seg", "freq")


# --- rules ---------------------------------------------------------------------


def rule_entries(rules: DataFrame) -> DataFrame:
    """Entries (entry, kind, long, short, examples) from ``ord``, ``rule``, ``transformations``.

    Entries without examples or with sides of equal length go; the longer side becomes ``long``, and the examples'
    inputs and outputs follow it.
    """
    kept = rules.where("transformations IS NOT NULL AND length(rule.`from`) <> length(rule.`to`)")
    longer = F.length("rule.from") > F.length("rule.to")
    turned = F.transform("transformations", lambda t: F.struct(F.when(longer, t["rule"]["input"]).otherwise(t["rule"]["output"]).alias("long"), F.when(longer, t["rule"]["output"]).otherwise(t["rule"]["input"]).alias("short"), t["cosine"].cast("double").alias("cosine")))
    return kept.select(F.col("ord").alias("entry"), F.col("rule.kind").alias("kind"), F.when(longer, F.col("rule.from")).otherwise(F.col("rule.to")).alias("long"), F.when(longer, F.col("rule.to")).otherwise(F.col("rule.from")).alias("short"), turned.alias("examples"))


def transform_directions(rules: DataFrame, vocab: DataFrame, vectors: DataFrame, num_examples: int | None = None) -> DataFrame:
    """ord, kind, from_str, to_str, dirs: generalised affix rules with their example directions, in the order they are tried.

    Examples count when both words are in the vocabulary; the ``num_examples`` of highest cosine stay per entry; their
    directions (vector of the shorter word minus that of the longer) are pooled over entries with equal rules.  Rules
    are tried by the length of ``to_str``, then in first-seen order of kind, from and to.
    """
    entries = rule_entries(rules)
    from_str, to_str = drop_strings(F.col("long"), F.col("short"), F.col("kind"))
    entries = entries.select("entry", "kind", from_str.alias("from_str"), to_str.alias("to_str"), "examples")
    each = entries.select("entry", "kind", "from_str", "to_str", F.posexplode("examples").alias("no", "e"))
    each = each.select("entry", "kind", "from_str", "to_str", "no", F.col("e.long").alias("lw"), F.col("e.short").alias("sw"), F.col("e.cosine").alias("cosine"))
    known = vocab.select("word")
    valid = each.join(known.withColumnRenamed("word", "lw"), "lw", "left_semi").join(known.withColumnRenamed("word", "sw"), "sw", "left_semi")
    if num_examples is not None:
        valid = valid.withColumn("_n", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("cosine"), "no"))).where(F.col("_n") <= num_examples).drop("_n")
    valid = valid.join(vectors.select(F.col("word").alias("lw"), F.col("vec").alias("lv")), "lw").join(vectors.select(F.col("word").alias("sw"), F.col("vec").alias("sv")), "sw")
    dirs = F.transform(F.array_sort(F.collect_list(F.struct("entry", (-F.col("cosine")).alias("c"), "no", subtract(F.col("sv"), F.col("lv")).alias("d")))), lambda x: x["d"])
    pooled = valid.groupBy("kind", "from_str", "to_str").agg(F.min(F.struct("entry", "no")).alias("seen"), dirs.alias("dirs"))
    # the rules are few: their order may come from one window
    kind_first, from_first = Window.partitionBy("kind"), Window.partitionBy("kind", "from_str")
    ranked = pooled.withColumn("_k", F.min("seen").over(kind_first)).withColumn("_f", F.min("seen").over(from_first))
    order = Window.orderBy(F.length("to_str"), "_k", "_f", "seen", "kind", "from_str", "to_str")
    return scratch(ranked.select((F.row_number().over(order) - 1).alias("ord"), "kind", "from_str", "to_str", "dirs"), "rules")


def candidates(words: DataFrame, transforms: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, ord, kind, from_str, parent: each word's rewritings by a rule that are in the vocabulary.

    Words meet rules by their affixes: an equi-join on (suffix or not, affix) with the rules, which are few, so that the
    affixes of all words need not be shuffled.
    """
    inner = F.when(F.length("word") > 1, F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    affixes = words.select("word", F.explode(inner).alias("i")).select("word", F.explode(F.array(F.struct(F.lit(True).alias("suffix"), F.expr("right(word, i)").alias("affix")), F.struct(F.lit(False).alias("suffix"), F.expr("left(word, i)").alias("affix")))).alias("a"))
    rules = transforms.select("ord", "kind", "from_str", "to_str", (F.col("kind") == "s").alias("_suffix"))
    met = affixes.join(F.broadcast(rules), (F.col("a.affix") == F.col("from_str")) & (F.col("a.suffix") == F.col("_suffix")))
    stem = F.when(F.col("kind") == "s", F.concat(F.expr("left(word, length(word) - length(from_str))"), "to_str")).otherwise(F.concat("to_str", F.expr("right(word, length(word) - length(from_str))")))
    return met.select("word", "ord", "kind", "from_str", stem.alias("parent")).join(vocab.select(F.col("word").alias("parent")), "parent", "left_semi").select("word", "ord", "kind", "from_str", "parent")


def _passes(threshold: float) -> Column:
    return F.exists("dirs", lambda d: F.coalesce(cosine(subtract(F.col("pv"), F.col("wv")), d) > threshold, F.lit(False)))


def best_transforms(words: DataFrame, transforms: DataFrame, vocab: DataFrame, vectors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """word, kind, from_str, parent: the first rule that yields a known word in a direction like one of its examples'."""
    found = scratch(candidates(words, transforms, vocab), "met")
    # only vectors of words that meet a rule, and of their parents, travel
    vec = lambda c, name: vectors.join(found.select(F.col(c).alias("word")), "word", "left_semi").select(F.col("word").alias(c), F.col("vec").alias(name))
    found = found.join(vec("word", "wv"), "word").join(vec("parent", "pv"), "parent")
    found = found.join(F.broadcast(transforms.select("ord", "dirs")), "ord").where(_passes(threshold))
    first = found.groupBy("word").agg(F.min_by(F.struct("kind", "from_str", "parent"), "ord").alias("t"))
    return first.select("word", "t.kind", "t.from_str", "t.parent")


def compute_presegs(targets: DataFrame, transforms: DataFrame, vocab: DataFrame, vectors: DataFrame, threshold: float = 0.5, spell_change: bool = False, propagate: bool = False) -> DataFrame:
    """word, parts for every target word: [stem, suffix], [prefix, stem] or the word itself.

    ``spell_change``: the stem is the parent word rather than what is left of the word.  ``propagate``: see
    ``propagated``.
    """
    best = best_transforms(targets, transforms, vocab, vectors, threshold)
    stem = F.when(F.lit(spell_change), F.col("parent")).when(F.col("kind") == "s", F.expr("left(word, length(word) - length(from_str))")).otherwise(F.expr("right(word, length(word) - length(from_str))"))
    parts = F.when(F.col("kind") == "s", F.array(stem, "from_str")).otherwise(F.array("from_str", stem))
    cut = best.select("word", "kind", "from_str", "parent", parts.alias("parts"))
    nodes = targets.select("word").join(cut, "word", "left").withColumn("parts", F.coalesce("parts", F.array("word")))
    return propagated(nodes) if propagate else nodes.select("word", "parts")


SENT = "array<struct<place:int,affix:string,suffix:boolean>>"


def _carried() -> Column:
    """What the splits in ``met`` do to ``parts``: struct<parts, taken>, the taken ones with their new place.

    A parent's part number k is the word's part number ``lead`` + k, and only as far as the parent's parts have been
    split off in the word as well: its first part, and one more for each split taken.
    """
    state = f"struct<parts:array<string>,taken:{SENT}>"
    part = "acc.parts[lead + x.place]"
    fits = f"x.place <= size(acc.taken) AND length({part}) > length(x.affix) AND CASE WHEN x.suffix THEN endswith({part}, x.affix) ELSE startswith({part}, x.affix) END"
    halves = f"CASE WHEN x.suffix THEN array(left({part}, length({part}) - length(x.affix)), x.affix) ELSE array(x.affix, right({part}, length({part}) - length(x.affix))) END"
    after = f"concat(slice(acc.parts, 1, lead + x.place), {halves}, slice(acc.parts, lead + x.place + 2, size(acc.parts)))"
    sent = f"concat(acc.taken, CAST(array(named_struct('place', lead + x.place, 'affix', x.affix, 'suffix', x.suffix)) AS {SENT}))"
    return F.expr(f"""aggregate(met, CAST(named_struct('parts', parts, 'taken', array()) AS {state}),
        (acc, x) -> CASE WHEN {fits} THEN CAST(named_struct('parts', {after}, 'taken', {sent}) AS {state}) ELSE acc END)""")


def propagated(nodes: DataFrame) -> DataFrame:
    """word, parts after every split has been carried to the words derived from the split word (word, parent, kind, from_str, parts).

    Derivations are worked off generation by generation, an equi-join of words with their parents each: a word meets its
    parent's own split and then those that reached the parent, in their order, and hands on those that it takes.  A parent is
    shorter than its words, so that there are no more generations than letters in the longest word.
    """
    split = scratch(nodes.where("parent IS NOT NULL").select("word", "parent", "kind", "from_str", "parts"), "derived")
    suffix = F.col("kind") == "s"
    own = F.array(F.struct(F.lit(0).alias("place"), F.col("from_str").alias("affix"), suffix.alias("suffix"))).cast(SENT)
    first = split.join(split.select(F.col("word").alias("parent")), "parent", "left_anti").withColumn("met", F.array().cast(SENT))
    out, now = nodes.where("parent IS NULL").select("word", "parts"), first
    while True:
        done = now.withColumn("lead", F.when(suffix, 0).otherwise(1)).withColumn("c", _carried())
        done = scratch(done.select("word", F.col("c.parts").alias("parts"), F.concat(own, "c.taken").alias("sent")), "generation")
        if done.isEmpty():
            return out
        out = out.unionByName(done.select("word", "parts"))
        now = split.join(done.select(F.col("word").alias("parent"), F.col("sent").alias("met")), "parent")

"""Composed runs: train on one corpus, apply to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bpe import Merge, apply_merges, delimit_corpus, delimit_with_merges, learn_bpe, segmentation_diff
from ..operators.preseg import apply_presegs, recover_presegs
from ..operators.vocab import kept, vocabulary


def train_and_apply(train: DataFrame, corpus: DataFrame, n_merges: int, presegs: DataFrame | None = None, ignore_case: bool = False, keys: tuple[str, ...] = ("doc_id", "line_no"), text: str = "text") -> tuple[list[Merge], DataFrame, DataFrame]:
    """Merges from ``train``, and ``corpus``'s segmentations and rewritten lines."""
    trained, seen = vocabulary(train, text, ignore_case), vocabulary(corpus, text, ignore_case)
    if presegs is not None:
        trained = apply_presegs(trained, presegs, drop_zero=True)
    merges, _ = learn_bpe(trained, n_merges)
    pairs = [(m.l, m.r) for m in merges]
    if presegs is None:
        return merges, apply_merges(seen, pairs), delimit_with_merges(corpus, pairs, keys, text, restore_case=ignore_case)
    seen = kept(seen)
    segs = recover_presegs(seen, presegs, apply_merges(apply_presegs(seen, presegs), pairs))
    return merges, segs, delimit_corpus(corpus, segs, keys, text, restore_case=ignore_case)


def base_and_morpho(vocab: DataFrame, presegs: DataFrame, n_merges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segmentations without and with pre-segmentation, and the words they cut differently."""
    _, base = learn_bpe(vocab, n_merges)
    _, cut = learn_bpe(apply_presegs(vocab, presegs), n_merges)  # words of frequency 0 are segmented too, and count for nothing
    morpho = recover_presegs(vocab, presegs, cut.select("word", "parts"))
    return base.select("word", "parts"), morpho, segmentation_diff(base, morpho.withColumn("freq", F.lit(0)))

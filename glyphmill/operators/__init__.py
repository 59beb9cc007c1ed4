"""Operators on corpora, vocabularies, segmentations, vectors and gold standards."""

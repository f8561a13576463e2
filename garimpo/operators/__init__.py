"""Corpus operators: cleaning, segmentation, vectors, answers, reports."""

"""Whole jobs: derived corpora, the seed sweep, the callable runs."""

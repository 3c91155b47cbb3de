"""Brute-force versions that several tests share."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_decontaminate_toxicity_lines import brute_leaks, brute_lines  # noqa: E402
from test_jaccard_join import brute  # noqa: E402


def lines_of(rows):
    return brute_lines(rows)[0]


def components_of(rows):
    return {d: c for d, _, c in brute(rows)}


def leaks_of(text, items):
    return brute_leaks([(0, text)], items)

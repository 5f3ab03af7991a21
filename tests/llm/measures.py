"""Measures of classifiers."""

from __future__ import annotations

import numpy as np


def auc(pairs: list[tuple[float, int]]) -> float:
    """Share of (label 1, label 0) pairs that the scores put in order."""
    score, label = np.array([s for s, _ in pairs]), np.array([v for _, v in pairs])
    good, bad = score[label == 1], score[label == 0]
    return float(((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2)

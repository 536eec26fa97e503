"""The best rows of many questions, kept while rows pass in batches."""

from __future__ import annotations

import numpy as np

#: Results are ordered by values rounded to six places; what may still change places by that is kept.
ROUNDED = 1.01e-6


class Best:
    """The ``k`` least values of each of ``n`` questions, and all within ``slack`` above the last of them.

    Of rows with one and the same value those with the ``k`` least ``tie`` stay, as these come first in any case.
    ``bound`` is, for each question, what a value must not exceed to matter.
    """

    def __init__(self, n: int, k: int, slack: float | np.ndarray = ROUNDED):
        self.k, self.slack = k, np.broadcast_to(slack, n)
        self.bound = np.full(n, np.inf)
        self.columns: list[np.ndarray] | None = None

    def add(self, question: np.ndarray, value: np.ndarray, tie: np.ndarray, *more: np.ndarray) -> None:
        """Rows of a batch; ``more`` are columns that go with them."""
        if not len(question):
            return
        new = [question, value, tie, *more]
        columns = [np.concatenate(c) for c in zip(self.columns, new)] if self.columns else new
        order = np.lexsort((columns[2], columns[1], columns[0]))
        question, value = columns[0][order], columns[1][order]
        at = np.arange(len(order))
        first = np.searchsorted(question, question)
        last = at - first == self.k - 1
        self.bound[question[last]] = value[last] + self.slack[question[last]]
        starts = np.ones(len(order), bool)
        starts[1:] = (question[1:] != question[:-1]) | (value[1:] != value[:-1])
        alike = at - np.maximum.accumulate(np.where(starts, at, 0))
        keep = order[(alike < self.k) & (value <= self.bound[question])]
        self.columns = [c[keep] for c in columns]

"""Plug-in models.  A model is any picklable object with the methods below; it is
loaded once per Python worker and sees Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np


class Scorer(Protocol):
    name: str
    labels: Sequence[str]

    def load(self) -> Callable[[list[str]], np.ndarray]:
        """A function from texts to a (rows x labels) array of probabilities."""


class Translator(Protocol):
    name: str

    def load(self) -> Callable[[str], str]:
        """A function from one text to its rewrite."""


class CountingScorer:
    """Deterministic stand-in: probabilities from how often two words occur."""

    name = "counting-scorer"
    labels = ("positive", "negative", "neutral")

    def __init__(self, up: str = "strong", down: str = "risk"):
        self.up, self.down = up, down

    def load(self) -> Callable[[list[str]], np.ndarray]:
        def predict(texts: list[str]) -> np.ndarray:
            up = np.array([1.0 + 2.0 * t.count(self.up) for t in texts])
            down = np.array([1.0 + 2.0 * t.count(self.down) for t in texts])
            rest = np.full(len(texts), 1.5)
            return np.stack([up, down, rest], axis=1) / (up + down + rest)[:, None]

        return predict


class TaggingTranslator:
    """Deterministic stand-in: marks the text; fails on texts holding ``fail_on``."""

    name = "tagging-translator"

    def __init__(self, fail_on: str | None = None):
        self.fail_on = fail_on

    def load(self) -> Callable[[str], str]:
        def rewrite(text: str) -> str:
            if self.fail_on and self.fail_on in text:
                raise ValueError("cannot rewrite")
            return f"[en] {text}"

        return rewrite

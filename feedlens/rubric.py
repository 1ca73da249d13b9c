"""Rubric definitions: label names, Likert maxima, which labels flip polarity.

Fixed values (must equal the source behaviour for equal results):
  binary labels, in order:  incorrect, reveal, suggestions, misconceptions, positive
  Likert labels, in order:  accurate, reveal, suggestions, misconceptions, positive
  Likert names in replies:  Accuracy, Revealing, Suggestions, Misconception, Positive
  Likert maximum scores:    2, 2, 3, 3, 3
  labels flipped for scoring (binary): incorrect -> correct, reveal
  shuffle seed: 221
"""

from __future__ import annotations

from dataclasses import dataclass, field

BINARY_LABELS = ["incorrect", "reveal", "suggestions", "misconceptions", "positive"]
LIKERT_LABELS = ["accurate", "reveal", "suggestions", "misconceptions", "positive"]
LIKERT_NAMES = ["Accuracy", "Revealing", "Suggestions", "Misconception", "Positive"]
LIKERT_MAX_SCORES = [2, 2, 3, 3, 3]
SEED = 221

# Flipped label names: after flipping, label 0 is "correct" (binary mode).
FLIPPED_LABELS = ["correct", "reveal", "suggestions", "misconceptions", "positive"]

METHODS = ["knn", "random", "zs", "gold"]  # order of the compiled method tables


@dataclass(frozen=True)
class Rubric:
    labels: list[str] = field(default_factory=lambda: list(BINARY_LABELS))
    max_scores: list[int] | None = None
    flip: tuple[str, ...] = ("incorrect", "reveal")
    mode: str = "bin"

    @property
    def scored_labels(self) -> list[str]:
        """Label names after polarity flips (``incorrect`` becomes ``correct``)."""
        return ["correct" if (l == "incorrect" and l in self.flip) else l for l in self.labels]


BINARY = Rubric()
LIKERT = Rubric(labels=list(LIKERT_LABELS), max_scores=list(LIKERT_MAX_SCORES), flip=(), mode="lik")

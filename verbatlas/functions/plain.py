"""The comparison of two texts for folds, which see one text at a time; the same as functions.text.similarity."""

from __future__ import annotations

import re

from . import lexicon as L

#: From here on two texts say the same.
NEAR = 0.72

NEGATION = re.compile(r"\b(?:" + "|".join(L.NEGATIONS) + r")\b")
NUMBER = re.compile(r"\b\d+(?:[.,]\d+)?\b")
REPEATED = re.compile(r"\b([a-záéíóúñü]+)\b(?:\s*[,;:]\s*|\s+)\1\b")
TERM = re.compile(L.TERM)


def profile(text: str) -> tuple[tuple, frozenset[str]]:
    """(what must be equal, content tokens)."""
    low = text.lower()
    same = frozenset(NEGATION.findall(low)), frozenset(NUMBER.findall(text)), frozenset(REPEATED.findall(low))
    words = (w.strip(".-_") for w in TERM.findall(low) if not w.isdigit())
    return same, frozenset(w for w in words if w not in L.STOPWORDS)


def shared(a: tuple, b: tuple) -> float:
    """How alike two texts are, from their profiles."""
    (same_a, x), (same_b, y) = a, b
    return len(x & y) / len(x | y) if same_a == same_b and x and y else 0.0


def similarity(a: str, b: str) -> float:
    return shared(profile(a), profile(b))


def distinct(texts: list[str], near: float = NEAR, most: int | None = None) -> list[int]:
    """Places of the texts that aren't nearly the same as one kept before; at most `most`."""
    kept: list[int] = []
    seen: list[tuple] = []
    for k, t in enumerate(texts):
        if most is not None and len(kept) >= most:
            break
        p = profile(t)
        if all(shared(p, q) < near for q in seen):
            kept.append(k)
            seen.append(p)
    return kept

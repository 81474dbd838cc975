"""Small reference forms for the tests."""

from __future__ import annotations

import math


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    shares = [value.count(c) / len(value) for c in set(value)]
    return -sum(p * math.log2(p) for p in shares)


def replace_all(text: str, pairs: dict[str, str]) -> str:
    """Leftmost, longest at a position, non-overlapping."""
    out, i = [], 0
    order = sorted(pairs, key=lambda s: -len(s))
    while i < len(text):
        hit = next((s for s in order if s and text.startswith(s, i)), None)
        out.append(pairs[hit] if hit else text[i])
        i += len(hit) if hit else 1
    return "".join(out)

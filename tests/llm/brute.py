"""Plain-Python versions of what SQL can't express, for the tests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import cache


def grams_of(text: str, order: int = 4) -> list[str]:
    """Grams of a text: words with a blank after each, three blanks before the first."""
    words = text.encode().split()
    line = " " * (order - 1) + b" ".join(words).decode() + " "
    line = "".join(c if ord(c) < 0xFFFF else "\uffff" for c in line)
    return [line[i - order + 1 : i + 1] for i in range(order - 1, len(line))] if words else []


def kneser_ney(taught: list[str]) -> Callable[[str], float]:
    """-> p(gram) by the definition of interpolated modified Kneser-Ney."""
    counts = {4: Counter(g for t in taught for g in grams_of(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, follows = {}, {}
    for k, c in counts.items():
        n = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
        discounts[k] = []
        for i in (1, 2, 3):
            d = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i] if n[i] and n[1] else -1
            discounts[k].append(d if 0 < d < i else 0.75 * i if i < 3 else 1.5)
        for g, v in c.items():
            follows.setdefault((k, g[:-1]), []).append(v)

    @cache
    def p(gram: str) -> float:
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        values = follows.get((k, gram[:-1]))
        if not values:
            return p(gram[1:])
        cut = lambda v: discounts[k][min(v, 3) - 1]
        own, total = counts[k].get(gram, 0), sum(values)
        return (max(own - cut(own), 0) / total if own else 0) + sum(map(cut, values)) / total * p(gram[1:])

    return p

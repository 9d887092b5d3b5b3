"""Character n-grams of running text as 64-bit numbers, and their costs inside a task."""

from __future__ import annotations

import numpy as np

ORDER = 4
BITS = 16
BLANK, FOLDED = 32, 0xFFFF


def gram_runs(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts one after the other, grams per text).

    The symbols of a text are its words' code points and a blank after each word;
    a gram is a symbol, lowest, and the ORDER - 1 before it, blanks before the first.
    So grams reach over word ends.  Code points of 2**16 and above fold into one.
    """
    pad = " " * (ORDER - 1)
    lines = [f"{pad}{b' '.join(words).decode('utf-8')} " if (words := (t or b"").split()) else "" for t in texts]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.minimum(np.frombuffer("".join(lines).encode("utf-32-le"), "<u4"), FOLDED).astype(np.int64)
    grams = np.zeros(len(codes), np.int64)
    for back in range(ORDER):
        grams[back:] |= codes[: len(codes) - back] << (BITS * back)
    real = np.ones(len(codes), bool)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    for k in range(ORDER - 1):
        real[begin + k] = False
    return grams[real], np.maximum(sizes - (ORDER - 1), 0)


class GramCounts:
    """Counts of grams by language; grams of text that doesn't teach count 0, they only name what is needed."""

    LIMIT = 1_000_000

    def __init__(self):
        self.held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, langs: list[str | None], texts: list[bytes | None], teaches: list[bool]) -> None:
        for lang in set(langs):
            for teach in (True, False):
                grams, n = np.unique(gram_runs([t for t, own, x in zip(texts, langs, teaches) if own == lang and x == teach])[0], return_counts=True)
                if len(grams):
                    self.held.setdefault(lang, []).append((grams, n if teach else np.zeros_like(n)))
                    self.size += len(grams)
        if self.size > self.LIMIT:
            for lang, parts in self.held.items():
                grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                sums = np.zeros(len(grams), np.int64)
                np.add.at(sums, where, np.concatenate([n for _, n in parts]))
                self.held[lang] = [(grams, sums)]
            self.size = sum(len(parts[0][0]) for parts in self.held.values())

    def full(self) -> bool:
        return self.size > self.LIMIT // 2

    def take(self):
        """(lang, grams, counts) of what is held, which is then forgotten."""
        for lang, parts in self.held.items():
            for grams, n in parts:
                yield lang, grams, n
        self.held, self.size = {}, 0


def text_costs(tables: dict, langs: list[str | None], texts: list[bytes | None]) -> list[tuple[int, int] | None]:
    """(cost, grams) of each text under ``tables`` (lang -> sorted grams, costs); None without a table or grams."""
    out: list[tuple[int, int] | None] = [None] * len(texts)
    for lang in set(langs) & set(tables):
        known, costs = tables[lang]
        rows = [i for i, own in enumerate(langs) if own == lang]
        grams, counts = gram_runs([texts[i] for i in rows])
        upto = np.concatenate(([0], np.cumsum(costs[np.searchsorted(known, grams)], dtype=np.int64)))
        ends = np.cumsum(counts)
        sums = upto[ends] - upto[ends - counts]
        for i, cost, n in zip(rows, sums.tolist(), counts.tolist()):
            if n:
                out[i] = cost, n
    return out

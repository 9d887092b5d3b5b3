"""Quality rules by divergence from the language.

Per document: base counts (words, symbols, repeated lines and windows), and two
histograms, of character classes and of the language's common words.  A language's
reference is the mean of the normalised histograms of all its documents that pass
the base rules; a document is rejected when the Jensen-Shannon distance (base 2,
0 to 1) of either histogram to its reference is above a limit, unless it is too
short for that histogram to mean anything.

Texts are read once, by an Arrow job that nothing is shuffled for; references
come from one aggregation over the small feature rows, one row per language.

Defined cases: a null or empty text has no words and fails the base rules; a null
language is a language of its own; a language without a word list is judged by
character classes only; repeated rows are judged one by one; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, keep, slices, tidy_worker

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
N_COMMON = 25
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")

MIN_WORDS = 20
MOST_REPEATED = 30  # per cent of words
WINDOW = 8

#: Code points from which classes, and words from which common words are judged.
CLASS_MIN_CHARS = 100
COMMON_MIN_WORDS = 40
#: Limits (a, b) of a distance: a + b / sqrt(n), as the distance of a fair sample
#: of n symbols falls with the root of n.
CLASS_LIMIT = (0.20, 1.5)
COMMON_LIMIT = (0.24, 0.6)

FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def _class_table() -> np.ndarray:
    """Class of each code point up to U+FFFF; everything above is "other"."""
    table = np.full(0x10000, 6, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if kind == "Ll":
            table[c] = 0
        elif kind == "Lu":
            table[c] = 1
        elif kind == "Nd":
            table[c] = 2
        elif c == 32 or 9 <= c <= 13:
            table[c] = 3
        elif chr(c) in ".,;:?'\"()-":
            table[c] = 4
        elif c < 128 and kind[0] in "PS":
            table[c] = 5
    return table


def _forms(word: str) -> list[bytes]:
    """A word as it may stand in running text: capital or not, a stop or comma after it."""
    return [(w + end).encode() for w in {word, word[:1].upper() + word[1:]} for end in ("", ".", ",")]


_tables: dict = {}


def _classes() -> np.ndarray:
    if "classes" not in _tables:
        _tables["classes"] = _class_table()
    return _tables["classes"]


def _lookup(lang: str | None) -> dict[bytes, int]:
    if ("words", lang) not in _tables:
        words = COMMON_WORDS.get(lang or "", "").split()
        _tables["words", lang] = {form: i for i, w in enumerate(words) for form in _forms(w)}
    return _tables["words", lang]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for k in range(window):
        mixed += (each[k : k + n] ^ (each[k : k + n] >> np.uint64(29))) * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D & (1 << 64) - 1 | 1
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        seen.add(line)
    return n


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of every whole text."""

    def measure(batches):
        import pyarrow as pa

        tidy_worker()

        names = [c.split()[0] for c in FEATURES.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2]
        for batch in slices(batches):
            rows = []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                text = text or b""
                forms = _lookup(lang)
                words = text.split()
                codes = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), "<u4")
                classes = np.bincount(_classes()[np.minimum(codes, 0xFFFF)], minlength=len(CLASSES))
                common = [0] * (N_COMMON + 1)
                for i in map(forms.get, words) if forms else ():
                    if i is not None:
                        common[i] += 1
                common[N_COMMON] = len(words) - sum(common)
                symbols = sum(map(text.count, SYMBOLS.encode()))
                rows.append((doc_id, lang, len(words), len(codes) - int(classes[3]), symbols, duplicate_lines(text), repeated_words(words), classes.tolist(), common))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(measure, FEATURES)


def _share(counts: str, i: int, total: Column) -> Column:
    return F.try_divide(F.get(F.col(counts), F.lit(i)), total)


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of a histogram to a normalised reference."""
    total = F.aggregate(F.col(counts), F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(F.try_divide(x, m))).otherwise(F.lit(0.0))

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    shares = F.transform(F.col(counts), lambda c: F.try_divide(c, total))
    terms = F.zip_with(shares, F.col(reference), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _beyond(distance: str, n: Column, least: int, limit: tuple[float, float]) -> Column:
    return (n >= least) & (F.col(distance) > limit[0] + F.try_divide(F.lit(limit[1]), F.sqrt(n)))


def judge(rows: DataFrame) -> DataFrame:
    """Feature rows with references, distances and the verdict; pass a kept table."""
    rows = rows.withColumn("base_failed", base_failed())
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    good = rows.filter(~F.col("base_failed")).withColumn("chars", chars)
    means = {
        "class_reference": F.array(*[F.avg(_share("classes", i, F.col("chars"))) for i in range(len(CLASSES))]),
        "common_reference": F.array(*[F.avg(_share("common", i, F.col("n_words"))) for i in range(N_COMMON + 1)]),
    }
    references = good.groupBy(F.col("lang").alias("_lang")).agg(*[c.alias(n) for n, c in means.items()])
    rows = rows.join(references, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    rows = rows.withColumn("class_distance", distance("classes", "class_reference")).withColumn("common_distance", distance("common", "common_reference"))
    odd = _beyond("class_distance", chars, CLASS_MIN_CHARS, CLASS_LIMIT) | _beyond("common_distance", F.col("n_words"), COMMON_MIN_WORDS, COMMON_LIMIT)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    out = judge(keep(features(docs), "quality-features"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))

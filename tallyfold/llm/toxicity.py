"""Toxic passages by maximum-scoring segments over token log-odds.

Labelled rows are split by a hash of the doc_id: rows held out for a test are never
used, one in CALIBRATE of the others calibrates, the rest teach.  Four steps:

1. Counts: in how many documents each token occurs, among toxic and clean teaching rows
   and among all documents of the table; the last give the Dirichlet prior, PRIOR
   pseudo-tokens spread as the whole table's tokens are.  A stem, which is the beginning of
   a token, counts what its tokens count.  Log-odds between the posteriors of both classes,
   over their standard deviation, tell which tokens and stems count.  A token's log-odds are
   the greatest among itself and its stems; all others are one token "rest", whose own
   log-odds are below zero.
   The tokens of toxic rows are named first, so that only they are counted elsewhere.
2. Scan: every document's tokens carry these log-odds as whole numbers; as the counts
   are of documents, a token that comes again scores as the rest.  All maximal
   scoring segments are found in one pass, linear in the tokens.
3. Extreme values: a clean text of n tokens has a segment of s nats or more with
   probability 1 - exp(-K n exp(-s)); log-odds decay by one nat a nat.  K is the likeliest on
   clean calibration rows (a text without a segment counts as one below the least score),
   with one passage more than seen.  A passage is significant if its expected number in
   clean text is at most SIGNIFICANT; a document's evidence is minus the logarithm of the
   probability of its best passage, or of the sum of the normalised scores of all its
   significant passages, whichever says more.
4. Score: logistic in the evidence, fitted on the calibration rows.

The scan's tasks hold the vocabulary, at most VOCABULARY tokens with the greatest
ratio of log-odds to deviation, a fixed size of the model.  Everything else is counted
over all rows.  Tokens are runs of letters, digits and "_" in lower case; language,
source, labels and doc_id are no inputs of a score.

Defined cases: a null or empty text has no token, no passage and evidence 0; rows with a null
doc_id are not held out and have no label; a doc_id with several label rows is toxic if one
says so; null labels count as none; equal texts have equal scores; without labelled rows of
both classes there is no vocabulary and every score is that of a text without evidence, below
0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, as_bytes, keep, slices

TOKEN = re.compile(r"\w+")
#: Of the rows by crc32(doc_id), one in HELD_OUT is kept for tests.
HELD_OUT = 5
CALIBRATE = 4
#: Pseudo-tokens of the Dirichlet prior of each class.
PRIOR = 10_000.0
#: A token or stem counts from this many deviations, nats and toxic teaching documents.
LEAST_Z, LEAST_ODDS, LEAST_DOCS = 3.5, 1.0, 3
#: Characters of a stem.
STEMS = range(4, 9)
VOCABULARY = 100_000
#: Nats that a token outside the vocabulary costs at least, so that passages end.
DRIFT = 0.02
#: Whole-number units in a nat.
UNIT = 1000
SIGNIFICANT = 0.01
#: Distinct tokens that a counting task holds before it hands them on.
HELD_TOKENS = 300_000
#: Tokens and stems that every counting task may hold.
WANTED = 500_000
#: Tokens whose score a scanning task remembers.
KNOWN_TOKENS = 500_000
#: Evidence is binned for the logistic fit by this much, up to MOST.
BIN, MOST = 0.125, 64.0

TEACH_CLEAN, TEACH_TOXIC, TRY_CLEAN, TRY_TOXIC = 0, 1, 2, 3
SEGMENTS = "array<struct<begin:int,end:int,score:long>>"


def held_out(doc_id: Column) -> Column:
    """True for one doc_id in HELD_OUT; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def roles(labels: DataFrame) -> DataFrame:
    """(doc_id, role) of labelled rows that are not held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    own = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    tried = F.crc32(F.concat(F.lit("try:"), F.col("doc_id").cast("string")).cast("binary")) % CALIBRATE == 0
    return own.select("doc_id", (F.col("toxic") + F.when(tried, TRY_CLEAN).otherwise(TEACH_CLEAN)).cast("int").alias("role"))


def folded(text: str) -> str:
    """Lower case, code point by code point, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def stems(token: str) -> list[str]:
    """Beginnings of a longer token, marked with a star, which no token holds."""
    return [token[:k] + "*" for k in STEMS if k < len(token)]


COUNTS = "token string, toxic long, clean long, everywhere long"


def _counted(docs: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    """COUNTS summed by token over rows (role, text), of the wanted tokens and stems or of all."""

    def count(batches):
        import pyarrow as pa

        counters = toxic, clean, everywhere = Counter(), Counter(), Counter()
        wants = wanted.value.__contains__ if wanted else None

        def out():
            sums = {None: [sum(of.values()) for of in counters]}
            for token, n in everywhere.items():
                row = toxic.get(token, 0), clean.get(token, 0), n
                for feature in filter(wants, (token, *stems(token))) if wants else (token, *stems(token)):
                    held = sums.setdefault(feature, [0, 0, 0])
                    for k in range(3):
                        held[k] += row[k]
            for of in counters:
                of.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(list(c), pa.int64()) for c in zip(*sums.values()))], ["token", "toxic", "clean", "everywhere"])

        for batch in slices(batches):
            for role, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                tokens = set(TOKEN.findall(folded(text.decode("utf-8")))) if text else ()
                everywhere.update(tokens)
                if role == TEACH_TOXIC:
                    toxic.update(tokens)
                elif role == TEACH_CLEAN:
                    clean.update(tokens)
                if len(everywhere) > HELD_TOKENS:
                    yield out()
        yield out()

    rows = docs.select("role", "text").mapInArrow(count, COUNTS)
    return rows.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "everywhere")))


def token_counts(docs: DataFrame, most_wanted: int = WANTED) -> DataFrame:
    """COUNTS: documents with the token, for stems summed over their tokens.

    Rows (role, text).  The row of token null sums all tokens; tokens and stems with fewer
    than LEAST_DOCS toxic documents are in these sums only.  A first job over toxic rows
    names the others; if they are at most ``most_wanted``, the tasks of the second job
    count just them, else all tokens are shuffled; the counts are the same.
    """
    enough = F.col("token").isNull() | (F.col("toxic") >= LEAST_DOCS)
    some = keep(_counted(docs.filter(F.col("role") == TEACH_TOXIC)).filter(enough).select("token"), "toxic-tokens")
    wanted = None
    if some.count() <= most_wanted:
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["token"] for r in some.collect()))
    return keep(_counted(docs, wanted).filter(enough), "token-counts")


class KnownScores(dict):
    """Scores of tokens as they are met: the greatest among the token and its stems, else 0."""

    def __init__(self, odds: TokenOdds):
        self.vocabulary = odds.scores

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        self[token] = score = max(self.vocabulary.get(x, 0) for x in (token, *stems(token)))
        return score


@dataclass
class TokenOdds:
    """Whole-number log-odds of tokens and stems, and of the rest."""

    scores: dict[str, int]
    rest: int

    @property
    def least(self) -> int:
        return min(self.scores.values(), default=UNIT)


def token_odds(counts: DataFrame) -> TokenOdds:
    """Log-odds with an informative Dirichlet prior from the rows of ``token_counts``."""
    total = counts.filter("token is null").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return TokenOdds({}, -round(DRIFT * UNIT))
    n1, n0 = total["toxic"] + PRIOR, total["clean"] + PRIOR
    prior = F.col("everywhere") * (PRIOR / total["everywhere"])
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(y1) - F.log(n1 - y1) - F.log(y0) + F.log(n0 - y0)
    known = counts.filter("token is not null").select("token", y1.alias("y1"), y0.alias("y0"), delta.alias("odds"), (delta / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    known = known.filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "token").limit(VOCABULARY).collect()
    # what no whole token of the vocabulary is, in both classes
    p1, p0 = (1 - sum(r[c] for r in known if not r["token"].endswith("*")) / n for c, n in (("y1", n1), ("y0", n0)))
    rest = min(round(UNIT * math.log(max(p1, 1e-9) / max(p0, 1e-9))), -round(UNIT * DRIFT))
    return TokenOdds({r["token"]: round(UNIT * r["odds"]) for r in known}, rest)


def maximal_segments(hits: list[tuple[int, int]], rest: int) -> list[tuple[int, int, int]]:
    """All maximal scoring segments as (first hit, last hit, score).

    ``hits``: (token number, score > 0), ascending; every other token scores ``rest`` < 0.
    A candidate keeps the sums left of it and up to its end, and the nearest earlier
    candidate with a smaller left sum; merges follow these links, so the work is linear.
    """
    found: list[tuple[int, int, int, int, int]] = []  # first, last, left, right, link
    gained = 0
    for k, (place, score) in enumerate(hits):
        left = gained + rest * (place - k)
        gained += score
        first, right = k, left + score
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= left:
                at = found[at][4]
            if at < 0 or found[at][3] >= right:
                break
            first, _, left, _, link = found[at]
            del found[at:]
            at = link
        found.append((first, k, left, right, at))
    return [(first, last, right - left) for first, last, left, right, _ in found]


def segments(docs: DataFrame, odds: TokenOdds, carried: list[str]) -> DataFrame:
    """(*carried, n_tokens, segments) of every row; segments are code point ranges with scores."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    rows = docs.select(*carried, "text")
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(f"n_tokens long, segments {SEGMENTS}").fields])

    def scan(batches):
        import pyarrow as pa

        scores, rest = KnownScores(shared.value).__getitem__, shared.value.rest
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.int64())]))
        for batch in slices(batches):
            n, found = [], []
            for raw in as_bytes(batch.column(len(carried))):
                text = folded(raw.decode("utf-8")) if raw else ""
                tokens = TOKEN.findall(text)
                hits, met = [], set()
                for i, s in enumerate(map(scores, tokens)):
                    if s and tokens[i] not in met:
                        met.add(tokens[i])
                        hits.append((i, s))
                own = []
                if hits:
                    spans = [m.span() for m in TOKEN.finditer(text)]
                    own = [{"begin": spans[hits[a][0]][0], "end": spans[hits[b][0]][1], "score": s} for a, b, s in maximal_segments(hits, rest)]
                n.append(len(tokens))
                found.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(found, kind)], [*batch.schema.names[:-1], "n_tokens", "segments"])

    return keep(rows.mapInArrow(scan, schema), "segments")


def clean_rate(scanned: DataFrame, odds: TokenOdds) -> float:
    """K: passages of score 0 or more that a token of clean text begins, from clean calibration rows."""
    best = F.array_max(F.transform("segments", lambda s: s["score"]))
    tail = F.col("n_tokens") * F.exp(-F.greatest(F.coalesce(best, F.lit(0)), F.lit(odds.least)) / UNIT)
    row = scanned.filter(F.col("role") == TRY_CLEAN).agg(F.count(best).alias("k"), F.sum(tail).alias("tail")).first()
    # one passage more than seen: a finite sample never proves that there are none
    return (row["k"] + 1) / ((row["tail"] or 0.0) + math.exp(-odds.least / UNIT))


def with_evidence(scanned: DataFrame, rate: float) -> DataFrame:
    """Adds ``passages``, the significant segments, and ``evidence``.

    A segment's ``nats`` are minus the logarithm of its expected number in clean text.
    """
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    rated = F.transform("segments", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["score"].alias("score"), (s["score"] / UNIT - F.log(n * rate)).alias("nats")))
    rows = scanned.withColumn("_rated", rated)
    rows = rows.withColumn("passages", F.filter("_rated", lambda s: s["nats"] >= -math.log(SIGNIFICANT)))
    most = F.array_max(F.transform("_rated", lambda s: s["nats"]))
    best = F.when(most > 14, most).otherwise(-F.log(-F.expm1(-F.exp(-most))))
    r, total = F.size("passages"), F.aggregate("passages", F.lit(0.0), lambda a, s: a + s["nats"])
    # probability that the r best normalised scores sum to more: exp(-t) t^(r-1) / (r! (r-1)!)
    log_factorial = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i))
    summed = F.when(r > 1, total - (r - 1) * F.log(total) + log_factorial(r) + log_factorial(r - 1))
    return rows.withColumn("evidence", F.coalesce(F.greatest(best, summed, F.lit(0.0)), F.lit(0.0))).drop("_rated")


def logistic(rows: list[tuple[float, int, float]]) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-a - b x)) from (x, label, weight), with one row of each kind added."""
    x, y, w = np.array([*rows, (0.0, 0, 1.0), (10.0, 1, 1.0)], float).T
    scale = MOST / 8
    features, theta = np.stack([np.ones_like(x), x / scale]), np.zeros(2)
    ridge = np.array([1e-3, 1e-3])

    def loss(t: np.ndarray) -> float:
        m = t @ features
        return float(w @ (np.logaddexp(0, m) - y * m) + ridge @ t**2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta @ features, -500, 500)))
        slope = features @ (w * (p - y)) + ridge * theta
        step = np.linalg.solve((features * (w * p * (1 - p))) @ features.T + np.diag(ridge), slope)
        size = 1.0
        while size > 1e-9 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
    return float(theta[0]), max(float(theta[1]) / scale, 0.0)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, passages) of every row.

    ``passages`` are code point ranges with their score and significance (nats).
    """
    marks = keep(roles(labels).withColumnRenamed("doc_id", "_id"), "roles")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    odds = token_odds(token_counts(texts))
    scanned = segments(texts, odds, ["doc_id", "role"])
    rows = with_evidence(scanned, clean_rate(scanned, odds))
    tried = rows.filter(F.col("role") >= TRY_CLEAN).groupBy(F.round(F.least("evidence", F.lit(MOST)) / BIN).alias("bin"), (F.col("role") == TRY_TOXIC).cast("int").alias("label")).count()
    a, b = logistic([(r["bin"] * BIN, r["label"], r["count"]) for r in tried.collect()])
    score = 1 / (1 + F.exp(-a - b * F.least("evidence", F.lit(MOST))))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "evidence", "passages")

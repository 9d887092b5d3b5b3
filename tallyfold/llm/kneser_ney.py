"""Quality classifier: interpolated modified Kneser-Ney over character n-grams.

Trusted documents are dealt by a hash of their text: one in HELD_OUT is held out,
the others teach the model, all of them.  One pass over all documents counts the
grams of teaching text and names the grams of all text; the count tables are
aggregated and joined by (language, gram), so they are sharded over the cluster
whatever their size: continuation counts, counts of counts, discounts and back-off
weights of each order are aggregations of the table of the order above.  Every gram
that occurs gets its cost, minus the logarithm of its probability in units of
1 / UNIT rounded to a whole number, by joins against these tables, lower orders
where it was not seen.  A second pass sums the costs of each document: with the
table of needed grams in every task if it has at most BROADCAST_GRAMS rows, else by
a join of document grams with the table.  Sums of whole numbers don't depend on
their order, so both ways and all reruns give the same result to the last digit.

A document's cost per symbol is drawn towards its language's mean as if PRIOR
symbols more had been seen, which keeps very short texts undecided, and rounded to
1 / RATES of a nat.  The limit is the QUANTILE of the held-out documents of its
language, read off a histogram of these rates, or their mean and DEVIATIONS standard
deviations where that is higher, as in languages with few held-out documents.

Defined cases: a null or empty text has no perplexity and is kept, as is a text in
a language without held-out documents (nothing is known against it); a null
language is a language of its own; repeated rows are judged one by one; documents
with a null doc_id are never trusted; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, as_bytes, keep, slices, tidy_worker
from .ngrams import BITS, ORDER, GramCounts, gram_runs, text_costs

#: Rows of the table of needed grams that each task may hold (12 bytes each).
BROADCAST_GRAMS = 4_000_000
HELD_OUT = 5
PRIOR = 200
QUANTILE = 0.99
DEVIATIONS = 3.0
UNIT = 1 << 20
RATES = 1000


def _suffix(order: int) -> Column:
    """A gram of ``order`` symbols without its first."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def _context() -> Column:
    return F.shiftrightunsigned(F.col("gram"), BITS)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) from rows (lang, text, teaches); n is 0 for grams not in teaching text."""

    def count(batches):
        import pyarrow as pa

        tidy_worker()
        held = GramCounts()

        def out():
            for lang, grams, n in held.take():
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(grams), np.int32))), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for batch in slices(batches, 1024, 1 << 20):
            held.add(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist())
            if held.full():
                yield from out()
        yield from out()
        tidy_worker()

    rows = docs.select("lang", F.col("text").cast("string"), "teaches").mapInArrow(count, "lang string, gram long, n long")
    return keep(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts from counts of counts."""
    n = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    row = counts.groupBy("lang").agg(*n)
    for k in (1, 2, 3):
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        usable = (F.col(f"n{k}") > 0) & (F.col("n1") > 0) & (d > 0) & (d < k)
        row = row.withColumn(f"d{k}", F.when(usable, d).otherwise(F.lit(0.75 * k if k < 3 else 1.5)))
    return row.select(F.col("lang").alias("_lang"), "d1", "d2", "d3")


def _discount() -> Column:
    return F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d1"))


def _on_lang(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join with a table of one row per language (column _lang)."""
    return left.join(right, F.col("lang").eqNullSafe(F.col("_lang")), how).drop("_lang")


def _on_gram(left: DataFrame, right: DataFrame, key: Column, how: str = "left") -> DataFrame:
    """Join with a sharded table keyed by (lang, gram); its columns other than the key stay."""
    right = right.withColumnsRenamed({"lang": "_lang", "gram": "_gram"})
    return left.join(right, F.col("lang").eqNullSafe(F.col("_lang")) & (key == F.col("_gram")), how).drop("_lang", "_gram")


def train(grams: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (lang, gram, p) of seen grams and (lang, gram, backoff) of contexts."""
    counts = {ORDER: grams.filter("n > 0")}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = keep(counts[order + 1].select("lang", _suffix(order + 1).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    symbols = counts[1].groupBy(F.col("lang").alias("_lang")).agg((F.count(F.lit(1)) + 1).alias("symbols"))
    model = []
    for order in range(1, ORDER + 1):
        rows = _on_lang(counts[order], _discounts(counts[order]))
        many = [F.count_if(F.col("n") == k if k < 3 else F.col("n") >= 3) * F.first(f"d{k}") for k in (1, 2, 3)]
        contexts = rows.groupBy("lang", _context().alias("gram")).agg(F.sum("n").alias("total"), (many[0] + many[1] + many[2]).alias("held_back"))
        contexts = keep(contexts.select("lang", "gram", "total", (F.col("held_back") / F.col("total")).alias("backoff")), "contexts")
        rows = _on_gram(rows, contexts, _context(), "inner")
        if order == 1:
            lower = 1.0 / F.col("symbols")
            rows = _on_lang(rows, symbols)
        else:
            rows = _on_gram(rows, model[-1][0].withColumnRenamed("p", "lower"), _suffix(order), "inner")
            lower = F.col("lower")
        p = F.greatest(F.col("n") - _discount(), F.lit(0.0)) / F.col("total") + F.col("backoff") * lower
        model.append((keep(rows.select("lang", "gram", p.alias("p")), "probabilities"), contexts.drop("total")))
    model.append((_on_lang(model[0][1].select("lang", "backoff"), symbols).select("lang", (F.col("backoff") / F.col("symbols")).alias("p")), None))
    return model


def probabilities(needed: DataFrame, model: list, order: int = ORDER) -> DataFrame:
    """(lang, gram, p) for every needed (lang, gram) of a language with a model."""
    if order == 0:
        return model[-1][0]
    seen, contexts = model[order - 1]
    found = _on_gram(needed.select("lang", "gram"), seen, F.col("gram"))
    known, missing = found.filter("p is not null"), found.filter("p is null").drop("p")
    missing = _on_gram(missing, contexts, _context())
    if order == 1:
        rest = _on_lang(missing, model[-1][0].select(F.col("lang").alias("_lang"), "p")).select("lang", "gram", "p")
    else:
        missing = keep(missing, "unseen")
        lower = probabilities(missing.select("lang", _suffix(order).alias("gram")).distinct(), model, order - 1)
        rest = _on_gram(missing, lower, _suffix(order), "inner").select("lang", "gram", (F.coalesce("backoff", F.lit(1.0)) * F.col("p")).alias("p"))
    return keep(known.unionByName(rest), "probabilities")


def gram_costs(table: DataFrame) -> DataFrame:
    """(lang, gram, cost) from (lang, gram, p)."""
    return table.select("lang", "gram", F.round(-F.log("p") * UNIT).cast("long").alias("cost"))


SCORES = "doc_id long, lang string, held boolean, cost long, n long"


def _scores_in_tasks(docs: DataFrame, table: DataFrame) -> DataFrame:
    """SCORES with the whole table in each task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = table.toArrow()
    tables = {}
    for lang in pc.unique(rows["lang"]).to_pylist():
        own = rows.filter(pc.is_null(rows["lang"]) if lang is None else pc.equal(rows["lang"], lang))
        grams, costs = own["gram"].to_numpy(), own["cost"].to_numpy().astype(np.int32)
        order = np.argsort(grams)
        tables[lang] = grams[order], costs[order]
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def score(batches):
        tidy_worker()
        for batch in slices(batches, 1024, 1 << 20):
            got = text_costs(shared.value, batch.column(1).to_pylist(), as_bytes(batch.column(3)))
            columns = [batch.column(0), batch.column(1), batch.column(2), *(pa.array([g and g[k] for g in got], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "held", "cost", "n"])
        tidy_worker()

    return docs.select("doc_id", "lang", "held", "text").mapInArrow(score, SCORES)


def _scores_by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The same by a join of the grams of each text with the sharded table."""

    def count(batches):
        import pyarrow as pa

        for batch in slices(batches, 64, 1 << 20):
            for a, b, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3)), as_bytes(batch.column(3))):
                grams, n = np.unique(gram_runs([text])[0], return_counts=True)
                if len(grams):
                    yield pa.RecordBatch.from_arrays([pa.array([a] * len(grams)), pa.array([b] * len(grams)), pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["a", "b", "lang", "gram", "k"])

    keyed = docs.withColumn("a", F.xxhash64("lang", "text")).withColumn("b", F.xxhash64(F.lit(1), "text", "lang"))
    distinct = keyed.select("a", "b", "lang", "text").dropDuplicates(["a", "b"])
    grams = distinct.mapInArrow(count, "a long, b long, lang string, gram long, k long")
    sums = _on_gram(grams, table, F.col("gram"), "inner").groupBy("a", "b").agg(F.sum(F.col("k") * F.col("cost")).alias("cost"), F.sum("k").alias("n"))
    return keyed.drop("text").join(sums, ["a", "b"], "left").select("doc_id", "lang", "held", "cost", "n")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def classify(docs: DataFrame, trusted: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, limit, kept) for every document."""
    trusted = keep(trusted, "trusted")
    mark = trusted.withColumn("trusted", F.lit(True))
    mark = F.broadcast(mark) if trusted.count() <= BROADCAST_IDS else mark
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(mark, "doc_id", "left")
    out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    known = F.coalesce("trusted", F.lit(False))
    texts = texts.select("doc_id", "lang", "text", (known & out).alias("held"), (known & ~out).alias("teaches"))
    grams = gram_counts(texts)
    table = keep(gram_costs(probabilities(grams, train(grams))), "costs")
    scores = keep((_scores_in_tasks if table.count() <= broadcast_grams else _scores_by_join)(texts.drop("teaches"), table), "scores")
    return judge(scores)


def judge(scores: DataFrame) -> DataFrame:
    """Limits by language and the verdicts; all comparisons are of whole numbers."""
    held = scores.filter("held and n > 0")
    means = held.groupBy(F.col("lang").alias("_lang")).agg((F.sum("cost") / F.sum("n")).alias("mean"))
    drawn = (F.col("cost") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR) / UNIT
    rows = _on_lang(scores, means, "left").withColumn("rate", F.round(drawn * RATES).cast("long"))
    bins = rows.filter("held and n > 0").groupBy(F.col("lang").alias("_lang"), "rate").agg(F.count(F.lit(1)).alias("k"))
    per = Window.partitionBy("_lang")
    upto, total = F.sum("k").over(per.orderBy("rate")), F.sum("k").over(per)
    bins = bins.withColumn("reached", F.when(upto >= QUANTILE * total, F.col("rate")))
    mean = F.sum(F.col("k") * F.col("rate")) / F.sum("k")
    spread = F.sqrt(F.greatest(F.sum(F.col("k") * F.col("rate") * F.col("rate")) / F.sum("k") - mean * mean, F.lit(0.0)))
    limits = bins.groupBy("_lang").agg(F.greatest(F.min("reached"), F.round(mean + DEVIATIONS * spread).cast("long")).alias("limit"))
    rows = _on_lang(rows, limits, "left")
    kept = F.coalesce(F.col("rate") <= F.col("limit"), F.lit(True))
    perplexity = lambda rate: F.round(F.exp(F.col(rate) / RATES), 6)
    return rows.select("doc_id", "lang", F.coalesce("n", F.lit(0)).alias("n_symbols"), perplexity("rate").alias("perplexity"), perplexity("limit").alias("limit"), kept.alias("kept"))

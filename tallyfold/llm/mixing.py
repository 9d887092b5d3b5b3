"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: a share of all words by its weight, never
above ``most`` times its own size, the excess going to the other sources by
weight.  Inside a source a document is wanted ``least(most, level * preference)``
times, with the level at which the words add up to the target; by default the
preference is the number of binary digits of a document's size, so longer documents
are likelier.  The whole part are certain copies; the fraction is the inclusion
probability p of one copy more, which goes to a sample without replacement of fixed
size (in words): documents are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and taken in that order while they bring the
source nearer to its target.  ``u`` is a hash of the doc_id, so reruns agree.

Only DataFrame functions are used.  Levels come from one row per source and
preference.  The ranking never meets in one task: a histogram of ranks by (source,
bin) finds the bin in which the target falls, that bin is cut into finer ones and so
on LEVELS times, the running sum over the distinct ranks of the last bin is taken,
and the last rank it takes is the cut to which every document is compared.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; an empty source name is another; rows with equal doc_id and, for a
null doc_id, with equal text share their random number, and if they are equally
long too they fall on the same side of the cut together; a document of size 0
takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Bins of a histogram, and how often the bin of the cut is cut finer.
BINS = 256
LEVELS = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a document's random number is made from."""
    by_text = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return F.coalesce(F.col(doc_id).cast("long").cast("string"), by_text)


def preference() -> Column:
    """Binary digits of the size: 1 for up to one word, 10 for 512 to 1,023 words, at most 63."""
    return F.length(F.bin("size"))


def random_odds(seed: str = SEED) -> Column:
    """Odds of a uniform number made from 52 bits of a hash of the key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.col("key")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return u / (1 - u)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source.

    The level L with ``sum(least(most * size, weight * L)) = share * all`` is read
    off the sources sorted by ``most * size / weight``: the first that need not
    stop at its cap sets it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.get(cycle, F.col("rank") % len(weights))).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after)).withColumn("ratio", F.col("cap") / F.col("weight"))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))
    per = per.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def source_copies(sizes: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """``targets`` by preference too, with ``certain`` copies, ``rest`` (p) and ``wanted`` (words of further copies).

    One row per source and preference; the level is found as in ``source_targets``.
    """
    per = _on_source(sizes.groupBy("source", "pref").agg(F.sum("size").alias("size")), targets)
    per = per.withColumn("ratio", most / F.col("pref")).withColumn("cap", most * F.col("size")).withColumn("weight", F.col("pref").cast("double") * F.col("size"))
    order = Window.partitionBy("source").orderBy("ratio", "pref")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", F.try_divide(F.col("target") - before, after))
    whole = Window.partitionBy("source")
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "pref", "level"))
    per = per.withColumn("level", F.min(fits).over(whole)["level"])
    copies = F.when(F.col("source_size") > 0, F.coalesce(F.least(F.lit(most), F.col("level") * F.col("pref")), F.lit(most))).otherwise(F.lit(0.0))
    per = per.withColumn("certain", F.floor(copies).cast("int")).withColumn("rest", copies - F.floor(copies))
    per = per.withColumn("wanted", F.col("target") - F.sum(F.col("certain") * F.col("size")).over(whole))
    return per.select("source", "pref", "source_size", "target", "certain", "rest", "wanted")


def _rank() -> Column:
    """The rank of a document mapped to (0, 1); 1 where nothing more is wanted."""
    q = F.col("odds") / (F.col("rest") / (1 - F.col("rest")))
    return F.when(F.col("rest") > 0, q / (1 + q)).otherwise(F.lit(1.0))


def _place(level: int) -> Column:
    """The bin of a rank among BINS ** level."""
    bins = BINS**level
    return F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per source and preference: target, certain copies, p, and the cut for one copy more.

    ``sizes``: (key, source, size, pref), read several times, so pass a kept table;
    ``pref`` is a positive whole number of few values.
    """
    plan = keep(source_copies(sizes, source_targets(sizes, weights, share, most), most), "mix-copies")
    ranked = _on_source(sizes.withColumn("odds", random_odds(seed)), plan, ["pref"]).filter("rest > 0").withColumn("rank", _rank())
    inside, edge = ranked, None
    for level in range(1, LEVELS + 1):
        if edge is not None:
            inside = _on_source(ranked, edge).filter(_place(level - 1) == F.col("edge_place"))
        before = F.lit(0).cast("long") if edge is None else F.col("edge_before")
        bins = inside.groupBy("source", "wanted", before.alias("base"), _place(level).alias("place")).agg(F.sum("size").alias("size"))
        upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("place"))
        bins = bins.withColumn("upto", upto).filter("upto > wanted").withColumn("before", F.col("upto") - F.col("size"))
        edge = bins.groupBy("source").agg(F.min(F.struct("place", "before")).alias("edge"))
        edge = keep(edge.select("source", F.col("edge.place").alias("edge_place"), F.col("edge.before").alias("edge_before")), "mix-edges")
    inside = _on_source(ranked, edge).filter(_place(LEVELS) == F.col("edge_place"))
    inside = inside.groupBy("source", "rank", "key", "wanted", "edge_before").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("edge_before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    taken = inside.withColumn("before", before).filter("before + size / 2.0 <= wanted")
    cuts = taken.groupBy("source").agg(F.max(F.struct("rank", "key")).alias("cut"))
    return keep(_on_source(_on_source(plan, edge, how="left"), cuts, how="left"), "mix-plan")


def _on_source(left: DataFrame, right: DataFrame, more: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join on source, null included, and ``more`` columns; Spark broadcasts the right side by its size."""
    names = ["source", *(more or [])]
    right = right.withColumnsRenamed({c: f"_{c}" for c in names})
    return left.join(right, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]), how).drop(*[f"_{c}" for c in names])


def copies_of(rows: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and ``copies`` to rows with key, source and pref."""
    extra = [c for c in plan.columns if c not in ("source", "pref", "source_size", "target")]
    rows = _on_source(rows.withColumn("odds", random_odds(seed)), plan, ["pref"]).withColumn("rank", _rank())
    at = _place(LEVELS)
    upto_cut = F.struct("rank", "key") <= F.col("cut")
    more = F.when(F.col("rest") <= 0, False).when(F.col("edge_place").isNull(), True).otherwise((at < F.col("edge_place")) | ((at == F.col("edge_place")) & F.coalesce(upto_cut, F.lit(False))))
    return rows.withColumn("copies", F.col("certain") + more.cast("int")).drop("odds", "rank", *extra)


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, size, pref) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("key"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    return rows.withColumn("pref", preference())


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    sizes = keep(document_sizes(docs), "mix-sizes")
    out = copies_of(sizes, mixing_plan(sizes, **options), options.get("seed", SEED))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it."""
    sizes = keep(document_sizes(docs), "mix-sizes")
    rows = docs.select(F.struct(*docs.columns).alias("row"), document_key().alias("key"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    rows = copies_of(rows.withColumn("pref", preference()), mixing_plan(sizes, **options), options.get("seed", SEED))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")

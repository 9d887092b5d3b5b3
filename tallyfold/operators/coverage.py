"""What of an id space or a time range has been seen, and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import containers
from ..session import stored

#: Time ranges up to this many are sent to every task.
BROADCAST_RANGES = 1_000_000


def coverage_bitmap(ids: DataFrame, mark: str = "mark") -> DataFrame:
    """Bitmaps of positive ids per (mark, bucket) with their exact counts.

    Partial bitmaps are combined before the shuffle; marking an id twice changes
    nothing.
    """
    rows = ids.filter("id > 0").select(mark, F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    maps = rows.groupBy(mark, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return maps.withColumn("n", F.bitmap_count("bitmap"))


def merge_bitmaps(bitmaps: DataFrame, mark: str = "mark") -> DataFrame:
    """One bitmap per (mark, bucket) from several tables of bitmaps."""
    return bitmaps.groupBy(mark, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).withColumn("n", F.bitmap_count("bitmap"))


CONTAINERS = "chunk long, container binary, n long"


def _batch(chunks, packed, *more):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), packed, *(pa.array(c, pa.int64()) for c in more)], ["chunk", "container", "n"][: 2 + len(more)])


def _sets_of(batches):
    """Containers of the ids of each batch, before the shuffle."""
    import numpy as np

    for batch in batches:
        ids = np.unique(batch.column(0).drop_null().to_numpy())
        if len(ids):
            yield _batch(*containers.pack_sets(ids)[:2])


def _merge_sets(batches):
    """One container a chunk from rows sorted by chunk, a slice of rows at a time; the last chunk waits for more."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        for begin, end in containers.slices(batch.column(1)):
            chunks, packed = batch.column(0).to_numpy()[begin:end], batch.column(1)[begin:end]
            if held is not None:
                chunks, packed = np.append(held[0], chunks), pa.concat_arrays([held[1], packed])
            first = np.append(True, np.diff(chunks) != 0)
            keys = containers.unpack_sets(packed)
            group = (np.cumsum(first) - 1)[keys >> containers.CHUNK_BITS]
            place, packed, n = containers.pack_sets(np.unique(group << containers.CHUNK_BITS | keys & (1 << containers.CHUNK_BITS) - 1))
            chunks = chunks[first][place]
            if len(chunks) > 1:
                yield _batch(chunks[:-1], packed[:-1], n[:-1])
            held = chunks[-1:], packed[-1:], n[-1:]
    if held is not None:
        yield _batch(*held)


def id_containers(ids: DataFrame) -> DataFrame:
    """CONTAINERS of a set of ids (any 64-bit numbers, repeats and nulls allowed).

    Ids become containers where they are read, so what is shuffled is a few bytes an id at
    most and a repeated id nothing; containers of a chunk are merged in any order.
    """
    parts = ids.select(F.col("id").cast("long")).mapInArrow(_sets_of, "chunk long, container binary")
    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge_sets, CONTAINERS)


def _combined(a: DataFrame, others: tuple[DataFrame, ...], how: str, keep) -> DataFrame:
    """CONTAINERS of the values of ``a`` that ``keep`` chooses; chunks are joined, then one pass over slices of rows."""
    rows = a.select("chunk", "container")
    for i, b in enumerate(others):
        rows = rows.join(b.select("chunk", F.col("container").alias(f"_{i}")), "chunk", how)

    def run(batches):
        for batch in batches:
            columns = batch.columns[1:]
            for begin, end in containers.slices(*columns):
                keys, *rest = (containers.unpack_sets(c[begin:end]) for c in columns)
                for other in rest:
                    keys = keys[keep(containers.among(keys, other))]
                if len(keys):
                    place, packed, n = containers.pack_sets(keys)
                    yield _batch(batch.column(0).to_numpy()[begin:end][place], packed, n)

    return rows.mapInArrow(run, CONTAINERS)


def sets_less(a: DataFrame, *others: DataFrame) -> DataFrame:
    """CONTAINERS of the ids of ``a`` that the others lack: joins of chunks, no join of ids."""
    return _combined(a, others, "left", lambda held: ~held)


def sets_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """CONTAINERS of the ids in both."""
    return _combined(a, (b,), "inner", lambda held: held)


def _ids(batch, begin: int, end: int, keys):
    return (batch.column(0).to_numpy()[begin:end][keys >> containers.CHUNK_BITS] << containers.CHUNK_BITS) + (keys & (1 << containers.CHUNK_BITS) - 1)


def ids_of(sets: DataFrame) -> DataFrame:
    """The ids of CONTAINERS as rows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin, end in containers.slices(batch.column(1)):
                keys = containers.unpack_sets(batch.column(1)[begin:end])
                yield pa.RecordBatch.from_arrays([pa.array(_ids(batch, begin, end, keys), pa.int64())], ["id"])

    return sets.select("chunk", "container").mapInArrow(run, "id long")


def ids_by_set(sets: DataFrame, other: DataFrame, name: str = "held") -> DataFrame:
    """The ids of CONTAINERS and whether another set holds them: one join of chunks, one Python worker a task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin, end in containers.slices(*batch.columns[1:]):
                keys, held = (containers.unpack_sets(c[begin:end]) for c in batch.columns[1:])
                yield pa.RecordBatch.from_arrays([pa.array(_ids(batch, begin, end, keys), pa.int64()), pa.array(containers.among(keys, held))], ["id", name])

    rows = sets.select("chunk", "container").join(other.select("chunk", F.col("container").alias("_other")), "chunk", "left")
    return rows.mapInArrow(run, f"id long, `{name}` boolean")


def missing_in_sets(discovered: DataFrame, *settled: DataFrame) -> DataFrame:
    """CONTAINERS of discovered ids that no other set holds."""
    return sets_less(discovered, *settled)


def coverage_summary(bitmaps: DataFrame, discovered: str = "discovered", successful: str = "successful", inaccessible: str = "inaccessible") -> DataFrame:
    """Counts per mark and missing = discovered less successful less inaccessible."""
    total = lambda m: F.coalesce(F.sum(F.when(F.col("mark") == m, F.col("n"))), F.lit(0))
    out = bitmaps.agg(total(discovered).alias("discovered"), total(successful).alias("successful"), total(inaccessible).alias("inaccessible"))
    return out.withColumn("missing", F.greatest(F.col("discovered") - F.col("successful") - F.col("inaccessible"), F.lit(0)))


def missing_ids(discovered: DataFrame, *settled: DataFrame) -> DataFrame:
    """Discovered ids that no other set holds."""
    out = discovered.select("id").distinct()
    for other in settled:
        out = out.join(other.select("id"), "id", "left_anti")
    return out


def coverage_by_day(success: DataFrame) -> DataFrame:
    """Newly successful ids per UTC day of creation; rows without one are counted as errors."""
    first = success.groupBy("id").agg(F.min("created_at").alias("created_at"))
    return first.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("error", F.col("day").isNull())


def day_partitions(bounds: DataFrame) -> DataFrame:
    """Closed one-day ranges [start, end] of one-second resolution; the last ends at the cutoff.

    ``bounds``: rows (epoch, cutoff), each of which is cut by itself.
    """
    days = bounds.select(F.col("cutoff").cast("timestamp").alias("cutoff"), F.explode(F.sequence(F.col("epoch").cast("timestamp"), F.col("cutoff").cast("timestamp"), F.expr("interval 1 day"))).alias("start_at"))
    return days.select("start_at", F.least(F.col("start_at") + F.expr("interval 86399 seconds"), F.col("cutoff")).alias("end_at"))


def bisect_partitions(events: DataFrame, ts: str, start: int, end: int, cap: int) -> DataFrame:
    """Time ranges (seconds, closed) halved until each holds at most ``cap`` rows.

    The range is taken as a power of two of seconds, so that the range of a second at
    every depth is arithmetic; ranges end at ``end`` and those after it don't exist.
    Events are counted per second, seconds into the ranges of each depth, and the
    leaves are the halves of ranges over the cap that are not over it themselves.  A
    one-second range over the cap is unresolved.  No loop: two aggregations and one
    join, all combined before they are shuffled.
    """
    depth = max(end - start, 0).bit_length()
    low = lambda second, k: start + F.call_function("shiftleft", F.call_function("shiftright", second - start, k), k)
    seconds = events.groupBy(F.unix_timestamp(ts).alias("second")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("second").between(start, end))
    levels = seconds.select("second", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("k"))
    counts = levels.groupBy("k", low(F.col("second"), F.col("k")).alias("lo")).agg(F.sum("n").alias("n"))
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") - 1)
    children = counts.filter((F.col("n") > cap) & (F.col("k") > 0)).select((F.col("k") - 1).alias("k"), F.explode(F.array("lo", F.col("lo") + half)).alias("lo"))
    whole = events.sparkSession.range(1).select(F.lit(depth).alias("k"), F.lit(start).cast("long").alias("lo"))
    leaves = children.filter(F.col("lo") <= end).union(whole).join(counts, ["k", "lo"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    leaves = leaves.filter((F.col("n") <= cap) | (F.col("k") == 0))
    hi = F.least(F.col("lo") + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k")) - 1, F.lit(end))
    return leaves.select("lo", hi.alias("hi"), "n", (F.col("n") > cap).alias("unresolved"))


def reconcile_counts(remote: DataFrame, local: DataFrame, cap: int = 1000, sample_per_cent: int = 1) -> DataFrame:
    """Per partition: consistent, split or repair, by remote and local counts.

    ``remote``: (day, remote_count, incomplete).  A pseudo-random share of consistent
    days is marked to be sampled.
    """
    rows = remote.join(local, "day", "left").withColumn("local_count", F.coalesce("local_count", F.lit(0)))
    state = F.when((F.col("remote_count") == F.col("local_count")) & ~F.col("incomplete"), "consistent").when((F.col("remote_count") > cap) | F.col("incomplete"), "split").otherwise("repair")
    rows = rows.withColumn("state", state)
    draw = F.pmod(F.conv(F.substring(F.md5(F.date_format("day", "yyyy-MM-dd")), 1, 8), 16, 10).cast("long"), F.lit(100))
    return rows.withColumn("sampled", (F.col("state") == "consistent") & (draw < sample_per_cent))


def calendar_gaps(days: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected days against observed counts: total, complete, sum, first missing, next day."""
    rows = days.select("day").distinct().join(observed.select("day", "n"), "day", "left")
    out = rows.agg(
        F.count(F.lit(1)).alias("days"),
        F.count("n").alias("complete"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.min(F.when(F.col("n").isNull(), F.col("day"))).alias("first_missing"),
        F.max("day").alias("last"),
    )
    return out.withColumn("next_day", F.coalesce("first_missing", F.date_add("last", 1))).drop("last")


def stage_partition(remote: DataFrame, successful: DataFrame) -> DataFrame:
    """Remote identities with ``resolved``: whether the success set holds them."""
    known = successful.select("id").distinct().withColumn("_known", F.lit(True))
    return remote.join(known, "id", "left").withColumn("resolved", F.coalesce("_known", F.lit(False))).drop("_known")


def place_in_ranges(rows: DataFrame, at: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each row with every closed range of seconds that holds its time ``at``; ranges of any length.

    A range shorter than 2**k seconds and not shorter than half of that meets at most two
    bins of 2**k seconds; a row looks into one bin of each k that occurs.  So the join is
    on equal (k, bin), and only ranges of about the same length are ever compared.  Ranges
    are sent to the rows if they are few, else both sides are shuffled by bin.
    """
    span = F.greatest(F.col(hi) - F.col(lo) + 1, F.lit(1))
    sized = ranges.withColumn("_k", F.ceil(F.log2(span)).cast("int"))
    # log2 may miss a power of two by a digit: one more is still right
    sized = sized.withColumn("_k", F.when(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_k")) < span, F.col("_k") + 1).otherwise(F.col("_k")))
    steps = sorted(r[0] for r in sized.select("_k").distinct().collect())
    bin_of = lambda second, k: F.call_function("shiftright", second, k)
    binned = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col(lo), F.col("_k")), bin_of(F.col(hi), F.col("_k"))))))
    binned = F.broadcast(binned) if binned.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES else binned
    probes = rows.withColumn("_k", F.explode(F.array(*map(F.lit, steps)).cast("array<int>"))).withColumn("_bin", bin_of(F.col(at).cast("long"), F.col("_k")))
    return probes.join(binned, ["_k", "_bin"]).filter(F.col(at).between(F.col(lo), F.col(hi))).drop("_k", "_bin")


def stage_time_partitions(remote: DataFrame, successful: DataFrame, ranges: DataFrame) -> DataFrame:
    """Identities with the range of their creation time and whether the success set holds them.

    ``remote``: (id, second); ``ranges``: (lo, hi) as ``bisect_partitions`` gives them, of any
    length.  A range that was split is repaired by the identities of its own bounds; an
    identity outside every range has none and isn't returned.
    """
    return stage_partition(place_in_ranges(remote, "second", ranges.select("lo", "hi")), successful).select("lo", "hi", "id", "resolved")


def partition_resolution(staged: DataFrame, key: str = "day") -> DataFrame:
    """A partition is resolved when none of its identities is unresolved."""
    return staged.groupBy(key).agg(F.count(F.lit(1)).alias("ids"), F.count_if(~F.col("resolved")).alias("unresolved"), F.bool_and("resolved").alias("resolved"))


def partition_rollup(partitions: DataFrame) -> DataFrame:
    """Counts of partition states, whether nothing is active, and the final state.

    A partition that was split carries no state of its own: its halves do.
    """
    count = lambda s: F.count_if(F.col("state") == s)
    out = partitions.agg(count("consistent").alias("consistent"), count("repair").alias("repairing"), count("unresolved").alias("unresolved"), count("pending").alias("pending"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    out = out.withColumn("done", (F.col("pending") + F.col("repairing")) == 0)
    final = F.when(~F.col("done"), "active").when(F.col("unresolved") > 0, "unresolved").otherwise("count_reconciled")
    return out.withColumn("final", final)


def audit_verdict(audits: DataFrame) -> DataFrame:
    """Verdict of a population audit: rows (complete, searchable, enumerated, initial_complete)."""
    gap = F.when(F.col("complete"), F.greatest(F.col("searchable") - F.col("enumerated"), F.lit(0)))
    rows = audits.withColumn("gap", gap)
    verdict = F.when(~F.col("complete"), "measuring").when(~F.col("initial_complete"), "initial in progress").when(F.col("gap") > 0, "gap detected").otherwise("consistent")
    return rows.withColumn("verdict", verdict)


def id_ranges(spark: SparkSession, lower: int, upper: int, n: int) -> DataFrame:
    """``n`` contiguous ranges of an id space, equal but for rounding (fewer if ids are)."""
    total = upper - lower + 1
    pieces = min(n, total)
    part = F.col("id")
    rows = spark.range(pieces)
    return rows.select(part.alias("range"), (lower + F.floor(total * part / pieces)).cast("long").alias("lower_id"), (lower + F.floor(total * (part + 1) / pieces) - 1).cast("long").alias("upper_id"))


def range_density(accounts: DataFrame, lower: int, upper: int, n: int) -> DataFrame:
    """Users per id position for ``n`` equal ranges, by arithmetic on the id (no range join)."""
    spark = accounts.sparkSession
    total = upper - lower + 1
    pieces = min(n, total)
    # the range of an id: the greatest part with lower + floor(total * part / pieces) <= id
    guess = F.floor(((F.col("id") - lower + 1) * pieces - 1) / total).cast("long")
    counts = accounts.filter(F.col("id").between(lower, upper)).groupBy(guess.alias("range")).agg(F.count(F.lit(1)).alias("users"))
    rows = id_ranges(spark, lower, upper, n).join(counts, "range", "left").withColumn("users", F.coalesce("users", F.lit(0)))
    return rows.withColumn("density", F.col("users") / (F.col("upper_id") - F.col("lower_id") + 1))


def _counted_before(batches):
    """For each edge of sorted rows the ids before it in this task, and a last row with all of the task's."""
    import numpy as np
    import pyarrow as pa

    part, seen = None, 0
    names = ["part", "lower_id", "upper_id", "kind", "before"]
    for batch in batches:
        if not batch.num_rows:
            continue
        part, kind = batch.column("part")[0].as_py(), batch.column("kind").to_numpy()
        upto = seen + np.cumsum(kind == 1)
        seen = int(upto[-1])
        edges = pa.array(kind != 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(upto, pa.int64())], names).filter(edges)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int32()), (None, pa.int64()), (None, pa.int64()), (1, pa.int32()), (seen, pa.int64()))], names)


def shard_density(ids: DataFrame, shards: DataFrame) -> DataFrame:
    """``shards`` (lower_id, upper_id, closed, of any length, overlapping or not) with users and density.

    A sweep over sorted edges: ids and both edges of every range are range-partitioned
    by position, each task counts the ids before its edges, the tasks' sums, one row each,
    are added up in order, and a range's users are the ids before its end less those
    before its beginning.  No range meets an id, so the cost is one sort whatever the
    ranges; a range of all ids costs as much as one of none.
    """
    spark = ids.sparkSession
    ranges = shards.select(F.col("lower_id").cast("long").alias("lower_id"), F.col("upper_id").cast("long").alias("upper_id")).distinct()
    ends = F.array(*[F.struct(F.col(c).alias("at"), F.lit(k).alias("kind")) for c, k in (("lower_id", 0), ("upper_id", 2))])
    edges = ranges.select("lower_id", "upper_id", F.inline(ends))
    points = ids.select(F.col("id").cast("long").alias("at")).filter("at is not null").distinct().withColumn("kind", F.lit(1))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.unionByName(points, allowMissingColumns=True).repartitionByRange(tasks, "at", "kind").sortWithinPartitions("at", "kind").withColumn("part", F.spark_partition_id())
    swept = stored(rows.mapInArrow(_counted_before, "part int, lower_id long, upper_id long, kind int, before long"), "edges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = swept.filter("kind = 1").select("part", F.coalesce(F.sum("before").over(earlier), F.lit(0)).alias("base"))
    at = swept.filter("kind <> 1").join(F.broadcast(base), "part").withColumn("before", F.col("before") + F.col("base"))
    users = at.groupBy("lower_id", "upper_id").agg((F.max(F.when(F.col("kind") == 2, F.col("before"))) - F.max(F.when(F.col("kind") == 0, F.col("before")))).alias("users"))
    return shards.join(users, ["lower_id", "upper_id"]).withColumn("density", F.col("users") / (F.col("upper_id") - F.col("lower_id") + 1))


def expected_new(remaining: Column, observed_users: Column, observed_ids: Column) -> Column:
    """Remaining positions times the observed density (0 to 1), rounded up."""
    density = F.greatest(F.lit(0.0), F.least(F.lit(1.0), observed_users / observed_ids))
    return F.ceil(remaining * density)


#: Equal parts of an id space inside which islands are found before they are joined up.
ISLAND_PARTS = 256


def id_coverage_islands(shards: DataFrame) -> DataFrame:
    """Contiguous covered ranges of (lower_id, upper_id) rows, with the gap before each.

    The id space is cut into equal parts; what earlier parts cover and how many islands
    begin in them is one row per part, so only that small table has a global order.
    """
    ends = shards.agg(F.min("lower_id").alias("least"), F.max("lower_id").alias("most"))
    place = F.floor((F.col("lower_id") - F.col("least")) / (F.col("most") - F.col("least") + 1) * ISLAND_PARTS)
    rows = shards.select("lower_id", "upper_id").crossJoin(F.broadcast(ends)).withColumn("part", place).drop("least", "most")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.max("upper_id").alias("top")).withColumn("top", F.max("top").over(earlier))
    w = Window.partitionBy("part").orderBy("lower_id", "upper_id")
    rows = rows.join(F.broadcast(parts), "part")
    before = F.greatest("top", F.max("upper_id").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("starts", F.coalesce(F.col("lower_id") > before + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("own", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counts = rows.groupBy("part").agg(F.sum("starts").alias("begun")).withColumn("begun", F.coalesce(F.sum("begun").over(earlier), F.lit(0)))
    rows = rows.join(F.broadcast(counts), "part").withColumn("island", F.col("own") + F.col("begun"))
    out = rows.groupBy("island").agg(F.min("lower_id").alias("lower_id"), F.max("upper_id").alias("upper_id"), F.count(F.lit(1)).alias("shards"))
    last = out.select((F.col("island") + 1).alias("island"), F.col("upper_id").alias("end_before"))
    out = out.join(last, "island", "left")
    return out.select("island", "lower_id", "upper_id", "shards", F.coalesce(F.col("lower_id") - F.col("end_before") - 1, F.lit(0)).alias("gap_before"))

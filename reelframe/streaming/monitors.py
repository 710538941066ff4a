"""Streaming monitors: windowed load, utilisation, arriving shards, pairing, enrichment, routing, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.operators.ordered import range_rank
from reelframe.operators.scoring import finalize, merge_accum, to_accum
from reelframe.session import shuffled
from reelframe.sources.files import scratch
from reelframe.streaming.core import bounded, event_time, run_append, run_batches
from reelframe.streaming.upsert import Upsert


def load_parts(trace: DataFrame, width: str) -> DataFrame:
    """Mergeable load of each tumbling window: sum, count, largest."""
    w = F.window(event_time(), width)
    return trace.groupBy(w.alias("w")).agg(F.sum("l1").alias("s"), F.max("l1").alias("peak"), F.count("l1").alias("k"), F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "s", "peak", "k", "n")


def merge_load(parts: DataFrame, quota: float) -> DataFrame:
    g = parts.groupBy("start").agg(F.sum("s").alias("s"), F.max("peak").alias("peak"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    return g.select("start", F.try_divide("s", "k").alias("mean"), "peak", "n", (F.col("peak") > quota).alias("alert"))


def load_peak(trace: DataFrame, quota: float, width: str = "1 minute") -> DataFrame:
    """Mean and peak load per tumbling window, with an alert above the quota."""
    return merge_load(load_parts(trace, width), quota)


def run_load_peak(trace: DataFrame, quota: float, width: str) -> DataFrame:
    """The same of a stream: each batch stores its windows' parts, so rows in any order and of any age count."""
    return merge_load(run_batches(trace, lambda b, i, p: load_parts(b, width)), quota)


def with_interval(samples: DataFrame) -> DataFrame:
    """Samples with the start and end of the time they took."""
    return samples.withColumn("start", event_time()).withColumn(
        "end", F.timestamp_micros((F.unix_micros("start") + F.round(F.col("wall_s") * 1e6)).cast("long")))


def utilisation_matches(samples: DataFrame, ticks: DataFrame, delay: str | None = None, bucket_s: int = 60, on: str | None = None) -> DataFrame:
    """Ticks inside each sample's interval, of the sample's own device where a column `on` names it on both sides. Samples meet ticks by time bucket, so
    the range condition has an equality to shuffle on; streams keep both sides, or what `delay` leaves of them."""
    device = lambda name: [] if on is None else [F.col(on).alias(name)]
    s = with_interval(samples)
    t = ticks.withColumn("tick", event_time()).select("tick", "util", *device("tick_device"))
    if samples.isStreaming:
        s, t = bounded(s, "start", delay), bounded(t, "tick", delay)
    b = lambda c: F.floor(F.unix_micros(c) / (bucket_s * 1_000_000))
    s = s.withColumn("bucket", F.explode(F.sequence(b("start"), b("end")))).select("sample_id", "start", "end", "bucket", *device("device"))
    t = t.withColumn("tb", b("tick"))
    meet = (F.col("bucket") == F.col("tb")) & (F.col("tick") >= F.col("start")) & (F.col("tick") <= F.col("end"))
    if on is not None:
        meet = meet & (F.col("device") == F.col("tick_device"))
    return s.join(t, meet, "inner").select("sample_id", "tick", "util")


#: widths of time buckets, in bits of a time in microseconds; one of the widest (1.05 s) holds at most 2 ** 20 different times
WIDTHS = [20, 17, 14, 11, 8, 5, 2, 0]


def utilisation_totals(samples: DataFrame, ticks: DataFrame, on: str | None = None) -> DataFrame:
    """The matches of `utilisation_matches` added up per sample_id without being formed, as their number is that of the samples times that of the ticks in an
    interval: sum and count of util, count of ticks. Samples without ticks are left out.

    A sample takes the widest buckets of WIDTHS that are no longer than its interval, which so is the end of one bucket, whole buckets and the beginning of another.
    Whole ones are taken in aligned runs of 1, 2, 4, ..., at most two of each length; the ends are running sums over the ticks of a bucket in both directions.
    Nothing is subtracted, so values outside an interval leave no rounding error in it.
    """
    device = [] if on is None else ["device"]
    of = [] if on is None else [F.col(on).alias("device")]
    add = [F.sum("util_sum").alias("util_sum"), F.sum("util_n").alias("util_n"), F.sum("ticks").alias("ticks")]
    names = ["util_sum", "util_n", "ticks"]
    # from low up to, but not including, high
    s = with_interval(samples).select("sample_id", F.unix_micros("start").alias("low"), (F.unix_micros("end") + 1).alias("high"), *of)
    s = s.dropna(subset=["low", "high", *device]).filter("low < high").withColumn("bits", F.coalesce(*[F.when(F.expr(f"high - low >= {1 << b}L"), b) for b in WIDTHS]))
    s = s.withColumn("first", F.expr("shiftright(low, bits)")).withColumn("last", F.expr("shiftright(high, bits)"))
    util = F.col("util").cast("double")
    t = ticks.select(F.unix_micros(event_time()).alias("at"), util.alias("util"), *of).dropna(subset=["at", *device])
    t = t.groupBy("at", *device).agg(F.sum("util").alias("util_sum"), F.count("util").alias("util_n"), F.count("*").alias("ticks"))

    longest = {r["bits"]: r["n"] for r in s.groupBy("bits").agg(F.max(F.expr("last - first")).alias("n")).collect()}
    runs = sorted({b + h for b, n in longest.items() for h in range(n.bit_length())})
    dealt = lambda widths: t.withColumn("bits", F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).withColumn("node", F.expr("shiftright(at, bits)"))
    node = [*device, "bits", "node"]

    inner = s.withColumn("low", F.col("first") + 1).withColumn("high", F.col("last")).filter("low < high")
    inner = inner.withColumn("h", F.explode(F.expr("sequence(0, length(bin(high - low)) - 1)")))
    inner = inner.withColumn("low", F.expr("-shiftright(-low, h)")).withColumn("high", F.expr("shiftright(high, h)")).filter("low < high")
    inner = inner.withColumn("node", F.explode(F.expr("filter(array(if(low % 2 != 0, low, null), if(high % 2 != 0, high - 1, null)), x -> x is not null)")))
    inner = inner.withColumn("bits", F.col("bits") + F.col("h")).select("sample_id", *node)
    whole = inner.join(shuffled(dealt(runs).groupBy(*node).agg(*add)), node).select("sample_id", *names)

    none = [F.lit(None).cast("double").alias("util_sum"), F.lit(None).cast("long").alias("util_n"), F.lit(None).cast("long").alias("ticks")]
    ends = s.withColumn("mark", F.explode(F.expr("array(struct(first as node, low as at, true as rest), struct(last as node, high as at, false as rest))")))
    ends = ends.select(*device, "bits", "mark.*", F.lit(0).alias("kind"), "sample_id", *none)
    rows = dealt(sorted(longest)).select(*node, "at", F.lit(None).cast("boolean").alias("rest"), F.lit(1).alias("kind"), F.lit(None).cast(s.schema["sample_id"].dataType).alias("sample_id"), *names)
    # a mark comes before the ticks of its own time: those before it are not in the rest
    w = Window.partitionBy(*node).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, rest = w.orderBy("at", "kind"), w.orderBy(F.desc("at"), F.desc("kind"))
    edges = ends.unionByName(rows)
    for c in names:
        edges = edges.withColumn(c + "_before", F.sum(c).over(before))
    for c in names:
        edges = edges.withColumn(c + "_rest", F.sum(c).over(rest))
    edges = edges.filter("kind = 0").select("sample_id", *[F.when(F.col("rest"), F.col(c + "_rest")).otherwise(F.col(c + "_before")).alias(c) for c in names])
    return whole.unionByName(edges.filter("ticks > 0")).groupBy("sample_id").agg(*add)


def run_utilisation_matches(samples: DataFrame, ticks: DataFrame, on: str | None = None) -> DataFrame:
    """`utilisation_totals` of streams without a watermark, to be added up over the batches; rows of every age lie in files, not in state stores.

    A batch stores its rows and adds up its samples with all ticks so far and the earlier samples with its ticks. A batch that runs again reads only what the
    batches before it stored and gives the same totals. Of earlier rows those that cannot meet the batch's are left out.
    """
    device = [] if on is None else [on]
    s = samples.select(F.lit("sample").alias("side"), "sample_id", event_time().alias("ts"), "wall_s", *device)
    t = ticks.select(F.lit("tick").alias("side"), event_time().alias("ts"), F.col("util").cast("double").alias("util"), *device)
    both = s.unionByName(t, allowMissingColumns=True)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema)

    def step(batch, number, path):
        spark, store = batch.sparkSession, path + "-rows"
        batch.write.mode("overwrite").partitionBy("side").parquet(f"{store}/batch={number}")
        rows = spark.read.schema(kept + ", batch int").option("basePath", store).parquet(store)
        of = lambda side, which: rows.filter((F.col("side") == side) & which)
        new, old = F.col("batch") == number, F.col("batch") < number
        if number == 0:
            return utilisation_totals(of("sample", new), of("tick", new), on)
        micros = lambda d, *c: d.agg(*map(F.unix_micros, c)).first()
        low, high = micros(with_interval(of("sample", new)), F.min("start"), F.max("end"))
        first, last = micros(of("tick", new), F.min("ts"), F.max("ts"))
        time = lambda at: F.timestamp_micros(F.lit(at).cast("long"))
        now = utilisation_totals(of("sample", new), of("tick", new).unionByName(of("tick", old).filter(F.col("ts").between(time(low), time(high)))), on)
        early = with_interval(of("sample", old)).filter((F.col("start") <= time(last)) & (F.col("end") >= time(first))).drop("start", "end")
        return now.unionByName(utilisation_totals(early, of("tick", new), on))

    out = f"sample_id {both.schema['sample_id'].dataType.simpleString()}, util_sum double, util_n bigint, ticks bigint, batch int"
    return run_batches(both, step, schema=out).drop("batch")


def utilisation(samples: DataFrame, matches: DataFrame) -> DataFrame:
    """Mean utilisation per sample and busy = wall * mean / 100; null without ticks. `matches` are single ticks, or totals of them that are added up."""
    m = matches.groupBy("sample_id")
    if "util" in matches.columns:
        m = m.agg(F.avg("util").alias("util_mean"), F.count("*").alias("ticks"))
    else:
        m = m.agg(F.try_divide(F.sum("util_sum"), F.sum("util_n")).alias("util_mean"), F.sum("ticks").alias("ticks"))
    return samples.select("sample_id", "wall_s").join(m, "sample_id", "left").withColumn(
        "busy_s", F.col("wall_s") * F.col("util_mean") / 100.0)


def merged_scores(results: DataFrame, delay: str | None = None) -> DataFrame:
    """Current mean per metric over the shards seen so far: repeated results are dropped (with `delay`, within
    the watermark of their arrival), and each batch adds only its partial sums."""
    keys = ["name", "metric"]
    d = bounded(results, "arrived", delay).dropDuplicatesWithinWatermark(keys) if delay else results.dropDuplicates(keys)
    part = run_batches(d, lambda b, i, p: to_accum(b, ["metric"]), schema="metric string, s double, n bigint, batch int")
    return finalize(merge_accum(part, ["metric"]))


def near_pairs(raw: DataFrame, gen: DataFrame, on: list[str], within: str) -> DataFrame:
    """Rows of raw and gen (keys, arrived, value) of equal keys that arrived within a time of each other."""
    r = raw.select(*on, F.col("arrived").alias("ra"), F.col("value").alias("raw_value"))
    g = gen.select(*[F.col(c).alias("g_" + c) for c in on], F.col("arrived").alias("ga"), F.col("value").alias("gen_value"))
    cond = (F.col("ga") >= F.col("ra") - F.expr(f"INTERVAL {within}")) & (F.col("ga") <= F.col("ra") + F.expr(f"INTERVAL {within}"))
    for c in on:
        cond = cond & (F.col(c) == F.col("g_" + c))
    return r.join(g, cond).select(*on, "raw_value", "gen_value")


def pair_frames(raw: DataFrame, gen: DataFrame, on: list[str], delay: str | None = None, within: str = "1 hour") -> DataFrame:
    """Raw and generated records that arrive apart, joined on their keys within a time bound. The state store keeps both sides, or what `delay` leaves of them."""
    return near_pairs(bounded(raw, "arrived", delay), bounded(gen, "arrived", delay), on, within)


def run_pair_frames(raw: DataFrame, gen: DataFrame, on: list[str], within: str = "1 hour") -> DataFrame:
    """The same pairs of streams without a watermark, whose rows of every age must be kept: they lie in files, not in the executors' state stores.

    A batch stores its rows and gives the pairs with at least one new side: its raw rows with all generated ones so far, and earlier raw rows with its
    generated ones. A batch that runs again reads only what the batches before it stored and gives the same pairs. Earlier rows are read once a batch, those
    that arrived too far from the batch's rows left out; in files that hold a span of arrivals each, most are not read.
    """
    names = [*on, "arrived", "value"]
    side = lambda d, name: d.select(F.lit(name).alias("side"), *on, "arrived", "value")
    both = side(raw, "raw").unionByName(side(gen, "gen"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema)

    def step(batch, number, path):
        spark, store = batch.sparkSession, path + "-rows"
        batch.write.mode("overwrite").partitionBy("side").parquet(f"{store}/batch={number}")
        rows = spark.read.schema(kept + ", batch int").option("basePath", store).parquet(store)
        new, old = rows.filter(F.col("batch") == number), rows.filter(F.col("batch") < number)
        of = lambda d, name: d.filter(F.col("side") == name).select(*names)
        if number == 0:
            return near_pairs(of(new, "raw"), shuffled(of(new, "gen")), on, within)
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        low, high = new.agg(micros(F.min("arrived") - F.expr(f"INTERVAL {within}")), micros(F.max("arrived") + F.expr(f"INTERVAL {within}"))).first()
        old = old.filter(event_time("arrived").between(F.timestamp_micros(F.lit(low).cast("long")), F.timestamp_micros(F.lit(high).cast("long"))))
        now = near_pairs(of(new, "raw"), shuffled(of(new, "gen").unionByName(of(old, "gen"))), on, within)
        return now.unionByName(near_pairs(of(old, "raw"), shuffled(of(new, "gen")), on, within))

    value = both.schema["value"].dataType.simpleString()
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name in on)
    return run_batches(both, step, schema=f"{out}, raw_value {value}, gen_value {value}, batch int").drop("batch")


def enrich(frames: DataFrame, attrs: DataFrame, on: list[str]) -> DataFrame:
    """Static attributes attached to a stream."""
    return frames.join(attrs, on, "left")


def processors(df: DataFrame, chain: list) -> DataFrame:
    """Chain of functions that add columns; the same for a batch and a stream."""
    for fn in chain:
        df = df.transform(fn)
    return df


def best_so_far(df: DataFrame, key: str, value: str, epoch: str, init: float) -> DataFrame:
    """Best value per key with its first epoch, strictly better than the start; -1 when none."""
    parts = run_batches(df.select(key, value, epoch), lambda b, i, p: b.groupBy(key).agg(
        F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))).alias("m")))
    g = parts.groupBy(key).agg(F.max("m").alias("m"))
    ok = F.col("m.v") > init
    return g.select(key, F.when(ok, F.col("m.v")).otherwise(F.lit(init)).alias("best_res"),
                    F.when(ok, -F.col("m.e")).otherwise(F.lit(-1)).alias("best_ep"))


def object_registry(objects: DataFrame) -> DataFrame:
    """Registry ids in the order of first appearance (frame, object) over batches that arrive in that order.

    A batch takes the first appearance of each object, leaves out the objects that earlier batches numbered, and ranks the new ones over ranges of
    (frame, object), so that no task orders a whole batch. How many were numbered before is the sum of one stored count per batch. A batch that runs again reads
    what the batches before it wrote and gives the same ids.
    """
    schema = "obj_id int, first_frame bigint, phrase string, reg_id bigint, batch int"

    def step(batch, batch_id, path):
        spark = batch.sparkSession
        first = batch.groupBy("obj_id").agg(F.min("frame").alias("first_frame"), F.min_by("phrase", F.struct("frame", "phrase")).alias("phrase"))
        base = 0
        if batch_id > 0:
            known = spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("batch") < batch_id)
            first = first.join(known.select("obj_id"), "obj_id", "left_anti")
            counts = spark.read.schema("n bigint, batch int").option("basePath", path + "-counts").parquet(path + "-counts")
            base = counts.filter(F.col("batch") < batch_id).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        new = range_rank(first, ["first_frame", "obj_id"], "reg_id").withColumn("reg_id", F.col("reg_id") + base)
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        written = spark.read.schema(new.schema).parquet(f"{path}/batch={batch_id}")
        written.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}-counts/batch={batch_id}")
        return None

    return run_batches(objects, step, schema=schema).drop("batch")


def dirty_refresh(changes: DataFrame, keys: list[str], by: str, derived_schema: str, derive, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Keep rows derived per `by` in step with a stream of changed source rows; returns (source, derived) as the last batch left them.

    A change replaces the source row of its `keys` (the last one of a batch by arrival `seq`, where that column exists). The derived rows of the values of `by` that changed, and no others, are
    made again from all their source rows by `derive(rows)`. Both tables write the hash buckets of changed values only, under the number of the batch, so a
    repeated batch leaves the same rows.
    """
    spark = changes.sparkSession
    path = scratch(spark, "stream")
    kept = [f for f in changes.schema if f.name != "seq"]
    source = Upsert(spark, f"{path}/source", [by], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), buckets)
    derived = Upsert(spark, f"{path}/derived", [by], derived_schema, buckets)
    names = [f.name for f in kept]

    def step(batch, number):
        if "seq" in batch.columns:
            rest = [c for c in names if c not in keys]
            batch = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")
        dirty = batch.select(by).distinct()
        same = source.read(number).join(dirty, by, "left_semi").join(batch.select(*keys), keys, "left_anti")
        source.write(same.select(*names).unionByName(batch.select(*names)), dirty, number)
        now = source.read(number + 1).join(dirty, by, "left_semi")
        derived.write(derive(now), dirty, number)

    q = changes.writeStream.foreachBatch(step).option("checkpointLocation", path + "/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return source.read(), derived.read()


def run(stream: DataFrame) -> DataFrame:
    return run_append(stream)

"""Request logs: windowed counts, latencies, alerts and requests in flight."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift import constants as K
from pagesift.functions.joins import matched


def windowed_counts(log: DataFrame, by: str, width: int = 300, slide: int = 15) -> DataFrame:
    """Counts of each value of `by` in windows of `width` seconds that end every `slide` seconds (window_end, in epoch seconds).

    Rows are first counted in buckets of one slide; only those counts are copied to their windows.
    """
    small = log.groupBy(F.floor(F.unix_micros("ts") / (slide * 1_000_000)).alias("bucket"), by).agg(F.count("*").alias("n"))
    ends = F.explode(F.sequence(F.col("bucket") + 1, F.col("bucket") + width // slide))
    return small.select(ends.alias("end"), by, "n").groupBy((F.col("end") * slide).alias("window_end"), by).agg(F.sum("n").alias("n"))


def latency_histogram(log: DataFrame, by: str) -> DataFrame:
    """Cumulative counts of durations up to each bound, for each value of `by`; le is infinite for all."""
    sums = [F.sum((F.col("duration_s") <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(K.LATENCY_BOUNDS)]
    wide = log.where("duration_s is not null").groupBy(by).agg(*sums)
    bounds = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(K.LATENCY_BOUNDS)])
    return wide.select(by, F.inline(bounds))


def latency_totals(log: DataFrame, by: str) -> DataFrame:
    """What goes with the buckets: the sum and the count of durations of each value of `by`."""
    return log.where("duration_s is not null").groupBy(by).agg(F.round(F.sum("duration_s"), 6).alias("total"), F.count("*").alias("n"))


def histogram_quantile(histogram: DataFrame, by: str, q: float) -> DataFrame:
    """The quantile of each group, linear within its bucket; the last finite bound beyond it; null without rows."""
    order = W.partitionBy(by).orderBy("le")
    rows = histogram.withColumns(
        {
            "low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "before": F.coalesce(F.lag("n").over(order), F.lit(0)),
            "total": F.max("n").over(W.partitionBy(by))
        }
    )
    rows = rows.where(F.col("n") >= q * F.col("total")).withColumn("k", F.row_number().over(order)).where("k = 1")
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(
        q * F.col("total") - F.col("before"), (F.col("n") - F.col("before")).cast("double")
    )
    value = F.when(F.col("total") == 0, None).when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    return rows.select(by, F.round(value, 6).alias("quantile"))


def error_rate_alert(log: DataFrame, limit: float = 0.1, width: int = 300, slide: int = 15, hold: int = 300) -> DataFrame:
    """Spells (start, end in epoch seconds) in which over `limit` of the requests of a window failed, for `hold` seconds or more."""
    counts = windowed_counts(log.withColumn("failed", (F.col("status") >= 500).cast("int")), "failed", width, slide)
    steps = counts.groupBy("window_end").agg((F.sum(F.col("n") * F.col("failed")) / F.sum("n")).alias("share")).where(F.col("share") > limit)
    # a spell's parts lie in days of their own; only parts at a day's edge are put together, two for each day at most
    step = F.col("window_end") / slide
    steps = steps.withColumn("day", F.floor(F.col("window_end") / 86_400))
    island = step - F.row_number().over(W.partitionBy("day").orderBy("window_end"))
    parts = steps.withColumn("island", island).groupBy("day", "island").agg(F.min("window_end").alias("a"), F.max("window_end").alias("b"))
    edge = (F.col("a") == F.col("day") * 86_400) | (F.col("b") == F.col("day") * 86_400 + 86_400 - slide)
    order = W.orderBy("a")
    edges = parts.where(edge).withColumn("new", (F.col("a") > F.coalesce(F.lag("b").over(order), F.lit(-1)) + slide).cast("int"))
    joined = edges.withColumn("spell", F.sum("new").over(order)).groupBy("spell").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    spells = parts.where(~edge).select(F.col("a").alias("start"), F.col("b").alias("end")).unionByName(joined.select("start", "end"))
    return spells.where(F.col("end") - F.col("start") >= hold)


def in_flight(log: DataFrame, by: str, bucket: int = 3600) -> DataFrame:
    """Most requests of each group under way at once; one that ends as another starts counts no more.

    Sums of buckets of `bucket` seconds are added up over each group, and changes are put in order within a bucket alone.
    """
    start = F.unix_micros("ts")
    both = log.select(
        by,
        F.explode(
            F.array(
                F.struct(start.alias("at"), F.lit(1).alias("d")),
                F.struct((start + F.round(F.col("duration_s") * 1e6).cast("long")).alias("at"), F.lit(-1).alias("d"))
            )
        ).alias("e")
    )
    both = both.select(by, "e.at", "e.d").withColumn("bucket", F.floor(F.col("at") / (bucket * 1_000_000)))
    earlier = W.partitionBy(by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = both.groupBy(by, "bucket").agg(F.sum("d").alias("change")).select(
        by, "bucket", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("before")
    )
    order = W.partitionBy(by, "bucket").orderBy("at", "d").rowsBetween(W.unboundedPreceding, 0)
    tops = both.withColumn("now", F.sum("d").over(order)).groupBy(by, "bucket").agg(F.max("now").alias("now"))
    return matched(tops, sums, [by, "bucket"]).groupBy(by).agg(F.max(F.col("before") + F.col("now")).alias("most"))


def _changes(log: DataFrame, by: str) -> DataFrame:
    """by, at (epoch microseconds) and change of requests under way, one row for each moment at which any starts or ends; open ones start alone."""
    start = F.unix_micros("ts")
    end = start + F.round(F.col("duration_s") * 1e6).cast("long")
    ends = F.array(F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))
    return log.select(by, F.inline(ends)).where("at is not null").groupBy(by, "at").agg(F.sum("d").alias("change"))


def in_flight_changes(log: DataFrame, by: str, bucket: int = 3600) -> DataFrame:
    """by, at (epoch microseconds) and in_flight: the requests under way from each moment on at which their number changes.

    Sums of buckets of `bucket` seconds are added up over a group; moments are put in order within a bucket alone.
    """
    rows = _changes(log, by).withColumn("bucket", F.floor(F.col("at") / (bucket * 1_000_000)))
    earlier = W.partitionBy(by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(by, "bucket").agg(F.sum("change").alias("c")).select(by, "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    order = W.partitionBy(by, "bucket").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = matched(rows.withColumn("now", F.sum("change").over(order)), sums, [by, "bucket"])
    return rows.where("change <> 0").select(by, "at", (F.col("before") + F.col("now")).alias("in_flight"))


def in_flight_series(log: DataFrame, by: str, step: int = 15) -> DataFrame:
    """by, at (epoch seconds), in_flight and mean: every `step` seconds the requests under way, and their mean over the step, weighted by time.

    Each request counts towards two steps, which are summed before they are shuffled; levels are running sums over steps.
    Steps without a change carry the level on; those without any request under way give no row.
    """
    start = F.unix_micros("ts")
    end = start + F.round(F.col("duration_s") * 1e6).cast("long")
    ends = F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))
    size = step * 1_000_000
    rows = log.select(by, F.inline(ends)).where("t is not null").withColumn("k", F.floor(F.col("t") / size))
    sums = rows.groupBy(by, "k").agg(F.sum("d").alias("change"), F.sum(F.col("d") * ((F.col("k") + 1) * size - F.col("t"))).alias("area"))
    order = W.partitionBy(by).orderBy("k")
    sums = sums.withColumn("level", F.sum("change").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("following", F.lead("k").over(order))
    own = F.struct((F.col("k") + 1).alias("end"), F.round((F.col("level") - F.col("change")) + F.col("area") / size, 6).alias("mean"))
    carried = F.when(F.col("level") != 0, F.filter(F.sequence("k", F.coalesce("following", F.col("k") + 1) - 1), lambda x: x > F.col("k")))
    carried = F.coalesce(F.transform(carried, lambda x: F.struct((x + 1).alias("end"), F.col("level").cast("double").alias("mean"))), F.array().cast("array<struct<end:bigint,mean:double>>"))
    out = sums.select(by, "level", F.inline(F.concat(F.array(own), carried)))
    return out.where("level <> 0 or mean <> 0").select(by, (F.col("end") * step).alias("at"), F.col("level").alias("in_flight"), "mean")


def latency_stats(runs: DataFrame, by: str) -> DataFrame:
    """Of each group: runs, the percentage without a server error, and of those with a duration the mean, median and 95th
    percentile by the exclusive rule (place p (n + 1)).

    Durations are counted in ranges (even steps of their inverse hyperbolic sine); only the few ranges that hold a wanted
    place are put in order, each on its own.
    """
    rows = runs.withColumn("range", F.floor(F.asinh(F.col("duration_s") * 1000) * 64))
    ok = F.coalesce(F.col("status") < 500, F.lit(True)) if "status" in runs.columns else F.lit(True)
    good = F.sum(ok.cast("long"))
    every = rows.groupBy(by, "range").agg(F.count("*").alias("m"), F.sum("duration_s").alias("s"), good.alias("good"))
    counts = every.where("range is not null")
    group = W.partitionBy(by)
    counts = counts.withColumn("before", F.coalesce(F.sum("m").over(group.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("n", F.sum("m").over(group))
    low = F.greatest(F.lit(1), F.least(F.floor(19 * (F.col("n") + 1) / 20), F.col("n") - 1))
    # (place, weight of twentieths) of the two middle values and of the two around the percentile
    part = 19 * (F.col("n") + 1) - 20 * low
    half = F.floor((F.col("n") + 1) / 2)
    places = F.array(half, F.floor(F.col("n") / 2) + 1, low, low + 1)
    counts = counts.withColumns({"places": places, "part": part})
    holds = F.exists("places", lambda x: (x > F.col("before")) & (x <= F.col("before") + F.col("m")))
    wanted = counts.where(holds).select(by, "range", "before", "places", "part")
    picked = matched(rows.where("range is not null").select(by, "range", "duration_s"), wanted, [by, "range"])
    picked = picked.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy(by, "range").orderBy("duration_s")))
    at = lambda i: F.max(F.when(F.col("rank") == F.col("places")[i], F.col("duration_s")))
    values = picked.groupBy(by).agg(
        at(0).alias("x0"), at(1).alias("x1"), at(2).alias("x2"), F.coalesce(at(3), F.lit(0.0)).alias("x3"), F.max("part").alias("part")
    )
    timed = F.sum(F.when(F.col("range").isNotNull(), F.col("m")))
    totals = every.groupBy(by).agg(
        F.sum("m").alias("n"), F.round(F.sum("good") * 100.0 / F.sum("m"), 6).alias("success_rate"), F.round(F.sum("s") / timed, 6).alias("mean")
    )
    p95 = (F.col("x2") * (20 - F.col("part")) + F.col("x3") * F.col("part")) / 20
    return matched(totals, values, [by], "left").select(by, "n", "success_rate", "mean", F.round((F.col("x0") + F.col("x1")) / 2, 6).alias("median"), F.round(p95, 6).alias("p95"))


def top_errors(log: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent errors of failed requests; ties go to the lesser message."""
    return log.where("status >= 500").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(n)


def breaker_alert(states: DataFrame, by: str, width: int = 300, slide: int = 15, hold: int = 60) -> DataFrame:
    """Spells (start, end in epoch seconds) of each group in which some state of the last `width` seconds was above 0, from `hold` seconds on.

    states has ts and state. Steps are `slide` seconds apart; samples of one step are first made one.
    """
    step = F.ceil(F.unix_micros("ts") / (slide * 1_000_000))
    steps = states.where("state > 0").select(by, step.alias("step")).distinct()
    order = W.partitionBy(by).orderBy("step")
    new = (F.col("step") - F.coalesce(F.lag("step").over(order), F.lit(-(1 << 40))) > width // slide).cast("int")
    spells = steps.withColumn("new", new).withColumn("spell", F.sum("new").over(order)).groupBy(by, "spell").agg(
        F.min("step").alias("a"), F.max("step").alias("b")
    )
    end = (F.col("b") + width // slide - 1) * slide
    return spells.select(by, (F.col("a") * slide + hold).alias("start"), end.alias("end")).where(F.col("end") >= F.col("start"))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key from a hash of its id and text, divided by its quality weight: sorting by it is
weighted sampling without replacement. A source's target is met by complete epochs over it first; the rest is taken
from the start of its documents in key order, by a prefix sum of sizes against the budget left.

The prefix sum is in two steps, so that no source meets in one task: sums of ranges of keys, then a running sum within a
range. Ranges are even steps of the key's logarithm, `steps` to each doubling: whatever the weights, one holds at most
about a part of 4 * steps of a source, and a source has a bounded number of them. Targets come from one row a source.

Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, the last; ties of keys
(repeated rows) go by size; weights that are null or not positive count as 1. Only the columns named are read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.llm.common import saved


def with_size(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words of its text, counted as the starts of words."""
    spaces = F.regexp_replace(F.concat(F.lit(" "), F.coalesce("text", F.lit(""))), r"[^\x20\x09-\x0D]+", "x")
    return docs.withColumn("size", F.length(F.regexp_replace(spaces, r"[\x20\x09-\x0D]+", "")).cast("long"))


def targets(sizes: DataFrame, most: float = 3.0, weights: int = 3) -> DataFrame:
    """source, source_size, target from sizes(source, source_size), one row for each source.

    Sources by code point, null last, weigh 1, 2, ... `weights`, repeating. Targets share all words by weight; a target
    stops at `most` times its source's size and the excess goes to the others by weight. In order of the factor at which
    each source stops, the factor of all later ones is what is left over the weight left; it stops where it is enough.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % weights + 1).cast("double"))
    w = w.withColumn("stop", most * F.col("source_size") / F.col("weight"))
    by_stop = W.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    from_here = W.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(by_stop), F.lit(0))
    w = w.withColumn("factor", left / F.sum("weight").over(from_here))
    factor = F.min(F.when(F.col("stop") >= F.col("factor"), F.struct("stop", "factor"))).over(everything)["factor"]
    return w.select("source", "source_size", F.least(most * F.col("source_size"), F.coalesce(factor, F.lit(0.0)) * F.col("weight")).alias("target"))


def quality(text: str = "text"):
    """Between 0.25 and 1: the share of letters and white space among a text's characters; null and empty texts have 0.25."""
    other = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return 0.25 + 0.75 * F.coalesce(1 - F.try_divide(other.cast("double"), F.length(text)), F.lit(0.0))


def _same(a: str, b: str):
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df to be broadcast if it is a saved table of a few rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, weight) with size and key, its exponential key over its quality weight."""
    unit = (F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    return with_size(docs).withColumn("key", -F.log(unit) / weight)


def mix(docs: DataFrame, most: float = 3.0, steps: int | None = None, held: int = 4096) -> DataFrame:
    """doc_id, source, key, size, source_size, target, epochs and taken of every row of docs(doc_id, text, source, weight).

    A document is in the mix taken / size times: epochs times, and once more at the start of its source's order. Keys are put
    in order in ranges of even steps of their logarithm, as fine as it takes for one to hold about `held` rows at most (a
    step of an octave / n holds a quarter of an n-th of a source, where keys are densest); repeated rows share a key.
    """
    rows = saved(keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "key"))
    sizes = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = saved(targets(sizes, most))
    steps = steps or max(256, rows.count() // (4 * held))
    place = F.floor(F.log2("key") * steps).cast("long")
    out = rows.alias("r").join(_small(goals).alias("g"), _same("r", "g")).select("r.*", "source_size", "target", place.alias("place"))
    before = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    ranges = out.groupBy("source", "place").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = out.alias("o").join(ranges.alias("s"), _same("o", "s") & (F.col("o.place") == F.col("s.place"))).select("o.*", "before")
    inside = W.partitionBy("source", "place").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    more = (ahead + F.col("size") / 2.0 <= F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("taken", F.least(F.col("epochs") + more, F.lit(int(most))) * F.col("size"))
    return out.select("doc_id", "source", "key", "size", "source_size", "target", "epochs", "taken")


def mixed_copies(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """docs, each row as often as the mix takes it; its columns doc_id, text, source and weight are read, all are returned but weight.

    What is taken of a source is a start of its order, so the last key taken decides row by row, without moving texts.
    """
    taken = saved(mix(docs, most))
    last = F.max(F.when((F.col("taken") > F.col("epochs") * F.col("size")), F.struct("key", "doc_id", "size")))
    ends = saved(taken.groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("last")))
    whole = F.struct(*[c for c in docs.columns if c != "weight"]).alias("whole")
    here = F.struct("d.key", F.col("d.doc_id").cast("long").alias("doc_id"), "d.size")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + F.coalesce((here <= F.col("last")).cast("long"), F.lit(0)))
    rows = keyed(docs.select(whole, "doc_id", "text", "source", "weight")).alias("d").join(_small(ends).alias("e"), _same("d", "e")).where(copies > 0)
    return rows.select("whole", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select("whole.*")

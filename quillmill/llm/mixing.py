"""Operator 9: mix sources to target weights, with DataFrame functions only.

Efraimidis-Spirakis sampling: a document of weight w and uniform u gets the
exponential key -ln(u)/w; keys in ascending order are a weighted sample
without replacement. Whole epochs of a source come first, then the prefix of
its keys that fills what is left of its budget.

The prefix sum is taken in two levels, since one source may hold a third of
all rows: the keys of a source with n documents are cut into about sqrt(n)
buckets by a monotone map, sums run inside a bucket, and the buckets' totals
give each bucket its start, so no task sorts more than some sqrt(n) rows of a
source at a time. Buckets are even for quality weights within a factor of about
four of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.llm.store import materialize
from quillmill.llm.text import count_words

#: Documents of a source that may be left to fill its gap one by one; more are filled by another prefix.
FILL = 1024
#: 13 hex digits of MD5 are 52 bits: exact in a double.
_SPAN = float(2**52)


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) from the id alone, so reruns agree."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(_SPAN)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes``, one row (source, source_size, ...) per source, with ``target``.

    Sources by code point, null last, get ``weights`` in rotation and share
    ``share`` times the total. A target stops at ``most`` times its source's
    size and the excess is shared again by weight. That fixed point is a level
    L with target = min(most * size, L * weight): sources sorted by
    most * size / weight are capped up to the first whose ratio reaches the
    level that the others would get. One row per source takes part.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("nth", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "nth").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("weight_sum", F.sum("weight").over(everything))
    # the level if all before this source are capped and it is not
    ranked = ranked.withColumn("level", (F.col("total") * share - F.col("capped_before")) / (F.col("weight_sum") - F.col("weight_before")))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(everything)
    ranked = ranked.withColumn("fixed", level["level"])
    target = F.least("cap", F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap")))
    return ranked.select(*sizes.columns, target.alias("target"))


def _sums(rows: DataFrame) -> DataFrame:
    """``rows`` (source, bucket, rank_key, doc_id, size) with ``upto``, the sum of the sizes in the order of keys."""
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("source", "bucket").orderBy(F.col("rank_key").desc(), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(inside))
    rows = rows.alias("r").join(starts.alias("s"), F.expr("r.source <=> s.source and r.bucket = s.bucket")).select("r.*", "s.start")
    return rows.withColumn("upto", F.col("start") + F.col("within")).drop("start", "within")


def mix(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", row_col: str | None = None, **targets) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``, and ``row, times`` if ``row_col`` names a unique long.

    ``taken`` is size times the whole epochs, plus size once more if the
    document falls into the fractional selection: the prefix of the source's
    keys whose sum is within the budget, and of all later documents in the order
    of keys those that still fit. ``quality`` is a positive weight (null or not positive: 1). Null text has size 0, rows
    with a null source form a source, ties of the key go by id, and an empty
    table gives an empty result. Other columns are ignored.
    """
    weight = F.lit(1.0) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    rows = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        count_words(F.col(text_col)).alias("size"),
        F.pow(uniform(F.col(id_col), seed), 1 / weight).alias("rank_key"),
    )
    rows = materialize(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = source_targets(sizes, **targets)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("n_buckets", F.greatest(F.lit(1), F.ceil(F.sqrt("n_docs"))))
    plan = materialize(plan, "mix-plan")

    rows = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source")).select("r.*", "source_size", "target", "epochs", "budget", "n_buckets")
    # u**(1/w), largest first, is the order of -ln(u)/w
    rows = rows.withColumn("bucket", F.least(F.floor((1 - F.col("rank_key")) * F.col("n_buckets")), F.col("n_buckets") - 1))
    rows = _sums(rows)
    rows = materialize(rows.withColumn("chosen", F.col("upto") <= F.col("budget")), "mix-chosen")

    # What the prefix leaves open is filled in key order from the documents that still fit. A prefix of these takes what
    # one by one would take up to the first that does not fit; the rest that fits the new gap goes the same way.
    gaps = rows.groupBy("source").agg((F.first("budget") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("gap"))
    left = rows.filter("not chosen and size > 0")
    filled = []
    while True:
        left = left.select("row", "doc_id", "source", "size", "rank_key", "bucket").alias("r").join(gaps.alias("g"), F.expr("r.source <=> g.source and r.size <= g.gap"))
        left = materialize(left.select("r.*", "g.gap"), "mix-left")
        if (left.groupBy("source").count().agg(F.max("count")).first()[0] or 0) <= FILL:
            break
        left = materialize(_sums(left).withColumn("fits", F.col("upto") <= F.col("gap")), "mix-filled")
        filled.append(left.filter("fits").select(F.col("row").alias("extra")))
        gaps = left.groupBy("source").agg((F.first("gap") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("gap"))
        left = left.filter("not fits")
    lists = left.groupBy("source").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct((-F.col("rank_key")).alias("k"), "doc_id", "row", "size"))).alias("next"))
    state = F.struct(F.col("gap"), F.array().cast("array<bigint>").alias("rows"))

    def fill(acc: Column, d: Column) -> Column:
        fits = d["size"] <= acc["gap"]
        return F.struct(F.when(fits, acc["gap"] - d["size"]).otherwise(acc["gap"]).alias("gap"), F.when(fits, F.array_append(acc["rows"], d["row"])).otherwise(acc["rows"]).alias("rows"))

    extra = lists.select(F.explode(F.aggregate("next", state, fill, lambda acc: acc["rows"])).alias("extra"))
    for more in filled:
        extra = extra.unionByName(more)
    rows = rows.join(extra, F.col("row") == F.col("extra"), "left")
    times = F.col("epochs") + F.when(F.col("chosen") | F.col("extra").isNotNull(), 1).otherwise(0)
    extra = ["row", times.cast("int").alias("times")] if row_col else []
    return rows.select(*extra, "doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))

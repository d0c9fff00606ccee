"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame
functions only.

Every document gets the exponential key -ln(u) / quality weight. A source first takes
its complete epochs; the rest of its budget goes to its documents in key order until
the prefix sum of sizes reaches it. A source is never sorted as a whole: keys fall into
buckets of about `BUCKET_ROWS` documents, sizes are summed per bucket, and only the one
bucket in which the budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix"
BUCKET_ROWS = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def uniform(id_text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, n) to the same with `target`.

    Weights repeat over the sources in code point order, null last. What a source cannot
    take within its cap is shared again by weight. The end of that process is one water
    level: sources are ordered by cap per weight, and the level is set by the first one
    that it does not fill. One row per source reaches this step, so its windows are small.
    """
    position = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), position))
    weighted = weighted.withColumn("cap", F.col("source_size") * float(MOST_EPOCHS))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * share
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighted.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank"))
    final = F.min_by("level", fits).over(everything)
    target = F.coalesce(F.least("cap", final * F.col("weight")), F.col("cap"))
    return levels.select("source", "source_size", "n", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    quality: Column | None = None,
    quality_of: DataFrame | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken,
    text_hash (xxhash64 of the text, to find the row again when its id is null or repeats).

    `quality` is a positive weight (default 1; null or not positive counts as 1), or it
    comes from the table `quality_of` (id, weight), of which the largest weight per id
    counts; that table meets the sizes of documents, never their texts.
    `copies` is how often the mix takes the document, `taken` its words times that. Of a
    source, full epochs come first; the document at which the rest of the budget ends is
    taken when that brings the sum nearer to the target. Null text has size 0, a null
    source is a source of its own, a null id draws like an empty one. Equal keys are
    ordered by id and size; repeated rows are rows of their own with equal keys. Only the
    named columns are read. An empty table gives no rows.
    """
    sized = cut_lineage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("text_hash"),
            (F.lit(1.0) if quality is None else quality.cast("double")).alias("raw"),
        )
    )
    if quality_of is not None:
        of, weight_name = quality_of.columns
        given = quality_of.groupBy(F.col(of).cast("long").alias("of")).agg(F.max(F.col(weight_name).cast("double")).alias("given"))
        sized = sized.join(given, sized.doc_id == given.of, "left").withColumn("raw", F.coalesce("given", "raw")).drop("of", "given")
    weight = F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.lit(1.0))
    sized = sized.withColumn("key", -F.log(uniform(F.col("doc_id").cast("string"), seed)) / weight).drop("raw")
    sized = cut_lineage(sized)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    planned = targets(sums, weights, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    planned = cut_lineage(
        planned.withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
        .withColumnRenamed("source", "name")
    )
    joined = sized.join(planned, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # 1 - exp(-key) is uniform for weight 1, so buckets hold about as many rows each.
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1)
    placed = cut_lineage(joined.withColumn("bucket", bucket))
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("budget"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = per_bucket.withColumn("upto", upto).filter(F.col("upto") >= F.col("budget"))
    last = cut_lineage(
        ends.groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
        .select(F.col("source").alias("name"), F.col("end.bucket").alias("end"), F.col("end.before").alias("before"))
    )
    known = placed.join(last, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    inside = Window.partitionBy("source").orderBy("key", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = known.filter(F.col("bucket") == F.col("end")).withColumn("through", F.col("before") + F.sum("size").over(inside))
    over = F.col("through") - F.col("rest")
    under = F.col("rest") - (F.col("through") - F.col("size"))
    edge = edge.withColumn("chosen", (over <= 0) | ((under > 0) & (over < under))).drop("through")
    # Without an end all buckets are inside the budget (it can only be met exactly).
    others = known.filter(F.coalesce(F.col("bucket") != F.col("end"), F.lit(True)))
    others = others.withColumn("chosen", F.coalesce(F.col("bucket") < F.col("end"), F.lit(True)))
    copies = F.col("epochs") + F.col("chosen").cast("long")
    return edge.unionByName(others).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "text_hash"
    )

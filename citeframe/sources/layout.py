"""The stored layout of extraction runs, in place of the indexes of a database.

Runs lie in buckets by organization, one file a bucket, sorted by organization, deal and
start. A lookup by organization reads one bucket, by deal only the row groups that may hold
it; what is asked per organization, such as the newest run of each deal, needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_BUCKETS = 64
ORDER = ["organization_id", "deal_id", "started_at"]


def write_runs(runs: DataFrame, name: str, path: str | None = None, buckets: int = RUN_BUCKETS) -> None:
    """Writes `runs` (organization_id, deal_id, started_at, ...) as the table `name`. The
    rows are dealt like the buckets, so that a bucket is one file. An organization with very
    many runs makes one large file, which readers split."""
    writer = runs.repartition(buckets, "organization_id").write.bucketBy(buckets, "organization_id").sortBy(*ORDER)
    (writer.option("path", path) if path else writer).mode("errorifexists").saveAsTable(name)


def runs_of(spark: SparkSession, name: str, organization_id, deal_id=None) -> DataFrame:
    """The runs of an organization, or of one of its deals, newest first."""
    found = spark.table(name).filter(F.col("organization_id") == organization_id)
    if deal_id is not None:
        found = found.filter(F.col("deal_id") == deal_id)
    return found.orderBy(F.desc("started_at"), F.desc("run_id"))


def newest_runs(spark: SparkSession, name: str) -> DataFrame:
    """The newest run of every deal, with `runs`, how many the deal has. Ties go to the
    greater run id."""
    deal = Window.partitionBy("organization_id", "deal_id")
    newest = deal.orderBy(F.desc("started_at"), F.desc("run_id"))
    ranked = spark.table(name).withColumn("_place", F.row_number().over(newest)).withColumn("runs", F.count(F.lit(1)).over(deal))
    return ranked.filter("_place = 1").drop("_place")

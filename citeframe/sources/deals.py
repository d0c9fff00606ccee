"""Deal files: JSON folders in, keyed snapshots out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_deal_files(spark: SparkSession, folder: str) -> DataFrame:
    """deal_id and content of every deal file; page sidecars are left out by name
    before any file is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.json")
        .load(folder)
        .filter(~F.col("path").endswith(".pages.json"))
    )
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("deal_id"), F.col("content").cast("string").alias("profile")
    )


def list_deals(spark: SparkSession, folder: str) -> DataFrame:
    return read_deal_files(spark, folder).select("deal_id").orderBy("deal_id")


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of every sidecar file, in list order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pages.json").load(folder)
    parsed = files.select(
        F.regexp_extract("path", r"([^/]+)\.pages\.json$", 1).alias("deal_id"),
        F.from_json(
            F.col("content").cast("string"), "array<struct<file_name:string,page_number:int,text:string>>"
        ).alias("_pages"),
    )
    return parsed.select("deal_id", F.posexplode_outer("_pages").alias("page_ord", "_p")).select(
        "deal_id", "page_ord", "_p.file_name", "_p.page_number", "_p.text"
    )


def merge_profiles(current: DataFrame | None, saved: DataFrame) -> DataFrame:
    """The profile snapshot after a batch of saves: the last save per id wins, ids
    not saved stay, a save without an id gets a new one. `saved`: deal_id, profile,
    save_ord; `current`: deal_id, profile."""
    named = saved.withColumn("deal_id", F.coalesce("deal_id", F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    latest = named.groupBy("deal_id").agg(F.max_by("profile", "save_ord").alias("profile"))
    if current is None:
        return latest
    return current.join(latest, "deal_id", "left_anti").select("deal_id", "profile").unionByName(latest)


def write_snapshot(profiles: DataFrame, path: str) -> None:
    """Writes a complete snapshot to a new version path; readers switch to it only
    when the write has finished."""
    profiles.write.mode("errorifexists").parquet(path)

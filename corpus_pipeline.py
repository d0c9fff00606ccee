"""A training-corpus pipeline: each stage works on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the docs of the next one. All but the last return the columns of `docs`.
Rows with a null doc_id are scored, cleaned and mixed like others; near dedup and
decontamination, which name documents by id, keep them. Rows that repeat an id stay or
go together there. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeframe.llm import decontaminate, lines, mixing, near_dedup, toxicity
from citeframe.llm.catalog import quality_weights, toxicity_model
from citeframe.session import cut_lineage, shared_folder

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    scored = toxicity.score(rows, toxicity_model(spark, docs, sf_dir), ["doc"])
    return scored.filter(F.col("predicted") == 0).select("doc.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; every document stays."""
    cleaned = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    out = lines.drop_boilerplate(docs, "source")
    return out.select(*[cleaned.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id."""
    linked = near_dedup.link_near_duplicates(docs)
    dropped = linked.filter(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; items shorter than a shingle drop nothing."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=False)
    dropped = cut_lineage(leaks.select("doc_id").distinct())
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with `copies`, how often, and `taken`, their words.
    These two replace columns of documents of the same name."""
    plan = mixing.mix_sources(docs, quality_of=quality_weights(spark, sf_dir))
    # Rows that share source, id and text differ in copies only where the budget ends.
    groups = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "text_hash").agg(
        F.max("copies").alias("_high"),
        F.min("copies").alias("_low"),
        F.first("size").alias("_size"),
        F.sum("copies").alias("_copies"),
        F.count(F.lit(1)).alias("_rows"),
    )
    taken = cut_lineage(groups.filter("_high > 0"))
    # A row travels as one struct, so that no column of documents clashes with those made here.
    whole = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("_doc"), F.col("source").alias("_from"), F.xxhash64("text").alias("_hash")
    )
    same = (
        F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("text_hash"))
    )
    split = taken.filter("_low < _high")
    rows = whole.join(taken.filter("_low = _high"), same).select("doc", "_size", F.col("_high").alias("copies"))
    if not split.isEmpty():
        place = F.row_number().over(Window.partitionBy("_source", "_id", "text_hash").orderBy(F.xxhash64("doc")))
        above = F.col("_copies") - F.col("_low") * F.col("_rows")  # counts differ by one at most
        copies = F.when(place <= above, F.col("_high")).otherwise(F.col("_low"))
        rest = whole.join(split, same).select("doc", "_size", copies.alias("copies")).filter("copies > 0")
        rows = rows.unionByName(rest)
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in ("copies", "taken")]
    return rows.select(*own, "copies", (F.col("_size") * F.col("copies")).alias("taken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("near dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{root}/{number}")
        docs = spark.read.parquet(path)
    return docs

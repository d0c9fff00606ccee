"""Accuracy against known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def values_match(exp_num: Column, exp_text: Column, act_num: Column, act_text: Column) -> Column:
    """Numbers within max(1.0, 1 %) of the expected one, text equal without case
    and outer blanks, null only equal to null. The floor of 1.0 is coarse for rates
    and kept as it is."""
    numbers = F.abs(exp_num - act_num) <= F.greatest(F.lit(1.0), F.abs(exp_num) * 0.01)
    texts = F.lower(strip(exp_text)) == F.lower(strip(act_text))
    nothing = exp_num.isNull() & exp_text.isNull() & act_num.isNull() & act_text.isNull()
    return (
        F.when(exp_num.isNotNull() & act_num.isNotNull(), numbers)
        .when(exp_text.isNotNull() & act_text.isNotNull(), texts)
        .otherwise(nothing)
    )


def score_cases(expected: DataFrame, actual: DataFrame, failed: DataFrame) -> DataFrame:
    """Expected fields with `correct`. Fields nobody expects are not scored, an
    absent value is a miss, and cases in `failed` (case_id) have no scored fields."""
    act = actual.select(
        "case_id", "field_name", F.col("num_value").alias("act_num"), F.col("text_value").alias("act_text")
    )
    return (
        expected.join(failed.select("case_id").distinct(), "case_id", "left_anti")
        .join(act, ["case_id", "field_name"], "left")
        .withColumn(
            "correct", values_match(F.col("exp_num"), F.col("exp_text"), F.col("act_num"), F.col("act_text"))
        )
    )


def case_accuracy(cases: DataFrame, scored: DataFrame, failed: DataFrame) -> DataFrame:
    """Correct, total and accuracy per case; accuracy is null for a failed or empty
    case. `cases`: case_id, suite."""
    counts = scored.groupBy("case_id").agg(
        F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    errors = failed.select("case_id", F.col("error"))
    return (
        cases.join(counts, "case_id", "left")
        .join(errors, "case_id", "left")
        .select(
            "case_id", "suite",
            F.coalesce("correct", F.lit(0)).alias("correct"),
            F.coalesce("total", F.lit(0)).alias("total"),
            "error",
        )
        .withColumn(
            "accuracy", F.when(F.col("error").isNull(), F.try_divide("correct", F.nullif(F.col("total"), F.lit(0))))
        )
    )


def suite_report(accuracy: DataFrame) -> DataFrame:
    """Totals per suite and over all suites (suite null), failed cases left out."""
    scored = F.col("error").isNull()
    return (
        accuracy.rollup("suite")
        .agg(
            F.count(F.lit(1)).alias("cases"),
            F.count_if(~scored).alias("failed_cases"),
            F.coalesce(F.sum(F.when(scored, F.col("correct"))), F.lit(0)).alias("correct"),
            F.coalesce(F.sum(F.when(scored, F.col("total"))), F.lit(0)).alias("total"),
        )
        .withColumn("accuracy", F.try_divide("correct", F.nullif(F.col("total"), F.lit(0))))
    )

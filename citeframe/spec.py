"""The field specification: one row per deal value field, driving every rule."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Deal value fields in schema order as (name, type).
REPE_FIELDS = [
    ("deal_name", "text"),
    ("location", "text"),
    ("transaction_type", "text"),
    ("asking_price", "double"),
    ("property_name", "text"),
    ("property_type", "text"),
    ("address", "text"),
    ("market", "text"),
    ("submarket", "text"),
    ("units", "int"),
    ("square_feet", "double"),
    ("year_built", "int"),
    ("occupancy_rate", "double"),
    ("annual_revenue", "double"),
    ("operating_expenses", "double"),
    ("noi", "double"),
    ("cap_rate", "double"),
    ("loan_amount", "double"),
    ("interest_rate", "double"),
    ("ltv", "double"),
    ("loan_term_years", "int"),
    ("sponsor_name", "text"),
    ("sponsor_equity", "double"),
    ("investment_strategy", "text"),
    ("business_plan", "text"),
]

# The company-acquisition variant of the profile.
PE_FIELDS = [
    ("deal_name", "text"),
    ("location", "text"),
    ("transaction_type", "text"),
    ("asking_price", "double"),
    ("company_name", "text"),
    ("industry", "text"),
    ("subsector", "text"),
    ("employee_count", "int"),
    ("ownership_type", "text"),
    ("annual_revenue", "double"),
    ("gross_profit", "double"),
    ("ebitda", "double"),
    ("adjusted_ebitda", "double"),
    ("free_cash_flow", "double"),
    ("capex", "double"),
    ("working_capital", "double"),
    ("debt", "double"),
    ("cash", "double"),
    ("seller_rollover", "double"),
    ("earnout", "double"),
    ("seller_financing", "double"),
    ("customer_concentration", "text"),
    ("revenue_quality", "text"),
]

# Profile fields that describe the extraction or its review.
BOOKKEEPING_FIELDS = [
    "missing_information",
    "conflicting_information",
    "uncertain_information",
    "evidence",
    "withheld_values",
    "possible_conflicts",
    "corrected_fields",
    "review_feedback",
    "review_status",
]

# Which fields are percentages, summarized narratives, money.
PERCENT_FIELDS = ["cap_rate", "interest_rate", "ltv", "occupancy_rate"]
QUOTE_ONLY_FIELDS = ["business_plan", "investment_strategy"]

# Inclusive bounds (lower, upper) per field; None is open.
BOUNDS = {
    "annual_revenue": (0, None),
    "asking_price": (0, None),
    "cap_rate": (0, 100),
    "interest_rate": (0, 100),
    "loan_amount": (0, None),
    "loan_term_years": (0, None),
    "ltv": (0, 100),
    "occupancy_rate": (0, 100),
    "operating_expenses": (0, None),
    "sponsor_equity": (0, None),
    "square_feet": (0, None),
    "units": (0, None),
    "year_built": (1700, 2100),
}

# The kinds of number in text that can support each field.
NUMBER_KINDS = {
    "annual_revenue": ["currency", "plain"],
    "asking_price": ["currency", "plain"],
    "cap_rate": ["percent", "plain"],
    "interest_rate": ["percent", "plain"],
    "loan_amount": ["currency", "plain"],
    "loan_term_years": ["plain", "years"],
    "ltv": ["percent", "plain"],
    "noi": ["currency", "plain"],
    "occupancy_rate": ["percent", "plain"],
    "operating_expenses": ["currency", "plain"],
    "sponsor_equity": ["currency", "plain"],
    "square_feet": ["area", "plain"],
    "units": ["plain", "units"],
    "year_built": ["plain", "years"],
}

# Text a model may write in place of null.
PLACEHOLDERS = [
    "", "-", "--", "n.a", "n/a", "na", "none", "not applicable", "not available", "not disclosed",
    "not provided", "not specified", "not stated", "null", "tbd", "undisclosed", "unknown", "unspecified",
]

SPEC_SCHEMA = T.StructType(
    [
        T.StructField("field_ord", T.IntegerType(), False),
        T.StructField("field_name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("lower", T.DoubleType(), True),
        T.StructField("upper", T.DoubleType(), True),
        T.StructField("percent", T.BooleanType(), False),
        T.StructField("quote_only", T.BooleanType(), False),
        T.StructField("kinds", T.ArrayType(T.StringType(), False), False),
    ]
)


def spec_rows(fields=None) -> list[tuple]:
    rows = []
    for ord_, (name, kind) in enumerate(fields or REPE_FIELDS):
        lower, upper = BOUNDS.get(name, (None, None))
        rows.append(
            (
                ord_,
                name,
                kind,
                None if lower is None else float(lower),
                None if upper is None else float(upper),
                name in PERCENT_FIELDS,
                name in QUOTE_ONLY_FIELDS,
                NUMBER_KINDS.get(name, ["plain"]),
            )
        )
    return rows


def field_spec(spark: SparkSession, fields=None) -> DataFrame:
    """The specification as a table: at most one row per profile field (25), so
    broadcasting it is safe at any data size."""
    return spark.createDataFrame(spec_rows(fields), SPEC_SCHEMA)


def constant(value, type_: str) -> Column:
    """A constant of any shape as one expression, which the optimizer folds into a
    literal. Rules stay small in the plan however many entries they have."""
    return F.from_json(F.lit(json.dumps(value)), type_)


def literal_map(pairs: dict) -> Column:
    """A constant map from text to text, numbers or lists of text."""
    first = next(iter(pairs.values()))
    value_type = "array<string>" if isinstance(first, list) else "double" if isinstance(first, float) else "string"
    return constant(pairs, f"map<string,{value_type}>")


def is_numeric(field: Column) -> Column:
    return field.isin([name for name, kind in REPE_FIELDS if kind != "text"])


def is_integer(field: Column) -> Column:
    return field.isin([name for name, kind in REPE_FIELDS if kind == "int"])


def is_percent(field: Column) -> Column:
    return field.isin(PERCENT_FIELDS)


def is_quote_only(field: Column) -> Column:
    return field.isin(QUOTE_ONLY_FIELDS)


def accepts_kind(field: Column, kind: Column) -> Column:
    """Whether a number of `kind` in the text can support `field`."""
    return F.coalesce(
        F.array_contains(F.try_element_at(literal_map(NUMBER_KINDS), field), kind), F.lit(False)
    )


def bounds(field: Column) -> tuple[Column, Column]:
    """The inclusive bounds of a field, null where it is open."""
    lower = literal_map({name: float(low) for name, (low, _) in BOUNDS.items() if low is not None})
    upper = literal_map({name: float(high) for name, (_, high) in BOUNDS.items() if high is not None})
    return F.try_element_at(lower, field), F.try_element_at(upper, field)


def in_bounds(field: Column, value: Column) -> Column:
    low, high = bounds(field)
    return F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))

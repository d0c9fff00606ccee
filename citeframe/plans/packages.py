"""Order packages: page text and proposals derived from orders and lineitem.

One deal per order; page 1 states the order, each line is a further page. The
SQL twins below build the same rows for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import spread, table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

SQL_LINES = """
lines AS (
  SELECT l_orderkey AS deal_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS rk,
         l_linenumber AS line_no, round(l_quantity, 2) AS quantity, round(l_extendedprice, 2) AS price,
         round(l_discount * 100, 2) AS discount, round(l_tax * 100, 2) AS tax
  FROM lineitem)
"""

# The planting rules for the asking price, first match wins.
SQL_RULE = """
CASE WHEN o_orderkey % 11 = 0 THEN 'no_evidence'
     WHEN o_orderkey % 13 = 0 THEN 'page_not_in_document'
     WHEN o_orderkey % 17 = 0 THEN 'snippet_too_short'
     WHEN o_orderkey % 19 = 0 THEN 'snippet_not_on_page'
     WHEN o_orderkey % 23 = 0 THEN 'value_not_in_snippet'
     WHEN o_orderkey % 29 = 0 THEN 'model_uncertain'
     WHEN o_orderkey % 31 = 0 THEN 'model_conflicting'
     WHEN o_orderkey % 37 = 0 THEN 'model_listed_as_missing'
     WHEN o_orderkey % 41 = 0 THEN 'conflicting_evidence' END
"""


def planted_rule(key: Column) -> Column:
    rules = [
        (11, "no_evidence"), (13, "page_not_in_document"), (17, "snippet_too_short"), (19, "snippet_not_on_page"),
        (23, "value_not_in_snippet"), (29, "model_uncertain"), (31, "model_conflicting"),
        (37, "model_listed_as_missing"), (41, "conflicting_evidence"),
    ]
    result = F.when(key % rules[0][0] == 0, F.lit(rules[0][1]))
    for modulus, name in rules[1:]:
        result = result.when(key % modulus == 0, F.lit(name))
    return result


def money(value: Column) -> Column:
    return F.format_number(value, 2)


def file_name(key: Column) -> Column:
    return F.concat(F.lit("order_"), key.cast("string"), F.lit(".pdf"))


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their rank inside the order (the page order)."""
    lines = table(spark, sf_dir, "lineitem").select(
        *LINE_ORDER, "l_orderkey", "l_quantity", "l_discount", "l_tax"
    )
    return lines.withColumn("rk", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


def package_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("deal_id"),
        F.lit(0).alias("page_ord"),
        file_name(F.col("o_orderkey")).alias("file_name"),
        F.lit(1).alias("page_number"),
        F.concat(
            F.lit("Order Number: "), F.col("o_orderkey").cast("string"),
            F.lit("\nAsking Price: $"), money(F.col("o_totalprice")),
            F.lit("\nStatus: "), F.col("o_orderstatus"),
            F.lit("\nPriority: "), F.col("o_orderpriority"),
        ).alias("text"),
    )
    lines = line_pages(spark, sf_dir).select(
        F.col("l_orderkey").alias("deal_id"),
        F.col("rk").alias("page_ord"),
        file_name(F.col("l_orderkey")).alias("file_name"),
        (F.col("rk") + 1).alias("page_number"),
        F.concat(
            F.lit("Line "), F.col("l_linenumber").cast("string"),
            F.lit("\nQuantity: "), money(F.col("l_quantity")),
            F.lit("\nExtended Price: $"), money(F.col("l_extendedprice")),
            F.lit("\nDiscount: "), money(F.col("l_discount") * 100), F.lit("%"),
            F.lit("\nTax: "), money(F.col("l_tax") * 100), F.lit("%"),
        ).alias("text"),
    )
    return orders.unionByName(lines)


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pages(spark, sf_dir).filter(F.col("rk") == 1).select(
        F.col("l_orderkey").alias("deal_id"),
        F.round("l_extendedprice", 2).alias("price"),
        F.round(F.col("l_discount") * 100, 2).alias("discount"),
    )


def proposed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asking_price and property_type from the order, noi and cap_rate from its
    first line. Rule 23 proposes one dollar too much."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deal_id"), F.round("o_totalprice", 2).alias("price"), "o_orderpriority"
    )
    rule = planted_rule(F.col("deal_id"))
    price = F.when(rule == "value_not_in_snippet", F.col("price") + 1).otherwise(F.col("price"))
    none = F.lit(None).cast("double")
    from_orders = orders.select(
        "deal_id",
        F.explode(
            F.array(
                F.struct(F.lit("asking_price").alias("f"), price.alias("n"), F.lit(None).cast("string").alias("t")),
                F.struct(F.lit("property_type").alias("f"), none.alias("n"), F.col("o_orderpriority").alias("t")),
            )
        ).alias("v"),
    )
    from_lines = first_lines(spark, sf_dir).select(
        "deal_id",
        F.explode(
            F.array(
                F.struct(F.lit("noi").alias("f"), F.col("price").alias("n"), F.lit(None).cast("string").alias("t")),
                F.struct(F.lit("cap_rate").alias("f"), F.col("discount").alias("n"), F.lit(None).cast("string").alias("t")),
            )
        ).alias("v"),
    )
    return from_orders.unionByName(from_lines).select(
        "deal_id", F.col("v.f").alias("field_name"), F.col("v.n").alias("num_value"), F.col("v.t").alias("text_value")
    )


def _citation(field, ord_, value, page, snippet) -> Column:
    return F.struct(
        F.lit(field).alias("field_name"), F.lit(ord_).alias("cite_ord"), value.alias("value"),
        F.lit(page).alias("page_number") if isinstance(page, int) else page.alias("page_number"),
        snippet.alias("snippet"),
    )


def proposed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deal_id"), F.round("o_totalprice", 2).alias("price"), "o_orderpriority"
    )
    rule = planted_rule(F.col("deal_id"))
    stated = money(F.col("price"))
    snippet = (
        F.when(rule == "snippet_too_short", F.lit("Price"))
        .when(rule == "snippet_not_on_page", F.lit("Guidance Price: $1.00 only"))
        .otherwise(F.concat(F.lit("Asking Price: $"), stated))
    )
    page = F.when(rule == "page_not_in_document", F.lit(99)).otherwise(F.lit(1))
    from_orders = orders.select(
        "deal_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        ~F.coalesce(rule == "no_evidence", F.lit(False)),
                        _citation(
                            "asking_price", 0,
                            F.concat(
                                F.lit("$"),
                                F.when(rule == "value_not_in_snippet", money(F.col("price") + 1)).otherwise(stated),
                            ),
                            page, snippet,
                        ),
                    ),
                    _citation(
                        "property_type", 0, F.col("o_orderpriority"), 1,
                        F.concat(F.lit("Priority: "), F.col("o_orderpriority")),
                    ),
                )
            )
        ).alias("c"),
    )
    price_quote = F.concat(F.lit("Extended Price: $"), money(F.col("price")))
    from_lines = first_lines(spark, sf_dir).select(
        "deal_id",
        F.explode(
            F.array_compact(
                F.array(
                    _citation("noi", 0, money(F.col("price")), 2, price_quote),
                    _citation(
                        "cap_rate", 0, F.concat(money(F.col("discount")), F.lit("%")), 2,
                        F.concat(F.lit("Discount: "), money(F.col("discount")), F.lit("%")),
                    ),
                    F.when(
                        planted_rule(F.col("deal_id")) == "conflicting_evidence",
                        _citation("asking_price", 1, F.concat(F.lit("$"), money(F.col("price"))), 2, price_quote),
                    ),
                )
            )
        ).alias("c"),
    )
    return (
        from_orders.unionByName(from_lines)
        .select("deal_id", "c.*")
        .withColumn("source_document", file_name(F.col("deal_id")))
    )


def proposal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"))
    return (
        orders.withColumn("rule", planted_rule(F.col("deal_id")))
        .filter(F.col("rule").isin("model_uncertain", "model_conflicting"))
        .select(
            "deal_id", F.lit(0).alias("flag_ord"), F.lit("asking_price").alias("field_name"),
            F.when(F.col("rule") == "model_uncertain", F.lit("uncertain")).otherwise(F.lit("conflicting")).alias("flag"),
            F.lit("check with the broker").alias("note"),
        )
    )


def missing_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"))
    return orders.filter(planted_rule(F.col("deal_id")) == "model_listed_as_missing").select(
        "deal_id", F.lit(0).alias("note_ord"), F.lit("asking price: not stated").alias("note")
    )

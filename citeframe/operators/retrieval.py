"""Tenant-scoped, filtered top-k search over chunk vectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import ship_package
from .blocks import search_block
from .checks import error_list

# Results per search and query length limits.
DEFAULT_MATCHES = 6
MAX_MATCHES = 20
MIN_QUERY_CHARS = 3
MAX_QUERY_CHARS = 4000
# Vectors and queries that meet in one task of a batch search.
PART_ROWS = 16_384
BATCH = 1024

RESULT_COLUMNS = [
    "document_id", "document_name", "deal_id", "source_type", "is_verified_knowledge", "page_number", "chunk_index",
    "content", "similarity",
]


def match_count(wanted: int | None) -> int:
    return min(max(DEFAULT_MATCHES if wanted is None else wanted, 1), MAX_MATCHES)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def _norm2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def check_searches(requests: DataFrame) -> DataFrame:
    """Adds `errors` and `k` per search request."""
    length = F.length(strip(F.col("query")))
    checks = {
        "query: not 3 to 4,000 characters": length.between(MIN_QUERY_CHARS, MAX_QUERY_CHARS),
        "match_count: not 1 to 20": F.col("match_count").isNull() | F.col("match_count").between(1, MAX_MATCHES),
    }
    return requests.withColumn("errors", error_list(checks)).withColumn(
        "k", F.coalesce("match_count", F.lit(DEFAULT_MATCHES))
    )


def searchable_chunks(
    chunks: DataFrame, documents: DataFrame, organization_id, deal_id=None, verified_only: bool = False
) -> DataFrame:
    """Chunks one tenant may search. The tenant filter is on both tables and is
    pushed into both scans."""
    docs = documents.filter((F.col("organization_id") == organization_id) & ~F.col("is_archived"))
    if verified_only:
        docs = docs.filter("is_verified_knowledge")
    docs = docs.select("document_id", "document_name", "source_type", "is_verified_knowledge")
    own = chunks.filter(F.col("organization_id") == organization_id)
    if deal_id is not None:
        own = own.filter(F.col("deal_id") == deal_id)
    return own.join(docs, "document_id")


def match_chunks(
    chunks: DataFrame,
    documents: DataFrame,
    query_vector: list[float],
    organization_id,
    deal_id=None,
    verified_only: bool = False,
    wanted: int | None = None,
) -> DataFrame:
    """The best chunks for one query vector, best first; ties by document and chunk.
    One pass over the tenant's vectors, each task keeping only its own k best."""
    pool = searchable_chunks(chunks, documents, organization_id, deal_id, verified_only)
    query = F.array(*[F.lit(float(x)) for x in query_vector])
    size = sum(float(x) * float(x) for x in query_vector) ** 0.5
    similarity = F.try_divide(_dot(F.col("embedding"), query), _norm2(F.col("embedding")) * F.lit(size))
    return (
        pool.withColumn("similarity", similarity)
        .select(*RESULT_COLUMNS)
        .orderBy(F.col("similarity").desc_nulls_last(), "document_id", "chunk_index")
        .limit(match_count(wanted))
    )


def search_parts(chunks: DataFrame, documents: DataFrame, requests: DataFrame, part_rows: int = PART_ROWS, batch: int = BATCH) -> DataFrame:
    """What every part of a tenant's vectors tells each of its queries: query_id,
    document_id, chunk_index, similarity of the part's k best, and one row without document
    with `pairs`, the vectors open to the query, and `scored`, those that were compared.

    Vectors and queries of a tenant are dealt by hash into parts of about `part_rows` rows
    and batches of about `batch` queries. A large tenant is many groups, none larger than
    that; the sizes come from counts per tenant."""
    ship_package(chunks.sparkSession)
    docs = documents.filter(~F.col("is_archived")).select("document_id", "organization_id", F.col("is_verified_knowledge").alias("verified"))
    pool = chunks.select(
        "organization_id", F.col("deal_id").cast("string").alias("deal"), "document_id", "chunk_index", "embedding"
    ).join(docs, ["document_id", "organization_id"])
    asked = requests.select(
        "query_id", "organization_id", F.col("deal_id").cast("string").alias("deal"), "verified_only", "query_vector",
        F.least(F.greatest(F.col("k"), F.lit(1)), F.lit(MAX_MATCHES)).alias("k"),
    )
    sizes = pool.groupBy("organization_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"))
    batches = asked.groupBy("organization_id").agg(F.ceil(F.count(F.lit(1)) / batch).cast("int").alias("_batches"))
    dealt = sizes.join(batches, "organization_id")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(dealt, "organization_id").withColumn("_batch", F.pmod(F.xxhash64("query_id"), "_batches").cast("int"))
    right = pool.join(dealt, "organization_id").withColumn("_part", F.pmod(F.xxhash64("document_id", "chunk_index"), "_parts").cast("int"))
    key = ["organization_id", "_part", "_batch"]
    left = left.withColumn("_part", numbers("_parts")).drop("_parts", "_batches")
    right = right.withColumn("_batch", numbers("_batches")).drop("_parts", "_batches")
    type_of = lambda df, c: df.schema[c].dataType.simpleString()
    schema = (
        f"query_id {type_of(asked, 'query_id')}, document_id {type_of(pool, 'document_id')}, chunk_index {type_of(pool, 'chunk_index')}, "
        "similarity double, pairs long, scored long"
    )
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(schema), schema)


def _search(schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def work(key: tuple[pa.Scalar, ...], asked: pa.Table, pool: pa.Table) -> pa.Table:
        rows = list(search_block(asked, pool)) if asked.num_rows and pool.num_rows else []
        types = [asked.schema.field("query_id").type, pool.schema.field("document_id").type, pool.schema.field("chunk_index").type]
        types += [pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([row[c] for row in rows], t) for c, t in zip(names, types)], names=names)

    return work


def search_cost(parts: DataFrame) -> DataFrame:
    """query_id, pairs, scored: how many vectors were open to a query, and compared."""
    return parts.filter("pairs is not null").groupBy("query_id").agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))


def match_chunks_batch(chunks: DataFrame, documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Many searches at once. `requests`: query_id, organization_id, deal_id (null:
    any), verified_only, k, query_vector.

    A query only meets its own tenant's vectors, in parts; each part sends its k best (see
    `blocks`). The text of a chunk is not carried through ranking: it is fetched for the k
    results.
    """
    scored = search_parts(chunks, documents, requests).filter(F.col("document_id").isNotNull())
    wanted = requests.select("query_id", F.least(F.greatest(F.col("k"), F.lit(1)), F.lit(MAX_MATCHES)).alias("k"))
    best = Window.partitionBy("query_id").orderBy(
        F.col("similarity").desc_nulls_last(), "document_id", "chunk_index"
    )
    ranked = (
        scored.select("query_id", "document_id", "chunk_index", "similarity")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= MAX_MATCHES)
        .join(wanted, "query_id")
        .filter(F.col("rank") <= F.col("k"))
        .drop("k")
    )
    details = documents.select("document_id", "document_name", "source_type", "is_verified_knowledge")
    text = chunks.select("document_id", "chunk_index", "deal_id", "page_number", "content")
    return ranked.join(text, ["document_id", "chunk_index"]).join(details, "document_id")


def active_organizations(memberships: DataFrame, user_id) -> DataFrame:
    """Organizations a user is an active member of."""
    return memberships.filter((F.col("user_id") == user_id) & F.col("is_active")).select("organization_id").distinct()


def visible_rows(rows: DataFrame, memberships: DataFrame, user_id) -> DataFrame:
    """Rows of the organizations a user is an active member of."""
    return rows.join(active_organizations(memberships, user_id), "organization_id", "left_semi")


def visible_objects(objects: DataFrame, documents: DataFrame, memberships: DataFrame, user_id) -> DataFrame:
    """Stored files whose path belongs to a document the user may see."""
    paths = visible_rows(documents, memberships, user_id).filter(F.col("storage_path").isNotNull())
    return objects.join(paths.select("storage_path"), "storage_path", "left_semi")


def visible_to_members(rows: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user, row) for every active member: the tenant views of all users at once."""
    active = memberships.filter("is_active").select("user_id", "organization_id").distinct()
    return rows.join(active, "organization_id")

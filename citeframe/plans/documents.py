"""Page, request, chunk, index and retrieval queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import clean_for_chunks, clean_page
from ..operators import chunks as ch
from ..operators import retrieval as rt
from ..session import shared_folder
from ..sources import pages as pg
from ..sources import requests as rq
from .registry import query, spread, table

SQL_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(133) || chr(8195) || chr(8239) || chr(12288)"


def _conversation_pages(spark, sf_dir):
    """A conversation is a document, a turn a page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("page_ord"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("file_name"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        "text",
    )


@query(
    "page_source_checked",
    """WITH p AS (
      SELECT conv_id AS doc_id, CASE WHEN conv_id % 10 = 1 THEN greatest(turn, 1) ELSE turn + 1 END AS page_number,
             CASE WHEN conv_id % 10 = 2 THEN '  ' ELSE text END AS text FROM conversations
      UNION ALL SELECT conv_id, turn + 1 + 10 * unnest(range(1, 200)), text FROM conversations WHERE conv_id % 10 = 3),
    d AS (
      SELECT doc_id, count(*) AS pages, count(DISTINCT page_number) AS distinct_pages,
             count(*) FILTER (trim(text) <> '') AS readable FROM p GROUP BY doc_id)
    SELECT doc_id, pages AS page_count, concat_ws('; ',
             CASE WHEN distinct_pages < pages THEN 'page: appears more than once' END,
             CASE WHEN pages > 500 THEN 'document: more than 500 pages' END,
             CASE WHEN readable = 0 THEN 'document: no readable text' END) AS errors FROM d""",
)
def page_source_checked(spark, sf_dir):
    key = F.col("doc_id") % 10
    pages = _conversation_pages(spark, sf_dir)
    pages = pages.withColumn(
        "page_number", F.when(key == 1, F.greatest(F.col("page_number") - 1, F.lit(1))).otherwise(F.col("page_number"))
    ).withColumn("text", F.when(key == 2, F.lit("  ")).otherwise(F.col("text")))
    # Every tenth document comes 200 times over, which takes it past the page limit.
    copies = pages.filter(key == 3).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(199))))
    longer = copies.withColumn("page_number", F.col("page_number") + 10 * F.col("_copy")).drop("_copy")
    return pg.check_documents(pages.unionByName(longer)).withColumn("errors", F.array_join("errors", "; "))


@query(
    "ingest_requests_checked",
    f"""WITH r AS (
      SELECT doc_id, CASE WHEN doc_id % 8 = 1 THEN 'a/' || source WHEN doc_id % 8 = 2 THEN '  ' ELSE source END AS name,
             length(trim(text, {SQL_BLANKS})) AS n, doc_id % 8 = 3 AS page_zero, doc_id % 8 = 4 AS odd_type FROM documents)
    SELECT doc_id, concat_ws('; ',
      CASE WHEN trim(name) = '' THEN 'document_name: not 1 to 255 characters' END,
      CASE WHEN name LIKE '%/%' THEN 'document_name: a path' END,
      CASE WHEN page_zero THEN 'pages: page number not positive' END,
      CASE WHEN n NOT BETWEEN 1 AND 25000 THEN 'pages: text not 1 to 25,000 characters' END,
      CASE WHEN odd_type THEN 'source_type: unknown' END) AS errors FROM r""",
)
def ingest_requests_checked(spark, sf_dir):
    key = F.col("doc_id") % 8
    docs = table(spark, sf_dir, "documents")
    requests = docs.select(
        "doc_id",
        F.when(key == 1, F.concat(F.lit("a/"), F.col("source"))).when(key == 2, F.lit("  ")).otherwise(F.col("source")).alias(
            "document_name"
        ),
        F.when(key == 4, F.lit("rumour")).otherwise(F.lit(None)).cast("string").alias("source_type"),
        F.lit(None).cast("boolean").alias("is_verified_knowledge"),
        F.array(
            F.struct(
                F.when(key == 3, F.lit(0)).otherwise(F.lit(1)).alias("page_number"), F.col("text").alias("text")
            )
        ).alias("pages"),
    )
    return rq.check_requests(requests).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "clean_pages_retrieval",
    f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
              '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {SQL_BLANKS})) AS digest FROM documents""",
)
def clean_pages_retrieval(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(clean_for_chunks(F.col("text"))).alias("digest"))


@query(
    "clean_pages_extraction",
    f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(
              replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
              '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '[\\x{{ad}}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g'),
              '[ \\t]+\\n', chr(10), 'g'), {SQL_BLANKS})) AS digest FROM documents""",
)
def clean_pages_extraction(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(clean_page(F.col("text"))).alias("digest"))


SQL_BLOCKS = f"""
b AS (SELECT conv_id AS doc_id, turn, '--- conv_' || conv_id || ' | Page ' || (turn + 1) || ' ---' || chr(10) || trim(text, {SQL_BLANKS}) AS block
      FROM conversations),
t AS (SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS document_text FROM b GROUP BY doc_id)
"""


@query(
    "document_fingerprints",
    f"WITH {SQL_BLOCKS} SELECT doc_id, sha256(document_text) AS input_sha256 FROM t WHERE length(document_text) <= 600000",
)
def document_fingerprints(spark, sf_dir):
    texts, _ = pg.document_texts(_conversation_pages(spark, sf_dir))
    return texts.select("doc_id", "input_sha256")


@query(
    "oversized_documents",
    f"""WITH b AS (SELECT doc_id % 100 AS doc_id, '--- set_' || (doc_id % 100) || ' | Page ' || (doc_id // 100 + 1) || ' ---' || chr(10) || trim(text, {SQL_BLANKS}) AS block
                   FROM (SELECT doc_id, repeat(text, 30) AS text FROM documents)),
    t AS (SELECT doc_id, sum(length(block)) + (count(*) - 1) * 2 AS n_chars FROM b GROUP BY doc_id)
    SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars FROM t WHERE n_chars > 600000""",
)
def oversized_documents(spark, sf_dir):
    """A hundred document sets whose pages are whole texts, thirty times over."""
    docs = table(spark, sf_dir, "documents")
    part, page = F.col("doc_id") % 100, F.floor(F.col("doc_id") / 100).cast("int")
    pages = docs.select(
        part.alias("doc_id"), page.alias("page_ord"), F.concat(F.lit("set_"), part.cast("string")).alias("file_name"),
        (page + 1).alias("page_number"), F.repeat("text", 30).alias("text"),
    )
    return pg.document_texts(pages)[1]


def _document_pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.lit(0).alias("page_ord"), F.lit(1).alias("page_number"), "text"
    )


SQL_CLEAN = f"""trim(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
              '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {SQL_BLANKS})"""
# Recursive twin of the cutting rule: each step looks at the last 480 of 1,200 characters.
SQL_CHUNKS = f"""
c AS (SELECT doc_id, {SQL_CLEAN} AS txt FROM documents),
steps AS (
  SELECT doc_id, txt, 0 AS s, CASE WHEN length(txt) <= 1200 THEN length(txt) ELSE NULL END AS e0,
         substr(txt, 721, 480) AS w FROM c WHERE length(txt) > 0
  UNION ALL
  SELECT doc_id, txt, ns, CASE WHEN ns + 1200 >= length(txt) THEN length(txt) END, substr(txt, ns + 721, 480)
  FROM (SELECT doc_id, txt, greatest(s + 1, s + 720 + cut - 200) AS ns
        FROM (SELECT *, greatest(CASE WHEN contains(w, ' ') THEN 481 - strpos(reverse(w), ' ') ELSE 0 END,
                                 CASE WHEN contains(w, chr(10) || chr(10)) THEN 480 - strpos(reverse(w), chr(10) || chr(10)) ELSE 0 END) AS found,
                     CASE WHEN found > 0 THEN found ELSE 480 END AS cut
              FROM steps WHERE e0 IS NULL)))
"""


@query(
    "chunk_pages",
    f"""WITH RECURSIVE {SQL_CHUNKS},
    ends AS (SELECT doc_id, s, txt, coalesce(e0, s + 720 + CASE WHEN found > 0 THEN found ELSE 480 END) AS e FROM (
      SELECT *, greatest(CASE WHEN contains(w, ' ') THEN 481 - strpos(reverse(w), ' ') ELSE 0 END,
                         CASE WHEN contains(w, chr(10) || chr(10)) THEN 480 - strpos(reverse(w), chr(10) || chr(10)) ELSE 0 END) AS found FROM steps)),
    parts AS (SELECT doc_id, s, trim(substr(txt, s + 1, e - s), {SQL_BLANKS}) AS content FROM ends)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, md5(content) AS digest
    FROM parts WHERE content <> ''""",
)
def chunk_pages(spark, sf_dir):
    chunks = ch.chunk_pages(_document_pages(spark, sf_dir))
    return chunks.select("doc_id", "chunk_index", F.md5("content").alias("digest"))


def _rag_documents(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad")
    )
    types = F.array(*[F.lit(t) for t in ch.SOURCE_TYPES])
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("document_id"),
            (F.col("doc_id") % 10).alias("organization_id"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("document_name"),
            F.get(types, (F.col("doc_id") % 6).cast("int")).alias("source_type"),
            F.coalesce("good", F.lit(False)).alias("is_verified_knowledge"),
            F.coalesce("bad", F.lit(False)).alias("is_archived"),
        )
    )


def _rag_chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("document_id"),
        (F.col("vec_id") % 10).alias("organization_id"),
        F.when(F.col("vec_id") % 4 != 0, F.col("label")).alias("deal_id"),
        F.lit(1).alias("page_number"),
        F.lit(0).alias("chunk_index"),
        F.concat(F.lit("text of "), F.col("vec_id").cast("string")).alias("content"),
        "embedding",
    )


SQL_RAG = """
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT documents.doc_id AS document_id, documents.doc_id % 10 AS organization_id, coalesce(good, FALSE) AS verified,
             coalesce(bad, FALSE) AS archived FROM documents LEFT JOIN l USING (doc_id)),
c AS (SELECT vec_id AS document_id, vec_id % 10 AS organization_id, CASE WHEN vec_id % 4 <> 0 THEN label END AS deal_id,
             CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pool AS (SELECT c.*, verified FROM c JOIN d USING (document_id) WHERE d.organization_id = c.organization_id AND NOT archived)
"""


@query(
    "match_chunks",
    f"""WITH {SQL_RAG}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 3)
    SELECT document_id, round(list_cosine_similarity(v, qv), 6) AS similarity FROM pool, q
    WHERE organization_id = 3 ORDER BY list_cosine_similarity(v, qv) DESC, document_id LIMIT 6""",
)
def match_chunks(spark, sf_dir):
    # One vector (a query embedding) is the argument of a single search.
    vector = table(spark, sf_dir, "embeddings").filter("vec_id = 3").select("embedding").first()[0]
    found = rt.match_chunks(_rag_chunks(spark, sf_dir), _rag_documents(spark, sf_dir), vector, organization_id=3)
    return found.select("document_id", F.round("similarity", 6).alias("similarity"))


def _search_requests(spark, sf_dir):
    """Every vector as a query of its tenant."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        (F.col("vec_id") % 10).alias("organization_id"),
        F.when(F.col("vec_id") % 5 == 0, F.col("label")).alias("deal_id"),
        (F.col("vec_id") % 3 == 0).alias("verified_only"),
        (F.col("vec_id") % 25).cast("int").alias("k"),
        F.col("embedding").alias("query_vector"),
    )


@query(
    "match_chunks_batch",
    f"""WITH {SQL_RAG},
    q AS (SELECT vec_id AS query_id, vec_id % 10 AS organization_id, CAST(embedding AS DOUBLE[]) AS qv, vec_id % 3 = 0 AS verified_only,
                 CASE WHEN vec_id % 5 = 0 THEN label END AS wanted_deal, CAST(vec_id % 25 AS INTEGER) AS k FROM embeddings),
    s AS (SELECT query_id, document_id, k, list_cosine_similarity(v, qv) AS sim,
                 row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(v, qv) DESC, document_id) AS rank
          FROM q JOIN pool USING (organization_id)
          WHERE (wanted_deal IS NULL OR wanted_deal = deal_id) AND (NOT verified_only OR verified))
    SELECT query_id, document_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity, 'text of ' || document_id AS content
    FROM s WHERE rank <= least(greatest(k, 1), 20)""",
)
def match_chunks_batch(spark, sf_dir):
    requests = _search_requests(spark, sf_dir)
    found = rt.match_chunks_batch(_rag_chunks(spark, sf_dir), _rag_documents(spark, sf_dir), requests)
    return found.select("query_id", "document_id", "rank", F.round("similarity", 6).alias("similarity"), "content")


@query(
    "search_cost",
    f"""WITH {SQL_RAG},
    q AS (SELECT vec_id AS query_id, vec_id % 10 AS organization_id, vec_id % 3 = 0 AS verified_only, CASE WHEN vec_id % 5 = 0 THEN label END AS wanted_deal FROM embeddings)
    SELECT query_id, count(*) FILTER ((wanted_deal IS NULL OR wanted_deal = deal_id) AND (NOT verified_only OR verified)) AS pairs, TRUE AS within
    FROM q JOIN pool USING (organization_id) GROUP BY query_id""",
)
def search_cost(spark, sf_dir):
    """Vectors open to each query, and that no more than these were compared."""
    parts = rt.search_parts(_rag_chunks(spark, sf_dir), _rag_documents(spark, sf_dir), _search_requests(spark, sf_dir))
    return rt.search_cost(parts).select("query_id", "pairs", (F.col("scored") <= F.col("pairs")).alias("within"))


@query(
    "page_sidecar",
    """WITH c AS (SELECT DISTINCT conv_id FROM conversations),
    p AS (
      SELECT conv_id AS deal_id, CAST(turn AS INTEGER) AS page_ord, text FROM conversations WHERE conv_id % 3 <> 0 AND conv_id % 4 <> 1
      UNION ALL SELECT conv_id, CAST(turn AS INTEGER), text || ' (new)' FROM conversations WHERE conv_id % 4 = 1 AND turn < 2)
    SELECT c.conv_id AS deal_id, p.deal_id IS NOT NULL AS has_pages, page_ord, md5(text) AS digest
    FROM c LEFT JOIN p ON p.deal_id = c.conv_id""",
)
def page_sidecar(spark, sf_dir):
    """Two thirds of the conversations are kept, then every fourth is written again with
    other, fewer pages; reported with the deals that have none."""
    path = f"{shared_folder(spark)}/sidecar-{uuid.uuid4().hex}"
    pages = _conversation_pages(spark, sf_dir).withColumnRenamed("doc_id", "deal_id").drop("page_number")
    pg.write_pages(pages.filter("deal_id % 3 <> 0"), path)
    pg.write_pages(pages.filter("deal_id % 4 = 1 and page_ord < 2").withColumn("text", F.concat("text", F.lit(" (new)"))), path)
    stored = pg.stored_pages(spark, path)
    deals = pages.select("deal_id").distinct()
    having = pg.with_pages(deals, stored).withColumn("has_pages", F.lit(True))
    lacking = pg.without_pages(deals, stored).withColumn("has_pages", F.lit(False))
    told = stored.select("deal_id", "page_ord", F.md5("text").alias("digest"))
    return having.unionByName(lacking).join(told, "deal_id", "left")


@query(
    "search_requests_checked",
    f"""WITH r AS (SELECT doc_id, length(trim(text, {SQL_BLANKS})) AS n, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 24 AS INTEGER) END AS k FROM documents)
    SELECT doc_id, concat_ws('; ', CASE WHEN n NOT BETWEEN 3 AND 4000 THEN 'query: not 3 to 4,000 characters' END,
           CASE WHEN k NOT BETWEEN 1 AND 20 THEN 'match_count: not 1 to 20' END) AS errors, coalesce(k, 6) AS k FROM r""",
)
def search_requests_checked(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("query"),
        F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 24).cast("int").alias("match_count"),
    )
    return rt.check_searches(requests).select("doc_id", F.array_join("errors", "; ").alias("errors"), "k")


@query(
    "index_documents",
    f"""WITH RECURSIVE {SQL_CHUNKS},
    n AS (SELECT doc_id, count(*) AS chunk_count FROM steps GROUP BY doc_id)
    SELECT doc_id AS document_id, coalesce(chunk_count, 0) AS chunk_count, 1 AS page_count, sha256(text) AS content_sha256,
           (doc_id % 10) || '/' || doc_id || '/doc_' || doc_id || '.pdf' AS storage_path
    FROM documents LEFT JOIN n USING (doc_id)""",
)
def index_documents(spark, sf_dir):
    pages = _document_pages(spark, sf_dir)
    chunks = ch.chunk_pages(pages, numbered=False).withColumnRenamed("doc_id", "document_id")
    indexed = ch.index_documents(
        _rag_documents(spark, sf_dir), pages.withColumnRenamed("doc_id", "document_id"), chunks
    )
    return indexed.select("document_id", "chunk_count", "page_count", "content_sha256", "storage_path")


@query(
    "attach_vectors",
    """WITH w AS (SELECT coalesce(doc_id, vec_id) AS document_id, vec_id IS NULL OR doc_id IS NULL AS unpaired,
                         coalesce(vec_id % 9 = 0, FALSE) AS short, coalesce(vec_id % 11 = 0, FALSE) AS twice,
                         coalesce(doc_id % 13 = 0, FALSE) AS blank
                  FROM documents FULL JOIN embeddings ON vec_id = doc_id)
    SELECT document_id, concat_ws('; ',
       CASE WHEN unpaired OR twice THEN 'vectors: not one per chunk' END,
       CASE WHEN short THEN 'vectors: not 64 long' END,
       CASE WHEN blank THEN 'chunks: blank text' END,
       CASE WHEN twice THEN 'vectors: more than one model' END) AS errors FROM w
    WHERE unpaired OR short OR twice OR blank""",
)
def attach_vectors(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("content"),
    )
    key = F.col("vec_id")
    base = table(spark, sf_dir, "embeddings").select(
        key.alias("document_id"), F.lit(0).alias("chunk_index"),
        F.when(key % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"),
        F.lit("model a").alias("embedding_model"),
    )
    doubled = base.filter(F.col("document_id") % 11 == 0).withColumn("embedding_model", F.lit("model b"))
    _, refused = ch.attach_vectors(chunks, base.unionByName(doubled), dimensions=64)
    return refused.select("document_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "index_checked",
    """SELECT doc_id AS document_id, concat_ws('; ',
         CASE WHEN doc_id % 7 = 0 THEN 'source_type: unknown' END,
         CASE WHEN doc_id % 5 = 0 THEN 'page_count: not positive' END,
         CASE WHEN doc_id % 3 = 0 THEN 'storage_path: not unique' END) AS errors,
         CAST(CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 1 THEN 2 ELSE 0 END AS BIGINT) AS bad_chunks
       FROM documents""",
)
def index_checked(spark, sf_dir):
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        key.alias("document_id"),
        F.when(key % 7 == 0, F.lit("gossip")).otherwise(F.lit("other")).alias("source_type"),
        F.sha2("source", 256).alias("content_sha256"),
        F.when(key % 5 == 0, F.lit(0)).otherwise(F.lit(1)).alias("page_count"),
        F.when(key % 3 == 0, F.lit("shared/path")).otherwise(key.cast("string")).alias("storage_path"),
    )
    chunks = table(spark, sf_dir, "documents").select(
        key.alias("document_id"), F.lit(1).alias("page_number"),
        F.explode(F.when(key % 4 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("chunk_index"),
        F.when(key % 6 == 1, F.lit("")).otherwise(F.col("text")).alias("content"),
    )
    documents, rows = ch.check_index(docs, chunks)
    bad = rows.groupBy("document_id").agg(F.count_if(F.size("errors") > 0).alias("bad_chunks"))
    return documents.join(bad, "document_id").select(
        "document_id", F.array_join("errors", "; ").alias("errors"), "bad_chunks"
    )


def _memberships(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") % 10).alias("organization_id"),
        F.col("c_custkey").alias("user_id"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


@query(
    "tenant_documents",
    """SELECT c_custkey AS user_id, count(*) AS documents FROM customer
       JOIN documents ON c_nationkey % 10 = doc_id % 10 WHERE c_acctbal >= 0 GROUP BY c_custkey""",
)
def tenant_documents(spark, sf_dir):
    """How many documents each user may see. Counted per organization before the
    tenant rule is applied, so no (user, document) pairs are formed."""
    counts = _rag_documents(spark, sf_dir).groupBy("organization_id").agg(F.count(F.lit(1)).alias("documents"))
    return rt.visible_to_members(counts, _memberships(spark, sf_dir)).select("user_id", "documents")


@query(
    "visible_rows",
    """SELECT doc_id AS document_id FROM documents
       WHERE doc_id % 10 IN (SELECT c_nationkey % 10 FROM customer WHERE c_custkey = 1 AND c_acctbal >= 0)""",
)
def visible_rows(spark, sf_dir):
    rows = rt.visible_rows(_rag_documents(spark, sf_dir), _memberships(spark, sf_dir), 1)
    return rows.select("document_id")


@query(
    "visible_files",
    """SELECT (doc_id % 10) || '/' || doc_id || '/doc_' || doc_id || '.pdf' AS storage_path FROM documents
       WHERE doc_id % 10 IN (SELECT c_nationkey % 10 FROM customer WHERE c_custkey = 1 AND c_acctbal >= 0)""",
)
def visible_files(spark, sf_dir):
    """Every document has its file and a stray copy no document row names."""
    path = F.concat_ws("/", F.col("organization_id").cast("string"), F.col("document_id").cast("string"), "document_name")
    documents = _rag_documents(spark, sf_dir).withColumn("storage_path", path)
    stored = documents.select("storage_path")
    stray = documents.select(F.concat(F.lit("stray/"), "storage_path").alias("storage_path"))
    return rt.visible_objects(stored.unionByName(stray), documents, _memberships(spark, sf_dir), 1)

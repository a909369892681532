"""The training-data operators as named queries, and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtable.llm import bitslice, chat, hnsw, mixing, packing, pii, shards, simhash, statements, toxicity
from logtable.llm import turn_repair, url_templates, vector_codes, warc, weak_labels
from logtable.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings."""
    text = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    probe = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    columns = ["conv_id", "turn", "role", "text"]
    all_turns = table(spark, sf_dir, "conversations").select(columns).unionByName(probe)
    return chat.digest(chat.format_conversations(all_turns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages and reads the archives back."""
    path = shared_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "damage"
    )


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = shards.clean_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
        F.size("passages").cast("bigint").alias("n_passages"),
    )


def op10_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth vector."""
    vectors = shards.clean_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return bitslice.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    found = pii.found(docs, pii.fit(docs))
    # a comma stands before each span, so that a kind's name counts once for each of its spans
    marked = F.concat(F.lit(","), "spans")
    counts = [F.regexp_count(marked, F.lit(f",{kind}:")).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces, and the place of each piece in its sequence.

    The digests are those of the ids in the written pieces.
    """
    return packing.pack(packing.digested(packing.written(table(spark, sf_dir, "documents"))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from heuristic votes alone."""
    seen = weak_labels.looked(table(spark, sf_dir, "documents"))
    return weak_labels.scored(seen, weak_labels.fit(seen)).select("doc_id", "posterior", "score", "predicted")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each document's words a balanced mix of all sources takes."""
    path = shared_dir(spark, "mix-sizes")
    docs = table(spark, sf_dir, "documents")
    docs.select(F.col("doc_id").alias("row_key"), "source", mixing.word_count(F.col("text")).alias("size")).write.parquet(path)
    return mixing.mix(spark.read.parquet(path)).select(
        F.col("row_key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


#: The url rules that come before the learned templates.
URL_RULES = (
    url_templates.Rule("net", "/", url_templates.BLOCK),
    url_templates.Rule("example.net", "/en/", url_templates.ALLOW),
    url_templates.Rule("example.com", "/de/", url_templates.BLOCK),
    url_templates.Rule("org", "/fr/", url_templates.ALLOW),
)


def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by the rules and by templates learned from what the rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_templates.judged(pages, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, by codebooks moved for six rounds."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return vector_codes.digested(vector_codes.encoded(vectors))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair, and a digest of the repaired turns."""
    found = turn_repair.repaired(turn_repair.damaged(table(spark, sf_dir, "conversations")))
    digests = turn_repair.digested(found.turns).withColumnRenamed("conv_id", "digested_id")
    return found.conversations.join(digests, F.col("conv_id").eqNullSafe(F.col("digested_id"))).drop("digested_id")


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_warc": op2_warc,
        "op3_hnsw": op3_hnsw,
        "op4_pii": op4_pii,
        "op5_simhash": op5_simhash,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_source_mixing": op8_source_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_bitsliced_topk": op10_bitsliced_topk,
        "op11_url_templates": op11_url_templates,
        "op12_vector_codes": op12_vector_codes,
        "op13_turn_repair": op13_turn_repair,
    }


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN before = role THEN 11 ELSE 12 + role_chars + 10 + 10 END) AS BIGINT)
         AS formatted_chars
FROM ordered GROUP BY conv_id
"""

OP2_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM payloads
), typed AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 AND kept IS NOT NULL AND (page_id IS NULL OR page_id < kept)
                 THEN kept END AS refers_to FROM kept
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
       CAST(NULL AS VARCHAR) AS damage
FROM typed
"""

OP10_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL,
        "op2_warc": OP2_SQL,
        "op10_bitsliced_topk": OP10_SQL,
        "op12_vector_codes": statements.vector_codes_sql(),
        "op13_turn_repair": statements.turn_repair_sql(),
    }

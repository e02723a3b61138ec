"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import langid, licences, mixing, packing, ppm, pq, secret_scan, simhash, substring, topk


def tokenizer_file() -> str:
    """Where the public word-level BPE vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by a byte model and by smoothed unigrams."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    scored = ppm.score_corpus(docs.withColumn("train", ~held), "train")
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word SimHash fingerprints differ in 3 bits at most."""
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of one and a half times the corpus takes from each document."""
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence of its own."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier elsewhere."""
    found = substring.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


LANGUAGES = ["de", "en", "es", "fr"]


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, from its text, markup, suffix and host."""
    model = langid.fit(_table(spark, sf_dir, "documents"), LANGUAGES)
    html, url = F.col("html"), F.col("url")
    found = langid.identify(
        _table(spark, sf_dir, "pages"),
        model,
        LANGUAGES,
        text=langid.text_of(html),
        declared=langid.declared_of(html),
        host=langid.host_of(url),
        keep=["page_id"],
    )
    return found.withColumn("probability", F.round("probability", 6))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its directory's.

    Documents have no paths, so they are given some, from their keys alone: source,
    language, hundred, and a name.  Every tenth stands for a licence file.
    """
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(
        F.concat("doc_id", F.lit(".txt"))
    )
    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100))
    docs = docs.withColumn("path", F.concat_ws("/", folder, name))
    found = licences.scan_licences(docs, keep=["doc_id"])
    return found.withColumn("score", F.round("score", 6))


def op7_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between embeddings of one label."""
    return pq.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best integer inner products for every 20th vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, scale=64, k=20)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts, a digest of the base spans and all spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.secret_digest(secret_scan.scan_secrets(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ppm": op1_ppm,
        "op2_simhash": op2_simhash,
        "op3_mix": op3_mix,
        "op4_pack": op4_pack,
        "op5_substring": op5_substring,
        "op6_langid": op6_langid,
        "op7_pq": op7_pq,
        "op8_licences": op8_licences,
        "op9_topk": op9_topk,
        "op10_secrets": op10_secrets,
    }


_SQL = {
    "op5_substring": """
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos
  FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents)
), g AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER f AS t, count(*) OVER f AS n
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), d AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM g WHERE n = 20) WHERE k > 1
), c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos, true AS gone FROM d),
k AS (
  SELECT w.doc_id, count(*) AS n_words, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE gone IS NULL) AS kept
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.pos = c.pos GROUP BY 1
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)""",
    "op7_pq": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN k ON a = vec_id""",
    "op9_topk": """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for those that it can express; tests hold the others against plain versions."""
    return dict(_SQL)

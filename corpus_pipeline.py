"""A corpus pipeline of five stages, each of which calls one operator.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``documents``; the last one returns sequences.  Between stages the rows are
written as Parquet and read again, so row numbers given by position in the files
are stable within a stage.  A stage called by itself needs the same: a table that
gives the same rows in the same order each time it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloft.llm import langid, mixing, packing, secret_scan, simhash
from keyloft.llm.common import ensure_checkpoint_dir
from keyloft.llm.queries import LANGUAGES, tokenizer_file

ROW = "_row"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language and those without letters.

    The declared language is column ``lang``, the host is the source.
    """
    model = langid.fit(docs, LANGUAGES)
    rows = _numbered(docs)
    found = langid.identify(
        rows, model, LANGUAGES, text=F.col("text"), declared=F.col("lang"), host=F.col("source"), keep=[ROW]
    )
    return rows.join(found.filter("accepted").select(ROW), ROW, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one of least id.

    Groups are texts whose sets of five-word shingles are alike by 0.8 or more.
    """
    rows = _numbered(docs)
    groups = simhash.similar_components(rows, id_col=ROW, shingle=5, similarity=0.8)
    named = rows.select(ROW, "doc_id").join(groups.select(ROW, "component_id"), ROW)
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(ROW).alias("r"))
    kept = named.groupBy("component_id").agg(F.min(first)["r"].alias(ROW))
    return rows.join(kept.select(ROW), ROW, "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``[SECRET]`` in the place of every secret; ``n_chars`` follows the text."""
    clean = secret_scan.scan_secrets(docs, redact="[SECRET]")
    size = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights.

    Random numbers come from ids and texts; row numbers only bring the copies back.
    """
    rows = _numbered(docs)
    taken = mixing.mix(rows, id_col=ROW, key_col="doc_id").filter("copies > 0").select(ROW, "copies")
    out = rows.join(taken, ROW).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, each a piece of one document."""
    # Workers go on to other stages, so they keep few words.
    return packing.pack(docs, tokenizer_file(), remembered=50_000)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mix", mix),
    ("pack", pack),
]

#: Fingerprints, random odds and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to tokens: the stages of the corpus pipeline, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from panelweave.llm.queries import tokenizer_path
from panelweave.llm.text import text_or_empty, words
from panelweave.sources.scratch import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame, text_hash: Column) -> DataFrame:
    """docs with three columns that are never null and tell documents apart."""
    return docs.withColumns({"k_id": F.coalesce("doc_id", F.lit(-1)), "k_null": F.col("doc_id").isNull(), "k_text": text_hash})


KEY = ["k_id", "k_null", "k_text"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, unchanged."""
    return quality_rules.cascade(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document of the smallest id; of repeated rows one."""
    found = minhash.near_duplicates(docs, width=5)
    alone = F.col("kept") | F.col("doc_id").isNull() & F.col("component_id").isNull()
    kept = _keyed(found.where(alone), F.col("text_hash")).select(*KEY).distinct()
    rows = _keyed(docs.select(*COLUMNS), F.xxhash64(text_or_empty()))
    return rows.join(kept, KEY, "left_semi").dropDuplicates(KEY).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what occurs twice or more: passages of over 50 words, and strings of 400 bytes.

    No character is cut.  Two places in one document count, too.  All places go, since strings overlap
    and which of them would stay is no document's own property.
    """
    cut = suffix_dedup.repeated_passages(docs.select(*COLUMNS))
    return cut.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source",
                      F.when(F.col("kept").isNotNull(), F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; texts without words are not taken.

    Rows that share doc_id, source and size get the same number of copies, the largest of theirs.
    """
    size = F.size(words(text_or_empty())).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"))
    taken = mixing.mix(sized).where("size > 0 AND copies > 0").groupBy(
        F.coalesce("doc_id", F.lit(-1)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"),
        F.coalesce("source", F.lit("")).alias("k_source"), F.col("source").isNull().alias("k_open"),
        F.col("size").alias("k_size")).agg(F.max("copies").alias("copies"))
    rows = docs.select(
        *COLUMNS, F.coalesce("doc_id", F.lit(-1)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"),
        F.coalesce("source", F.lit("")).alias("k_source"), F.col("source").isNull().alias("k_open"), size.alias("k_size"))
    mixed = rows.join(taken, ["k_id", "k_null", "k_source", "k_open", "k_size"])
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    path = tokenizer_path()
    encoded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Near-duplicate components, entropy balancing and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

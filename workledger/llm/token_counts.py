"""Token counts through a digest cache: only distinct texts that no earlier run has counted are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import python_batches, skew_join, text_bytes, written
from workledger.llm.tokens import tokenizer_digest, word_counts

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def content_digest(squeeze: bool) -> Column:
    """SHA-256 of the normalised text. ``squeeze``: runs of white space count as one, outer ones not at all,
    which is right for vocabularies that drop white space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if squeeze:
        text = F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " "))
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_counts(path)
        seen: set[bytes] = set()  # repeated rows lie in one task, as the join left them
        for batch in batches:
            fresh = []
            for digest in batch.column(0).to_pylist():
                fresh.append(digest not in seen)
                seen.add(digest)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            n = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per input row.

    ``cache_path`` is a Parquet table of ``digest, tokenizer, n_tokens``, created or appended to. Its rows for
    other tokenizer versions are left alone. A null or empty text has 0 bytes and 0 tokens. Repeated rows
    repeat; rows without doc_id are counted as others; no rows give no rows and leave the cache as it is.
    """
    spark = docs.sparkSession
    python_batches(spark)
    version = tokenizer_digest(tokenizer_path)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = written(
        source.select(
            "doc_id",
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            content_digest(True).alias("digest"),
        ),
        "digests",
    )

    def cached() -> DataFrame | None:
        try:
            table = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        mine = table.where(F.col("tokenizer") == version)
        return mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    chosen = keyed.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("chosen_id"))
    if (stored := cached()) is not None:
        chosen = chosen.join(stored, "digest", "left_anti")
    misses = (
        source.withColumn("chosen_id", F.coalesce("doc_id", F.lit(0)))
        .join(chosen.hint("shuffle_hash"), "chosen_id")
        .where(F.col("digest") == content_digest(True))
        .select("digest", text_bytes().alias("body"))
    )
    counted = misses.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    return skew_join(keyed, cached(), "digest", "left").select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )

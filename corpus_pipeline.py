"""From raw documents to token blocks: the stages of the corpus, each written before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workledger.llm.common import read, shared_dir, written
from workledger.llm.decontaminate import contaminated_pairs
from workledger.llm.minhash import near_duplicates
from workledger.llm.mixing import MixConfig, mix
from workledger.llm.token_blocks import read_documents, write_token_blocks
from workledger.llm.toxicity import toxicity


def _free(name: str, docs: DataFrame) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Rows without doc_id stay; a doc_id of which any row is rejected goes with all its rows. Null and empty
    texts score as the intercept alone; equal scores get equal verdicts; other columns pass through.
    """
    rejected = (
        toxicity(docs.select("doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
        .where("predicted = 1")
        .select("doc_id")
        .distinct()
    )
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each near-duplicate group: five-word shingles at 0.8.

    Rows that share a doc_id are one document and stay or go together; rows without one, and texts without
    words, are in no group and stay. Other columns pass through.
    """
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Rows without doc_id stay; rows that share one are judged together. Null and empty texts contain nothing;
    without items all stay. Other columns pass through.
    """
    pairs = contaminated_pairs(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix uses them, within the tokens there are, in the order of the mix.

    A row without doc_id takes part, and rows that share one are used each by itself; a null source is a source
    of its own. Rows lie in files by their places, so that files read one after the other give the schedule, in which
    every stretch holds about the target shares.
    """
    # rows may share a doc_id or have none, so each gets a key; it is written, as it must not change between two reads
    key, use = _free("row_key", docs), _free("row_use", docs)
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    uses = mix(rows.select("doc_id", "source", "text", key), MixConfig(entropy_share=0.95), key)
    times = uses.groupBy(key).agg(F.collect_list("place").alias(use))
    placed = rows.join(times, key).withColumn(use, F.explode(use))
    return placed.repartitionByRange(use, key).sortWithinPartitions(use, key).select(docs.columns)


def _as_written(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` with columns that tell where in its files each row lies, and their names; none if it is no file scan."""
    try:
        placed = docs.select("doc_id", "text", F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) AS bigint)").alias("file_part"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("file_row"))
    except AnalysisException as absent:
        if not str(absent.getCondition()).startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
            raise
        return docs.select("doc_id", "text"), ()
    return placed, ("file_part", "file_name", "file_row")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document written as coded blocks, and read back.

    Blocks are in the order in which the rows lie in the files before, which is that of the mix; rows that are not read
    from files are in ascending doc_id order. A null or empty text is its end id alone; no rows give no rows.
    """
    path = shared_dir(spark, "token-blocks")
    placed, order = _as_written(docs)
    write_token_blocks(placed, path, public_tokenizers.path("byte_bpe_50k.json"), order=order)
    return read_documents(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token blocks", token_output),
]

#: The toxicity model and the coded blocks have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs

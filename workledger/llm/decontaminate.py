"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Items differ in size, so they are partitioned by their number of distinct shingles, and each partition has a
signature of its own length: the bottom-k MinHash of the item, with k one more than the shingles a document
may lack and still contain the item to the threshold. A document that holds the share ``percent`` of an
item's shingles therefore holds at least one of its signature's, whatever the document's length: the search
loses nothing, and it probes a few shingles an item instead of all.

An item of fewer words than a shingle has is one shingle of all its words, found among documents' windows of
that many words; these are probed only for widths that occur.

Both steps are DataFrame functions only. Documents are turned into shingle hashes inside one stage (word
array, five shifted views, one hash a row) and probe the signatures there; candidates alone are read again
and counted exactly on the shingles' words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import written

#: Signature rows and candidate documents up to which they are sent to all executors; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class ContainmentConfig:
    """``width`` words a shingle; an item is found at ``percent`` of its distinct shingles."""

    width: int = 5
    percent: int = 80


def normal_words(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits, in order; null and empty texts have none."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.split(F.trim(cleaned), " ")


def _shingles(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """``keep`` and one row per shingle: its hash and its words. Texts with fewer words have none."""
    n = F.size("words") - (width - 1)
    views = F.arrays_zip(*(F.slice("words", i + 1, n).alias(f"w{i}") for i in range(width)))
    parts = [F.col(f"window.w{i}") for i in range(width)]
    return (
        df.select(*keep, normal_words().alias("words"))
        .where((F.size("words") >= width) & (F.col("words")[0] != ""))
        .select(*keep, F.explode(views).alias("window"))
        .select(*keep, F.xxhash64(*parts).alias("shingle"), F.concat_ws(" ", *parts).alias("gram"))
    )


def item_shingles(items: DataFrame, config: ContainmentConfig) -> DataFrame:
    """Distinct shingles of every item with the item's size."""
    words = items.where("item_id is not null").select("item_id", "text", normal_words().alias("all"))
    grams = _shingles(words, config.width, "item_id").withColumn("width", F.lit(config.width))
    for width in range(1, config.width):
        short = _shingles(words.where(F.size("all") == width), width, "item_id")
        grams = grams.union(short.withColumn("width", F.lit(width)))
    grams = grams.select("item_id", "shingle", "gram", "width").distinct()
    sizes = grams.groupBy("item_id").agg(F.countDistinct("gram").cast("long").alias("item_size"))
    return grams.join(sizes, "item_id")


def _windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """Shingles of the documents, of every width that occurs among the items."""
    parts = [_shingles(docs, width, "doc_id") for width in widths]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def signatures(grams: DataFrame, config: ContainmentConfig) -> DataFrame:
    """``shingle, item_id`` of the bottom-k sketches; k depends on the item's size partition."""
    from pyspark.sql import Window

    order = Window.partitionBy("item_id").orderBy("shingle")
    may_lack = F.floor(F.col("item_size") * (100 - config.percent) / 100)
    return (
        grams.select("item_id", "item_size", "shingle")
        .distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= may_lack + 1)
        .select("item_id", "shingle")
    )


def contaminated_pairs(docs: DataFrame, items: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """``(doc_id, text)`` and ``(item_id, text)`` -> ``doc_id, item_id, item_size, found``, one row a pair.

    ``found`` counts the item's distinct shingles in the document. An item with fewer words than ``width`` is
    one shingle of all its words; null, empty and wordless texts match nothing; rows without an id are ignored.
    Rows that share an id count as one document, or one item, with the shingles of all of them. Nothing is
    chosen among pairs, so ties cannot arise. No rows on either side give no rows; other columns are not read.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    grams = written(item_shingles(items.select("item_id", "text"), config), "item-shingles")
    probes = signatures(grams, config)
    small = grams.count() <= BROADCAST_ROWS
    keyed = F.broadcast(probes) if small else probes
    # at most ``width`` numbers; without items, any width will do
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect()) or [config.width]
    hits = _windows(docs, widths).select("doc_id", "shingle").join(keyed, "shingle")
    candidates = written(hits.select("doc_id", "item_id").distinct(), "candidates")

    chosen = candidates.select("doc_id").distinct()
    few = candidates.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(chosen) if few else chosen.hint("shuffle_hash"), "doc_id")
    wanted = grams.select("item_id", "item_size", F.col("shingle").alias("s"), F.col("gram").alias("g"))
    meets = (F.col("shingle") == F.col("s")) & (F.col("gram") == F.col("g"))
    found = (
        _windows(texts, widths)
        .join(F.broadcast(wanted) if small else wanted, meets)
        .select("doc_id", "item_id", "item_size", "gram")
        .distinct()
        .groupBy("doc_id", "item_id", "item_size")
        .agg(F.count("*").alias("found"))
    )
    return found.where(F.col("found") * 100 >= F.col("item_size") * config.percent)


def decontaminate(docs: DataFrame, items: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """``doc_id, n_items, item_ids, contaminated``, one row per row of ``docs``.

    ``item_ids`` lists the items found, ascending (empty if none). A row without doc_id is never contaminated;
    rows that share a doc_id get the same verdict; no items leave everything clean.
    """
    pairs = contaminated_pairs(docs, items, config)
    lists = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return (
        docs.select("doc_id")
        .join(lists, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
            F.col("item_ids").isNotNull().alias("contaminated"),
        )
    )

"""SimHash near duplicates: candidates by the pigeonring principle, groups by linking to leaders first.

A fingerprint is a ring of eight segments of 8 bits. If two fingerprints differ in at most ``distance`` bits, then
from some segment on *every* chain of l consecutive segments differs in at most ``l * distance / 8`` bits (otherwise
a walk round the ring from one broken chain to the next would add up to more than ``distance``). For three bits
that leaves nothing for chains of one and two segments, one bit for three to five, two for six and seven. So:

* the index key is the two segments at the start and two of the next three (one bit breaks at most one of them):
  8 starts times 3 choices, 32 bits each;
* what meets in a bucket must keep all budgets of its chain before the whole distance is taken.

Only distinct fingerprints take part, each for all its documents. Members of a bucket are compared with the bucket's
smallest fingerprint first; components of these links follow. Then only pairs of a bucket that lie in different
components are compared, large buckets in blocks, so that neither a hot bucket nor its pairs meet in one task; pairs
inside a component could not change the result. No candidate is dropped otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import python_batches, skew_join, text_bytes, words_of, written
from workledger.operators.graph import components

SEGMENTS = 8


@dataclass(frozen=True)
class SimHashConfig:
    """``width`` words a shingle, hashed with ``seed``; links at ``distance`` differing bits, 3 at most, since the
    keys are made for that. Blocks of about ``block_rows`` members of a bucket are compared in one call.
    """

    width: int = 3
    seed: int = 42
    distance: int = 3
    block_rows: int = 1024

    def __post_init__(self) -> None:
        if not 0 <= self.distance <= 3:
            raise ValueError("distance must lie between 0 and 3")


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included; zero without words."""
    words = words_of(text)
    if not words:
        return 0
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    count = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for _ in range(0, count, 65_536):  # bits are unpacked in parts, so that long texts take no more memory
        part = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in islice(shingles, 65_536)), np.uint64)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def _fingerprints(config: SimHashConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(v.as_py(), config.width, config.seed) for v in batch.column(1)]
            prints = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    return run


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("print", 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))


#: Which two of the three segments after the first two are in a key.
CHOICES = ((2, 3), (2, 4), (3, 4))


def bucket_keys() -> Column:
    """Index keys of ``print``: the number of the key and its four segments."""
    keys = []
    for start in range(SEGMENTS):
        for n, choice in enumerate(CHOICES):
            key = F.lit(start * len(CHOICES) + n).cast("long")
            for at in (0, 1, *choice):
                key = F.shiftleft(key, 8).bitwiseOR(_segment(start + at))
            keys.append(key)
    return F.array(*keys)


def budgets(distance: int) -> list[int]:
    """Bits that a chain of 1, 2, ... segments may differ in."""
    return [distance * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def ring_near(one: np.ndarray, two: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Which of ``two`` lie within the budgets of every chain of ``one`` (broadcast) from segment ``start`` on."""
    differ = one ^ two
    total = np.zeros(differ.shape, np.uint8)
    inside = np.ones(differ.shape, bool)
    for step, most in enumerate(budgets(distance)):
        total += _BITS[(differ >> np.uint64(8 * ((start + step) % SEGMENTS))).astype(np.uint8)]
        inside &= total <= most
    return inside


def _compare(rows: pa.Table, distance: int) -> list[tuple[int, int]]:
    """Links between the two blocks of one bucket that ``rows`` holds, across components only."""
    prints, labels, block, low, high, bucket = (rows.column(c).to_numpy() for c in ("print", "label", "block", "low", "high", "bucket"))
    if len(prints) < 2 or labels.min() == labels.max():
        return []
    start = int(bucket[0] >> 32) // len(CHOICES)
    first, second = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
    merged, found, same = labels.copy(), [], low[0] == high[0]
    values = prints.view(np.uint64)
    for i in first.tolist():
        other = second[second > i] if same else second
        other = other[merged[other] != merged[i]]
        for j in other[ring_near(values[i], values[other], start, distance)].tolist():
            if merged[i] != merged[j]:  # a link found here joins two components, whose other pairs need no look
                found.append((int(prints[i]), int(prints[j])))
                merged[merged == merged[j]] = merged[i]
    return found


def _block_links(distance: int):
    """Compares runs of rows with equal (bucket, low, high); rows come sorted by these."""

    def result(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            pairs, start = [], 0
            for stop in changes.tolist():
                pairs += _compare(rows.slice(start, stop - start), distance)
                start = stop
            held = rows.slice(start)
            yield result(pairs)
        if held is not None:
            yield result(_compare(held, distance))

    return run


def print_groups(prints: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Distinct ``print`` longs -> ``node, root`` of every one that is linked with another."""
    keyed = prints.select("print", F.explode(bucket_keys()).alias("bucket"))
    meeting = keyed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("print").alias("lead")).where("members > 1")
    buckets = written(skew_join(keyed, meeting, "bucket").select("bucket", "print", "lead"), "print-buckets")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("lead"))) <= config.distance
    links = written(
        buckets.where("print <> lead").where(near).select(F.col("lead").alias("a"), F.col("print").alias("b")).distinct(), "print-links"
    )
    roots = components(links).withColumnRenamed("node", "print")
    labelled = written(
        skew_join(buckets, roots, "print", "left").select("bucket", "print", "lead", F.coalesce("root", "print").alias("label")), "print-labels"
    )
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("members"))
        .where("least < most")
        .select("bucket", F.ceil(F.col("members") / F.lit(config.block_rows)).alias("blocks"))
    )
    each = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = (
        skew_join(labelled, mixed, "bucket")
        .where("print <> lead")
        .withColumn("block", F.pmod(F.xxhash64("print", "bucket"), F.col("blocks")))
        .withColumn("other", F.explode(each))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select("bucket", "low", "high", "block", "print", "label")
    )
    key = ["bucket", "low", "high"]
    crossing = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_block_links(config.distance), "a long, b long")
    return components(links.union(written(crossing, "print-crossing")))


def simhash_groups(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``(doc_id, text)`` -> ``doc_id, fingerprint, component_id``, one row per input row.

    A null or empty text, and one without words, has the fingerprint zero and is linked like any other; fewer words
    than ``width`` form one shingle. Repeated rows give repeated result rows; rows that share a doc_id are one node, so they
    tie their fingerprints together. A row without doc_id has a fingerprint, links nothing and has no component_id.
    No rows give no rows. Other columns of ``docs`` are not read.
    """
    python_batches(docs.sparkSession)
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    found = written(bodies.mapInArrow(_fingerprints(config), "doc_id long, print long"), "prints")
    owned = found.where("doc_id is not null")
    classes = written(owned.groupBy("print").agg(F.min("doc_id").alias("rep")), "print-classes")
    groups = print_groups(classes.select("print"), config)
    # rows that share a doc_id but not their fingerprint tie two classes together
    several = owned.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select("doc_id", "a")
    ties = skew_join(owned, several, "doc_id").where("print <> a").select("a", F.col("print").alias("b")).distinct()
    ties = written(ties, "print-ties")
    if not ties.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(ties))
    rooted = skew_join(classes, groups.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = written(rooted, "print-roots")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = skew_join(rooted.select("print", "root"), least, "root").select("print", "component_id")
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return skew_join(found, named, "print", "left").select(
        "doc_id", shown, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )

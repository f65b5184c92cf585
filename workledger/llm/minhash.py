"""MinHash near-duplicate groups with fast similarity sketching, banding and exact verification.

A sketch has ``bins`` coordinates. In round i every shingle of the set draws a bin and a value; a bin keeps
the smallest value of the first round in which anything falls into it. In the first ``bins`` rounds bins
are drawn by hash, in the next ``bins`` rounds all shingles go to bin i, so every coordinate is filled after
at most twice as many rounds, and usually after two or three. Coordinates of two sets agree with the
probability of their Jaccard similarity, and concentrate as independent MinHashes do.

How the job stays linear with large groups of copies:

1. documents with equal shingle sets are one class, stood for by its smallest doc_id;
2. classes that share a band meet in a bucket. Each is first checked against the bucket's smallest class
   only. Components of the confirmed links follow;
3. only then the remaining pairs of a bucket that lie in *different* components are checked: large buckets are
   dealt into blocks, and two blocks at a time are compared on sketches and, where these come near the
   threshold, on full sets. Only confirmed links leave; pairs are never rows. Pairs inside a component could
   not change the result and are skipped.

Candidates carry no cap; every link is confirmed on the full sets of both texts. With 32 bands of 5
coordinates a pair at similarity 0.8 shares no band with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import (
    binary_lists,
    mix64,
    python_batches,
    shingle_set,
    skew_join,
    text_bytes,
    written,
)
from workledger.operators.graph import components


@dataclass(frozen=True)
class MinHashConfig:
    """``width`` words a shingle, link at ``percent`` Jaccard, ``bands`` of ``rows`` coordinates each.

    ``slack`` is how far below the threshold a sketch's estimate may lie before a pair is verified no more:
    0.18 is over five standard deviations of the estimate at the default size. ``block_rows`` is about how many
    members of a bucket are compared with as many others in one call.
    """

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    slack: float = 0.18
    block_rows: int = 512

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def fast_similarity_sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of a non-empty array of distinct 64-bit shingle hashes, one 64-bit value per bin."""
    out = np.zeros(bins, np.uint64)
    empty = np.ones(bins, bool)
    at_once = max(1, min(256, 768 // len(shingles)))
    low40 = np.uint64((1 << 40) - 1)
    start = 0
    while start < 2 * bins:
        rounds = np.arange(start, min(start + at_once, 2 * bins), dtype=np.uint64)
        h = mix64(shingles[None, :] + mix64(rounds + np.uint64(1))[:, None])
        drawn = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        into = np.where((rounds >= bins)[:, None], (rounds - np.uint64(bins))[:, None], drawn)
        step = (rounds - np.uint64(start))[:, None]
        keys = ((into << np.uint64(48)) | (step << np.uint64(40)) | (mix64(h) & low40)).ravel()
        keys.sort()
        filled = (keys >> np.uint64(48)).astype(np.int64)
        first = np.ones(len(filled), bool)
        first[1:] = filled[1:] != filled[:-1]
        bin_no, value = filled[first], keys[first] & np.uint64((1 << 48) - 1)
        new = empty[bin_no]
        out[bin_no[new]] = mix64(value[new] + (np.uint64(start) << np.uint64(40)))
        empty[bin_no[new]] = False
        if not empty.any():
            break
        start += at_once
    return out


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    grid = sketch.reshape(bands, -1)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(grid.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + grid[:, i])
    return out.view(np.int64)


def _sketches(config: MinHashConfig):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("bytes8", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            sizes, digests, bands, small = [], [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), config.width)
                sizes.append(len(found))
                if not len(found):
                    digests.append(b"")
                    bands.append(none)
                    small.append(b"")
                    continue
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketch = fast_similarity_sketch(found, config.bins)
                bands.append(band_hashes(sketch, config.bands))
                small.append((sketch >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    binary_lists(bands, pa.int64()),
                    pa.array(small, pa.binary()),
                ],
                schema=schema,
            )

    return run


def _overlap(one: np.ndarray, two: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _compare(rows: pa.Table, config: MinHashConfig) -> list[tuple[int, int]]:
    """Confirmed links between the two blocks of one bucket that ``rows`` holds, across components only.

    A pair that meets in several buckets is looked at in the first of them.
    """
    rep, label, n, block, low, high, band = (
        rows.column(c).to_numpy() for c in ("rep", "label", "n", "block", "low", "high", "band")
    )
    same = low[0] == high[0]
    first, second = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
    if len(rep) < 2 or label.min() == label.max() or not len(first) or not len(second):
        return []
    sketch = np.frombuffer(b"".join(rows.column("bytes8").to_pylist()), np.uint8).reshape(-1, config.bins)
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, config.bands)
    bodies = rows.column("body")
    least = (config.percent / 100 - config.slack) * config.bins
    sets: dict[int, np.ndarray] = {}

    def members(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(bodies[i].as_py(), config.width)
        return sets[i]

    found = []
    merged = label.copy()  # a link found here joins two components, whose other pairs need no look
    for i in first.tolist():
        other = second[second > i] if same else second
        other = other[merged[other] != merged[i]]
        near = (label[other] != label[i]) & (100 * np.minimum(n[other], n[i]) >= config.percent * np.maximum(n[other], n[i]))
        other = other[near]
        if len(other):
            other = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
        if len(other):
            other = other[(bands[other] == bands[i]).argmax(axis=1) == band[0]]
        for j in other.tolist():
            if merged[i] == merged[j]:
                continue
            both = _overlap(members(i), members(j))
            if 100 * both >= config.percent * (n[i] + n[j] - both):
                found.append((int(rep[i]), int(rep[j])))
                merged[merged == merged[j]] = merged[i]
    return found


def _block_links(config: MinHashConfig):
    """Compares runs of rows with equal (bucket, low, high); rows come sorted by these."""

    def result(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            pairs = []
            start = 0
            for stop in changes.tolist():
                pairs += _compare(rows.slice(start, stop - start), config)
                start = stop
            held = rows.slice(start)
            yield result(pairs)
        if held is not None:
            yield result(_compare(held, config))

    return run


def _confirmed(config: MinHashConfig):
    """Keeps pairs whose full shingle sets reach the threshold. Rows come sorted by ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            ids = batch.column(0).to_pylist()
            for i, a in enumerate(ids):
                if a != last:
                    last, held = a, shingle_set(batch.column(2)[i].as_py(), config.width)
                other = shingle_set(batch.column(3)[i].as_py(), config.width)
                both = _overlap(held, other)
                keep.append(100 * both >= config.percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_())
            )

    return run


def _verify(pairs: DataFrame, texts: DataFrame, config: MinHashConfig, name: str) -> DataFrame:
    """``(a, b)`` candidate pairs of classes -> the confirmed ones, written."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b"))
    joined = skew_join(skew_join(pairs, right, "b"), left, "a").select("a", "b", "body_a", "body_b")
    return written(joined.mapInArrow(_confirmed(config), "a long, b long"), name)


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``(doc_id, text)`` -> ``doc_id, n_shingles, component_id, kept``, one row per input row.

    A null or empty text has no shingles and links with nothing; fewer words than ``width`` form one shingle.
    Repeated rows give repeated result rows; rows that share a doc_id are one node (but a row without shingles
    stays by itself). A row without doc_id is linked with nothing: its component_id is null and it is kept. No rows give no rows. Other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    python_batches(spark)
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    sketches = written(
        bodies.mapInArrow(_sketches(config), "doc_id long, n long, digest binary, bands array<long>, bytes8 binary"),
        "sketches",
    )
    classes = written(
        sketches.where("doc_id is not null and n > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bytes8").alias("bytes8")),
        "classes",
    )
    banded = classes.select("rep", "n", F.posexplode("bands").alias("band", "h")).select(
        F.xxhash64("band", "h").alias("bucket"), "band", "rep", "n"
    )
    meeting = (
        banded.groupBy("bucket")
        .agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("lead"))
        .where("members > 1")
    )
    buckets = written(
        skew_join(banded, meeting, "bucket").select(
            "bucket", "band", "rep", "n", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n")
        ),
        "buckets",
    )
    texts = bodies.where("doc_id is not null")
    fits = f"100 * least(n, lead_n) >= {config.percent} * greatest(n, lead_n)"
    first = buckets.where("rep <> lead").where(fits).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    # rows that share a doc_id but not their shingles tie their classes together
    shared = (
        sketches.where("doc_id is not null and n > 0")
        .groupBy("doc_id")
        .agg(F.min(F.xxhash64("digest")).alias("one"), F.max(F.xxhash64("digest")).alias("two"))
        .where("one < two")
        .select("doc_id")
    )
    tied = skew_join(skew_join(sketches.select("doc_id", "digest"), shared, "doc_id"), classes.select("digest", "rep"), "digest")
    tied = written(tied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "links-tied")
    links = _verify(first, texts, config, "links-lead").union(tied)
    roots = components(links)

    labelled = skew_join(
        buckets.withColumnRenamed("rep", "node"), roots, "node", "left"
    ).select("bucket", "band", F.col("node").alias("rep"), "lead", F.coalesce("root", "node").alias("label"))
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("members"))
        .where("least < most")
        .select("bucket", F.ceil(F.col("members") / F.lit(config.block_rows)).alias("blocks"))
    )
    open_ = written(skew_join(labelled, mixed, "bucket").where("rep <> lead"), "open")
    held = skew_join(
        open_.select("bucket", "band", "rep", "label", "blocks"),
        classes.select("rep", "n", "bands", "bytes8"),
        "rep",
    )
    bodies_of = texts.select(F.col("doc_id").alias("rep"), "body")
    dealt = (
        skew_join(held, bodies_of, "rep")
        .withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select("bucket", "low", "high", "block", "band", "rep", "label", "n", "bands", "bytes8", "body")
    )
    key = ["bucket", "low", "high"]
    crossing = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_block_links(config), "a long, b long")
    links = links.union(written(crossing, "links-rest"))
    roots = components(links)

    owner = skew_join(classes.select("digest", F.col("rep").alias("node")), roots, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("component_id")
    )
    return skew_join(sketches.select("doc_id", "n", "digest"), owner, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.expr("doc_id is null or doc_id = coalesce(component_id, doc_id)").alias("kept"),
    )

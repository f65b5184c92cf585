"""Running sums and products along keys that may lie in many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import written

PRIME = (1 << 31) - 1


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo the prime."""
    out = np.ones(len(exponents), np.int64)
    square, left = base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def running(bases_of: list[int | None], key: str, values: list[str]):
    """Products along runs of equal ``key``, in the order in which rows come: ``n``, the row's number in its run in
    this task from 1, and for each value the sum of ``value * base ** (n - 1)``; a plain sum where the base is None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, carried = None, 0, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            rows = np.arange(len(keys))
            starts = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = np.maximum.accumulate(np.where(starts, rows, 0))
            goes_on = (first == 0) & (keys[0] == last)
            n = rows - first + np.where(goes_on, count, 0)
            out = [*batch.columns, pa.array(n + 1, pa.int64())]
            for k, (base, value) in enumerate(zip(bases_of, values, strict=True)):
                terms = batch.column(value).to_numpy()
                if base is not None:
                    terms = terms % PRIME * powers(base, n) % PRIME
                sums = np.cumsum(terms)
                sums = sums - np.where(first > 0, sums[first - 1], 0) + np.where(goes_on, carried[k], 0)
                sums = sums % PRIME if base is not None else sums
                carried[k] = int(sums[-1])
                out.append(pa.array(sums, pa.int64()))
            last, count = keys[-1], int(n[-1]) + 1
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "n", *(f"sum_{v}" for v in values)])

    return run


def products(rows: DataFrame, name: str, key: str, order: list[str], values: list[str], bases_of: list[int | None]) -> DataFrame:
    """``rows`` with ``n``, a row's number within its ``key`` from 1, and ``sum_*``, the product up to it.

    ``key`` may not be null. A key with very many rows lies in many tasks; what goes from one task to the next is a row a task.
    """
    spark = rows.sparkSession
    sums = [f"sum_{v}" for v in values]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, at long, n long, " + ", ".join(f"{c} long" for c in sums)
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    dealt = dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    done = written(dealt.mapInArrow(running(bases_of, key, values), schema), name)
    # the last row of each task, found by number so that the winner combines before the shuffle
    ends = done.groupBy("part").agg(F.max("at").alias("at"), F.min(key).alias("first"))
    ends = ends.join(done.select("part", "at", key, "n", *sums), ["part", "at"]).orderBy("part").collect()
    carries, held, count, state = [], None, 0, [0] * len(sums)
    for end in ends:
        if end["first"] == held:
            carries.append((end["part"], held, count, *state, *(pow(b, count, PRIME) if b else 1 for b in bases_of)))
        if end[key] != held:
            held, count, state = end[key], 0, [0] * len(sums)
        state = [s + (end[c] * pow(b, count, PRIME) if b else end[c]) for s, c, b in zip(state, sums, bases_of, strict=True)]
        state = [s % PRIME if b else s for s, b in zip(state, bases_of, strict=True)]
        count += end["n"]
    columns = ["c_n", *(f"c_{c}" for c in sums), *(f"p_{c}" for c in sums)]
    table = spark.createDataFrame(carries, f"part int, {key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in columns))
    both = done.join(F.broadcast(table), ["part", key], "left")
    whole = [
        F.when(F.col("c_n").isNull(), F.col(c)).otherwise((F.col(f"c_{c}") + F.col(f"p_{c}") * F.col(c)) % F.lit(PRIME) if b else F.col(f"c_{c}") + F.col(c)).alias(c)
        for c, b in zip(sums, bases_of, strict=True)
    ]
    return both.select(*rows.columns, (F.col("n") + F.coalesce("c_n", F.lit(0))).alias("n"), *whole)

"""Merkle manifest of a corpus: leaf coordinates by bitmap ranks, levels reduced in keyed slot arrays.

Where a leaf lies in its tree follows from the ids alone, so no document is sorted:

1. doc_ids become bits of 64-bit words, merged per language by ``bit_or`` before the shuffle. Words without a
   bit are not stored, so sparse ids cost one word each and dense ones a 64th;
2. a popcount directory holds, for each word, how many rows of its language lie before it. It is a radix
   tree: each level sums siblings under one parent, so no group exceeds ``2 ** fan_bits`` rows;
3. a leaf's place is its word's entry plus the popcount of the bits below its own.

A word in which rows share a doc_id, or the rows without one, cannot be told apart by bits. Only these rows are
numbered by a range partition, in the order (doc_id, leaf digest).

``2 ** block_bits`` neighbours are put into the slots of one array, which is reduced by as many levels in one go;
the arrays' tops are the next round's leaves. On the way down each array hands its members their siblings,
so proofs and folded roots are made where the leaves lie, in the last step. Texts are read once and not moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workledger.llm.common import python_batches, skew_join, written
from workledger.shared import in_order

#: What a leaf digests, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stands for the word of rows without doc_id: below every word of an id.
NO_ID_WORD = -(1 << 57) - 1


@dataclass(frozen=True)
class ManifestConfig:
    """``block_bits`` levels of a tree are reduced in one array; directory groups have ``2 ** fan_bits`` rows."""

    block_bits: int = 10
    fan_bits: int = 15


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(**changed: Column) -> Column:
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``key, doc_id, word, low, leaf, touched, row`` of every row; ``touched`` is the leaf after tampering, if any.

    ``key`` names the language and sorts as languages do: null first, then by UTF-8 bytes. Tampering adds 1 to
    n_chars where 7 divides the CRC-32 of the decimal doc_id; a null n_chars or doc_id is left alone.
    """
    tampers = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # wider than n_chars, so that it cannot overflow
    return docs.select(*FIELDS).select(
        F.when(F.col("lang").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("lang"))).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 6), F.lit(NO_ID_WORD)).alias("word"),
        F.expr("cast(cast(doc_id as long) & 63 as int)").alias("low"),
        _digest().alias("leaf"),
        F.when(tampers, _digest(n_chars=more)).alias("touched"),
        F.monotonically_increasing_id().alias("row"),
    )


def directory(words: DataFrame, fan_bits: int = 15) -> DataFrame:
    """``(key, word, n)`` -> ``key, word, base``: rows of the key in smaller words, by sums over a radix tree."""
    steps = list(range(0, 58, fan_bits))
    base = None
    for shift in reversed(steps):
        last = shift == steps[-1]
        level = words.groupBy("key", F.shiftright("word", shift).alias("unit")).agg(F.sum("n").alias("n"))
        level = level.withColumn("parent", F.lit(0).cast("long") if last else F.shiftright("unit", fan_bits))
        ahead = Window.partitionBy("key", "parent").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        if base is not None:
            level = level.join(base, ["key", "parent"]).withColumn("before", F.col("before") + F.col("above"))
        base = level.select("key", F.col("unit").alias("parent"), F.col("before").alias("above"))
    return base.select("key", F.col("parent").alias("word"), F.col("above").alias("base"))


def coordinates(found: DataFrame, config: ManifestConfig = ManifestConfig()) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (written) -> them with ``index``, the place within their key from 0; and ``key, n``."""
    words = written(
        found.groupBy("key", "word").agg(F.expr("coalesce(bit_or(shiftleft(1L, low)), 0L)").alias("bits"), F.count("*").alias("n")), "manifest-words"
    )
    placed = written(words.join(directory(words, config.fan_bits), ["key", "word"]), "manifest-directory")
    clear = F.col("n") == F.bit_count("bits")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, low))")
    keep = [c for c in found.columns if c not in ("word", "low", "row")]
    index = (F.col("base") + below).cast("long").alias("index")
    ranked = found.join(placed.where(clear), ["key", "word"]).select(*keep, index)
    shared = placed.where(~clear)
    if not shared.isEmpty():
        rows = in_order(found.join(shared.select("key", "word"), ["key", "word"], "left_semi"), "manifest-shared", "key", "word", "doc_id", "leaf", "row")
        starts = rows.groupBy("key", "word").agg(F.min("place").alias("start"))
        within = rows.join(starts.join(shared.select("key", "word", "base"), ["key", "word"]), ["key", "word"])
        ranked = ranked.union(within.select(*keep, (F.col("base") + F.col("place") - F.col("start")).alias("index")))
    return ranked, words.groupBy("key").agg(F.sum("n").alias("n"))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels that ``n`` nodes need to become one."""
    return max(0, n - 1).bit_length()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each of ``levels`` levels, the given ones first, and what they become last."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_hash("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def path_of(levels: list[list[str]], at: int) -> tuple[str, str]:
    """Sides (L, R, or - where there is none) and digests of the siblings of node ``at``, from its level up."""
    sides, siblings = [], []
    for nodes in levels[:-1]:
        other = at ^ 1
        if other < len(nodes):
            sides.append("L" if at & 1 else "R")
            siblings.append(nodes[other])
        else:
            sides.append("-")
        at >>= 1
    return "".join(sides), "".join(siblings)


def folded(node: str, sides: str, siblings: str) -> str:
    """The root that a node and its siblings give."""
    at = 0
    for side in sides:
        if side == "-":
            node = _hash(node)
            continue
        other = siblings[at : at + 64]
        at += 64
        node = _hash(other + node if side == "L" else node + other)
    return node


def _rows(batch: pa.RecordBatch):
    """Every array of a batch as a dict of its columns, its slots in order."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in names if c != "slots"}
        entries = batch.column("slots")[i].values
        slots: list = [None] * len(entries)
        for entry in entries.to_pylist():
            slots[entry["slot"]] = entry
        yield row, slots


def _levels(row: dict, slots: list[dict], done: int, bits: int) -> list[list[str]]:
    return reduced([s["digest"] for s in slots], min(bits, max(0, height(row["n"]) - done)))


def _tops(done: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [_levels(row, slots, done, bits)[-1][0] for row, slots in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(tops, pa.string()), batch.column("n")], names=["key", "index", "digest", "n"])

    return run


_PATH = ("sides", "siblings", "subroot", "root")


def _members(done: int, bits: int):
    """An array's path, handed on to its members, each with its own siblings in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "index", *_PATH)}
            for row, slots in _rows(batch):
                levels = _levels(row, slots, done, bits)
                for at in range(len(slots)):
                    sides, siblings = path_of(levels, at)
                    values = (row["key"], (row["block"] << bits) + at, sides + row["sides"], siblings + row["siblings"], row["subroot"], row["root"])
                    for c, v in zip(out, values, strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64() if c == "index" else pa.string()) for c in out]))

    return run


def _proofs(bits: int):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, slots in _rows(batch):
                levels = _levels(row, slots, 0, bits)
                out: list[tuple] = []
                for at, slot in enumerate(slots):
                    sides, siblings = path_of(levels, at)
                    sides, siblings = sides + row["sides"], siblings + row["siblings"]
                    root = folded(slot["touched"] or slot["digest"], sides, siblings)
                    out.append((slot["doc_id"], slot["digest"], row["subroot"], row["root"], _hash(siblings), root, root == row["root"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return run


class _Tree:
    """Trees by ``key`` over ``(key, index, digest, n, *carry)``: slot arrays, round by round, and their tops."""

    def __init__(self, nodes: DataFrame, most: int, bits: int, name: str, *carry: str) -> None:
        self.bits, self.arrays = bits, []
        rounds = max(1, -(-height(most) // bits))
        for r in range(rounds):
            columns = [F.expr(f"cast(index & {(1 << bits) - 1} as int)").alias("slot"), "digest", *(carry if not r else ())]
            arrays = nodes.groupBy("key", F.shiftright("index", bits).alias("block")).agg(
                F.first("n").alias("n"), F.collect_list(F.struct(*columns)).alias("slots")
            )
            self.arrays.append(written(arrays, f"{name}-arrays"))
            nodes = self.arrays[-1].select("key", "block", "n", "slots").mapInArrow(_tops(r * bits, bits), "key string, index long, digest string, n long")
        self.tops = written(nodes, f"{name}-tops")

    def joined(self, r: int, paths: DataFrame) -> DataFrame:
        """Arrays of round ``r`` with the paths of their tops."""
        above = paths.withColumnRenamed("index", "block")
        return self.arrays[r].join(above, ["key", "block"]).select("key", "block", "n", "slots", *_PATH)

    def descend(self, paths: DataFrame, down_to: int) -> DataFrame:
        """``paths`` of the tops, led down to the nodes of round ``down_to``."""
        schema = "key string, index long, " + ", ".join(f"{c} string" for c in _PATH)
        for r in range(len(self.arrays) - 1, down_to - 1, -1):
            paths = self.joined(r, paths).mapInArrow(_members(r * self.bits, self.bits), schema)
        return paths


def manifest(docs: DataFrame, config: ManifestConfig = ManifestConfig()) -> DataFrame:
    """``(doc_id, source, lang, n_chars, text)`` -> ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``, one row per input row.

    Nulls are digested as ``-``, apart from empty texts (``0:``). Within a language rows without doc_id come first;
    rows that share a doc_id follow one another in the order of their leaf digests (equal rows have equal leaves, and
    each its own place). A row alone in its language has its leaf as subroot, and a language alone its subroot as
    root; the proof of a leaf without siblings digests the empty text. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    python_batches(spark)
    found = written(leaves(docs), "manifest-leaves")
    ranked, sizes = coordinates(found, config)
    sizes = written(sizes, "manifest-sizes")
    langs, most = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).head()
    nodes = skew_join(ranked.withColumnRenamed("leaf", "digest"), sizes, "key")
    trees = _Tree(nodes, most, config.block_bits, "manifest", "doc_id", "touched")
    # the subroots are the leaves of one more tree
    subroots = in_order(trees.tops.select("key", F.col("digest").alias("subroot")), "manifest-langs", "key")
    top = _Tree(
        subroots.select(F.lit("").alias("key"), F.col("place").alias("index"), F.col("subroot").alias("digest"), F.lit(langs).cast("long").alias("n")),
        langs, config.block_bits, "manifest-top",
    )
    empty = F.lit("")
    roots = top.tops.select("key", "index", empty.alias("sides"), empty.alias("siblings"), empty.alias("subroot"), F.col("digest").alias("root"))
    ways = top.descend(roots, 0).select(F.col("index").alias("place"), "sides", "siblings", "root")
    paths = subroots.join(ways, "place").select("key", F.lit(0).cast("long").alias("index"), "sides", "siblings", "subroot", "root")
    arrays = trees.joined(0, trees.descend(written(paths, "manifest-paths"), 1))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return arrays.mapInArrow(_proofs(config.block_bits), schema)

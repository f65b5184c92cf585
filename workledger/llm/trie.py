"""Prefix trie of rebuilt conversations by composable fingerprints; no rebuilt text is ever made.

A sequence of turns has an element of a monoid: ``(n, v)``, its length and, for each base B, the sum of
``t_j * B**j`` modulo a prime, where ``t_j`` is hashed from turn j. Products are symbolic:
``(n, v) * (m, w) = (n + m, v + B**n * w)``, and as B has an inverse, the part of a conversation after its first h
turns follows from two of its prefixes. So the prefixes of a rebuilt conversation, the head of another one followed by
a part of its own, are arithmetic on the prefixes of stored conversations.

1. Conversations are dealt by range of (conv_id, turn), so that a long one may lie in many tasks. Each task multiplies
   what it has; the product of a task's last conversation, a row a task, is carried on to the next ones.
2. Equal (depth, fingerprint) propose one node. Each member refers to the stored turn that comes last by content
   address (SHA-256 of role and text). A node whose members refer to different turns is a collision: all bases are
   drawn anew. If all of a node's members agree on the fingerprint and on the last turn, they agree on the parent's
   fingerprint, which these two determine; so by induction nodes are equal sequences.
3. Every node belongs to its smallest member, so each conversation owns an unbroken branch, from where it leaves the
   smaller ones to its end. Sums over subtrees are then sums over a node's *members* of what each one owns, and, on the
   owner's branch, a suffix sum. That takes a fixed number of jobs however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workledger.llm.common import skew_join, written
from workledger.llm.prefix import PRIME, products

#: Longs of a turn's content address.
ADDRESS = ("r1", "r2", "r3", "r4")
PRINT = ("v1", "v2", "v3")
NODE = ("depth", *PRINT)


@dataclass(frozen=True)
class TrieConfig:
    """A rebuilt conversation takes its head from the conversation ``id - id % stride``, and its length is the
    CRC-32 of the decimal id modulo ``heads``. ``bits`` are hashed from a turn for each base; fewer of them
    only make redraws likelier, of which there may be ``draws``. An end digest is made of pieces of ``piece`` ids.
    """

    stride: int = 5
    heads: int = 9
    bits: int = 31
    draws: int = 4
    piece: int = 65_536


def bases(draw: int) -> list[int]:
    """One base for each part of a fingerprint."""
    return [int.from_bytes(hashlib.sha256(f"base {draw} {i}".encode()).digest()[:8]) % (PRIME - 1000) + 500 for i in range(len(PRINT))]


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, bytes, r1..r4`` of every turn; null role and text are empty."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    address = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda i: F.conv(F.substring("address", 16 * i + 1, 16), 16, -10).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.octet_length(text).cast("long").alias("bytes"), address.alias("address"),
    )
    return rows.select("conv_id", "turn", "role", "bytes", *(part(i).alias(r) for i, r in enumerate(ADDRESS)))


def _inverse(base: int, most: int) -> Column:
    """Powers 0 to ``-most`` of a base."""
    return F.array(*(F.lit(pow(base, -i, PRIME)).cast("long") for i in range(most + 1)))


def members(stored: DataFrame, config: TrieConfig, drawn: list[int]) -> DataFrame:
    """Stored turns with prefix products -> ``conv_id, depth, v1..v3, r1..r4, bytes, ends`` of every prefix of every
    rebuilt conversation, the empty one included.
    """
    heads = config.heads - 1
    sums = [f"sum_t{i + 1}" for i in range(len(PRINT))]
    wanted = F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {config.heads} as int)")
    at_head = F.col("n") == wanted
    own = stored.groupBy("conv_id").agg(F.max("n").alias("own"), *(F.max(F.when(at_head, F.col(c))).alias(f"own_{v}") for c, v in zip(sums, PRINT, strict=True)))
    first = stored.where((F.col("n") <= heads) & (F.col("conv_id") % config.stride == 0))
    entry = F.struct("n", *(F.col(c).alias(v) for c, v in zip(sums, PRINT, strict=True)), *ADDRESS, "bytes")
    base = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(entry)).alias("head"))  # at most ``heads`` entries
    own = own.withColumn("h", wanted).withColumn("base", F.col("conv_id") - F.col("conv_id") % config.stride)
    plan = own.join(base, "base", "left").withColumn("k", F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0))))
    plan = written(
        plan.select(
            "conv_id", "h", "k", F.when(F.col("k") > 0, F.slice("head", 1, "k")).alias("head"), *(f"own_{v}" for v in PRINT),
            (F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len"),
        ),
        "trie-plan",
    )
    zero = F.lit(0).cast("long")
    ends = (F.col("depth") == F.col("len")).cast("int").alias("ends")
    columns = ["conv_id", "depth", *PRINT, *ADDRESS, "bytes"]
    roots = plan.select("conv_id", zero.alias("depth"), *(zero.alias(c) for c in columns[2:]), "len")
    taken = plan.select("conv_id", F.explode("head").alias("e"), "len").select(
        "conv_id", F.col("e.n").alias("depth"), *(F.col(f"e.{c}") for c in columns[2:]), "len"
    )
    # own turns after the first h: head * (own prefix h) ** -1 * own prefix
    before = [F.when(F.col("k") > 0, F.element_at("head", -1)[v]).otherwise(zero) for v in PRINT]
    start = plan.select(
        F.col("conv_id"), "h", "k", "len", *(b.alias(f"head_{v}") for b, v in zip(before, PRINT, strict=True)),
        *(F.coalesce(f"own_{v}", zero).alias(f"own_{v}") for v in PRINT),
    )
    suffix = skew_join(stored, start, "conv_id").where("n > h")
    moved = [
        (F.col(f"head_{v}") + F.pmod(F.col(c) - F.col(f"own_{v}"), F.lit(PRIME)) * F.element_at(_inverse(b, heads), F.col("h") - F.col("k") + 1)) % F.lit(PRIME)
        for c, v, b in zip(sums, PRINT, drawn, strict=True)
    ]
    rest = suffix.select("conv_id", (F.col("k") + F.col("n") - F.col("h")).alias("depth"), *(m.alias(v) for m, v in zip(moved, PRINT, strict=True)), *ADDRESS, "bytes", "len")
    return roots.union(taken).union(rest).select(*columns, ends)


def _pieces(piece: int):
    """Runs of equal nodes, ids ascending -> comma-joined ids, a row for up to ``piece`` of them."""
    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("first", pa.int64()), ("ids", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(NODE, node)) | {"first": ids[0], "ids": ",".join(map(str, ids))}], schema=schema)

        for batch in batches:
            for *here, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (here != node or len(ids) == piece):
                    yield closed()
                    ids = []
                node = here
                ids.append(conv)
        if ids:
            yield closed()

    return run


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of nodes in order -> a digest a node; no more than a piece is held."""
    node, state = None, None

    def out(of, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in of), pa.array([digest.hexdigest()])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *here, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if here != node:
                if state is not None:
                    yield out(node, state)
                node, state = here, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield out(node, state)


def end_digests(ends: DataFrame, piece: int) -> DataFrame:
    """``(node, conv_id)`` -> the SHA-256 of each node's ids, ascending and comma-joined.

    Ids are joined where a range partition put them. A digest is sequential by nature: of a node that many
    conversations end in, one task takes the pieces, in order and one at a time.
    """
    order = [*NODE, "conv_id"]
    sorted_ = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    types = ", ".join(f"{c} long" for c in NODE)
    pieces = written(sorted_.mapInArrow(_pieces(piece), f"{types}, first long, ids string"), "trie-pieces")
    several = pieces.groupBy(*NODE).agg(F.count("*").alias("pieces"), F.first("ids").alias("ids"))
    one = several.where("pieces = 1").select(*NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = pieces.join(several.where("pieces > 1").select(*NODE), list(NODE), "left_semi")
    many = many.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_joined_digests, f"{types}, ends_sha256 string")
    return one.union(many)


def prefix_trie(conversations: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, one row per distinct prefix of a rebuilt conversation.

    Turns come in the order of ``turn``, null first; of equal ones, the smaller role and then the smaller content
    address. Repeated rows are repeated turns. Null roles and texts are empty. Rows without conv_id are left out. A negative
    id takes its head from ``id - id % stride`` with SQL's remainder, which is negative. No rows give no rows.
    Other columns are not read.
    """
    told = turns(conversations)
    hashed = [(F.col(r).bitwiseAND(F.lit((1 << config.bits) - 1))).alias(f"t{i + 1}") for i, r in enumerate(ADDRESS[: len(PRINT)])]
    told = written(told.select("*", *hashed), "trie-turns")
    values = [f"t{i + 1}" for i in range(len(PRINT))]
    for draw in range(config.draws):
        drawn = bases(draw)
        stored = products(told, "trie-products", "conv_id", ["turn", "role", *ADDRESS], values, drawn)
        stored = stored.select("conv_id", "n", *(f"sum_{v}" for v in values), *ADDRESS, "bytes")
        rows = written(members(stored, config, drawn), "trie-members")
        differ = " or ".join(f"min({r}) <> max({r})" for r in ADDRESS)
        nodes = written(
            rows.groupBy(*NODE).agg(
                F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("ends").alias("n_ends"),
                F.max("bytes").alias("bytes"), F.expr(differ).alias("mixed"),
            ),
            "trie-nodes",
        )
        if nodes.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError(f"fingerprints of different prefixes met in each of {config.draws} draws of bases")
    return _summed(rows, nodes, config)


def _summed(rows: DataFrame, nodes: DataFrame, config: TrieConfig) -> DataFrame:
    """Members and verified nodes -> the nodes with what their subtrees hold."""
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    owned = written(
        nodes.groupBy("conv_id").agg(
            F.min("depth").alias("from"), F.max("depth").alias("to"), F.sum("saved").alias("owned"), F.sum(leaf).alias("leaves")
        ),
        "trie-owned",
    )
    shown = skew_join(rows.select("conv_id", *NODE), owned, "conv_id")
    shown = written(shown, "trie-shown")
    branches = F.col("depth") + 1 == F.col("from")
    other = F.col("depth") < F.col("from")
    goes_on = (F.col("depth") >= F.col("from")) & (F.col("depth") < F.col("to"))
    sums = shown.groupBy(*NODE).agg(
        F.sum((branches | goes_on).cast("long")).alias("n_children"), F.sum("leaves").alias("n_leaves"),
        F.sum(F.when(other, F.col("owned")).otherwise(0)).alias("branched"),
    )
    # on the owner's branch: its own nodes from here on, as the whole less what lies before
    along = products(nodes.select("conv_id", *NODE, "saved"), "trie-branches", "conv_id", ["depth"], ["saved"], [None])
    along = along.select(*NODE, F.col("sum_saved"))
    # where a branch starts, the parent is another's node
    joint = shown.where(branches).select(F.col("conv_id").alias("branch"), *NODE)
    joint = skew_join(joint.withColumn("at", F.xxhash64(*NODE)), nodes.select(*(F.col(c).alias(f"n_{c}") for c in NODE), F.col("conv_id").alias("parent"), F.xxhash64(*NODE).alias("at")), "at")
    parents = joint.where(" and ".join(f"{c} = n_{c}" for c in NODE)).select(F.col("branch").alias("conv_id"), "parent")
    digests = end_digests(rows.where("ends = 1"), config.piece)
    empty = hashlib.sha256(b"").hexdigest()
    key = list(NODE)
    owner = owned.select("conv_id", "from", "owned").join(parents, "conv_id", "left")
    full = nodes.join(sums, key).join(along, key).join(digests, key, "left")
    full = skew_join(full, owner, "conv_id")
    parent = F.when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("parent"))
    return full.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("branched") + F.col("owned") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )

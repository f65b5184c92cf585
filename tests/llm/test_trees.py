"""Prefix trie, Merkle manifest and SimHash groups: results against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("workledger.llm")
import xxhash  # noqa: E402

from workledger.llm.manifest import ManifestConfig, manifest  # noqa: E402
from workledger.llm.simhash import SimHashConfig, print_groups, simhash_groups  # noqa: E402
from workledger.llm.prefix import products  # noqa: E402
from workledger.llm.trie import TrieConfig, bases, prefix_trie  # noqa: E402

CONVERSATION = "conv_id long, turn long, role string, text string"
DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is not None, v if v is not None else 0) for v in r])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- prefix trie


def address(role, text):
    found = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return [int.from_bytes(found[8 * i : 8 * i + 8], signed=True) for i in range(4)]


def rebuilt_conversations(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", address(role or "", text or ""), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:head] + turns[head:])
    return out


def brute_trie(rows):
    rebuilt = rebuilt_conversations(rows)
    members, children = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in below)
    return [
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
            digest(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(node))),
        )
        for node, m in members.items()
    ]


def odd_conversations():
    draw = random.Random(1)
    rows = []
    for c in [*range(60), -3, -5, -7, 1 << 40]:
        if c in (10, 15):  # heads that are absent
            continue
        for t in range(draw.choice([1, 2, 3, 12, 20])):
            turn = None if draw.random() < 0.05 else t
            rows.append((c, turn, draw.choice(["user", "user", None]), draw.choice(["a", "b", None, "é"]) if t < 3 else draw.choice("ab")))
    rows += [(None, 1, "user", "lost")] * 3 + [(200, 1, "user", "again")] * 50 + [(70, 0, "user", "long " * 30_000)]
    rows += [(c, i, "user", "same") for c in (205, 206) for i in range(300)]
    draw.shuffle(rows)
    return rows


def test_trie_against_brute_force(spark):
    rows = odd_conversations()
    found = prefix_trie(spark.createDataFrame(rows, CONVERSATION), TrieConfig(piece=7)).collect()
    assert ordered(found) == ordered(brute_trie(rows))
    assert any(r.depth == 0 and r.parent_conv_id is None for r in found)


def test_trie_of_conversations_over_many_tasks(spark):
    """A key in several tasks gets one product, and clashing columns of the input do no harm."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, i, i % 7) for i in range(3000)] + [(2, i, 3) for i in range(20)]
        base = bases(0)[0]
        found = products(spark.createDataFrame(rows, "k long, i long, v long").repartition(9), "products", "k", ["i"], ["v", "i"], [base, None])
        found = found.collect()
        for k in (1, 2):
            total = plain = 0
            for n, row in enumerate(sorted((r for r in found if r.k == k), key=lambda r: r.i), 1):
                total, plain = (total + row.v * pow(base, n - 1, (1 << 31) - 1)) % ((1 << 31) - 1), plain + row.i
                assert (row.n, row.sum_v, row.sum_i) == (n, total, plain)
        turns = [(5, i, "user", f"t{i % 3}", "x") for i in range(400)] + [(6, i, "user", f"t{i % 3}", "x") for i in range(390)]
        d = spark.createDataFrame(turns, CONVERSATION + ", depth string").repartition(11)
        assert ordered(prefix_trie(d).collect()) == ordered(brute_trie([t[:4] for t in turns]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing_and_of_colliding_fingerprints(spark):
    d = spark.createDataFrame(odd_conversations(), CONVERSATION)
    assert prefix_trie(d.limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="fingerprints"):
        prefix_trie(d, TrieConfig(bits=1, draws=2))


def test_trie_of_turnless_conversations(spark):
    """A conversation shorter than the head it would take from an absent one has no turns left and ends in the root."""
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    (root,) = prefix_trie(spark.createDataFrame([(alone, 0, "user", "x"), (alone, 1, "user", "y")], CONVERSATION)).collect()
    assert tuple(root) == (alone, 0, None, 1, 0, 1, 0, digest(str(alone)))


# ---- Merkle manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return digest("".join(map(field, row)))


def tree_of(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def runs_to_root(levels, at):
    for nodes in levels[:-1]:
        yield at % 2, nodes[at // 2 * 2 : at // 2 * 2 + 2]
        at //= 2


def brute_manifest(rows):
    by = {}
    for doc_id, source, lang, n_chars, text in rows:
        by.setdefault(lang, []).append((doc_id, source, lang, n_chars, text))
    for group in by.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree_of([leaf_of(r) for r in by[v]]) for v in langs}
    top = tree_of([trees[v][-1][0] for v in langs])
    root, out = top[-1][0], []
    for place, lang in enumerate(langs):
        for at, row in enumerate(by[lang]):
            runs = [*runs_to_root(trees[lang], at), *runs_to_root(top, place)]
            siblings = "".join(x for mine, run in runs for k, x in enumerate(run) if k != mine)
            doc_id, n_chars = row[0], row[3]
            tampers = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            node = leaf_of((*row[:3], n_chars + 1, row[4])) if tampers else leaf_of(row)
            for mine, run in runs:
                node = digest("".join(node if k == mine else x for k, x in enumerate(run)))
            out.append((doc_id, leaf_of(row), trees[lang][-1][0], root, digest(siblings), node, node == root))
    return out


def odd_documents():
    rows = [(None, "a", None, None, None)] * 3 + [(None, "q", "en", 7, "t")] + [(5, "a", "en", 1, "x")] * 4 + [(5, "b", "en", 2, "y")]
    rows += [(-7, None, "en", 3, ""), (-64, None, "en", 3, ""), (1 << 62, "a", "en", (1 << 63) - 1, "é" * 200_000), (-(1 << 63), "z", "zz", None, None)]
    rows += [(i * 37, "s", "é" if i % 3 else "", i, "t") for i in range(90)] + [((1 << 63) - 1 - i, "s", "fr", i, "t") for i in range(9)]
    random.Random(2).shuffle(rows)
    return rows


@pytest.mark.parametrize(("block_bits", "fan_bits"), [(1, 15), (3, 5), (10, 15)])
def test_manifest_against_brute_force(spark, block_bits, fan_bits):
    rows = odd_documents()
    found = manifest(spark.createDataFrame(rows, DOCUMENT), ManifestConfig(block_bits, fan_bits)).collect()
    assert ordered(found) == ordered(brute_manifest(rows))
    assert {r.verified for r in found} == {True, False}


def test_manifest_of_little(spark):
    assert manifest(spark.createDataFrame([], DOCUMENT)).count() == 0
    row = (1, "a", "en", 4, "text")
    (alone,) = manifest(spark.createDataFrame([(*row, "k", 9)], DOCUMENT + ", key string, index int")).collect()
    assert tuple(alone) == (1, leaf_of(row), leaf_of(row), leaf_of(row), digest(""), leaf_of(row), True)


# ---- SimHash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def linked(prints):
    values = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist():
            root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_print_groups_against_brute_force(spark, block_rows):
    draw = random.Random(4)
    prints = {draw.getrandbits(64) for _ in range(300)}
    for size, reach in [(60, 7)] * 10 + [(1200, 9)]:  # families whose members lie on both sides of the bound
        centre = draw.getrandbits(64)
        for _ in range(size):
            value = centre
            for _ in range(draw.randrange(reach)):
                value ^= 1 << draw.randrange(64)
            prints.add(value)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {r.node: r.root for r in print_groups(spark.createDataFrame([(p,) for p in signed], "print long"), SimHashConfig(block_rows=block_rows)).collect()}
    groups = {}
    for value, root in zip(signed, linked(prints), strict=True):
        groups.setdefault(root, []).append(value)
    assert {p: found.get(p, p) for p in signed} == {p: min(g) for g in groups.values() for p in g}
    assert len(groups) < len(prints) / 2


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(9, None), (3, ""), (7, " \t\n"), (4, "One two THREE four"), (5, "one  two three\tFOUR"), (6, "É é"), (8, "é é"), (10, long), (2, long + " end")]
    rows += [(None, "one two three four"), (11, "word"), (11, "other words here, and more"), (4, "One two THREE four"), (12, "other words here, and more")]
    found = simhash_groups(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, root int"))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    out = found.collect()
    assert sorted(r.fingerprint for r in out) == sorted(f"{plain_fingerprint(t):016x}" for _, t in rows)
    group = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert group[9] == group[3] == group[7] == 3 and group[4] == group[5] == 4 and group[10] == group[2] == 2
    assert group[12] == 11, "rows that share a doc_id tie their texts together"
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="distance"):
        SimHashConfig(distance=4)

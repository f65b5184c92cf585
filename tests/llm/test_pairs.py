"""Near duplicates, lines, decontamination: results against brute force, and odd rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("workledger.llm")
from workledger.llm.common import words_of  # noqa: E402
from workledger.llm.decontaminate import ContainmentConfig, contaminated_pairs, decontaminate  # noqa: E402
from workledger.llm.lines import LineConfig, dedup_lines, late_lines, line_report, sized  # noqa: E402
from workledger.llm.minhash import MinHashConfig, fast_similarity_sketch, near_duplicates, shingle_set  # noqa: E402
from workledger.operators.graph import components  # noqa: E402

DOC = "doc_id long, text string"


def sets(texts, width):
    out = []
    for t in texts:
        w = words_of((t or "").encode())
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_components(ids, texts, width, percent):
    s = sets(texts, width)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(x) for i, x in zip(ids, s, strict=True)}


def near_corpus(seed=3):
    """Families of edited copies, some of whose members are only linked through others."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(400)}"
    texts = []
    for _ in range(6):
        base = [word() for _ in range(60)]
        for k in range(9):
            copy = list(base)
            for _ in range(k % 5):
                copy[draw.randrange(60)] = word()
            texts.append(" ".join(copy))
    texts += ["", None, "one", "one", "ONE", "a b c", "a  b\tc"]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return order, [texts[i] for i in range(len(texts))]


@pytest.mark.parametrize("config", [MinHashConfig(width=4), MinHashConfig(width=4, block_rows=3)])
def test_components_equal_brute_force(spark, config):
    ids, texts = near_corpus()
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), DOC), config).collect()}
    roots, sizes = brute_components(ids, texts, 4, 80)
    assert {i: r.component_id for i, r in got.items()} == roots
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_rows(spark):
    empty = near_duplicates(spark.createDataFrame([], DOC))
    assert empty.count() == 0 and [f.name for f in empty.schema] == ["doc_id", "n_shingles", "component_id", "kept"]
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, long), (3, long + " end")], DOC)
    got = near_duplicates(rows.withColumn("kept", F.lit("x")).withColumn("component_id", F.lit(0))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 2, False)]
    a, b = "a b c d e f", "u v w x y z"
    shared = near_duplicates(spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (4, "k l m n o p")], DOC)).collect()
    assert sorted((r.doc_id, r.component_id) for r in shared) == [(3, 3), (4, 4), (5, 3), (5, 3), (9, 3)]


def test_sketch_estimates_similarity_and_fills_every_bin():
    a = shingle_set(" ".join(f"x{i}" for i in range(900)).encode(), 1)
    b = shingle_set(" ".join(f"x{i}" for i in range(100, 1000)).encode(), 1)
    near = (fast_similarity_sketch(a, 400) == fast_similarity_sketch(b, 400)).mean()
    assert abs(near - 0.8) < 0.08
    one = fast_similarity_sketch(a[:1], 160)
    assert len(set(one.tolist())) == 160


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, 41)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def late(spark, lines, config):
    """Numbers of the lines that are near one with a smaller number."""
    rows = spark.createDataFrame([*enumerate(lines), (-1, None)], "line_id long, line string").withColumn("place", F.col("line_id"))
    got = [r.line_id for r in late_lines(sized(rows), config).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("edits,few", [(1, 0), (2, 0), (2, 2), (2, 16), (3, 1)])
def test_near_lines_equal_brute_force(spark, edits, few):
    draw = random.Random(edits)
    lines = []
    for _ in range(12):
        base = [draw.choice("abc é") for _ in range(draw.randrange(12, 20))]
        for _ in range(6):
            copy = list(base)
            for _ in range(draw.randrange(0, 4)):
                k = draw.randrange(len(copy))
                draw.choice([lambda: copy.pop(k), lambda: copy.insert(k, "z"), lambda: copy.__setitem__(k, "y")])()
            lines.append("".join(copy))
    lines = sorted(set(lines))
    near = lambda i, j: distance(lines[i], lines[j]) <= (edits if min(len(lines[i]), len(lines[j])) >= 8 else 1)
    want = {j for j in range(len(lines)) if any(near(i, j) for i in range(j))}
    assert late(spark, lines, LineConfig(distance=edits, least_chars=8, few=few)) == want and want


def test_short_lines_are_near_copies_at_one_edit(spark):
    draw = random.Random(9)
    lines = {"", "a", "b", "ab", "é", "Is and thnd.", "To and thnd.", "Thwhesnd esator whshing and hewh.", "Thwhesnd, esator whshing and hewh."}
    for size in (1, 2, 3, 5, 11, 37, 38, 39, 40, 41, 42):
        for _ in range(3):
            base = [draw.choice("abcé ") for _ in range(size)]
            for _ in range(6):
                copy = list(base)
                for _ in range(draw.randrange(0, 3)):
                    k = draw.randrange(len(copy) + 1)
                    draw.choice([lambda: copy.__delitem__(slice(k, k + 1)), lambda: copy.insert(k, "z"), lambda: copy.__setitem__(slice(k, k + 1), "y")])()
                lines.add("".join(copy))
    lines = sorted(lines)
    want = {j for j, y in enumerate(lines) if any(distance(x, y) <= (1 if min(len(x), len(y)) < 40 else 2) for x in lines[:j])}
    for few in (0, 3, 16):
        assert late(spark, lines, LineConfig(few=few)) == want
    docs = spark.createDataFrame([(1, "Thwhesnd esator whshing and hewh.\nIs and thnd."), (2, "Thwhesnd, esator whshing and hewh.\nTo and thnd.")], DOC)
    assert {r.doc_id: tuple(r)[1:] for r in line_report(docs).collect()} == {1: (2, 0, 0, 2), 2: (2, 0, 1, 1)}


def test_lines_of_one_template(spark):
    """Lines that share most segments are told apart by what is rare in them; texts of all kinds of difference."""
    draw = random.Random(6)
    lines = {"session id " + "".join(draw.choice("0123456789abcdef") for _ in range(10)) + " closed by the remote peer after a timeout" for _ in range(300)}
    for line in sorted(lines)[:60]:
        k = draw.randrange(11, 21)
        lines.add(draw.choice([line[:k] + line[k + 1 :], line[:k] + "z" + line[k:], line[:k] + "yz" + line[k + 2 :], line[:3] + "!" + line[4:k] + line[k + 1 :], line + "é."]))
    lines = sorted(lines)
    counts = [Counter(x) for x in lines]
    alike = lambda i, j: (counts[i] - counts[j]).total() <= 2 and (counts[j] - counts[i]).total() <= 2
    want = {j for j, y in enumerate(lines) if any(alike(i, j) and distance(lines[i], y) <= 2 for i in range(j))}
    assert late(spark, lines, LineConfig()) == want and len(want) >= 50
    assert late(spark, lines, LineConfig(common=2)) == want


def test_line_report_and_texts(spark):
    base = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, f"{base}\nshort\n\n{base}"), (2, f"{base}s\nshort\nother"), (3, None), (4, ""), (None, base), (5, f"{base}s")]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: tuple(r)[1:] for r in line_report(docs).collect()}
    assert got == {1: (3, 1, 0, 2), 2: (3, 1, 1, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (1, 1, 0, 0)}
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == {1: f"{base}\nshort", 2: "other", 3: "", 4: "", 5: ""}
    assert line_report(docs.limit(0)).count() == 0


def test_lines_of_odd_rows(spark):
    """Repeated rows, rows that share a doc_id, clashing column names, and a very long line."""
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, "a line that is here twice, once more\nb"), (1, "a line that is here twice, once more\nb"), (1, "another first line, of the same place"), (2, long), (3, long + "!")]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(7) for c in ("line", "at", "line_id", "place", "key", "length", "near", "probe")})
    assert {r.doc_id: tuple(r)[1:] for r in line_report(docs).collect()} == {1: (5, 2, 0, 3), 2: (1, 0, 0, 1), 3: (1, 0, 1, 0)}
    texts = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert sorted(texts[1].split("\n")) == sorted(["a line that is here twice, once more", "b", rows[2][1]]) and (texts[2], texts[3]) == (long, "")


def test_containment_equals_brute_force(spark):
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(2000)}"
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t or "")
    items = [(i, " ".join(word() for _ in range(draw.randrange(5, 40)))) for i in range(20)] + [(20, "too few words"), (21, None), (22, items_text := "a a a a a a a"), (23, "Solo!"), (24, "--")]
    docs = []
    for d in range(60):
        words = [word() for _ in range(draw.randrange(0, 200))]
        if d % 3 == 0:
            passage = items[d % 20][1].upper().split()
            cut = passage[: max(1, int(len(passage) * draw.choice([0.6, 0.85, 0.95, 1])))]
            at = draw.randrange(len(words) + 1)
            words = words[:at] + cut + words[at:]
        docs.append((d, ", ".join(words)))
    docs += [(100, None), (101, ""), (102, items_text + " b"), (102, "x"), (None, items_text), (103, "So, too few words of it; solo"), (104, " ".join(f"v{i}" for i in range(30_000)) + " too few words"), (105, "few")]
    s = {i: x for (i, _), x in zip(items, sets([plain(t) for _, t in items], 5), strict=True) if x}
    texts = {}
    for d, t in docs:
        if d is not None:
            for width in range(1, 6):
                texts.setdefault(d, set()).update(x for x in sets([plain(t)], width)[0] if len(x) == width)
    want = {(d, i) for d, x in texts.items() for i, y in s.items() if 100 * len(x & y) >= 80 * len(y)}
    frame = spark.createDataFrame(docs, DOC)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated_pairs(frame, bench).collect()} == want and want
    out = decontaminate(frame.withColumn("item_id", F.lit(1)), bench, ContainmentConfig()).collect()
    assert len(out) == len(docs) and {r.doc_id for r in out if r.contaminated} == {d for d, _ in want}
    assert not any(r.contaminated for r in decontaminate(frame, bench.limit(0)).collect())

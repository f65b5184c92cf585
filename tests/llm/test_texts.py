"""Pages, archives, toxicity, quality, mixing: cases and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("workledger.llm")
from workledger.llm.html import ARTICLE, blocks_of, main_blocks, main_text, neighbours, shared_lines  # noqa: E402
from workledger.llm.mixing import MixConfig, entropy, mix, solve_exponent, weights_at  # noqa: E402
from workledger.llm.quality import COUNTS, QualityConfig, quality, rule_statistics  # noqa: E402
from workledger.llm.toxicity import ToxicityConfig, cross_validated, held_out, toxicity  # noqa: E402
from workledger.llm.warc import WarcConfig, archived, dechunk, read_archives, records_in, write_archives  # noqa: E402

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>T</h1><p>a  <b>b</b>\nc<p>d &amp;&lt; &eacute;</article>", ["T", "a b c", "d &< é"]),
        ("<nav>menu</nav><article><p>x</p><aside>no</aside><div class='ad'>buy</div><p>y</article><footer>f</footer>", ["x", "y"]),
        ("<article><p>x<script>var t='</p>'</script><style>p{}</style><!-- c --> y</p></article>", ["x y"]),
        ("<header>h</header><article><header><h1>T</h1></header><p>x</p><section class=\"reader comments\"><p>no</p></section></article>", ["T", "x"]),
        ("<div class=cookie-notice><div>c</div></div><main><p>x</p><form><p>f</p></form><p>y", ["x", "y"]),
        ("<nav><ul><li>open<article><p>x</p></article>", ["x"]),
        ("", []),
    ],
)
def test_article_blocks(page, want):
    blocks, labels = blocks_of(page)
    assert [b for b, label in zip(blocks, labels, strict=True) if label == ARTICLE] == want


@pytest.mark.parametrize("name", ["content no-sidebar", "related-work", "notice-period", "ad-hoc", "has-comments", "shared"])
def test_names_that_only_look_like_frames(name):
    assert blocks_of(f"<article class='{name}'><div id='{name}'><p>x</p></div></article>") == (["x"], [ARTICLE])


@pytest.mark.parametrize("name", ["sidebar", "post ad", "ad_slot", "cookie-notice", "commentList", "site-footer left", "related-posts"])
def test_names_of_frames(name):
    assert blocks_of(f"<main><div class='{name}'><p>x</p></div><svg/><svg-icon>y</svg-icon><p>z</main>") == (["x", "y", "z"], [0, ARTICLE, ARTICLE])


def test_whole_pages_equal_brute_force(spark):
    """Every page against its two neighbours on either side, by plain loops over all pages of its host."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    parsed = {r.page_id: blocks_of(r.html or "") for r in rows}
    place = {r.page_id: (r.url.split("/")[2], "/" + r.url.split("/", 3)[3].split("?")[0].split("#")[0]) for r in rows}
    first = {}
    for i in sorted(place, key=lambda i: (place[i][1], i)):
        first.setdefault((place[i][0], tuple(parsed[i][0])), i)
    order = {h: sorted((i for (g, _), i in first.items() if g == h), key=lambda i: (place[i][1], i)) for h in {h for h, _ in place.values()}}
    want = {}
    for i, (blocks, labels) in parsed.items():
        line = order[place[i][0]]
        k = line.index(first[(place[i][0], tuple(blocks))])
        near = [parsed[line[j]][0] for j in range(max(0, k - 2), min(len(line), k + 3)) if j != k]
        want[i] = "\n".join(blocks[j] for j in main_blocks(blocks, bytes(labels), near))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows)).collect()}
    assert got == want
    article = {i: "\n".join(b for b, label in zip(*parsed[i], strict=True) if label == ARTICLE) for i in parsed}
    assert sum(got[i] == article[i] for i in got) >= 0.99 * len(got)


def test_shared_lines_lie_on_a_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(0, 12))] for _ in "ab")
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                grid[i + 1][j + 1] = grid[i][j] + 1 if a[i] == b[j] else max(grid[i][j + 1], grid[i + 1][j])
        found = sorted(shared_lines(a, b))
        assert len(found) == grid[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_pages_without_an_article_lose_what_neighbours_share(spark):
    page = lambda x: f"<div>Site name</div><p>{x}</p><p>All rights</p>"
    rows = [(i, f"http://h.example/p/{i}", page(f"own {i}")) for i in range(4)] + [(9, "http://other.example/p/1", page("alone")), (10, None, None), (None, "http://h.example/p/2", page("x"))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("clash"))).collect()}
    assert got == {**{i: f"own {i}" for i in range(4)}, 9: "Site name\nalone\nAll rights", 10: "", None: "Site name\nx\nAll rights"}
    assert main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_copies_and_passages_of_two_pages_survive_differencing(spark):
    page = lambda *x: "<div>Site name</div>" + "".join(f"<p>{y}</p>" for y in x) + "<p>All rights</p>"
    own = [("copied", "again")] * 5 + [(f"own {i}",) for i in range(5)]
    own[6:8] = [("own 6", "quoted"), ("quoted", "own 7")]
    rows = [(i, f"http://h.example/p/{i}", page(*x)) for i, x in enumerate(own)]
    rows += [(20 + i, f"http://two.example/{i}", page(f"own {i}")) for i in range(2)]
    want = {i: "\n".join(x) for i, x in enumerate(own)} | {20 + i: f"Site name\nown {i}\nAll rights" for i in range(2)}
    assert {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGE)).collect()} == want


def test_articles_keep_what_others_say_too(spark):
    """Opening and closing lines that neighbours share are text where the article has a line of its own."""
    page = lambda *x: "<div>Site name</div><article>" + "".join(f"<p>{y}</p>" for y in x) + "</article><p>All rights</p>"
    rows = [(i, f"http://h.example/p/{i}", page("Dear readers", f"own {i}", "See you tomorrow")) for i in range(6)]
    rows += [(10 + i, f"http://k.example/p/{i}", "<article><p>Only this</p></article><p>Between</p>" + f"<article><p>own {i}</p></article>") for i in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {i: f"Dear readers\nown {i}\nSee you tomorrow" for i in range(6)} | {10 + i: f"own {i}" for i in range(5)}


def test_neighbours_over_the_edges_of_partitions(spark):
    rows = [(i, "a" if i < 30 else "b", f"/{i:03}", i) for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.page, r.near) for r in neighbours(spark.createDataFrame(rows, "page long, host string, path string, page_id long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(i, j) for i in range(50) for j in range(50) if i != j and abs(i - j) <= 2 and (i < 30) == (j < 30)}


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1 text " * 4000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/\n3", "x" * 999), (4, None, "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", "y" * 1000), (8, "u", big)]
    out = archived(spark.createDataFrame(rows, PAGE).withColumn("owner", F.lit(1)), f"file://{tmp_path}/w", WarcConfig(segment_chars=500, chunk_chars=64))
    got = {r.page_id: r for r in out.collect()}
    assert not [r.error for r in got.values() if r.error]
    for page, _, html in rows:
        data = (html or "").encode()
        r = got[page]
        again = page in (1, 2)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 8) if again else ("response", None))
    again = archived(spark.createDataFrame([*rows, rows[0], (2, "u", "other")], PAGE), f"file://{tmp_path}/x", WarcConfig(compress=False))
    assert sorted(r.page_id for r in again.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    payload = {r.page_id: bytes(r.payload) for r in read_archives(spark, f"file://{tmp_path}/w").where("kind = 'response'").collect()}
    assert payload[8] == big.encode()


def test_a_lost_segment_is_an_error(spark, tmp_path):
    write_archives(spark.createDataFrame([(1, "u", "z" * 3000)], PAGE), f"file://{tmp_path}/w", WarcConfig(segment_chars=700, compress=False))
    (file,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    records = list(records_in(file.read_bytes()))
    assert len(records) == 5 and {r["kind"] for r in records} == {"response", "continuation"}
    raw = file.read_bytes()
    cut = raw.index(b"WARC-Segment-Number: 3")
    start = raw.rindex(b"WARC/1.1", 0, cut)
    end = raw.index(b"WARC/1.1", cut)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "part-0").write_bytes(raw[:start] + raw[end:])
    assert [r.error for r in read_archives(spark, f"file://{tmp_path}/v").collect()] == ["missing segment"]
    with pytest.raises(ValueError):
        dechunk(b"5\r\nab")
    with pytest.raises(ValueError):
        list(records_in(raw[:-2]))


def test_no_pages_no_records(spark, tmp_path):
    assert archived(spark.createDataFrame([], PAGE), f"file://{tmp_path}/w").count() == 0


def toxic_corpus():
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        words = [f"w{draw.randrange(300)}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words[draw.randrange(40)] = draw.choice(["idiot", "moron", "vileness", "vilest"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "w1 idiot"), (902, "w1 " * 50_000)], "doc_id long, text string")
    truth = dict(labels)
    held = spark.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity(docs.withColumn("score", F.lit("clash")), held).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.95
    assert {r.score for r in toxicity(docs, held.limit(0)).collect()} == {0.5}
    assert toxicity(docs.limit(0), held, ToxicityConfig(sample_rows=10)).count() == 0


def brute_counts(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), lines, sum(33 <= ord(c) < 127 and not c.isalnum() for c in text or "")


def test_rule_statistics_equal_brute_force(spark):
    texts = ["a b c a b c", "é x y\n\nx\nx\n x", "", None, "####", "a " * 70, "one\ntwo\none\n", "\x1c a\x0bb"]
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in rule_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_l1_is_chosen_without_held_out_labels(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abcdefghij") * 3 for _ in range(12)) + (" vile wretch" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    wrong = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    found = {r.l1: r for r in cross_validated(docs, labels, choices=(1.0, 400.0)).collect()}
    assert found == {r.l1: r for r in cross_validated(docs, wrong, choices=(1.0, 400.0)).collect()}
    assert found[1.0].log_loss < found[400.0].log_loss and found[1.0].found == found[1.0].toxic > 0 and found[1.0].wrong == 0
    assert found[1.0].rows == sum(zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows)
    assert cross_validated(docs, labels.limit(0)).count() == 0


def test_forest_rejects_what_the_base_rules_pass(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality(spark.read.parquet(f"{sf}/documents.parquet"), labels := spark.read.parquet(f"{sf}/labels.parquet"))
    judged = rows.join(labels, "doc_id").where("not base_failed").select("kept", F.col("quality").alias("q")).collect()
    rejected = [r.q for r in judged if not r.kept]
    assert len(rejected) >= 0.5 * sum(r.q == 0 for r in judged) and sum(rejected) <= 0.1 * len(rejected)


def test_quality_rejects_what_labels_call_bad(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = [f"{draw.choice('abcdef')}{draw.randrange(10_000)}" for _ in range(80)]
        bad = i % 20 == 0
        share, most = draw.random(), draw.choice((2, 8, 40))
        rows.append((i, " ".join(w + "#" * (bad and draw.random() < share) * draw.randrange(1, most) for w in words)))
        labels.append((i, int(not bad)))
    rows += [(500, None), (501, "few words")]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality(docs.withColumn("kept", F.lit(1)), held, QualityConfig(trees=50)).collect()}
    good, bad = ([i for i, q in labels if q == k] for k in (1, 0))
    assert sum(not got[i].kept for i in good) <= 8 and sum(not got[i].kept for i in bad) >= 0.6 * len(bad)
    assert got[500].base_failed and not got[501].kept
    assert quality(docs, held.limit(0)).where("kept").count() == 400
    assert quality(docs.limit(0), held).count() == 0


def test_exponent_meets_its_target():
    tokens = {"a": 1000, "b": 100, "c": 10, "d": 0}
    e = solve_exponent(tokens, MixConfig(entropy_share=0.9))
    assert abs(entropy(weights_at({k: v / 1110 for k, v in tokens.items()}, e)) - 0.9 * math.log(3)) < 1e-9
    e = solve_exponent(tokens, MixConfig(max_repeats=2.0))
    w = weights_at({k: v / 1110 for k, v in tokens.items()}, e)
    assert abs(max(w[s] * 1110 / tokens[s] for s in w) - 2.0) < 1e-6
    assert solve_exponent({"a": 5}, MixConfig()) == 1.0 and solve_exponent({}, MixConfig()) == 1.0


def test_schedule_meets_budgets_to_within_a_document(spark):
    draw = random.Random(8)
    rows = [(i, "big" if i % 3 else "small", "w " * draw.randrange(0, 40)) for i in range(600)] + [(700, None, "a b c"), (701, "big", None), (None, "small", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    config = MixConfig(entropy_share=0.99, block_tokens=100)
    got = mix(docs.withColumn("block", F.lit("clash")), config).collect()
    own = {}
    for _, s, t in rows:
        own[s] = own.get(s, 0) + len((t or "").split())
    e = solve_exponent(own, config)
    total = sum(own.values())
    weights = weights_at({s: n / total for s, n in own.items()}, e)
    for s, n in own.items():
        used = sum(r.n_tokens for r in got if r.source == s)
        assert round(weights[s] * total) <= used < round(weights[s] * total) + 40 or used == n * max(r["pass"] for r in got if r.source == s)
    uses = {}
    for r in got:
        uses.setdefault((r.source, r.doc_id), []).append(r["pass"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in uses.values())
    assert mix(docs.limit(0), config).count() == 0


def test_every_stretch_of_the_schedule_holds_the_target_shares(spark):
    """Nineteen to one, also with rows that share a doc_id or have none."""
    rows = [(None if i % 7 == 0 else i % 500, "small" if i % 20 == 0 else "big", "w " * (1 + i % 9)) for i in range(8000)]
    config = MixConfig(entropy_share=0.95, block_tokens=2000)
    got = sorted(mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), config).collect(), key=lambda r: (r.place, r.source))
    assert all(0 <= r.place < 1 for r in got) and {r["pass"] for r in got if r.source == "small"} > {1, 2, 3}
    total = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("small", "big")}
    share = total["small"] / sum(total.values())
    for start in range(0, len(got) - 1000, 250):
        part = got[start : start + 1000]
        small = sum(r.n_tokens for r in part if r.source == "small")
        assert abs(small / sum(r.n_tokens for r in part) - share) < 0.04

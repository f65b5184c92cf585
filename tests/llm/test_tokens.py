"""Token counts, range coder, token blocks, pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("workledger.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from workledger.llm.rangecoder import IdTable, decode_blocks, encode_blocks, split_blocks  # noqa: E402
from workledger.llm.token_blocks import BlockConfig, read_documents, token_segments, write_token_blocks  # noqa: E402
from workledger.llm.token_counts import token_counts  # noqa: E402
from workledger.llm.tokens import PieceIds, WordCounts  # noqa: E402

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", " ", "\n", "a", " a  b   c \n\n d\t\te ", "it's DON'T we'll 12 345", "x  y z", "<|endoftext|> a<|endoftext|>b <|startoftext|>",
    "é é ﬁ ΑΣ Σ", "日本語 テキスト", "a\x1cb\x0bc\x0cd", "🙂 👩‍👩‍👧", "​﻿x", "  ### $$ %%\n  x", "A" * 3000,
]
DOC = "doc_id long, text string"


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1'.,é́  \n\t")) | st.characters(codec="utf-8"), max_size=40), max_size=8))
@settings(max_examples=80, deadline=None)
def test_pieces_give_the_library_results(texts):
    texts = texts + ODD
    data = [t.encode() for t in texts]
    tok = Tokenizer.from_file(WORD)
    assert COUNTS(data) == [len(tok_ids(tok, t)) for t in texts]
    tok = Tokenizer.from_file(BYTE)
    assert [np.frombuffer(x, "<u4").tolist() for x in IDS(data)] == [tok_ids(tok, t) for t in texts]


COUNTS, IDS = WordCounts(WORD), PieceIds(BYTE)


def tok_ids(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def test_different_pieces_of_a_batch_are_looked_up_once_and_may_be_forgotten(monkeypatch):
    """Before, every piece was looked up where it stands."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    ids, tok = PieceIds(BYTE), Tokenizer.from_file(BYTE)
    ids.rows = Counted()
    text = " some words, some é words\n" * 200
    want = np.array(tok_ids(tok, text), "<u4").tobytes()
    assert ids([text.encode()] * 3) == [want] * 3 and 0 < Counted.asked < 10
    monkeypatch.setattr("workledger.llm.tokens.REMEMBERED_IDS", 40)
    draw = np.random.default_rng(5)
    for _ in range(30):
        texts = [*ODD, "".join(draw.choice([" ", "ab", "Cé", "x", "'s", "$", "\n", "12"], 60)), " ".join(f"w{'abcdefgh'[k % 8]}{k}" for k in draw.integers(0, 99, 50))]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids([t.encode() for t in texts])] == [tok_ids(tok, t) for t in texts]
    assert len(ids.rows) < 300


def test_counts_and_their_cache(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(90, ODD[5]), (90, "other"), (91, None), (None, "x y"), (92, "w " * 3000)], DOC)
    cache = f"file://{tmp_path}/cache"
    got = token_counts(docs.withColumn("digest", F.lit(1)), WORD, cache).collect()
    tok = Tokenizer.from_file(WORD)
    want = sorted((d or 0, len((t or "").encode()), n := len(tok_ids(tok, t or "")), n > 2048) for d, t in docs.collect())
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    stored = spark.read.parquet(cache).count()
    assert token_counts(docs, WORD, cache).count() == len(got) and spark.read.parquet(cache).count() == stored
    token_counts(spark.createDataFrame([(1, "a wholly new text"), (2, " a wholly  new text ")], DOC), WORD, cache).collect()
    assert spark.read.parquet(cache).count() == stored + 1
    token_counts(spark.createDataFrame([(1, "twice the same row")] * 2, DOC), WORD, cache).collect()
    assert spark.read.parquet(cache).count() == stored + 2
    assert token_counts(docs.limit(0), WORD, cache).count() == 0


@given(st.lists(st.lists(st.integers(0, 50_256) | st.integers(0, 3), min_size=1, max_size=300), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    table = IdTable.of(np.concatenate(arrays))
    coded = encode_blocks(arrays, table)
    table = IdTable.from_bytes(table.to_bytes())
    assert all(np.array_equal(a, b) for a, b in zip(arrays, decode_blocks(split_blocks(b"".join(coded)), table), strict=True))


def test_long_and_sure_blocks_round_trip():
    """Predictions that hold for long, then fail: the narrowest intervals there are."""
    draw = np.random.default_rng(3)
    for top in (1, 255, 50_256, (1 << 18) - 1):
        blocks = [np.where(draw.random(6000) < p, draw.integers(0, top + 1, 6000), 0).astype(np.uint32) for p in (0, 0.001, 0.01, 0.2, 1)]
        blocks[0][-1] = top
        table = IdTable.of(np.concatenate(blocks))
        assert all(np.array_equal(a, b) for a, b in zip(blocks, decode_blocks(encode_blocks(blocks, table), table), strict=True))


def test_repeats_shrink_and_damage_is_found():
    ids = np.tile(np.arange(40_000, 40_050, dtype=np.uint32), 40)
    table = IdTable.of(ids)
    (block,) = encode_blocks([ids], table)
    assert len(block) < len(ids)
    assert np.array_equal(decode_blocks([block], table)[0], ids)
    with pytest.raises(ValueError):
        decode_blocks([block[:-1] + bytes([block[-1] ^ 1])], table)
    with pytest.raises(ValueError):
        split_blocks(block[:-1])
    with pytest.raises(ValueError):
        IdTable.of(np.array([1 << 18]))
    assert encode_blocks([], table) == []


def test_blocks_of_text_are_smaller_than_deflated_ones(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in IDS(texts)])
    blocks = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
    table = IdTable.of(ids)
    coded = sum(map(len, encode_blocks(blocks, table))) + len(table.to_bytes())
    assert coded < 0.8 * sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks)


def test_files_give_back_every_document(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(500, "long text " * 4000), (501, None), (None, "no id"), (7, "same"), (7, "other"), (7, "same")]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    path = f"file://{tmp_path}/t"
    config = BlockConfig(block_ids=64, segment_ids=256, lanes=16)
    write_token_blocks(docs.withColumn("body", F.lit(0)), path, BYTE, config)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in read_documents(spark, path, config).collect())
    tok, start, want = Tokenizer.from_file(BYTE), 0, []
    for d, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array([*tok_ids(tok, t or ""), 2], "<u4")
        want.append((-1 if d is None else d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want and token_segments(spark, path).count() >= 3
    write_token_blocks(docs.limit(0), f"file://{tmp_path}/e", BYTE)
    assert read_documents(spark, f"file://{tmp_path}/e").count() == 0


def test_pipeline_keeps_rows_without_or_with_the_same_doc_id(spark, tmp_path):
    """One source is used once, so whatever passes the first stages must come out as it is."""
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as p

    draw = np.random.default_rng(4)
    text = lambda: " ".join(f"w{k}" for k in draw.integers(0, 5000, 60))
    ids = [*range(20), None, None, None, 7, 7, 7]
    rows = [(i, text(), "one") for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, text())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = p.mix_sources(spark, docs, str(tmp_path))
    assert sorted((r.text, r.doc_id or -1) for r in mixed.collect()) == sorted((t, i or -1) for i, t, _ in rows) and mixed.columns == docs.columns
    out = [r.doc_id for r in p.run(spark, str(tmp_path)).collect()]
    assert sorted(-1 if i is None else i for i in out) == sorted(-1 if i is None else i for i in ids)
    two = docs.unionByName(docs.withColumn("source", F.lit("two")).where("doc_id = 7").limit(1))
    schedule = p.mix(two, p.MixConfig(entropy_share=0.95), "text").groupBy("text").count().collect()
    again = p.mix_sources(spark, two, str(tmp_path)).groupBy("text").count().collect()
    assert sum(r["count"] for r in again) == sum(r["count"] for r in schedule)


def test_pipeline_stages(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as p

    from tests.llm.test_pairs import brute_components, sets

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("extra"))
    columns = docs.columns
    cleaner = p.drop_toxic(spark, docs, sf).cache()
    truth = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    left = {r.doc_id for r in cleaner.collect()}
    assert cleaner.columns == columns and len(truth - left) <= len(truth) * 0.05
    unique = p.drop_near_duplicates(spark, cleaner, sf).cache()
    rows = cleaner.select("doc_id", "text").collect()
    roots, _ = brute_components([r.doc_id for r in rows], [r.text for r in rows], 5, 80)
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == set(roots.values())
    clean = p.drop_contaminated(spark, unique, sf).cache()
    normal = lambda t: "".join(c if c.isalnum() else " " for c in t.lower())
    items = [s for s in sets([normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 5)]
    bad = {r.doc_id for r in unique.collect() if any(100 * len(s & g) >= 80 * len(s) for g in sets([normal(r.text)], 5) for s in items)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - bad and bad
    mixed = p.mix_sources(spark, clean, sf).cache()
    assert mixed.columns == columns and mixed.count() and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert p.token_output(spark, mixed, sf).count() == mixed.count()
    assert len(p.STAGES) == 5
